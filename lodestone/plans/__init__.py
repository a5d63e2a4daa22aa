"""Registered queries by family; importing a family registers it."""

from . import documents, graphs, indexes, survey, tables, workflows  # noqa: F401
