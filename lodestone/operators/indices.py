"""Composite indices and the statistics behind them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import correlations


def base_medians(df: DataFrame, period: str, base: object, indicators: Sequence[str]) -> DataFrame:
    return df.where(F.col(period) == base).agg(*[F.median(c).alias(c) for c in indicators])


def ampi(df: DataFrame, unit: str, period: str, indicators: dict[str, str], base: object, penalty: str = "POS") -> DataFrame:
    """unit, period, each indicator scaled (n_*), mean, sd (n - 1), penalty, score.

    Goalposts are the base period's medians plus and minus half the range over all units and periods; the median maps to 100, the goalposts
    to 70 and 130, reversed for polarity NEG. The score is mean minus sd * sd / mean (penalty POS) or plus it (NEG). An indicator
    without range gives null.
    """
    names = list(indicators)
    goal = base_medians(df, period, base, names).select(*[F.col(c).alias(f"g_{c}") for c in names])
    ends = df.agg(*[((F.max(c) - F.min(c)) / 2).alias(f"d_{c}") for c in names])
    wide = df.crossJoin(F.broadcast(goal)).crossJoin(F.broadcast(ends))  # one row each
    def scaled(c: str):
        low, width = F.col(f"g_{c}") - F.col(f"d_{c}"), 2 * F.col(f"d_{c}")
        up = F.col(c) - low if indicators[c] == "POS" else low + width - F.col(c)
        return F.when(width > 0, 60 * up / width + 70)
    out = wide.select(unit, period, *[scaled(c).alias(f"n_{c}") for c in names])
    cols = [F.col(f"n_{c}") for c in names]
    k = len(cols)
    total = sum(cols[1:], cols[0])
    mean = total / k
    spread = sum([F.pow(c - mean, 2) for c in cols[1:]], F.pow(cols[0] - mean, 2))
    out = out.withColumn("mean", mean).withColumn("sd", F.sqrt(spread / max(1, k - 1)))
    out = out.withColumn("penalty", F.col("sd") * F.col("sd") / F.col("mean"))
    return out.withColumn("score", F.col("mean") - F.col("penalty") if penalty == "POS" else F.col("mean") + F.col("penalty"))


def weighted(df: DataFrame, weights: dict[str, float], name: str = "index") -> DataFrame:
    """The sum of columns times weights, which need not add up to 1."""
    terms = [F.col(c) * w for c, w in weights.items()]
    return df.withColumn(name, sum(terms[1:], terms[0]))


def prune_collinear(df: DataFrame, columns: Sequence[str], limit: float = 0.99, keep_first: bool = False) -> list[str]:
    """Columns left when pairs with |r| above the limit go: both members, or only the later one."""
    gone: set[str] = set()
    for r in correlations(df, columns).where((F.abs("r") > limit) & (F.col("a") != F.col("b"))).collect():  # as many rows as pairs of columns
        a, b = sorted((r.a, r.b), key=list(columns).index)
        gone |= {b} if keep_first else {a, b}
    return [c for c in columns if c not in gone]


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    r = {(x.a, x.b): x.r for x in correlations(df, columns).collect()}
    return np.array([[r[a, b] if r[a, b] is not None else 0.0 for b in columns] for a in columns])


def eigenvalues(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """axis, eigenvalue, share, kaiser (eigenvalue above 1) of the correlation matrix."""
    values = np.linalg.eigvalsh(correlation_matrix(df, columns))[::-1]
    return df.sparkSession.createDataFrame([(i + 1, float(v), float(v / values.sum()), bool(v > 1)) for i, v in enumerate(values)], "axis int, eigenvalue double, share double, kaiser boolean")


def principal_axes(df: DataFrame, columns: Sequence[str], k: int = 2) -> tuple[DataFrame, np.ndarray]:
    """df with axis_1..axis_k (scores of standardised columns) and the loadings."""
    values, vectors = np.linalg.eigh(correlation_matrix(df, columns))
    loadings = vectors[:, ::-1][:, :k]
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(0), range(k)])
    return scores(df, columns, loadings, "axis"), loadings


def scores(df: DataFrame, columns: Sequence[str], loadings: np.ndarray, name: str = "axis") -> DataFrame:
    stats = df.agg(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("m", F.avg), ("s", F.stddev_samp))])
    wide = df.crossJoin(F.broadcast(stats))  # one row on the right
    z = [(F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in columns]
    for j in range(loadings.shape[1]):
        terms = [x * float(w) for x, w in zip(z, loadings[:, j], strict=True)]
        wide = wide.withColumn(f"{name}_{j + 1}", sum(terms[1:], terms[0]))
    return wide.drop(*stats.columns)


def factor_analysis(r: np.ndarray, k: int, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood loadings and uniquenesses of a correlation matrix, by expectation-maximisation."""
    values, vectors = np.linalg.eigh(r)
    load = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 1e-6))
    unique = np.maximum(np.diag(r) - (load**2).sum(1), 0.05)
    for _ in range(rounds):
        beta = load.T @ np.linalg.inv(load @ load.T + np.diag(unique))
        ezz = np.eye(k) - beta @ load + beta @ r @ beta.T
        load = r @ beta.T @ np.linalg.inv(ezz)
        unique = np.maximum(np.diag(r - load @ beta @ r), 1e-3)
    return load, unique


def factor_index(df: DataFrame, factors: Sequence[str], loadings: np.ndarray, name: str = "index") -> DataFrame:
    """Factor scores weighted by the mean loading of their factor, scaled to 0..1."""
    means = loadings.mean(0)
    terms = [F.col(c) * float(w) for c, w in zip(factors, means, strict=True)]
    raw = df.withColumn("_raw", sum(terms[1:], terms[0]))
    ends = raw.agg(F.min("_raw").alias("_low"), F.max("_raw").alias("_high"))
    return raw.crossJoin(F.broadcast(ends)).withColumn(name, (F.col("_raw") - F.col("_low")) / (F.col("_high") - F.col("_low"))).drop("_raw", "_low", "_high")  # one row on the right
