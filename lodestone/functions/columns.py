"""Column functions for text, addresses, dates and numbers, all inside code generation but for nfkc."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(c: Column) -> Column:
    """NFKC by the ICU library that comes with Spark, row by row in the JVM, so no worker holds batches of texts. Its Unicode is 16.0: of all characters
    it differs from Python 3.13's unicodedata (15.1) in 36 that are new in 16.0 (U+1CCD6 to U+1CCF9)."""
    return F.when(c.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True)))


def normalize_query(c: Column, compose: bool = False) -> Column:
    """Trimmed, lower case, single blanks, straight apostrophes; compose=True applies NFKC first."""
    c = nfkc(c) if compose else c
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "[‘’]", "'"), r"(?U)\s+", " ")))


def safe_name(c: Column, most: int = 50) -> Column:
    return F.regexp_replace(F.substring(c, 1, most), r"(?U)[^\w\-.]", "_")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), r"\s+", " "))


def truncate(c: Column, most: int) -> Column:
    return F.substring(c, 1, most)


def shorten(c: Column, beyond: int = 100, to: int = 99) -> Column:
    return F.when(F.length(c) > beyond, F.substring(c, 1, to)).otherwise(c)


def price(c: Column) -> Column:
    return F.regexp_replace(c, "[$£€Â]", "").try_cast("double")


def token_int(c: Column, at: int = 3) -> Column:
    return F.regexp_replace(F.get(F.split(F.trim(c), r"\s+"), F.lit(at - 1)), r"[^0-9-]", "").try_cast("int")


def parts(c: Column, sep: str) -> Column:
    """Pieces between separators, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, "^(#*)", 1))


def quote_plus(c: Column) -> Column:
    return F.url_encode(c)


def with_page(url: Column, page: Column) -> Column:
    has = url.rlike(r"[?&]page=\d+")
    return F.when(has, F.regexp_replace(url, r"([?&]page=)\d+", F.concat(F.lit("$1"), page.cast("string")))).otherwise(F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("page="), page.cast("string")))


def url_join(base: Column, link: Column) -> Column:
    root = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    return F.when(link.rlike("^[a-z]+://"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), link)).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(F.regexp_extract(F.when(base == root, F.concat(base, F.lit("/"))).otherwise(base), r"^([a-z]+://(?:[^?#]*/))", 1), link))


def search_url(root: str, query: Column, page: Column, lang: Column | None = None, languages: tuple[str, ...] = ("it", "en")) -> Column:
    """A search address; a page below 1 or an unknown language is an error."""
    checked = F.when(page >= 1, page).otherwise(F.raise_error(F.lit("page must be 1 or more")).cast("int"))
    args = [F.concat(F.lit("q="), quote_plus(normalize_query(query))), F.concat(F.lit("page="), checked.cast("string"))]
    if lang is not None:
        args.append(F.concat(F.lit("lang="), F.when(lang.isin(*languages), lang).otherwise(F.raise_error(F.lit("unknown language")).cast("string"))))
    return F.concat(F.lit(root + "?"), F.concat_ws("&", *args))


def offset_url(root: str, query: Column, page: Column, size: int) -> Column:
    return F.concat(F.lit(root + "?query="), quote_plus(query), F.lit(f"&size={size}&start="), (page * size).cast("string"))


def looks_like_date(c: Column) -> Column:
    return c.rlike(r"^\d{2}/\d{2}/\d{4}$")


def date_text(c: Column) -> Column:
    return F.get(F.split(F.replace(c, F.lit("Submitted "), F.lit("")), ", "), F.lit(0))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def interval(p: Column, variance: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Lower end, upper end and width of the confidence interval."""
    half = z * F.sqrt(variance)
    return p - half, p + half, 2 * half


def min_max(c: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (c - low) / (high - low))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def noisy(c: Column, sigma: float, seed: int) -> Column:
    return clip(c + sigma * F.randn(seed))


def labelled(text: Column, label: str, *following: str) -> Column:
    """The text behind "label:" up to a line that begins with one of the following labels, or to the end; null if there is none."""
    stop = "|".join(rf"\n\s*{x}\s*:" for x in following)
    found = F.regexp_extract(text, rf"(?s){label}\s*:\s*(.*?)(?={stop + '|' if stop else ''}\s*$)", 1)
    return F.nullif(F.trim(found), F.lit(""))


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_classes(values: Column, k: int = 3) -> Column:
    """The k most probable classes, ties by class."""
    ranked = F.sort_array(F.transform(values, lambda p, i: F.struct((-p).alias("p"), i.alias("c"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: x["c"])


def colour_index(c: Column) -> Column:
    return (F.round(c * 255) + 1).cast("int")


def traffic_factor(ts: Column, rush: Column | float = 2.0) -> Column:
    """7-9 and 17-19 o'clock: rush; from 22 to 6: 0.8; else 1."""
    h = F.hour(ts)
    return F.when(h.between(7, 9) | h.between(17, 19), F.lit(rush) if isinstance(rush, float) else rush).when((h >= 22) | (h <= 6), 0.8).otherwise(1.0)


def tag_texts(html: Column, tag: str) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), lambda x: collapse(F.regexp_replace(x, "<[^>]*>", " ")))


def first_tag(html: Column, *tags: str, default: str = "N/A") -> Column:
    """The first non-empty text of the given tags, tried in order."""
    return F.coalesce(*[F.nullif(F.get(tag_texts(html, t), F.lit(0)), F.lit("")) for t in tags], F.lit(default))
