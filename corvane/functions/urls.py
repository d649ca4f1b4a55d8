"""Column functions on URLs, by patterns that never fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as X

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, SCHEME, 1))


def authority(u: Column) -> Column:
    return F.regexp_extract(u, AUTHORITY, 1)


def path(u: Column) -> Column:
    return F.regexp_extract(u, PATH, 1)


def normalize(u: Column) -> Column:
    """Scheme (https where missing), authority as it is, path with one slash at its end; no query, no fragment."""
    return F.concat(F.coalesce(F.nullif(scheme(u), F.lit("")), F.lit("https")), F.lit("://"), authority(u), F.regexp_replace(path(u), "/+$", ""), F.lit("/"))


def is_skipped(u: Column) -> Column:
    low = F.lower(path(u))
    out = F.lit(False)
    for p in X.SKIPPED_PATHS:
        out = out | F.contains(low, F.lit(p))
    return out


def is_dynamic(u: Column, patterns: list[str] = X.DYNAMIC_PATHS) -> Column:
    return path(u).rlike("|".join(patterns))


def language(u: Column) -> Column:
    low = F.lower(path(u))
    out = None
    for code in X.URL_LANGUAGES:
        hit = F.startswith(low, F.lit(f"/{code}/"))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(X.URL_LANGUAGE_DEFAULT)


def category(u: Column, hints: dict[str, str] = X.CATEGORY_HINTS, default: str = X.CATEGORY_DEFAULT) -> Column:
    """The category of the first hint that the path holds."""
    low = F.lower(path(u))
    out = None
    for hint, label in hints.items():
        hit = F.contains(low, F.lit(hint))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)


def bare_host(u: Column) -> Column:
    """Authority in lower case without a www. before it; a port stays."""
    return F.regexp_replace(F.lower(authority(u)), r"^www\.", "")


def is_allowed(u: Column, domains: list[str]) -> Column:
    return bare_host(u).isin([d.lower() for d in domains])


def is_pdf(u: Column) -> Column:
    return F.endswith(F.lower(path(u)), F.lit(".pdf"))


def without_fragment(u: Column) -> Column:
    return F.split_part(u, F.lit("#"), F.lit(1))


def _tidy(p: Column) -> Column:
    """A path without its . and .. segments."""
    parts = F.split(p, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda s, x: F.when(x == ".", s).when(x == "..", F.when(F.size(s) > 1, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)).otherwise(F.concat(s, F.array(x))),
    )
    closed = F.when(p.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), closed)


def resolve(base: Column, link: Column) -> Column:
    """An href as an absolute URL, seen from base."""
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    link_path, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    return (
        F.when(link.rlike(SCHEME), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme(base), F.lit(":"), link))
        .when(link == "", base)
        .when(F.startswith(link, F.lit("#")), F.concat(without_fragment(base), link))
        .when(F.startswith(link, F.lit("?")), F.concat(origin, path(base), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, _tidy(link_path), rest))
        .otherwise(F.concat(origin, _tidy(F.concat(folder, link_path)), rest))
    )
