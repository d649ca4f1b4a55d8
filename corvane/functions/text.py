"""Column functions on text. What Python calls casefold, strip and white space is meant throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as X

#: What Python's casefold makes of each code point that it changes: of one character, or of several.
_FOLDS = {c: c.casefold() for c in map(chr, range(0x110000)) if c.casefold() != c}
_ONE = {c: f for c, f in _FOLDS.items() if len(f) == 1}
_MORE = {c: f for c, f in _FOLDS.items() if len(f) > 1}


def _ranges(chars: str) -> str:
    """A pattern of any of these characters, as ranges: a class that lists many single ones is tried one by one."""
    runs: list[list[int]] = []
    for x in sorted(map(ord, chars)):
        if runs and runs[-1][1] == x - 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]"


#: Those of several but the German one, which is common and replaced by itself.
_RARE = _ranges("".join(c for c in _MORE if c != "ß"))


def casefold(c: Column) -> Column:
    """Full case folding, as Unicode has it; texts of ASCII take the short way."""
    several = F.create_map(*[F.lit(x) for pair in _MORE.items() for x in pair])
    c = F.replace(c, F.lit("ß"), F.lit("ss"))
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(several, x), x)), "")
    whole = F.when(c.rlike(_RARE), spelled).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(whole, "".join(_ONE), "".join(_ONE.values()))).otherwise(F.lower(c))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def squeeze(c: Column) -> Column:
    """White space of any length as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def join_parts(separator: str, *parts: Column) -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.concat_ws(separator, *[blank_to_null(p) for p in parts])


def words(c: Column) -> Column:
    """All runs of letters and digits of the casefolded text, in order."""
    return F.regexp_extract_all(casefold(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def tokens(c: Column) -> Column:
    """Words of more than one character that are no stopwords, in order, repeats kept."""
    return F.filter(words(c), lambda t: (F.char_length(t) > 1) & ~t.isin(X.STOPWORDS))


def expand(terms: Column) -> Column:
    """Distinct terms with all synonyms of their groups, sorted."""
    groups = [F.when(F.arrays_overlap(terms, F.array(*map(F.lit, g))), F.array(*map(F.lit, g))).otherwise(F.array().cast("array<string>")) for g in X.SYNONYM_GROUPS]
    return F.array_sort(F.array_distinct(F.concat(terms, *groups)))


def _lookup(c: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), c)


def language_code(c: Column) -> Column:
    """The code of a language's name or code; itself, casefolded, where it is unknown."""
    name = strip(casefold(c))
    return F.coalesce(_lookup(name, X.LANGUAGE_ALIASES), name)


def not_found(c: Column) -> Column:
    """The message for questions in that language that have no answer."""
    return F.coalesce(_lookup(_lookup(strip(casefold(c)), X.LANGUAGE_ALIASES), X.NOT_FOUND), F.lit(X.NOT_FOUND["en"]))


def confidence(score: Column) -> Column:
    """0 for scores up to 0, else s / (s + 2) to four places."""
    s = score.cast("double")
    return F.when(F.coalesce(s, F.lit(0.0)) <= 0, F.lit(0.0)).otherwise(F.round(F.least(s / (s + 2.0), F.lit(1.0)), 4))


def excerpt(c: Column) -> Column:
    """The stripped text; if over 1200 characters, its first 1197 up to the last space, and three dots."""
    cut = lambda t: F.concat(F.regexp_replace(F.substring(t, 1, X.EXCERPT_CUT), r" [^ ]*\z", ""), F.lit("..."))
    return let(strip(c), lambda t: F.when(F.char_length(t) > X.EXCERPT_MOST, cut(t)).otherwise(t))


def or_default(c: Column, default) -> Column:
    """c unless it is null or 0."""
    return F.coalesce(F.nullif(c, F.lit(0)), F.lit(default))


def positive_int(c: Column, default: int) -> Column:
    """A setting read as an integer over 0, or the default."""
    n = c.try_cast("int")
    return F.when(F.coalesce(n, F.lit(0)) > 0, n).otherwise(F.lit(default))


def float_value(c: Column, default: float) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))
