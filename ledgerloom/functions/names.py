"""Name keys and field-name sets as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cleaning vocabulary of the data contract.
NULL_TOKENS = ["", "-", "--", "n/a", "na", "null", "none", "nan", "nat", "(blank)", "."]
TRUTHY = ["yes", "y", "true", "1", "t"]
FALSY = ["no", "n", "false", "0", "f"]
NAME_NOISE = ["copy", "final", "v1", "v2", "v3", "old", "new", "temp", "draft", "backup", "report", "the", "a", "of"]

#: White space as Python's str.split() sees it; Java's \s is ASCII only.
UNICODE_SPACE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Zero-width space, non-joiner, joiner and the byte-order mark.
INVISIBLE = "\u200b\u200c\u200d\ufeff"

#: Characters whose case folding is longer than, or differs from, their lower case (common scripts).
CASEFOLD_EXTRA = {
    "ß": "ss", "ẞ": "ss", "ς": "σ", "ſ": "s", "\u00b5": "\u03bc",
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st",
    "ŉ": "ʼn", "ǰ": "ǰ",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: What makes a text differ from its squeezed form: a cheap test before the replacement.
UNTIDY = "^ | $|  |[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200d\u2028\u2029\u202f\u205f\u3000\ufeff]"


def squeeze(c: Column) -> Column:
    """Trim and collapse Unicode white space to single spaces. Cheapest on a plain column."""
    return F.when(c.rlike(UNTIDY), F.btrim(F.regexp_replace(c, UNICODE_SPACE + "+", " "))).otherwise(c)


def casefold(c: Column) -> Column:
    """Unicode case folding: lower case, then the few characters that fold further."""
    low = out = F.lower(c)
    single = {k: v for k, v in CASEFOLD_EXTRA.items() if len(v) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    for k, v in CASEFOLD_EXTRA.items():
        if k not in single:
            out = F.replace(out, F.lit(k), F.lit(v))
    # plain ASCII folds by lower case alone
    return F.when(low.rlike(r"[^\x00-\x7f]"), out).otherwise(low)


def name_key(c: Column) -> Column:
    """Exact join key of a report name: invisible characters removed, case folded, spaces collapsed.

    Null gives the empty key.
    """
    tidy = F.when(c.rlike(UNTIDY), F.btrim(F.regexp_replace(F.translate(c, INVISIBLE, ""), UNICODE_SPACE + "+", " "))).otherwise(c)
    return F.coalesce(casefold(tidy), F.lit(""))


def clean_text(c: Column, tokens: list[str] | None = None) -> Column:
    """Trimmed, space-collapsed text; null tokens (any case) become null."""
    return let(squeeze(c), lambda s: F.when(~F.lower(s).isin(NULL_TOKENS if tokens is None else tokens), s))


def clean_lines(c: Column, tokens: list[str] | None = None) -> Column:
    """Like ``clean_text``, but line breaks stay: spaces collapse inside each line, blank ends go; null tokens become null."""
    lines = F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n")
    tidy = F.array_join(F.transform(lines, lambda x: F.btrim(F.regexp_replace(x, "[ \t]+", " "))), "\n")
    return let(F.regexp_replace(tidy, "^[\\s]+|[\\s]+$", ""), lambda s: F.when(~F.lower(s).isin(NULL_TOKENS if tokens is None else tokens), s))


def field_name(c: Column) -> Column:
    """Normalised field name: lower case, everything but a-z, 0-9 and space is a space, collapsed."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def field_set(c: Column) -> Column:
    """Distinct normalised field names of a packed text, sorted; null and blank give the empty array."""
    parts = F.split(F.coalesce(c, F.lit("")), r"[,;|\n\r]+")
    names = F.transform(parts, field_name)
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "")))


def denoised_name(c: Column, keep_digits: bool = False, noise: list[str] | None = None) -> Column:
    """Name without punctuation, noise tokens and (unless kept) bare numbers."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]+", " "), " +")
    bad = F.array(*[F.lit(x) for x in (NAME_NOISE if noise is None else noise)])
    keep = F.filter(words, lambda t: (t != "") & ~F.array_contains(bad, t) & (F.lit(keep_digits) | ~t.rlike("^[0-9]+$")))
    return F.array_join(keep, " ")


def to_bool(c: Column) -> Column:
    """Three-valued truth of a text; unknown spellings are null."""
    return let(F.lower(squeeze(c)), lambda s: F.when(s.isin(TRUTHY), F.lit(True)).when(s.isin(FALSY), F.lit(False)))


def to_number(c: Column) -> Column:
    """Number after removing commas, dollar signs and white space; else null."""
    return F.regexp_replace(c, r"[,$]|" + UNICODE_SPACE, "").try_cast("double")
