"""SQL fragments that mirror the text functions, for the comparison queries."""

from __future__ import annotations

from ledgerloom.functions.names import NAME_NOISE, NULL_TOKENS

SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKENS = ", ".join("'" + t + "'" for t in NULL_TOKENS)


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def name_key(c: str) -> str:
    bare = rf"regexp_replace({c}, '[\x{{200b}}\x{{200c}}\x{{200d}}\x{{feff}}]', '', 'g')"
    return f"coalesce(replace(replace(lower({squeeze(bare)}), 'ß', 'ss'), 'ς', 'σ'), '')"


def clean_text(c: str) -> str:
    return f"CASE WHEN lower({squeeze(c)}) NOT IN ({TOKENS}) THEN {squeeze(c)} END"


def denoised(c: str, keep_digits: bool) -> str:
    noise = ", ".join("'" + t + "'" for t in NAME_NOISE)
    digits = "" if keep_digits else " AND NOT regexp_full_match(t, '[0-9]+')"
    words = f"string_split(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'), ' ')"
    return f"array_to_string(list_filter({words}, lambda t: t <> '' AND t NOT IN ({noise}){digits}), ' ')"


def field_list(c: str) -> str:
    parts = rf"regexp_split_to_array(coalesce({c}, ''), '[,;|\n\r]+')"
    names = f"list_transform({parts}, lambda p: trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g')))"
    return f"list_sort(list_distinct(list_filter({names}, lambda n: n <> '')))"


CURRENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_uid ORDER BY run_id DESC, loaded_at DESC) AS rn FROM reports WHERE report_uid IS NOT NULL) WHERE rn = 1)"
