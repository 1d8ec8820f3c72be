"""Words of a text as leak detection counts them."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1)
def _format_characters() -> re.Pattern[str]:
    found = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Cf"]
    return re.compile("[" + "".join(map(re.escape, found)) + "]")


def words(text: str | None) -> list[str]:
    """Runs of letters or digits after NFKC, removal of format characters and case folding; null has none."""
    if not text:
        return []
    if not text.isascii():
        text = _format_characters().sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.casefold())
