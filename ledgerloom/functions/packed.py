"""Quote-aware finite-state tokenizer for cells that pack several values."""

from __future__ import annotations

import html
import re
import zlib

from ledgerloom.functions.names import INVISIBLE, UNICODE_SPACE

# Characters that part values, quotes and their closers, list marks.
SEPARATORS = ",;|\n\t•·"
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»"}
BRACKETS = {"[": "]", "{": "}"}
NESTING = {"(": ")", "[": "]"}

_BREAK = re.compile(r"_x000[dDaA]_|<\s*/?\s*(?:br|p|li|ul|ol|div)\s*/?\s*>|\r\n?|[\v\f\x85\u2028\u2029]", re.I)
_ENTITY = re.compile(r"&(?:amp|quot|lt|gt|apos|nbsp|#\d+|#x[0-9a-fA-F]+);")
_MARK = re.compile(r"(?:[-*+–—◦▪●‣]\s+|\(?\d{1,3}[.)]\s+)")
_SPACE = " \t\xa0\u200b\ufeff"


def tokenize(cell: str) -> list[tuple[str, int, int, bool]]:
    """(value, start, end, quoted) of each piece between separators outside quotes; offsets into ``tidy(cell)``."""
    return _scan(tidy(cell))


def tidy(cell: str) -> str:
    """The cell with export leftovers and HTML breaks as line breaks, and without brackets around the whole."""
    s = _BREAK.sub("\n", cell)
    if "&" in s:
        s = _ENTITY.sub(lambda m: html.unescape(m.group()), s)
    s = s.strip()
    if len(s) >= 2 and BRACKETS.get(s[0]) == s[-1]:
        s = s[1:-1].strip()
    return s


def _quoted(s: str, i: int) -> tuple[str, int] | None:
    """Value and end of the quoted string that opens at ``i``, if a separator or the end follows it."""
    closer, out, k, n = QUOTES[s[i]], [], i + 1, len(s)
    while k < n:
        ch = s[k]
        if ch == "\\" and k + 1 < n and s[k + 1] in '"\\/\'':
            out.append(s[k + 1])
            k += 2
            continue
        if ch in closer:
            if ch == s[i] and k + 1 < n and s[k + 1] == ch:
                out.append(ch)
                k += 2
                continue
            j = k + 1
            while j < n and s[j] in _SPACE and s[j] not in SEPARATORS:
                j += 1
            return ("".join(out), j) if j == n or s[j] in SEPARATORS else None
        out.append(ch)
        k += 1
    return None


def _scan(s: str) -> list[tuple[str, int, int, bool]]:
    out: list[tuple[str, int, int, bool]] = []
    i, n, line_start = 0, len(s), True
    while i < n:
        while i < n and (s[i] in _SPACE or s[i] in SEPARATORS):
            line_start |= s[i] in "\n•·"
            i += 1
        if i >= n:
            break
        if line_start and (m := _MARK.match(s, i)):
            i = m.end()
            line_start = False
            continue
        line_start = False
        if s[i] in QUOTES and (q := _quoted(s, i)):
            out.append((q[0], i, q[1], True))
            i = q[1]
            continue
        start, depth = i, []
        while i < n:
            ch = s[i]
            if ch in NESTING:
                j = s.find(NESTING[ch], i)
                if j > 0 and "\n" not in s[i:j]:
                    depth.append(NESTING[ch])
            elif depth and ch == depth[-1]:
                depth.pop()
            elif ch in SEPARATORS and (not depth or ch == "\n"):
                break
            i += 1
        text = s[start:i].strip(_SPACE)
        if text[:1] in QUOTES and text.count(text[0]) == 1 and not (set(QUOTES[text[0]]) - {text[0]}) & set(text):
            text = text[1:]
        elif text[-1:] == '"' and text.count('"') == 1:
            text = text[:-1]
        out.append((text.strip(_SPACE), start, i, False))
    return out


_LEAD = re.compile(f"{UNICODE_SPACE}*((?:(?!{UNICODE_SPACE})[^,;|•·])*)")
_INVISIBLE = str.maketrans("", "", INVISIBLE)
#: Buckets of first words, so that the table of them is bounded whatever the number of names.
BUCKETS = 1 << 16


def first_bucket(text: str) -> int:
    """Bucket of the first word of a text's name key; -1 if it is not ASCII."""
    word = _LEAD.match(text.translate(_INVISIBLE)).group(1).casefold()
    return zlib.crc32(word.encode()) % BUCKETS if word.isascii() else -1


def spans(cell: str, most: dict[int | None, int]) -> list[tuple[int, int, str]]:
    """(first, last, text) of runs of two or more unquoted pieces, with the separators between them, that may be a name.

    ``most`` tells how many pieces a name has at most whose first word falls into a bucket, and under None for all others.
    """
    s = tidy(cell)
    pieces = _scan(s)
    out = []
    for a in range(len(pieces) - 1):
        if pieces[a][3] or pieces[a + 1][3]:
            continue
        for b in range(a + 1, min(len(pieces), a + most.get(first_bucket(s[pieces[a][1] : pieces[a][2]]), most.get(None, 0)))):
            if pieces[b][3]:
                break
            out.append((a, b, s[pieces[a][1] : pieces[b][2]].strip(_SPACE)))
    return out


def merged(cell: str, joins: list[tuple[int, int]]) -> list[str]:
    """Values of a cell after joining the given runs of pieces, leftmost and longest first; blanks dropped."""
    s = tidy(cell)
    pieces = _scan(s)
    longest: dict[int, int] = {}
    for a, b in joins:
        longest[a] = max(b, longest.get(a, -1))
    out, k = [], 0
    while k < len(pieces):
        if k in longest:
            out.append(s[pieces[k][1] : pieces[longest[k]][2]].strip(_SPACE))
            k = longest[k] + 1
        else:
            out.append(pieces[k][0])
            k += 1
    return [v for v in out if v.strip(_SPACE + "\n\r\x0b\x0c\u200c\u200d")]
