"""One timestamp text to one UTC instant.

``Instants`` parses a text by its written form and resolves it to microseconds since 1970 UTC. It runs
inside an Arrow-batched UDF: the forms (month names in several languages, zone abbreviations that mean
something only at one site, spreadsheet days) are beyond Spark's pattern letters.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache
from zoneinfo import ZoneInfo

EPOCH_ORDINAL = dt.date(1970, 1, 1).toordinal()
SPREADSHEET_DAY_0 = dt.date(1899, 12, 30).toordinal() - EPOCH_ORDINAL
DAY = 86_400_000_000

# Month names by language, each from January on.
MONTH_NAMES = """
january february march april may june july august september october november december
januar februar märz april mai juni juli august september oktober november dezember
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
janvier février mars avril mai juin juillet août septembre octobre novembre décembre
janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro
gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre
januari februari maart april mei juni juli augustus september oktober november december
"""
# Abbreviations that are not the first three letters.
MONTH_SHORT = {"sept": 9, "mrz": 3, "mär": 3, "maerz": 3, "ene": 1, "abr": 4, "ago": 8, "dic": 12, "dez": 12, "okt": 10, "fév": 2, "févr": 2, "avr": 4, "aoû": 8, "déc": 12, "janv": 1, "juil": 7, "fevr": 2, "aout": 8, "decembre": 12, "fevrier": 2, "marco": 3, "setiembre": 9, "mag": 5, "giu": 6, "lug": 7, "set": 9, "ott": 10, "mrt": 3, "out": 10, "fev": 2}


def _months() -> dict[str, int]:
    out: dict[str, int] = {}
    for line in MONTH_NAMES.split("\n"):
        for i, word in enumerate(line.split()):
            out.setdefault(word, i + 1)
    for line in MONTH_NAMES.split("\n")[1:3]:
        for i, word in enumerate(line.split()):
            out.setdefault(word[:3], i + 1)
    return out | MONTH_SHORT


MONTHS = _months()

_ZONE = r"(?P<zone>[Zz]|[+\-−]\d{1,2}(?::?\d{2})?|(?:UTC|GMT)[+\-]\d{1,2}(?::?\d{2})?|\(?[^\W\d_]{2,5}\)?)?\s*(?:\[(?P<region>[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?"
_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\b\.?)?"
_TAIL = rf"(?:(?:\s*[Tt]\s*|,?\s+(?:at\s+|um\s+|a\s+las\s+|à\s+)?){_TIME}\s*{_ZONE})?$"
_WEEKDAY = r"(?:[^\W\d_]{2,10}\.?,?\s+)?"
_WORD = r"(?P<mon>[^\W\d_]{3,10})\.?"

_YMD = re.compile(rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}}){_TAIL}")
_DOTTED = re.compile(rf"{_WEEKDAY}(?P<d>\d{{1,2}})\.\s?(?P<m>\d{{1,2}})\.\s?(?P<y>\d{{4}}|\d{{2}}){_TAIL}")
_NUMERIC = re.compile(rf"{_WEEKDAY}(?P<a>\d{{1,2}})(?P<sep>[-/])(?P<b>\d{{1,2}})(?P=sep)(?P<c>\d{{4}}|\d{{2}}){_TAIL}")
_DAY_WORD = re.compile(rf"{_WEEKDAY}(?P<d>\d{{1,2}})(?:\.|st|nd|rd|th|º)?[-\s]\s*(?:de\s+|of\s+)?{_WORD}[-,\s]\s*(?:de\s+|del\s+)?(?P<y>\d{{4}}|\d{{2}}){_TAIL}", re.I)
_WORD_DAY = re.compile(rf"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?{_WORD}\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_TAIL}", re.I)
_COMPACT = re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:[Tt _]?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})?(?:[.,](?P<f>\d{{1,9}}))?\s*{_ZONE})?$")
_SERIAL = re.compile(r"\d{5}(?:\.\d+)?$")
_UNIX = re.compile(r"(?:\d{10}|\d{13})(?:\.\d+)?$")


@lru_cache(maxsize=4096)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


@lru_cache(maxsize=65536)
def _day_offset(zone: str, day: int) -> int | None:
    """Offset in microseconds if it is one and the same all over that local day (with a day's margin)."""
    z = _zone(zone)
    if z is None:
        return None
    try:
        at = [dt.datetime.fromordinal(day + EPOCH_ORDINAL + k).replace(tzinfo=z).utcoffset() for k in (-1, 0, 1, 2)]
    except (ValueError, OverflowError):
        return None
    return int(at[0].total_seconds() * 1e6) if len(set(at)) == 1 else None


@lru_cache(maxsize=8192)
def _abbreviation(zone: str, name: str, year: int) -> int | None:
    """Offset that ``name`` stands for in a zone, near a year."""
    z = _zone(zone)
    if z is None:
        return None
    for y in (year, year - 1, year + 1):
        for month in range(1, 13):
            at = dt.datetime(y, month, 15, 12, tzinfo=z)
            if at.tzname() == name:
                return int(at.utcoffset().total_seconds() * 1e6)
    return None


def local_to_utc(local: int, zone: str) -> int | None:
    """UTC of a local time: the first passage if clocks show it twice, null if they skip it."""
    day = local // DAY
    off = _day_offset(zone, day)
    if off is not None:
        return local - off
    z = _zone(zone)
    if z is None:
        return None
    try:
        at = dt.datetime.fromordinal(day + EPOCH_ORDINAL) + dt.timedelta(microseconds=local - day * DAY)
        aware = at.replace(tzinfo=z, fold=0)
        off = int(aware.utcoffset().total_seconds() * 1e6)
        back = aware.astimezone(dt.timezone.utc).astimezone(z).replace(tzinfo=None)
    except (ValueError, OverflowError):
        return None
    return local - off if back == at else None


def _offset(text: str) -> int | None:
    sign = -1 if text[0] in "-−" else 1
    digits = text[1:].replace(":", "")
    if len(digits) <= 2:
        h, m = int(digits), 0
    else:
        h, m = int(digits[:-2]), int(digits[-2:])
    if h > 15 or m > 59:
        return None
    return sign * (h * 60 + m) * 60_000_000


@lru_cache(maxsize=65536)
def _day(y: int, m: int, d: int) -> int | None:
    try:
        return dt.date(y, m, d).toordinal() - EPOCH_ORDINAL
    except ValueError:
        return None


def parse(text: str | None, order: str | None) -> tuple[str, int, str | None] | None:
    """(kind, micros, zone text): kind 'utc' for instants, 'local' for wall-clock times; null if unreadable.

    ``order`` is MDY, DMY or YMD and decides all-numeric dates that open with neither four digits nor dots.
    """
    if text is None:
        return None
    s = " ".join(text.replace("\u200b", "").replace("\ufeff", "").split()).strip("\"'")
    if len(s) < 5 or len(s) > 80:
        return None
    g = None
    if s[0].isdigit():
        if s.isdigit() or _UNIX.match(s) or _SERIAL.match(s):
            if _SERIAL.match(s):
                if s.isdigit():
                    return "local", (int(s) + SPREADSHEET_DAY_0) * DAY, None
                whole, _, frac = s.partition(".")
                seconds = round(float("0." + frac) * 86400)
                return "local", (int(whole) + SPREADSHEET_DAY_0) * DAY + seconds * 1_000_000, None
            if _UNIX.match(s):
                whole, _, frac = s.partition(".")
                if len(whole) == 13:
                    return "utc", int(whole) * 1000 + int((frac + "000")[:3] or 0), None
                return "utc", int(whole) * 1_000_000 + int((frac + "000000")[:6] or 0), None
        m = _YMD.match(s)
        if m:
            g = m.groupdict()
            y, mo, d = int(g["y"]), int(g["m"]), int(g["d"])
        else:
            m = _COMPACT.match(s)
            if m:
                g = m.groupdict()
                y, mo, d = int(g["y"]), int(g["m"]), int(g["d"])
    if g is None:
        m = _DOTTED.match(s)
        if m:
            g = m.groupdict()
            y, mo, d = g["y"], int(g["m"]), int(g["d"])
            y = int(y) + 2000 if len(y) == 2 else int(y)
    if g is None:
        m = _NUMERIC.match(s)
        if m:
            g = m.groupdict()
            a, b, c = g["a"], g["b"], g["c"]
            if order == "MDY":
                y, mo, d = c, a, b
            elif order == "DMY":
                y, mo, d = c, b, a
            elif order == "YMD" and len(c) == 2:
                y, mo, d = a, b, c
            else:
                return None
            y, mo, d = (int(y) + 2000 if len(y) <= 2 else int(y)), int(mo), int(d)
    if g is None:
        m = _DAY_WORD.match(s) or _WORD_DAY.match(s)
        if not m:
            return None
        g = m.groupdict()
        mo = MONTHS.get(g["mon"].lower())
        if mo is None:
            return None
        y = int(g["y"]) + 2000 if len(g["y"]) == 2 else int(g["y"])
        d = int(g["d"])
    day = _day(y, mo, d)
    if day is None:
        return None
    micros = day * DAY
    h = g.get("h")
    if h is None:
        return "local", micros, None
    h, mi, sec = int(h), int(g["mi"]), int(g["s"] or 0)
    ap = g.get("ap")
    if ap:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if ap in "Pp" else 0)
    f = g["f"]
    frac = int((f + "000000")[:6]) if f else 0
    if mi > 59 or sec > 59 or h > 24 or (h == 24 and (mi or sec or frac)):
        return None
    micros += ((h * 60 + mi) * 60 + sec) * 1_000_000 + frac
    zone = (g.get("zone") or "").strip("()")
    if zone.lower() == "uhr":
        zone = ""
    if zone:
        up = zone.upper()
        if up in ("Z", "UTC", "GMT", "UT"):
            return "utc", micros, None
        if up[:3] in ("UTC", "GMT") and up[3:4] in "+-":
            zone = up[3:]
        if zone[0] in "+-−":
            off = _offset(zone)
            return None if off is None else ("utc", micros - off, None)
        return "local", micros, up
    if g.get("region"):
        utc = local_to_utc(micros, g["region"])
        return None if utc is None else ("utc", utc, None)
    return "local", micros, None


def to_utc(text: str | None, zone: str | None, order: str | None) -> int | None:
    """UTC microseconds of a text written at a site with that zone and date order; null if no real instant."""
    got = parse(text, order)
    if got is None:
        return None
    kind, micros, mark = got
    if kind == "utc":
        return micros
    if not zone:
        return None
    if mark:
        year = dt.date.fromordinal(micros // DAY + EPOCH_ORDINAL).year
        z = _zone(zone)
        if z is None:
            return None
        at = dt.datetime.fromordinal(micros // DAY + EPOCH_ORDINAL) + dt.timedelta(microseconds=micros % DAY)
        for fold in (0, 1):
            aware = at.replace(tzinfo=z, fold=fold)
            if aware.tzname() == mark:
                return micros - int(aware.utcoffset().total_seconds() * 1e6)
        off = _abbreviation(zone, mark, year)
        return None if off is None else micros - off
    return local_to_utc(micros, zone)
