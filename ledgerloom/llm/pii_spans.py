"""Candidate spans of personal data and their features (p10).

Generators are broad: a person is any two to six neighbouring words written like names, known or not; the
trees decide by form and context. Only scripts without upper case have no person candidates.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

import numpy as np

from ledgerloom.llm.name_statistics import NameStatistics

KINDS = ["email", "phone", "id_number", "address", "person"]

# Words between given and family name.
PARTICLES = frozenset("van von vom de del della der den di da du dos das la le el al bin bint ben ibn abu ter ten zu zum zur af av st san y e".split())
# Words before a name that are no part of it.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir dame herr frau hr fr mme mlle monsieur madame m sr sra srta señor señora don doña sig sigra dott ing dhr mevr".split())
# Closed-class words of the languages covered; no name holds them.
FUNCTION = frozenset(
    """a an the this that these those my our your his her its their and or but nor so if then than as at by for from in into of off on onto out over to up with without about after before
    because since until while when where who whom whose which what how why not no yes we you he she it they i me him us them is are was were be been being am do does did has have had having can could should would
    shall might must also only just both each every all any some most more many much few other another same such there here now very too one two three four five six seven eight nine ten eleven twelve even though although rather still yet quite again never always please thanks thank regards dear hello hi
    laut ohne gegen durch zwischen während trotz hinter neben noch schon nur auch alle jede jeder kein keine dieser diese dieses im am der die das dem den des ein eine einen einem einer und oder aber nicht auf mit für von vom zum zur im ins am bei aus nach über unter vor seit wie wenn weil dass wir sie ihr ist sind war wird werden hat haben bitte
    le les un une des et ou mais dans sur avec sans pour par est sont était ce cette ces il elle nous vous ils elles ne pas que qui dont où au aux
    los las una unos unas y o pero en con sin por para merci gracias danke es son era este esta estos estas que como cuando donde no se su sus lo según pues donc car selon deshalb jedoch außerdem dazu ab sich
    il lo gli uno ed ma nel nella con per che sono het een en maar met voor op naar os as um uma na nos nas""".split()
) - PARTICLES
_CUES = {
    "phone": "phone tel telephone mobile cell fax call calls dial ring reach text sms whatsapp voicemail hotline landline telefon telefonnummer handy mobil mobilfunk rufnummer durchwahl anrufen téléphone tél portable appeler appelez teléfono tel. móvil celular llamar llame numero cellulare telefono telefone telemóvel telefoon bel contact at au",
    "id": "ssn soc sec nino nin sin passport passports aadhaar pan tin ein itin nif nie dni cpf curp bsn nir nss insurance security social national tax taxpayer identity identification identifier licence license visa fiscal steuer-id steuernummer steuer personalausweis ausweis reisepass sozialversicherungsnummer rentenversicherungsnummer passeport pasaporte passaporto passaporte seguridad sécurité sociale codice fiscale document travel",
    "other": "ticket tickets case order po invoice batch build version release node host ip port server row rows line lines page pages column cell unit room floor item sku part serial asset tag lot shipment tracking reference ref job run task release score total sum amount usd eur price count counts code hash commit branch table chapter section edition isbn year account customer vendor cost center centre employee staff badge report dashboard meter parcel vorgang auftrag rechnung bestellung kunde zeile seite konto pedido factura caso expediente línea página dossier commande facture ligne page client fattura ordine pratica zaak klant",
}
CUES = {k: frozenset(v.split()) for k, v in _CUES.items()}
PERSON_BEFORE = frozenset("contactez contacter appelez prévenez demandez écrivez contacte llame avise kontaktieren fragen chiamate by to of from with cc bcc attn attention contact owner author manager supervisor name called fullname full_name signed signature approver requester sender recipient employee patient client nurse colleague an bei durch ansprechpartner gez par avec chez contacter con contactar atentamente cordialement grüßen saludos firmado signé da verantwortlich according per via for and or".split())
PERSON_AFTER = frozenset("said says say asked asks wrote writes told reported confirmed approved called emailed sent will joined leaves left started has had was is lives works moved and or who whose noticed wants requested signed owns checked thinks needs hat sagt sagte schrieb fragt bat wohnt wird arbeitet a dit écrit demande habite travaille validé ha dijo escribió pide vive trabaja aprobó scrive chiede è".split())
# What places and things named like people are called.
THINGS = frozenset("site building plant campus tower hall house office room wing floor depot warehouse store shop station street road avenue lane bridge park garden square harbour harbor valley hill lake river island county school college university hospital clinic church museum library airport centre center branch region district team group desk crew club band league board council committee project programme program scheme plan policy process flow workflow step stage phase queue list form package level grade grant fund bank account award prize week day month season quarter event summit conference workshop act law rule model method test index score scale system platform server database table ledger portal module feature report dashboard summary overview extract edition release review archive brand label cup trophy line route express".split())
CALENDAR = frozenset("january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday spring summer autumn winter easter christmas".split())


#: Capital letters of all scripts that have them.
_UPPER = "".join(c for c in map(chr, range(0x41, 0x2000)) if c.isupper() or c.istitle())
_REST = r"(?:[^\W\d_]|['’](?=[^\W\d_]{2})|-(?=[^\W\d_]))*+"
_CAP = rf"[{_UPPER}]{_REST}(?![\w@])"
_INITIALS = rf"(?:[{_UPPER}]\.(?:-?[{_UPPER}]\.){{0,2}})"
_SMALL = "|".join(sorted(PARTICLES - {"y", "e", "m"}, key=len, reverse=True))
_GAP = "[ \xa0]{1,3}"
_NEXT = rf"(?:{_GAP}(?:{_INITIALS}|{_CAP}|(?:{_SMALL})(?={_GAP})))+"
_RUN = re.compile(rf"[{_UPPER}](?<![\w@./&'’-].)(?:\.(?:-?[{_UPPER}]\.){{0,2}}|{_REST}(?![\w@])){_NEXT}")
_PART = re.compile(rf"{_INITIALS}|[^\W\d_]{_REST}")
_COMMA = re.compile(rf",[ \xa0]?(?=[{_UPPER}])")
_COMMA_LEFT = re.compile(rf"(?<![\w@./&'’-])((?:(?:{_SMALL})[ ]){{0,3}}{_CAP}(?:[ ](?:(?:{_SMALL})[ ])?{_CAP})?)$")
_COMMA_RIGHT = re.compile(rf"(?:{_INITIALS}|{_CAP})(?:[ ](?:{_INITIALS}|{_CAP}))*")
_WORD = re.compile(rf"[^\W\d_]{_REST}")
#: A few words in lower case alone between structural marks: a table cell, a value, a line.
_CELL = re.compile(rf"[|\t>:=\"(;\n][ ]?([^\W\d_]{_REST}(?:[ ][^\W\d_]{_REST}\.?){{1,3}}|[^\W\d_]{_REST},[ ][^\W\d_]{_REST}(?:[ ][^\W\d_]\.?)?)(?=[ ]?(?:[|\t<>\";)\n\r]|\Z))")

_EMAIL = re.compile(r"(?<![\w.+\-'%])[\w.+\-'%]++(?: ?[@＠] ?| ?[\[(<{] ?[aA][tT] ?[\])>}] ?)(?:[\w\-]++(?:\.| ?[\[(]dot[\])] ?))+[^\W\d_]{2,}")
_PHONE = re.compile(r"(?<![\w./\-+])(?:\+[ ]?\d{1,3}|\(\+?\d{1,5}\)|\d)(?:[ .\-/‑–\xa0]?(?:\(\d{1,5}\)|\d)){5,18}(?![\w]|[.\-/]\d)")
_ID_CORE = re.compile(r"(?<!\d)(?<!\d[.\-/])\d(?:[ .\-/\xa0]?\d){5,17}(?:[ \-]?[A-Za-z](?:\d{1,2}[A-Za-z]?)?)?(?![\w]|[\-/.]\d)")
_ID_LEAD = re.compile(r"(?<![\w.\-/])[A-Za-z]{1,6}[ \-]?$")
_ID_MIXED = re.compile(r"(?<![\w.\-/@])(?=[A-Z0-9]{8,18}(?![\w\-/@]))(?=[A-Z0-9]*\d[A-Z0-9]*\d[A-Z0-9]*\d)(?=\d*[A-Z])[A-Z0-9]+")
_TYPE_EN = r"(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|terrace|ter|way|boulevard|blvd|close|place|pl|square|sq|crescent|cres|row|hill|gardens|gdns|park|parade|mews|grove|walk|highway|hwy|parkway|pkwy|circle|cir|trail|quay|alley|rise|green|view|wharf|broadway)"
_ADDR_EN = re.compile(rf"\d(?<![\w,.\-/].)\d{{0,4}}(?:[A-Za-z]|[-–]\d{{1,4}}[A-Za-z]?)?,?[ \xa0](?:(?:[^\W\d_][\w'’\-]*|[^\W\d_]{{1,2}}\.|\d{{1,3}}(?:st|nd|rd|th))[ \xa0]){{1,4}}?{_TYPE_EN}\b\.?", re.I)
_MORE_EN = re.compile(rf"[ \xa0](?:{_TYPE_EN}\b\.?|(?:NE|NW|SE|SW|N|S|E|W|North|South|East|West)\b)", re.I)
_END_DE = r"(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer|steig|pfad|straat|gracht|laan|plein|gatan|vägen|gade|vej)"
_ANCHOR_DE = re.compile(_END_DE + r"\s\d")
_ADDR_DE = re.compile(rf"(?<![\w\-])(?:(?:[^\W\d_][\w\-]*+\s){{0,2}}[^\W\d_][\w\-]*{_END_DE}|(?:[^\W\d_][\w\-]*+\s){{1,2}}{_END_DE})\s\d{{1,4}}(?:\s?[a-z](?![\w]))?(?:\s?-\s?\d{{1,4}})?(?![\w])", re.I)
_HEAD_FR = ("rue", "chemin", "avenue", "boulevard", "allée", "allee", "quai", "impasse", "place", "cours", "route", "passage", "square", "sentier", "voie", "bd", "faubourg")
_ADDR_FR = re.compile(rf"(?<![\w,.\-/])\d{{1,4}}(?:\s?(?:bis|ter|quater|[A-D]\b))?,?\s(?:{'|'.join(_HEAD_FR)})\s(?:(?:de|du|des|la|le|les)\s|[ld]['’]\s?){{0,3}}[^\W\d_][\w'’\-]*(?:\s(?:de|du|des|la|le)(?=\s[{_UPPER}]))?(?:\s[{_UPPER}][\w'’\-]+){{0,3}}", re.I)
_ANCHOR_ES = re.compile(r"(?<!\w)(?:calle|c/|avenida|avda|av\.|plaza|paseo|camino|ronda|travesía|carretera|via|viale|piazza|corso|vicolo|largo|rua|travessa|praça|ul\.|ulica|ulitsa)")
_ADDR_ES = re.compile(r"(?:calle|c/|avenida|avda\.?|av\.|plaza|paseo|camino|ronda|travesía|carretera|via|viale|piazza|corso|vicolo|largo|rua|travessa|praça|ul\.|ulica|ulitsa)\s?(?:(?:de|del|della|dei|la|las|los|el|da|do|dos|das)\s){0,3}[^\W\d_][\w'’\-]*(?:\s[^\W\d_][\w'’\-]*){0,3}?,?\s(?:n\.?\s?[ºo°]\.?\s?|núm\.?\s|nº\s?)?\d{1,4}(?:\s?[a-z]\b)?(?!\w)", re.I)


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    x: list[float]


_PREV = re.compile(r"[\w@/.\-]+")


def _before(text: str, start: int, n: int = 3) -> list[str]:
    return [w.casefold().strip(".:=#") for w in _PREV.findall(text[max(0, start - 48) : start])][-n:]


def _after(text: str, end: int, n: int = 2) -> list[str]:
    return [w.casefold().strip(".:=") for w in _PREV.findall(text[end : end + 32])][:n]


_GROUPS = re.compile(r"\d+")


def _number_features(text: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    groups = [len(g) for g in _GROUPS.findall(s)]
    prev = _before(text, a, 5)
    last = prev[-1] if prev else ""
    before, nxt = text[a - 1 : a], text[b : b + 1]
    # nearest cue of each sort: 5 right before the number, 0 none
    hits = {k: next((5 - i for i, w in enumerate(reversed(prev)) if w in v), 0) for k, v in CUES.items()}
    first = _after(text, b, 1)
    return [
        sum(groups), len(groups), *(groups + [0] * 4)[:4], groups[-1], max(groups), min(groups), s[0] == "+", "(" in s, s.startswith("00"), s[0] == "0",
        s.count("."), s.count("-"), s.count(" ") + s.count("\xa0"), s.count("/"), len({c for c in s if not c.isalnum()}), sum(c.isalpha() for c in s), s[0].isalpha(), s[:2].isalpha(), s[-1].isalpha(),
        hits["phone"], hits["id"], hits["other"], last in CUES["other"], nxt in ",;:", nxt in "\t|\"<", before in "\t|\"\n>", before in "(=:", nxt == "%", s[:2] in ("19", "20") and groups[0] == 4,
        bool(first) and first[0] in ("x", "ext", "ext.", "extension", "durchwahl", "poste", "extensión"), bool(first) and (first[0] in CUES["other"] or first[0] in FUNCTION), a == 0 or before == "\n", last in FUNCTION,
    ]


def _address_features(text: str, a: int, b: int, form: int, longer: bool = False) -> list[float]:
    s = text[a:b]
    w = [x.strip(".,") for x in s.split()]
    inner = w[1:-1] if form == 0 else w[:-1] if form in (1, 3) else w[2:]
    prev, nxt = _before(text, a, 2), _after(text, b, 1)
    last, first = (prev[-1] if prev else ""), (nxt[0] if nxt else "")
    low = [x.casefold() for x in inner]
    return [
        form, len(w), sum(x in FUNCTION for x in low), sum(x[:1].isupper() for x in inner) / max(1, len(inner)), s.isupper(), s.islower(),
        len(re.match(r"\d*", s).group()), "-" in w[0], w[0][-1:].isalpha() and w[0][:1].isdigit(), last in FUNCTION, last in CUES["other"], last in ("at", "address", "lives", "live", "adresse", "anschrift", "dirección", "indirizzo", "to", "in", "from"),
        text[b : b + 1] in ",);\"|.\n\t", text[b : b + 1] == "", text[b : b + 2] == ", ", any(x[:1].islower() for x in inner if x.casefold() not in PARTICLES), first in THINGS, longer,
        any(any(c.isdigit() for c in x) for x in inner), text[a - 1 : a] in "(\"|\t\n:>", a == 0, max([0, *(len(x) for x in inner)]), sum(x in THINGS for x in low), sum(x in CUES["other"] for x in low), w[0].casefold() in FUNCTION, w[0][:1].islower(), w[-1].casefold() in ("way", "close", "row", "hill", "view", "green", "park", "place", "rise", "walk", "circle", "trail"), w[-1][:1].isupper(),
    ]


#: Facts of one word, see ``NameKnowledge.facts``.
N_FACTS = 17


@dataclass
class NameKnowledge:
    """Facts about words for the person features, remembered per word."""

    statistics: NameStatistics
    _row: dict[str, int] = field(default_factory=dict, repr=False, compare=False)
    _facts: list[tuple[float, ...]] = field(default_factory=list, repr=False, compare=False)
    _table: np.ndarray = field(default_factory=lambda: np.zeros((0, N_FACTS), dtype=np.float32), repr=False, compare=False)
    _codes: dict[str, int] = field(default_factory=dict, repr=False, compare=False)

    def facts(self, word: str) -> tuple[float, ...]:
        low, s = word.rstrip(".").lower(), self.statistics
        parts = [p for p in low.split("-") if p] or [low]
        folded = low.casefold()
        shape = 0 if word.islower() else 3 if len(low.replace(".", "").replace("-", "")) == 1 or "." in word else 2 if word.isupper() else 1 if word[1:].islower() or "-" in word else 4
        return (
            shape, len(low), s.lift("given", low), max(s.lift("family", p) for p in parts), min(s.lift("ending", p[-4:]) for p in parts), s.lift("title", low), s.likeness(low), len(parts),
            folded in FUNCTION, low in PARTICLES, folded in TITLES, folded in PERSON_BEFORE, folded in PERSON_AFTER, folded in THINGS, folded in CALENDAR, sum(c in "aeiouyáéíóúäöüàèâêôåø" for c in low) / max(1, len(low)), any(len(p) < 3 for p in parts),
        )

    def row(self, word: str) -> int:
        """Number of the word's facts in ``table``; forgotten words are computed anew."""
        got = self._row.get(word)
        if got is None:
            got = self._row[word] = len(self._facts)
            self._facts.append(self.facts(word))
        return got

    def table(self) -> np.ndarray:
        known = len(self._table)
        if known < len(self._facts):
            self._table = np.concatenate([self._table, np.array(self._facts[known:], dtype=np.float32)])
        return self._table

    def forget(self, most: int = 100_000) -> None:
        """Empty the memory between batches if it has grown large; facts do not change by it."""
        if len(self._row) > most:
            self._row.clear()
            self._facts.clear()
            self._table = self._table[:0]
        if len(self._codes) > 2 * most:
            self._codes.clear()

    def codes(self, tokens: list[str]) -> list[int]:
        """What each white-space token may be part of, as flags, remembered per token."""
        get = self._codes.get
        out = [get(t, -1) for t in tokens]
        if -1 in out:
            for k, c in enumerate(out):
                if c < 0:
                    out[k] = self._codes[tokens[k]] = self._code(tokens[k])
        return out

    def _code(self, token: str) -> int:
        code = 0
        low = token.lower()
        if (m := _WORD.search(token)) and m.group().islower():
            w = m.group()
            f = self._facts[self.row(w)]
            if f[2] > 3 or (len(w) == 1 and w not in FUNCTION and w not in PARTICLES):
                code |= GIVEN
            if f[1] > 3 and f[3] > 3 or f[1] > 5 and f[4] > 3:
                code |= FAMILY
        if any(c.isdigit() for c in token):
            code |= DIGIT
            if _ID_MIXED.search(token):
                code |= MIXED
        if "@" in token or "＠" in token or re.search(r"at ?[\])>}]", low):
            code |= AT
        if re.search(_END_DE + r"\W*$", low):
            code |= STREET_DE
        if any(w in _HEAD_FR for w in re.findall(r"\w+", low)):
            code |= STREET_FR
        if _ANCHOR_ES.search(low):
            code |= STREET_ES
        return code


#: Flags of a token: what generators have to look at a text that holds it.
GIVEN, FAMILY, DIGIT, MIXED, AT, STREET_DE, STREET_FR, STREET_ES = (1 << k for k in range(8))


class People:
    """Person candidates of a batch of texts as columns: spans, rows of word facts, and counts."""

    WORDS = 7  # first, second, last, last but one, word before, word before that, word after

    def __init__(self, knowledge: NameKnowledge):
        self.k = knowledge
        self.spans: list[tuple[int, int, int]] = []
        self.rows: list[tuple[int, ...]] = []
        self.more: list[tuple[float, ...]] = []

    def add(self, i: int, text: str, a: int, b: int, words: list[str], form: int, before: list[str], after: list[str], left: int, right: int) -> None:
        row = self.k.row
        rows = (row(words[0]), row(words[1]), row(words[-1]), row(words[-2]), row(before[-1]), row(before[-2]), row(after[0]))
        self._add(i, text, a, b, rows, form, len(words), sum(len(w) == 1 or "." in w for w in words), sum(w in PARTICLES for w in words), left, right)

    def _add(self, i: int, text: str, a: int, b: int, rows: tuple[int, ...], form: int, n: int, n_initial: int, n_small: int, left: int, right: int) -> None:
        self.spans.append((i, a, b))
        self.rows.append(rows)
        # the marks next to the span: 0 other, 1 start or end of text or line, 2 sentence mark, 3 comma, 4 colon or semicolon, 5 structural mark, 6 hyphen, digit, apostrophe or the like
        x, y = text[a - 3 if a > 3 else 0 : a].rstrip(" \xa0")[-1:], text[b : b + 3].lstrip(" \xa0")[:1]
        self.more.append((form, n, n_initial, n_small, left, right, _MARKS.get(x, 0), _MARKS.get(y, 0), text[b : b + 1] in "'’", b - a))

    def collect(self, i: int, text: str, codes: list[int], tokens: list[str]) -> None:
        """All candidates of one text, given its white-space tokens and their codes."""
        for m in _RUN.finditer(text):
            self._windows(i, text, [(x.start(), x.end(), x.group()) for x in _PART.finditer(text, m.start(), m.end())])
        for m in _COMMA.finditer(text):
            left, right = _COMMA_LEFT.search(text, max(0, m.start() - 120), m.start()), _COMMA_RIGHT.match(text, m.end())
            if left and right:
                self._comma(i, text, left.start(1), m.start(), right.span())
        self._small(i, text, codes, tokens)

    def _windows(self, i: int, text: str, found: list[tuple[int, int, str]]) -> None:
        parts: list[tuple[int, int, str]] = []
        for p in found + [(0, 0, "The")]:
            low = p[2].casefold()
            if low not in FUNCTION and low.rstrip(".") not in TITLES or (len(p[2]) == 2 and p[2][1] == "."):
                parts.append(p)
                continue
            self._run(i, text, parts)
            parts = []

    def _run(self, i: int, text: str, parts: list[tuple[int, int, str]]) -> None:
        n = len(parts)
        if n < 2:
            return
        kind = [2 if w in PARTICLES else 1 if len(w) == 1 or "." in w else 0 for _, _, w in parts]
        row = self.k.row
        rows = [row(w) for _, _, w in parts]
        before = ["", "", *_PREV_WORD.findall(text[max(0, parts[0][0] - 40) : parts[0][0]])][-2:]
        after = [*_PREV_WORD.findall(text[parts[-1][1] : parts[-1][1] + 24]), ""][0]
        around = [row(before[0]), row(before[1]), *rows, row(after)]  # shifted by two
        for s in range(n - 1):
            if kind[s] == 2 and s:
                continue
            full = initials = small = 0
            for e in range(s, min(n, s + 6)):
                x = kind[e]
                if x == 1:
                    initials += 1
                    continue
                if x == 2:
                    small += 1
                    continue
                full += 1
                if full > 4:
                    break
                if e > s:
                    self._add(i, text, parts[s][0], parts[e][1], (rows[s], rows[s + 1], rows[e], rows[e - 1], around[s + 1], around[s], around[e + 3]), 0, e - s + 1, initials, small, s, n - 1 - e)

    def _comma(self, i: int, text: str, start: int, comma: int, given: tuple[int, int]) -> None:
        lead = [(x.start(), x.end(), x.group()) for x in _PART.finditer(text, start, comma)]
        tail = [(x.start(), x.end(), x.group()) for x in _PART.finditer(text, *given)]
        if any(w.casefold() in FUNCTION or w.casefold() in TITLES for _, _, w in lead) or tail[0][2].casefold() in FUNCTION:
            return
        before = ["", "", *_PREV_WORD.findall(text[max(0, start - 40) : start])][-2:]
        # the given name, then up to two initials or further names
        for t in range(min(3, len(tail))):
            if tail[t][2].casefold() in FUNCTION:
                break
            after = [w for _, _, w in tail[t + 1 :]] + _PREV_WORD.findall(text[tail[-1][1] : tail[-1][1] + 24]) + [""]
            end = tail[t][1]
            words = [w for _, _, w in lead + tail[: t + 1]]
            self.add(i, text, start, end, words, 1, before, after[:1], 0, len(tail) - 1 - t)
            if len(lead) > 1:
                k = next((k for k, (_, _, w) in enumerate(lead) if w not in PARTICLES), 0)
                if k:
                    self.add(i, text, lead[k][0], end, words[k:], 1, (before + words[:k])[-2:], after[:1], k, len(tail) - 1 - t)

    def _small(self, i: int, text: str, codes: list[int], tokens: list[str]) -> None:
        """Names written small: in cells of their own, or with a given and a family name of the directory."""
        for m in _CELL.finditer("\n" + text):
            s = m.group(1)
            if not s.islower():
                continue
            words = [x.group() for x in _PART.finditer(s)]
            if len(words) < 2 or any(w in FUNCTION or w in THINGS for w in words):
                continue
            a, b = m.start(1) - 1, m.end(1) - 1
            before = ["", "", *_PREV_WORD.findall(text[max(0, a - 40) : a])][-2:]
            self.add(i, text, a, b, words, 3 if "," in s else 2, before, [*_PREV_WORD.findall(text[b : b + 24]), ""][:1], 0, 0)
        for k in [k for k, c in enumerate(codes) if c & FAMILY]:
            if any(c & GIVEN for c in codes[max(0, k - 3) : k]) or codes[k + 1 : k + 2] and codes[k + 1] & GIVEN and tokens[k][-1] == ",":
                break
        else:
            return
        parts = [(x.start(), x.end(), x.group()) for x in _PART.finditer(text)]
        codes = self.k.codes([w for _, _, w in parts])
        for s in range(len(parts) - 1):
            if not codes[s]:
                continue
            for e in range(s + 1, min(len(parts), s + 4)):
                gap = text[parts[e - 1][1] : parts[e][0]]
                comma = gap in (", ", ",")
                if not (comma or gap.strip(" \xa0") == "" and gap):
                    break
                g, f = (e, s) if comma else (s, e)
                if codes[g] & GIVEN and codes[f] & FAMILY:
                    a, b = parts[s][0], parts[e][1]
                    before = ["", "", *[w for _, _, w in parts[max(0, s - 2) : s]]][-2:]
                    after = [w for _, _, w in parts[e + 1 : e + 2]] + [""]
                    self.add(i, text, a, b, [w for _, _, w in parts[s : e + 1]], 3 if comma else 2, before, after[:1], 0, 0)
                if comma:
                    break

    def features(self) -> np.ndarray:
        rows = np.array(self.rows, dtype=np.int64).reshape(-1, self.WORDS)
        words = self.k.table()[rows].reshape(len(rows), self.WORDS * N_FACTS)
        return np.concatenate([words, np.array(self.more, dtype=np.float32).reshape(len(rows), -1)], axis=1)


_PREV_WORD = re.compile(r"[^\W\d_][\w'’]*")
_MARKS = {"": 1, "\n": 1, "\r": 1, ".": 2, "!": 2, "?": 2, ",": 3, ":": 4, ";": 4} | dict.fromkeys("|\t\"<>()[]{}=“”„«»", 5) | dict.fromkeys("-–—/_@&%'’0123456789", 6)


def _emails(text: str) -> list[Candidate]:
    out = []
    for m in _EMAIL.finditer(text):
        at = m.start() + len(m.group()) - len(m.group().lstrip("'.-%+"))
        whole = text[at : m.end()]
        name = re.match(r"[\w.+\-'%]*", whole).group()
        if name:
            out.append(Candidate("email", at, m.end(), [min(200, len(whole)), "@" in whole, whole.count("."), min(200, len(name)), any(c.isdigit() for c in name), "+" in name, text[at - 1 : at] in "/#", text[m.end() : m.end() + 1] in ":/", " " in whole, whole.rsplit(".", 1)[-1].islower() or whole.isupper()]))
    return out


_CLUSTER = re.compile(r"\d(?:[ .\-/‑–\xa0()]{0,3}\d){5,}")


def _numbers(text: str) -> list[Candidate]:
    out = []
    done = 0
    for k in _CLUSTER.finditer(text):
        # the region holds the whole number and what its look-around needs
        lo, hi = max(done, k.start() - 6), min(len(text), k.end() + 12)
        spans: set[tuple[str, int, int]] = {("phone", *m.span()) for m in _PHONE.finditer(text, lo, hi) if m.start() < k.end()}
        for m in _ID_CORE.finditer(text, lo, hi):
            if m.start() >= k.end():
                break
            a, b = m.span()
            lead = _ID_LEAD.search(text[max(0, a - 8) : a])
            starts = {a} if not text[a - 1 : a].isalpha() and (a == 0 or text[a - 1] not in "./-") else set()
            if lead:
                starts |= {a, a - len(lead.group())}
            ends = {b}
            if text[b - 1].isalpha():
                ends.add(a + re.search(r"[ \-]?[A-Za-z][\dA-Za-z]*$", m.group()).start())
            spans |= {("id_number", x, y) for x in starts for y in ends}
        features: dict[tuple[int, int], list[float]] = {}
        for kind, a, b in sorted(spans):
            if (a, b) not in features:
                features[a, b] = _number_features(text, a, b)
            out.append(Candidate(kind, a, b, features[a, b]))
        done = k.end()
    return out


def _addresses(text: str, flags: int) -> list[Candidate]:
    out = []
    if flags & DIGIT:
        for m in _ADDR_EN.finditer(text):
            a, b = m.span()
            spans = [b]
            while (k := _MORE_EN.match(text, b)) and len(spans) < 4:
                b = k.end()
                spans.append(b)
            for n, e in enumerate(spans):
                if text[e - 1] == "." and (e == len(text) or not re.match(r"\s?,", text[e : e + 2])):
                    e -= 1
                out.append(Candidate("address", a, e, _address_features(text, a, e, 0, n + 1 < len(spans))))
    low = text.lower() if flags & (STREET_DE | STREET_ES) else ""
    if low and len(low) != len(text):  # a few letters change length: positions must stay those of the text
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    seen: set[tuple[int, int]] = set()
    if flags & STREET_DE:
        for k in _ANCHOR_DE.finditer(low):
            for m in _ADDR_DE.finditer(text, max(0, k.start() - 80), min(len(text), k.end() + 12)):
                if not m.start() < k.end() <= m.end():
                    continue
                a, b = m.span()
                parts = m.group().split(" ")
                starts = {a + sum(len(x) + 1 for x in parts[:i]) for i in range(len(parts) - 1) if not re.fullmatch(_END_DE, parts[i], re.I)}
                for x in sorted(starts | {a}):
                    if (x, b) not in seen:
                        seen.add((x, b))
                        out.append(Candidate("address", x, b, _address_features(text, x, b, 1, x > a)))
    if flags & STREET_FR:
        for m in _ADDR_FR.finditer(text):
            a, b = m.span()
            out.append(Candidate("address", a, b, _address_features(text, a, b, 2)))
            # shorter ends: what follows the name may be the town or the next sentence
            words = text[a:b].split(" ")
            for n in range(len(words) - 1, 2, -1):
                e = a + len(" ".join(words[:n]))
                if words[n][:1].isupper() and not words[n - 1].islower():
                    out.append(Candidate("address", a, e, _address_features(text, a, e, 2, True)))
    if flags & STREET_ES:
        for k in _ANCHOR_ES.finditer(low):
            m = _ADDR_ES.match(text, k.start())
            if m:
                out.append(Candidate("address", *m.span(), _address_features(text, *m.span(), 3)))
    return out


def candidates(text: str, codes: list[int]) -> list[Candidate]:
    """All spans but people that may be personal data, given the codes of the text's tokens; spans may overlap."""
    flags = 0
    for c in set(codes):
        flags |= c
    out: list[Candidate] = []
    if flags & AT:
        out += _emails(text)
    if flags & DIGIT:
        out += _numbers(text)
    if flags & MIXED:
        out += [Candidate("id_number", *m.span(), _number_features(text, *m.span())) for m in _ID_MIXED.finditer(text)]
    return out + _addresses(text, flags)
