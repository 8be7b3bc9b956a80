"""Personal data in texts, also where it is disguised, with spans in source characters.

Base: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers as written. Disguises
are undone by two transducers, each of which keeps for every character it writes the span of source
characters that it read:

1. characters: digits of any script, full-width and styled letters, and look-alikes of Latin letters
   become ASCII; invisible characters are deleted;
2. phrases: `[at]`, `(dot)`, ` at ` ... ` dot `, digits and dots spelled between others, `plus`
   before digits, and O, o, l and I that stand for digits among digits.

Look-alikes are the fixed letters below and what Unicode's names and one-character forms tell; spelled
numbers are digits of four languages and English ones to 99. Others are not undone.

The detectors then run on the normalised text and their spans are mapped back. Only spans in which
something was rewritten, and that overlap no base span of their kind or hold it whole, are added; a
single spelled digit beside a base span ("+1 555 123 4567, one more") is prose and adds none.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .runtime import ship

KINDS = ("email", "ip", "card", "phone")

# Letters that look like Latin ones (Greek, Cyrillic, Armenian, Cherokee, phonetic Latin).
LOOKALIKES = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγηικνορτυχϲϳ" + "АВЕЅІЈКМНОРСТУХЅԌԚԜаесіјкорѕухһӏԁԛԝүѵ" + "ӀԼՕՍհոսօցզյ" + "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᏔᏃ" + "ıȷɑɡɩɪʋʏſꞮ",
        "ABEZHIKMNOPTYXaynikvoptuxcj" + "ABESIJKMHOPCTYXSGQWaecijkopsyxhldqwyv" + "lLOUhnuogqj" + "ABCDEGHJKLMPRSTVWZ" + "ijagiivysI",
        strict=True,
    )
)
# What hides between characters.
INVISIBLE = "­​‌‍⁠﻿"
# Spelled digits, English, German, French, Spanish; English numbers to 99.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19",
    "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGIT_DOT = re.compile(r"[0-9]\.[0-9]")


def luhn(digits: str) -> bool:
    """The check of card numbers."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@label(.label)+, found from their @."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done:  # the local part reaches back over its characters, in pieces
            piece = max(done, lo - 64)
            m = _LOCAL_END.search(text[piece:lo])
            lo = piece + m.start()
            if lo > piece or piece == done:
                break
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((lo, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def find(text: str) -> list[list[tuple[int, int]]]:
    """Base spans of each kind, in the order of KINDS."""
    out: list[list[tuple[int, int]]] = [emails(text) if "@" in text else [], [], [], []]
    if not _DIGIT.search(text):
        return out
    if _DIGIT_DOT.search(text):
        out[1] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out[2].append(m.span())
    if "+" in text:
        out[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


@lru_cache(maxsize=1)
def _characters() -> tuple[dict[int, str], frozenset[str]]:
    """One character to one: built from Unicode's decimal digits and one-character compatibility forms; and all that are rewritten or deleted."""
    table = {ord(a): b for a, b in LOOKALIKES.items()}
    for code in [*range(0x80, 0xD800), *range(0xF900, 0x20000)]:
        c = chr(code)
        if (d := unicodedata.decimal(c, None)) is not None:
            table[code] = str(d)
        elif (small := unicodedata.name(c, "")).startswith("LATIN LETTER SMALL CAPITAL ") and len(small) == 28:
            table.setdefault(code, small[-1].lower())
        elif len(n := unicodedata.normalize("NFKC", c)) == 1 and n != c and n.isascii() and not n.isspace():
            table[code] = n
    return table, frozenset(map(chr, table)) | frozenset(INVISIBLE)


_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
_AT, _DOT = r"at|arobase|arroba|klammeraffe", r"dot|punkt|point|punto"
_ATOM = r"[A-Za-z0-9_%+-]+"
_ATOM_HERE = re.compile(_ATOM)
_BEFORE = re.compile(r"[A-Za-z0-9_%+-]*\Z")
_SPELLED = "|".join(sorted(SPELLED, key=len, reverse=True))
#: Disguised @ and dots; which of the bare words count is decided by what stands around them.
_SIGNS = re.compile(rf"(?P<at>{_OPEN}(?:{_AT}|@){_CLOSE})|(?P<dot>{_OPEN}(?:{_DOT}|\.){_CLOSE})|(?P<bareat>(?<=[A-Za-z0-9_%+-])\s{{1,3}}(?:{_AT})\s{{1,3}}(?=[A-Za-z0-9]))|(?P<baredot>(?<=[A-Za-z0-9_%+-])\s{{1,3}}(?:{_DOT})\s{{1,3}}(?=[A-Za-z0-9]))", re.I)
_ITEM = rf"(?:(?:{_SPELLED})(?!\w)|[0-9]+(?!\w))"
#: Spelled and written digits and spelled dots in a row.
_NUMBERS = re.compile(rf"(?<!\w)(?:plus\s+{_ITEM}|{_ITEM}(?=[\s,.()-]))(?:[\s,.()-]{{1,3}}(?:(?:{_SPELLED}|{_DOT})(?!\w)|[0-9]+(?!\w)))*", re.I)
_WORD = re.compile(r"[^\W0-9]")
_NUMBER_WORDS = re.compile(rf"(?P<digit>{_SPELLED})|(?P<dot>\s*(?:{_DOT})\s*)|(?P<plus>plus\s+)|(?P<gap>[\s,]+)", re.I)
_LONE = re.compile(rf"[\s,.()-]*(?:{_SPELLED})[\s,.()-]*", re.I)
_LABEL = re.compile(r"(?:^|[^A-Za-z0-9-])([A-Za-z]{2,24})\Z")
_ODD = re.compile(r"[0-9._]")
_UNIT = re.compile(r"[\s-]{1,3}(?=(?:one|two|three|four|five|six|seven|eight|nine)\b)", re.I)
#: Digits with letters that stand for some.
_LETTERED = re.compile(r"(?<![\w+])\+?[0-9OolI](?:[ .()-]{0,2}[0-9OolI]){8,}(?!\w)")
_LETTER = re.compile("[OolI]")
# Last labels that make bare words read as an address.
_LAST = frozenset("com org net edu gov mil int info biz name io co ai app dev me tv eu uk de fr es it nl at ch be pt pl se no dk fi ie us ca mx br ar cl au nz jp cn in ru ua test example invalid".split())


class Rewritten:
    """A text under rewriting: pieces (source start, source end, what they became)."""

    def __init__(self, text: str):
        self.text, self.edits = text, []

    def put(self, start: int, end: int, new: str) -> None:
        self.edits.append((start, end, new))

    def build(self) -> tuple[str, list[int], list[int], list[bool]]:
        """The new text and, for each of its characters, source start, source end, and whether it was rewritten."""
        out, starts, ends, changed, done = [], [], [], [], 0
        for start, end, new in sorted(self.edits):
            if start < done:
                continue
            out += [self.text[done:start], new]
            starts += [*range(done, start), *([start] * len(new))]
            ends += [*range(done + 1, start + 1), *([end] * len(new))]
            changed += [False] * (start - done) + [True] * len(new)
            done = end
        out.append(self.text[done:])
        starts += range(done, len(self.text))
        ends += range(done + 1, len(self.text) + 1)
        return "".join(out), starts, ends, changed + [False] * (len(self.text) - done)


def _atom_start(text: str, to: int) -> int:
    """Where the atom that ends at `to` starts."""
    while to > 0:
        piece = max(0, to - 64)
        lo = piece + _BEFORE.search(text[piece:to]).start()
        if lo > piece or lo == to:
            return lo
        to = lo
    return 0


def _bare_signs(text: str, signs: list[re.Match]) -> list[tuple[int, int, str]]:
    """Bracketed signs always count; bare ones only where the whole reads as an address. Linear: an address is followed from sign to sign."""
    out = [(m.start(), m.end(), "@" if m.lastgroup == "at" else ".") for m in signs if m.lastgroup in ("at", "dot")]
    ats = [m for m in signs if m.lastgroup == "bareat"] + [m for m in signs if m.lastgroup == "at"]
    dots = {m.start(): m for m in signs if m.lastgroup in ("dot", "baredot")}
    ends = {m.end(): m for m in signs if m.lastgroup == "baredot"}
    for at in ats:
        here, used, plain = at.end(), [], False
        while m := _ATOM_HERE.match(text, here):
            here = m.end()
            if text[here : here + 1] == "." and _ATOM_HERE.match(text, here + 1):
                here, plain = here + 1, True
            elif here in dots:
                used.append(dots[here])
                here = dots[here].end()
            else:
                break
        tail = _LABEL.search(text[max(at.end(), here - 25) : here])
        if not tail or not (used or plain):
            continue
        if at.lastgroup == "bareat" and tail[1].lower() not in _LAST:
            continue  # "at the dot on the map" is prose
        if at.lastgroup == "bareat":
            before = _LOCAL_END.search(text[max(0, at.start() - 64) : at.start()])[0]
            if not used and not _ODD.search(before):
                continue  # "look at example.com" is prose
            out.append((at.start(), at.end(), "@"))
        out += [(d.start(), d.end(), ".") for d in used if d.lastgroup == "baredot"]
        if at.lastgroup == "bareat" or used:  # dots in the local part
            lo = at.start()
            while (first := _atom_start(text, lo)) < lo and first in ends:
                out.append((*ends[first].span(), "."))
                lo = ends[first].start()
    return list(dict.fromkeys(out))


def _number_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for run in _NUMBERS.finditer(text):
        if not _WORD.search(run[0]):
            continue
        for m in _NUMBER_WORDS.finditer(run[0]):
            new = {"digit": SPELLED.get(m[0].lower(), ""), "dot": ".", "plus": "+", "gap": " "}[m.lastgroup]
            if new[1:] == "0" and new != "10" and (unit := _UNIT.match(run[0], m.end())):  # twenty-one
                out.append((run.start() + m.start(), run.start() + unit.end(), new[0]))
                continue
            if m.lastgroup == "gap":
                left, right = run[0][max(0, m.start() - 12) : m.start()], run[0][m.end() : m.end() + 12]
                near = re.search(rf"(?:{_SPELLED})\Z", left, re.I) or re.match(rf"(?:{_SPELLED})\b", right, re.I)
                if not near:
                    continue
                new = ""  # spelled digits stand one by one
            out.append((run.start() + m.start(), run.start() + m.end(), new))
    for run in _LETTERED.finditer(text):
        letters = [m.start() for m in _LETTER.finditer(run[0])]
        if letters and 2 * len(letters) <= len(_DIGIT.findall(run[0])):
            out += [(run.start() + k, run.start() + k + 1, "0" if run[0][k] in "Oo" else "1") for k in letters]
    return out


def disguised(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind that only show after normalisation, in source characters."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    odd = not text.isascii() and not _characters()[1].isdisjoint(text)
    steps = [(text, range(len(text)), range(1, len(text) + 1), None)]
    if odd:
        plain = text.translate(_characters()[0])
        work = Rewritten(plain)
        for m in re.finditer(f"[{INVISIBLE}]", plain):
            work.put(m.start(), m.end(), "")
        new, starts, ends, _ = work.build()
        changed = [text[a:b] != c for a, b, c in zip(starts, ends, new, strict=True)]
        if len(new) != len(text):  # a deletion counts for the character before it
            changed = [x or (k + 1 < len(starts) and starts[k + 1] != ends[k]) for k, x in enumerate(changed)]
        steps = [(new, starts, ends, changed)]
    new, starts, ends, changed = steps[0]
    work = Rewritten(new)
    for edit in _bare_signs(new, list(_SIGNS.finditer(new))):
        work.put(*edit)
    for edit in _number_edits(new):
        work.put(*edit)
    if work.edits:
        last, first, to, edited = work.build()
        changed = [e or bool(changed and any(changed[a:b])) for a, b, e in zip(first, to, edited, strict=True)]
        starts, ends = [starts[a] for a in first], [ends[b - 1] for b in to]
        new = last
    elif not changed:
        return out
    for kind, spans in enumerate(find(new)):
        out[kind] = [(starts[a], ends[b - 1]) for a, b in spans if any(changed[a:b])]
    return out


def all_spans(text: str) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Base spans and added spans of each kind."""
    base, more = find(text), disguised(text)

    def stays(s: tuple[int, int], old: list[tuple[int, int]], starts: list[int]) -> bool:
        k = max(0, bisect_left(starts, s[0]) - 1)  # base spans of a kind are in order and apart
        while k < len(old) and old[k][0] < s[1]:
            b = old[k]
            if s[0] < b[1] and (s == b or not s[0] <= b[0] or not b[1] <= s[1] or _LONE.fullmatch(text[s[0] : b[0]] + text[b[1] : s[1]])):
                return False
            k += 1
        return True

    return base, [[s for s in own if stays(s, old, starts)] for old, own, starts in zip(base, more, [[b[0] for b in old] for old in base], strict=True)]


def _said(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, own in zip(KINDS, spans, strict=True) for a, b in sorted(own))


def private_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 512) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base, spans (base and added) and n_added of every row.

    base and spans are kind:start:end in code points, end exclusive, by kind as in KINDS, then start,
    comma-joined. A null text is empty and has none; repeated rows and equal ids give a row each;
    null ids stay null; other columns are not read; an empty table gives none.
    """
    ship(docs.sparkSession)

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, slice_rows):
                batch = big.slice(at, slice_rows)
                counts, base_said, said, added = [[], [], [], []], [], [], []
                for text in pc.fill_null(batch.column(1), "").to_pylist():
                    base, more = all_spans(text)
                    for c, own in zip(counts, base, strict=True):
                        c.append(len(own))
                    base_said.append(_said(base))
                    added.append(sum(map(len, more)))
                    said.append(_said([a + b for a, b in zip(base, more, strict=True)]) if added[-1] else base_said[-1])
                columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_said, pa.string()), pa.array(said, pa.string()), pa.array(added, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long")


def masked(text: str) -> str:
    """The text with each found span replaced by its kind in brackets; overlapping spans by the first's."""
    base, more = all_spans(text)
    spans = sorted((a, -b, k) for k, own in enumerate(x + y for x, y in zip(base, more, strict=True)) for a, b in own)
    out, done = [], 0
    for a, b, k in spans:
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, -b)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", slice_rows: int = 512) -> DataFrame:
    """docs with personal data in the text replaced by its kind, and the length column set to the new length.

    Rows without any, and null texts, stay as they are; every row and all other columns are kept.
    """
    ship(docs.sparkSession)
    names = docs.columns
    text_at, length_at = names.index(text_col), names.index(length_col) if length_col in names else -1

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, slice_rows):
                batch = big.slice(at, slice_rows)
                old = batch.column(text_at).to_pylist()
                new = [t if t is None else masked(t) for t in old]
                columns = list(batch.columns)
                columns[text_at] = pa.array(new, batch.column(text_at).type)
                if length_at >= 0:
                    n = batch.column(length_at).to_pylist()
                    columns[length_at] = pa.array([k if a == b else len(b) for a, b, k in zip(old, new, n, strict=True)], batch.column(length_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
