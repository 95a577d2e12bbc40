"""Operator 3: personal data, found through disguises and mapped back to the source.

A text passes through a cascade of transducers, each of which rewrites it and keeps, for each
character it emits, the source span that the character stands for:

1. homoglyphs: look-alike, full-width and styled letters and foreign digits become ASCII,
   invisible characters vanish;
2. "at" and "dot": bracketed forms, and bare words where they spell out an address;
3. digits spelled as words, where two or more follow each other, joined by what separates digits.

Identifiers are detected on the rewritten text, and each match's span is carried back through
the cascade, so it covers the source characters that spell it out.  A transducer that changes
nothing in a text costs one search and keeps no offsets.

Numbers have to be more than long: cards have an issuer's prefix and a valid Luhn digit, account
numbers (IBAN) a valid remainder by 97, addresses of IPv6 a digit and two groups; a bare number, or
a phone number in no common form, counts only where it was disguised or where a word like "call"
stands before it.
"""

from __future__ import annotations

import bisect
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import pick
from corvane.session import spread

_LOOK = dict(zip("аеорсухіјѕԁһԛԝьвнкмтАВЕКМНОРСТУХІЈЅοανικρτυχεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwbBHKMTABEKMHOPCTYXIJSoavikptuxeABEZHIKMNOPTYX"))
_LOOK |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
for _c in (*range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x966, 0x970), *range(0x1D400, 0x1D800), *range(0x24B6, 0x24EA)):
    _n = unicodedata.normalize("NFKC", chr(_c))
    _d = unicodedata.decimal(chr(_c), None)
    if _d is not None or (len(_n) == 1 and _n.isascii()):
        _LOOK[chr(_c)] = str(_d) if _d is not None else _n
_GONE = "­​‌‍⁠﻿"
_CONFUSABLE = re.compile("[" + re.escape("".join(_LOOK)) + _GONE + "]")
#: Of these ranges only; a plain range is searched for many times faster.
_FOREIGN = re.compile("[\xad\u0370-\U0010ffff]")
_TABLE = str.maketrans(_LOOK)

_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORDS = "|".join(sorted(_DIGITS, key=lambda w: (-len(w), w)))
_SAID = {"dash": "-", "hyphen": "-", "minus": "-", "dot": ".", "point": "."}
_SEP = rf"[\s,.\-]{{1,3}}(?:(?:{'|'.join(_SAID)})[\s,.\-]{{1,3}})?"
_SPELLED = re.compile(rf"(?<!\w)(?:{_WORDS})(?:{_SEP}(?:{_WORDS}|\d+)(?!\w))+|(?<!\w)\d+(?:{_SEP}\d+)*(?:{_SEP}(?:{_WORDS})(?!\w))+(?:{_SEP}(?:{_WORDS}|\d+)(?!\w))*", re.I)
_ONE = re.compile(rf"{_WORDS}|\d+|[\s,.\-]*(?:{'|'.join(_SAID)})[\s,.\-]*|[\s,.\-]+", re.I)

#: After a bare "dot" only these: all country codes, and common generic names.  After a sign that can't be prose any ending.
_TLD = (
    "com|org|net|edu|gov|mil|int|arpa|info|biz|name|pro|aero|coop|museum|jobs|mobi|travel|tel|cat|asia|post|xxx|dev|app|page|blog|shop|store|online|site|website|tech|cloud|xyz|club|live|news|email|digital|agency|studio|design|global|world|group|berlin|hamburg|bayern|koeln|wien|paris|london|nyc|tokyo|example|test|"
    "ac|ad|ae|af|ag|ai|al|am|ao|aq|ar|as|at|au|aw|ax|az|ba|bb|bd|be|bf|bg|bh|bi|bj|bm|bn|bo|br|bs|bt|bv|bw|by|bz|ca|cc|cd|cf|cg|ch|ci|ck|cl|cm|cn|co|cr|cu|cv|cw|cx|cy|cz|de|dj|dk|dm|do|dz|ec|ee|eg|er|es|et|eu|fi|fj|fk|fm|fo|fr|ga|gb|gd|ge|gf|gg|gh|gi|gl|gm|gn|gp|gq|gr|gs|gt|gu|gw|gy|hk|hm|hn|hr|ht|hu|id|ie|il|im|in|io|iq|ir|is|it|je|jm|jo|jp|ke|kg|kh|ki|km|kn|kp|kr|kw|ky|kz|la|lb|lc|li|lk|lr|ls|lt|lu|lv|ly|"
    "ma|mc|md|me|mg|mh|mk|ml|mm|mn|mo|mp|mq|mr|ms|mt|mu|mv|mw|mx|my|mz|na|nc|ne|nf|ng|ni|nl|no|np|nr|nu|nz|om|pa|pe|pf|pg|ph|pk|pl|pm|pn|pr|ps|pt|pw|py|qa|re|ro|rs|ru|rw|sa|sb|sc|sd|se|sg|sh|si|sj|sk|sl|sm|sn|so|sr|ss|st|su|sv|sx|sy|sz|tc|td|tf|tg|th|tj|tk|tl|tm|tn|to|tr|tt|tv|tw|tz|ua|ug|uk|us|uy|uz|va|vc|ve|vg|vi|vn|vu|wf|ws|ye|yt|za|zm|zw"
)
_ANY_TLD = "[a-z]{2,24}"
_AT = r"\s{0,3}[\[({<]\s{0,3}(?:at|@|arroba)\s{0,3}[\])}>]\s{0,3}"
_DOT = r"\s{0,3}[\[({<]\s{0,3}(?:dot|punto|punkt|point|\.)\s{0,3}[\])}>]\s{0,3}"
_BARE_AT = r"\s{1,3}(?:at|arroba)\s{1,3}|_at_|-at-"
_BARE_DOT = r"\s{1,3}(?:dot|punto|punkt)\s{1,3}|_dot_|-dot-"
#: A plain dot between spaces, but not one that ends a sentence.
_SPACED_DOT = r"\s{0,2}\.(?:\s{1,2}(?!(?-i:[A-Z][a-z])))?"
_LABEL = r"[a-z0-9](?:[a-z0-9\-]{0,62}[a-z0-9])?"
#: Words after a plain "at".
_PLAIN = "the|a|an|this|that|these|those|my|our|your|his|her|its|their|some|any|every|each|no|one|all"
#: An address in which "at", "dot" or both are spelled; either both are bare words, or one is bracketed.
_DISGUISED = re.compile(
    rf"(?<![\w.+\-])[^\W_][\w+.\-]{{0,63}}?(?:(?:{_DOT}|{_BARE_DOT})[\w+\-]{{1,63}}){{0,3}}"
    rf"(?:{_AT}{_LABEL}(?:(?:{_DOT}|{_BARE_DOT}|{_SPACED_DOT}){_LABEL}){{0,4}}(?:(?:{_DOT}|\.){_ANY_TLD}|(?:{_BARE_DOT}|{_SPACED_DOT})(?:{_TLD}))"
    rf"|\s{{0,2}}@\s{{0,2}}{_LABEL}(?:(?:{_DOT}|{_BARE_DOT}|{_SPACED_DOT}){_LABEL}){{0,4}}(?:{_DOT}{_ANY_TLD}|(?:{_BARE_DOT}|{_SPACED_DOT})(?:{_TLD}))"
    rf"|(?:{_BARE_AT})(?!(?:{_PLAIN})\b){_LABEL}(?:(?:{_DOT}|{_BARE_DOT}|\.){_LABEL}){{0,4}}(?:{_DOT}{_ANY_TLD}|(?:{_BARE_DOT})(?:{_TLD})))(?!\w)",
    re.I,
)
_SIGNS = re.compile(rf"(?P<at>{_AT}|{_BARE_AT}|\s{{0,2}}@\s{{0,2}})|(?P<dot>{_DOT}|{_BARE_DOT}|\s{{0,2}}\.\s{{0,2}})", re.I)
#: What the patterns above can't do without, searched in lowered text.
_BRACKETED_AT = re.compile(_AT.removeprefix(r"\s{0,3}"))
_ANY_BARE_AT = re.compile(_BARE_AT)
_BRACKETED_DOT = re.compile(_DOT.removeprefix(r"\s{0,3}"))
_TOKEN = re.compile(r"\w+")

_BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Words that make a number before which they stand a personal one.
_CONTEXT = re.compile(r"\b(?:phone|tel|telephone|telefon|teléfono|téléphone|call|dial|ring|fax|mobile|mobil|móvil|cell|handy|whatsapp|sms|text|ssn|account|acct|konto|compte|cuenta|passport|id|number|nummer|número|numéro|no|nr)\b", re.I)
CONTEXT_REACH = 40
#: Issuers' prefixes with the lengths of their numbers.
_ISSUERS = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}|3(?:0[0-5]\d{11,16}|[689]\d{12,17})|35(?:2[89]|[3-8]\d)\d{12,15}|6(?:011\d\d|4[4-9]\d{3}|5\d{4}|2\d{4})\d{10,13}")
_RUN = re.compile(r"(?<!\d)(?<!\d[.,])\d+(?:[ \-]\d+)*")
_GROUP = re.compile(r"\d+")


def luhn(digits: str) -> bool:
    """Whether a number's last digit is its Luhn check digit."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def is_card(digits: str) -> bool:
    """13 to 19 digits with an issuer's prefix and length and a valid check digit."""
    return bool(_ISSUERS.fullmatch(digits)) and luhn(digits)


def cards(text: str) -> Iterator[tuple[int, int]]:
    """Spans of card numbers: whole groups of digits, joined by single spaces or hyphens, the longest from the left."""
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 13:
            continue
        groups = [g.span() for g in _GROUP.finditer(text, run.start(), run.end())]
        i = 0
        while i < len(groups):
            digits, ends = "", []
            for j in range(i, len(groups)):
                digits += text[groups[j][0] : groups[j][1]]
                if len(digits) > 19:
                    break
                if is_card(digits):
                    ends.append(j)
            if ends:
                yield groups[i][0], groups[ends[-1]][1]
                i = ends[-1]
            i += 1


def is_iban(text: str) -> bool:
    """Whether the remainder by 97 of an account number is 1."""
    plain = text.replace(" ", "").upper()
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def is_ipv6(text: str) -> bool:
    """An address with at least two groups and a digit."""
    if sum(map(bool, text.split(":"))) < 2 or not any(c.isdigit() for c in text):
        return False
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans of account numbers; a match may have taken words behind along, so shorter ones are tried too."""
    for m in _IBAN.finditer(text):
        at = m.end()
        while at > m.start():
            if is_iban(text[m.start() : at]):
                yield m.start(), at
                break
            at = text.rfind(" ", m.start(), at)


_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")


def ipv6s(text: str) -> Iterator[tuple[int, int]]:
    if "::" in text or text.count(":") >= 7:
        for m in _IPV6.finditer(text):
            if is_ipv6(m.group()):
                yield m.span()


def _spans(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    """A detector of a pattern's matches, or of their groups named ``it`` and ``hex``."""
    compiled = re.compile(pattern)
    named = [g for g in ("it", "hex") if g in compiled.groupindex]

    def spans(text: str) -> Iterator[tuple[int, int]]:
        for m in compiled.finditer(text):
            yield m.span(next((g for g in named if m.group(g)), 0))

    return spans


#: Kinds in the order in which they take what they match: how they find it, and whether it needs a context or a disguise.
DETECTORS: tuple[tuple[str, Callable[[str], Iterator[tuple[int, int]]], bool], ...] = (
    ("EMAIL", _spans(r"(?<![\w.+\-])[^\W_][\w.+\-]{0,63}+@[A-Za-z0-9][A-Za-z0-9\-]{0,62}(?:\.[A-Za-z0-9\-]{1,63})*\.[A-Za-z]{2,24}(?![A-Za-z0-9])"), False),
    ("SECRET", _spans(r"(?i:(?<![A-Za-z])(?:api[_\-]?key|access[_\-]?key|token|secret|password|passwd|pwd)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<it>[^\s\"']{6,})|(?<![A-Za-z0-9])(?P<hex>(?=[a-fA-F]{0,40}\d)[A-Fa-f0-9]{32,}|(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9\-]{20,}))(?![A-Za-z0-9])"), False),
    ("IP", _spans(rf"(?<![\w.]){_BYTE}(?:\.{_BYTE}){{3}}(?![\d])(?!\.\d)"), False),
    ("IP", ipv6s, False),
    ("IBAN", ibans, False),
    ("CARD", cards, False),
    ("PHONE", _spans(r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<![\w+])\+\d{9,15}(?!\d)|(?<![\w+])\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<![\w+\-.])\d{3}([ .\-])\d{3}\1\d{4}(?![\d])"), False),
    ("PHONE", _spans(r"(?<![\w+])\d{2,4}[ .\-]\d{3,4}[ .\-]?\d{3,4}(?![\d])"), True),
    ("SSN", _spans(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"), False),
    ("NUMBER", _spans(r"(?<!\d)(?<!\d[.,])\d(?:[ \-]?\d){9,11}(?!\d)"), True),
)
_HOT = re.compile(r"[@\d]")
_KEYS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
_NAMED = ("token", "secret", "passw", "pwd", "api", "access")


def _lowered(text: str) -> str:
    """Lower case as patterns that ignore case see it: they take these three letters for "s" and "i"."""
    return (text if text.isascii() else text.replace("ſ", "s").replace("ı", "i").replace("İ", "i")).lower()


def may_spell_address(text: str) -> bool:
    """Whether a text has what any match of ``_DISGUISED`` has."""
    lowered = _lowered(text)
    if "@" in lowered or _BRACKETED_AT.search(lowered):
        return True
    return bool(any(w in lowered for w in ("dot", "punto", "punkt")) or _BRACKETED_DOT.search(lowered)) and bool(_ANY_BARE_AT.search(lowered))


def may_spell_digits(text: str) -> bool:
    """Whether a text has a digit's word between characters of no word, as any match of ``_SPELLED`` has."""
    return not _DIGITS.keys().isdisjoint(_TOKEN.findall(_lowered(text)))


def may_identify(text: str) -> bool:
    """Whether a rewritten text has what any match of a detector has."""
    if _HOT.search(text) or any(k in text for k in _KEYS):
        return True
    lowered = _lowered(text)
    return any(n in lowered for n in _NAMED)


class Traced:
    """A text with, for each character, its source span; ``None`` while it is the source itself."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a non-empty span of this text."""
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])

    def rewritten(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Traced:
        """This text with spans replaced; each new character names the span it stands for."""
        if not edits:
            return self
        starts = self.starts if self.starts is not None else range(len(self.text))
        ends = self.ends if self.ends is not None else range(1, len(self.text) + 1)
        out, to, till, at = [], [], [], 0
        for a, b, put in edits:
            out.append(self.text[at:a])
            to.extend(starts[at:a])
            till.extend(ends[at:a])
            for ch, x, y in put:
                out.append(ch)
                to.append(starts[x])
                till.append(ends[y - 1])
            at = b
        out.append(self.text[at:])
        to.extend(starts[at:])
        till.extend(ends[at:])
        return Traced("".join(out), to, till)


def homoglyphs(t: Traced) -> Traced:
    """Look-alikes as ASCII (one for one), invisible characters away."""
    if t.text.isascii() or not _FOREIGN.search(t.text) or not _CONFUSABLE.search(t.text):
        return t
    mapped = Traced(t.text.translate(_TABLE), t.starts, t.ends)
    return mapped.rewritten([(i, i + 1, []) for i, ch in enumerate(mapped.text) if ch in _GONE])


def signs(t: Traced) -> Traced:
    """Spelled "at" and "dot" as signs, within what is an address then."""
    if not may_spell_address(t.text):
        return t
    edits = []
    for m in _DISGUISED.finditer(t.text):
        for s in _SIGNS.finditer(t.text, m.start(), m.end()):
            if s.group() not in "@.":
                edits.append((s.start(), s.end(), [("@" if s.lastgroup == "at" else ".", s.start(), s.end())]))
    return t.rewritten(edits)


def spelled_digits(t: Traced) -> Traced:
    """Runs of two or more digits, at least one of them a word, as digits.

    White space and commas between them vanish; dots and hyphens stay, also as words.
    """
    if not may_spell_digits(t.text):
        return t
    edits = []
    for m in _SPELLED.finditer(t.text):
        put = []
        for x in _ONE.finditer(t.text, m.start(), m.end()):
            word = _DIGITS.get(_lowered(x.group()))
            if word:
                put.append((word, x.start(), x.end()))
            elif x.group()[0].isdigit():
                put += [(ch, x.start() + i, x.start() + i + 1) for i, ch in enumerate(x.group())]
            else:
                said = _lowered(re.sub(r"[\s,.\-]+", "", x.group()))
                sign = _SAID[said] if said else re.sub(r"[\s,]+", "", x.group())[:1]
                if sign:
                    put.append((sign, x.start(), x.end()))
        edits.append((m.start(), m.end(), put))
    return t.rewritten(edits)


CASCADE = (homoglyphs, signs, spelled_digits)


def find(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, plain form)`` of each identifier, by source position, without overlaps.

    Of overlapping matches that of the earlier detector stays, within a detector the first one.
    """
    t = Traced(text)
    for step in CASCADE:
        t = step(t)
    if not may_identify(t.text):
        return []
    starts: list[int] = []
    taken: list[tuple[int, int, str, str]] = []  # by position; spans don't overlap, so neighbours decide
    for kind, spans, needs_context in DETECTORS:
        for a, b in spans(t.text):
            x, y = t.source(a, b)
            at = bisect.bisect_left(starts, x)
            if (at and taken[at - 1][1] > x) or (at < len(taken) and taken[at][0] < y):
                continue
            if needs_context and text[x:y] == t.text[a:b] and not _CONTEXT.search(t.text, max(0, a - CONTEXT_REACH), a):
                continue
            starts.insert(at, x)
            taken.insert(at, (x, y, kind, t.text[a:b]))
    return [(kind, x, y, plain) for x, y, kind, plain in taken]


def redact(text: str, found: list[tuple[str, int, int, str]]) -> str:
    """The text with each identifier replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b, _ in found:
        out += (text[at:a], f"<{kind}>")
        at = b
    return "".join((*out, text[at:])) if found else text


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("source", pa.string()), ("plain", pa.string())])


def find_in_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_found, found, redacted)`` for each row of ``docs``.

    ``found`` lists kind, span in characters of the source, source and plain form.  A null text
    has nulls; a text without identifiers an empty list and itself.  Repeated rows are kept.
    """
    names = [id_col, "n_found", "found", "redacted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                found = [None if t is None else find(t) for t in texts]
                lists = [None if f is None else [{"kind": k, "start": a, "end": b, "source": t[a:b], "plain": p} for k, a, b, p in f] for t, f in zip(texts, found)]
                clean = [None if t is None else redact(t, f) for t, f in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if f is None else len(f) for f in found], pa.int32()), pa.array(lists, pa.list_(_SPAN)), pa.array(clean, pa.string())], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(pick(docs, id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_found int, found array<struct<kind: string, start: int, end: int, source: string, plain: string>>, redacted string")


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with identifiers in the text replaced, other columns as they are; ``length_col``, if there, is counted anew.

    Null texts stay null (and have a null length), empty ones empty.  Each row is rewritten by
    itself, so repeated rows stay repeated; an empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact(t, find(t)) for t in texts], dtype=object)

    docs = spread(docs)
    out = docs.withColumn(text_col, cleaned(docs[f"`{text_col}`"]))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(out[f"`{text_col}`"]).cast(docs.schema[length_col].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])
