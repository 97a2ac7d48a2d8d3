"""Personal data: e-mail addresses, IPv4 addresses, payment cards and phone numbers, plain or disguised."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match starts where a run of digits starts: were it to fail there, it would fail at each later digit too.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base identifiers, in order; leftmost and non-overlapping within a kind.

    Linear in the text: e-mails are sought from each @ outwards, and the digit patterns never go back.
    """
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, 0, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(g.lstrip("0")) <= 3 and int(g[-4:]) <= 255 for g in m.groups()):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if m.end() - m.start() >= 11 and 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


# Letters of other scripts that look like ASCII letters.
_LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХЅІЈаеорсухіјѕԁһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυχ",
        "ABEKMHOPCTYXSIJaeopcyxijsdhlABEZHIKMNOPTYXaivopux",
        strict=True,
    )
)
# Marks that stand for the signs of identifiers.
_SIGNS = {"\u3002": ".", "\u2024": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u00a0": " ", "\ufe62": "+", "\ufe6b": "@"}
_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _char_table() -> dict[str, str]:
    out = _LOOKALIKES | _SIGNS | dict.fromkeys("\u200b\u200c\u200d\u2060\ufeff\u00ad", "")
    out |= {chr(0xFF00 + k): chr(0x20 + k) for k in range(1, 95)}  # full-width forms
    for code in range(0x660, 0x1FBFA):  # decimal digits of other scripts
        if (d := unicodedata.decimal(chr(code), None)) is not None:
            out.setdefault(chr(code), str(d))
    return out


_CHARS = _char_table()
_ODD = re.compile("[" + "".join(map(re.escape, _CHARS)) + "]")
_WORD_DIGIT = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_GAP = r"(?:[\x20\t]|-|,\x20?)"
_SPELLED = re.compile(rf"(?<![A-Za-z])(?:plus{_GAP}+)?(?:{_WORD_DIGIT}|[0-9]++)(?:{_GAP}{{1,3}}(?:{_WORD_DIGIT}|[0-9]++|dot|point|dash))++(?![A-Za-z])", re.I)
_SPELLED_HINT = re.compile(rf"{_WORD_DIGIT}{_GAP}{{1,3}}(?:{_WORD_DIGIT}|[0-9]|dot|point|dash)", re.I)
_UNIT = re.compile(rf"{_GAP}+|[A-Za-z]+|[0-9]+")
_BRACKETED = re.compile(r"[\x20\t]{0,3}[\[({<][\x20\t]{0,3}(at|dot)[\x20\t]{0,3}[\])}>][\x20\t]{0,3}", re.I)
_AT_WORD = re.compile(r"(?<=[A-Za-z0-9])[\x20\t]{1,3}at[\x20\t]{1,3}(?=[A-Za-z0-9-]{1,63}(?:[\x20\t]{1,3}dot[\x20\t]{1,3}|\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?)[A-Za-z0-9])", re.I)
_DOT_WORD = re.compile(r"(?<=[A-Za-z0-9])[\x20\t]{1,3}dot[\x20\t]{1,3}(?=[A-Za-z0-9])", re.I)
_AT_HINT = re.compile(r"[\[({<][\x20\t]{0,3}at|dot[\x20\t\])}>]", re.I)


def _odd(text: str) -> bool:
    """False for texts that surely hold no character of the table: Latin-1 without soft hyphens and hard spaces."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return "\xad" in text or "\xa0" in text


class Edited:
    """A text with pieces replaced, and the way back from its positions to those of the source."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, here, made = [], 0, 0
        self.marks: list[tuple[int, int, int, int]] = []  # made start, made end, source start, source end
        for start, end, new in edits:
            parts += [text[here:start], new]
            made += start - here
            self.marks.append((made, made + len(new), start, end))
            made += len(new)
            here = end
        parts.append(text[here:])
        self.text = "".join(parts)
        self.starts = [m[0] for m in self.marks]

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of [start, end), and whether an edit lies in it."""
        from bisect import bisect_left, bisect_right

        def point(x: int, last: bool) -> int:
            """Source offset of the character x: its first position, or the end of it."""
            k = bisect_right(self.starts, x) - 1
            while k >= 0 and self.marks[k][1] <= x and self.marks[k][0] == x:
                k -= 1  # removed characters before x
            if k < 0:
                return x + last
            a, b, s, e = self.marks[k]
            if a <= x < b:
                if b - a == e - s:
                    return s + (x - a) + last
                return e if last else s
            return e + (x - b) + last

        lo, hi = point(start, False), point(end - 1, True)
        touched = bisect_left(self.starts, end) > bisect_left(self.starts, start) or any(a < end and b > start for a, b, _, _ in self.marks[max(0, bisect_left(self.starts, start) - 1) : bisect_left(self.starts, start)])
        return lo, hi, touched


def _spelled(match: re.Match) -> list[tuple[int, int, str]]:
    """Edits that turn a run of spelled digits into digits; the gaps next to words go."""
    units = [(m.start() + match.start(), m.end() + match.start(), m[0]) for m in _UNIT.finditer(match[0])]
    words = [u for u in units if u[2].lower() in _DIGIT_WORDS]
    if not words:
        return []
    means = _DIGIT_WORDS | {"dot": ".", "point": ".", "dash": "-", "plus": "+"}
    worded = [u[2].lower() in means for u in units]
    out = []
    for k, (start, end, unit) in enumerate(units):
        if worded[k]:
            out.append((start, end, means[unit.lower()]))
        elif not unit[0].isdigit() and (k and worded[k - 1] or k + 1 < len(units) and worded[k + 1]):
            out.append((start, end, ""))
    return out


def _apply(text: str, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits in order, those that overlap an earlier one left out."""
    out, free = [], 0
    for e in sorted(edits):
        if e[0] >= free:
            out.append(e)
            free = e[1]
    return out


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifiers that show only once the text is normalised, as source spans (start, kind, end)."""
    layers, plain = [], text
    if _odd(text) and (edits := [(m.start(), m.end(), _CHARS[m[0]]) for m in _ODD.finditer(text)]):
        layers.append(Edited(text, edits))
        plain = layers[-1].text
    edits = []
    if _SPELLED_HINT.search(plain):
        edits += [e for m in _SPELLED.finditer(plain) for e in _spelled(m)]
    if _AT_HINT.search(plain):
        edits += [(m.start(), m.end(), "@" if m[1].lower() == "at" else ".") for m in _BRACKETED.finditer(plain)]
        # a plain "at" counts before a spelled dot; a plain "dot" only in the name after an at sign
        ats = [(m.start(), m.end(), "@") for m in _AT_WORD.finditer(plain)]
        signs = sorted([e[1] for e in edits if e[2] == "@"] + [e[1] for e in ats] + [k + 1 for k, c in enumerate(plain) if c == "@"] if "@" in plain or ats or edits else [])
        edits += ats
        for here in signs:
            while m := _DOMAIN_WORDS.match(plain, here):
                if m[2]:
                    edits.append((m.start(2), m.end(2), "."))
                here = m.end()
    if edits := _apply(plain, edits):
        layers.append(Edited(plain, edits))
    if not layers:
        return []
    known, out = {(s, k, e) for s, k, e in base}, []
    for start, kind, end in identifiers(layers[-1].text):
        s, e, touched = start, end, False
        for layer in reversed(layers):
            s, e, hit = layer.back(s, e)
            touched |= hit
        if touched and (s, kind, e) not in known and not any(k == kind and a <= s and e <= b for a, k, b in base):
            out.append((s, kind, e))
    return out


_DOMAIN_WORDS = re.compile(r"([A-Za-z0-9-]+)(?:(?=\.)\.|([\x20\t]{1,3}dot[\x20\t]{1,3})(?=[A-Za-z0-9])|(?=\x20?[\[({<]\x20?dot)\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?)", re.I)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans; spans: base and disguised ones.

    n_added counts the disguised ones. One output row for each input row, whole texts, no shuffle. A null or
    empty text has no spans (the digest is that of the empty string); repeated rows repeat.
    """
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, added = [[], [], [], []], [], [], []
            for text in batch.column(1).to_pylist():
                base = identifiers(text) if text else []
                more = disguised(text, base) if text else []
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + more))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents; odd rows as in ``find_pii``."""
    return find_pii(table(spark, sf_dir, "documents"))


QUERIES = {"op10_pii": op10_pii}
ORACLES: dict[str, str] = {}
