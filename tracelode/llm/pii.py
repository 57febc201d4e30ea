"""PII: exact base patterns, and transducers that undo disguises while they keep source offsets.

Base spans are the leftmost matches that don't overlap, by kind: e-mail, IPv4, payment card (Luhn), phone. The
transducers rewrite a text to plain characters, noting for each the source characters it came from: look-alike
letters and digits become ASCII, invisible characters go, "at" and "dot" in brackets (or as words in a row
that reads "name at host dot domain") become signs, spelled digits in a row become digits. The same
patterns then run on the rewritten text, and a span found is mapped back to the source. It is added unless
it meets a base span; a span that holds whole base spans of its kind, and more, is added beside them.

A text is only rewritten if it holds something that a transducer would change.

Defined results: a null or empty text has no spans; very long texts are searched whole, in linear time;
rows with a null doc_id and repeated rows have a result each; an empty table gives an empty result; extra
columns are left alone. The counts ``n_*`` are of base spans; ``spans`` holds base and added ones.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracelode.llm import textnum
from tracelode.llm.common import table

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGIT_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last:  # back over the run of local characters, in steps of 64
            lo = max(last, start - 64)
            m = _LOCAL_END.search(text[lo:start]) if _NOT_LOCAL.search(text[lo:start]) else None
            if m is None and not _NOT_LOCAL.search(text[lo:start]):
                start = lo
                continue
            start = lo + m.start() if m else start
            break
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
        if out and at >= 0 and at < last:
            at = text.find("@", last)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four dotted numbers at a time from each chain, kept where all are at most 255."""
    out = []
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            size = sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in own):
                out.append((at, at + size))
            at += size + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DIGIT_CHAIN.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NO_DIGITS.sub("", m.group())) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGITS.sub("", m.group())) <= 15]


def found(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    digits = _ANY_DIGIT.search(text) is not None
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if digits:
        if "." in text:
            out += [(1, *s) for s in addresses(text)]
        out += [(2, *s) for s in cards(text)]
        if "+" in text:
            out += [(3, *s) for s in phones(text)]
    return out


#: Letters of other scripts that look like ASCII ones.
LOOK_ALIKES = str.maketrans(
    "АВЕЅІЈКМНОРСТУХаеіјорсухѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονι․‐‑‒–−＠﹫﹢",
    "ABESIJKMHOPCTYXaeijopcyxsdqwABEZHIKMNOPTYXovi.-----@@+",
)
LOOK_ALIKES |= {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
LOOK_ALIKES |= {ord(d): str(unicodedata.decimal(d)) for d in map(chr, range(0x0660, 0xABFA)) if unicodedata.decimal(d, None) is not None}
LOOK_ALIKES |= {c: None for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_ODD = re.compile("[" + "".join(map(re.escape, map(chr, LOOK_ALIKES))) + "\U0001d7ce-\U0001d7ff]")

#: The digits as words, and the signs' names.
DIGIT_WORDS = [
    "zero null cero zéro".split(), "one eins uno un".split(), "two zwei dos deux".split(), "three drei tres trois".split(), "four vier cuatro quatre".split(),
    "five fünf cinco cinq".split(), "six sechs seis".split(), "seven sieben siete sept".split(), "eight acht ocho huit".split(), "nine neun nueve neuf".split(),
]
_DIGIT_OF = {w: str(k) for k, words in enumerate(DIGIT_WORDS) for w in words}
_WORD = "(?:" + "|".join(sorted(_DIGIT_OF, key=len, reverse=True)) + ")"
_SPELLED_RUN = rf"(?<!\w)(?:plus[ ,.-]+)?{_WORD}(?:[ ,.-]+(?:dot[ ,.-]+)?(?:{_WORD}|[0-9])(?!\w)){{6,}}"
_SPELLED = re.compile(_SPELLED_RUN, re.I)
_SPELLED_PART = re.compile(rf"(?<!\w)(?:plus|dot|{_WORD}|[0-9])(?!\w)", re.I)
_DOT_NAME, _AT_NAME = r"(?:dot|\.|punkt|punto|point)", r"(?:at|@|arroba)"
#: White space before a bracket is taken from its start only, so that long runs of it take linear time.
_DOT_SIGN = rf"(?:(?:(?<!\s)\s+)?[\[({{<]\s*{_DOT_NAME}\s*[\])}}>]\s*)"
_AT_SIGN = rf"(?:(?:(?<!\s)\s+)?[\[({{<]\s*{_AT_NAME}\s*[\])}}>]\s*)"
_SIGNS = re.compile(rf"(?P<at>{_AT_SIGN}|(?<=[A-Za-z0-9]) +at +(?=[A-Za-z0-9-]+(?: +dot +|{_DOT_SIGN})[A-Za-z0-9-]))|(?P<dot>{_DOT_SIGN}|(?<=[A-Za-z0-9]) +dot +(?=[A-Za-z0-9]))", re.I)


class Rewritten:
    """A text with, for each character, where its source starts and ends."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces [a, b) of the present text by a string, for all (a, b, string) in order."""
        text, start, end, at = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            start.extend(self.start[at:a])
            end.extend(self.end[at:a])
            if new:
                text.append(new)
                start.extend([self.start[a]] * len(new))
                end.extend([self.end[b - 1]] * len(new))
            at = b
        self.text, self.start, self.end = "".join(text), start, end


def look_alikes(r: Rewritten) -> None:
    def plain(c: str) -> str:
        d = unicodedata.decimal(c, None)
        return str(d) if d is not None else c.translate(LOOK_ALIKES)

    if edits := [(m.start(), m.end(), plain(m.group())) for m in _ODD.finditer(r.text)]:
        r.edit(edits)


def spelled_digits(r: Rewritten) -> None:
    edits = []
    for run in _SPELLED.finditer(r.text):
        last = None
        for m in _SPELLED_PART.finditer(r.text, run.start(), run.end()):
            word = m.group().lower()
            if last is not None and last < m.start():
                edits.append((last, m.start(), ""))
            edits.append((m.start(), m.end(), "+" if word == "plus" else "." if word == "dot" else _DIGIT_OF.get(word, word)))
            last = m.end()
    if edits:
        r.edit(edits)


def signs(r: Rewritten) -> None:
    if edits := [(m.start(), m.end(), "@" if m.lastgroup == "at" else ".") for m in _SIGNS.finditer(r.text)]:
        r.edit(edits)


_BRACKETED = re.compile(rf"[\[({{<]\s*(?:{_DOT_NAME}|{_AT_NAME})\s*[\])}}>]", re.I)
#: The same as ``_SPELLED`` for lower-case ASCII texts, where it is faster.
_SPELLED_LOW = re.compile(_SPELLED_RUN.replace("(?:plus[ ,.-]+)?", ""))


def disguised(text: str) -> bool:
    """Whether a transducer could change the text, by the transducers' own patterns: any sign that isn't in
    brackets has a "dot" between spaces."""
    plain = text.isascii()
    if not plain and _ODD.search(text):
        return True
    low = text.lower()
    return " dot " in low or _BRACKETED.search(text) is not None or (_SPELLED_LOW.search(low) if plain else _SPELLED.search(text)) is not None


def undisguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the rewritten text shows, in source offsets."""
    r = Rewritten(text)
    for transducer in (look_alikes, spelled_digits, signs):
        transducer(r)
    if r.text == text:
        return []
    out, taken = [], list(base)
    for kind, a, b in found(r.text):
        new = kind, r.start[a], r.end[b - 1]
        met = [t for t in taken if new[1] < t[2] and t[1] < new[2]]
        if new not in met and all(t[0] == kind and new[1] <= t[1] and t[2] <= new[2] for t in met):
            out.append(new)
            taken.append(new)
    return out


def identify(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (kind, start, end), by kind and start, in code points."""
    if not text:
        return [], []
    base = found(text)
    return base, sorted(base + undisguised(text, base)) if disguised(text) else base


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                got = [identify(t) for t in part.column("text").to_pylist()]
                counts = [pa.array([sum(k == s[0] for s in base) for base, _ in got], pa.int64()) for k in range(len(KINDS))]
                sha = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *counts, sha, pa.array([joined(s) for _, s in got], pa.string()), pa.array([len(s) - len(b) for b, s in got], pa.int64())], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", "text").mapInArrow(textnum.released(searched), schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
