"""Suffix-array dedup: every byte that a repeated string of ``LENGTH`` bytes covers goes, but at its first start.

Suffixes are compared by their first ``LENGTH`` bytes only, so an index's suffix array is in byte order of these;
the bytes themselves are compared. A family of such arrays holds distinct beginnings with their first starts. A
new batch gets its array, is merge-scanned against every level (of two equal beginnings the later start is
reported, the earlier one stays), and becomes a level; levels of like size merge, so there are logarithmically many.

Not every suffix has to enter. Each string of LENGTH bytes is stood for by one of its ``GRAM``-byte grams, that
of least hash (winnowing), so equal strings have equal grams at equal places. Neighbouring starts share their
gram: such a run, with its gram's and its whole context's 64-bit hash, is the unit that is first compared. A run
whose context occurs before is repeated as a whole; a run whose gram is alone repeats nothing; runs whose gram has
several contexts are cut, at places counted from the gram, into runs of ``STEP`` starts at most, which are compared
in the same way by the core of bytes that all their strings share. Only starts of cores with several contexts put
their suffixes into the index. A task folds its own copies and hands on two contexts of a key at most, since
two tell that all the others need the closer look; so no hot passage, gram or copy meets in one task.

Defined results: a null or empty text has no bytes and the digest of nothing; texts of any length are treated
whole; texts under LENGTH bytes lose nothing; rows with a null doc_id are left out; equal rows are one document each
that start where the other does, so neither is earlier; rows of one doc_id with different texts are documents in order
of a hash of their texts; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import textnum
from tracelode.llm.common import table, work_dir, written

LENGTH, GRAM, STEP = 100, 32, 8
#: Bytes of text whose runs a task folds at once; runs, and starts, that it folds at once when it looks closer.
FOLD, FOLD_RUNS, FOLD_STARTS = 16 << 20, 1 << 18, 1 << 17

# Starts (lo, at) are the text's tag in the upper and the place in the text in the lower 32 bits. A run has n + 1 starts
# and its gram off bytes after the first.
RUN = np.dtype([("key", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("lo", "<u8"), ("n", "u1"), ("off", "u1")])
RANGE = np.dtype([("doc", "<i8"), ("lo", "<u8"), ("n", "u1"), ("off", "u1")])
START = np.dtype([("mark", f"S{LENGTH}"), ("doc", "<i8"), ("at", "<u8")])
PLACE = np.uint64((1 << 32) - 1)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return textnum.mix((prefix[end] - prefix[start]) * textnum.powers(len(prefix))[1][start])


def context_of(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of all bytes of the strings that start from lo to hi, and of where these lie around their gram."""
    shape = (off.astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64)
    with np.errstate(over="ignore"):
        return textnum.mix(span_hash(prefix, lo, hi + LENGTH) + shape * np.uint64(0x9E3779B97F4A7C15))


def runs(data: np.ndarray, offs: np.ndarray, doc_ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """The runs of starts that share their gram, of all documents."""
    n = len(data)
    valid = np.zeros(n + 1, np.int32)
    long = np.diff(offs) >= LENGTH
    np.add.at(valid, offs[:-1][long], 1)
    np.add.at(valid, offs[1:][long] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(starts):
        return np.zeros(0, RUN)
    prefix = textnum.prefix_hash(data)
    grams = n - GRAM + 1
    h = textnum.mix((prefix[GRAM:] - prefix[:-GRAM]) * textnum.powers(n + 1)[1][:grams])
    mask = np.uint64((1 << max(1, int(n).bit_length())) - 1)
    least = (h & ~mask) | np.arange(grams, dtype=np.uint64)
    width, want = 1, LENGTH - GRAM + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if want > width:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    at = (least[starts] & mask).astype(np.int64)
    doc = np.searchsorted(offs, starts, "right") - 1
    new = np.append(True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))
    lo = starts[new]
    hi = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    at, doc = at[new], doc[new]
    out = np.zeros(len(lo), RUN)
    # Grams are least hashes of their windows, so these are small; keys, by whose upper bits runs are dealt, must not be.
    with np.errstate(over="ignore"):
        out["key"] = textnum.mix(h[at] * np.uint64(0x9E3779B97F4A7C15))
    out["context"] = context_of(prefix, lo, hi, at - lo)
    out["doc"], out["lo"] = doc_ids[doc], tags[doc] | (lo - offs[doc]).astype(np.uint64)
    out["n"], out["off"] = hi - lo, at - lo
    return out


def firsts(r: np.ndarray, key: str, place: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of (key, start), and where each key's first row stands for each of them."""
    r = r[np.lexsort((r[place], r["doc"], r[key]))]
    new = np.append(True, r[key][1:] != r[key][:-1]) if len(r) else np.zeros(0, bool)
    return r, np.flatnonzero(new)[np.cumsum(new) - 1] if len(r) else np.zeros(0, np.int64)


def later(r: np.ndarray, first: np.ndarray, place: str) -> np.ndarray:
    """Which rows start after the first row of their key."""
    return (r["doc"] != r["doc"][first]) | (r[place] != r[place][first])


def folded(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs whose context occurs before; of the first runs of contexts two a key, and the further ones of each key."""
    r, first = firsts(r, "context", "lo")
    once = r[np.unique(first)]
    once = once[np.argsort(once["key"], kind="stable")]
    new = np.append(True, once["key"][1:] != once["key"][:-1])[: len(once)]
    rank = np.arange(len(once))
    rank = rank - np.maximum.accumulate(np.where(new, rank, 0))
    return r[later(r, first, "lo")], once[rank < 2], once[rank >= 2]


def narrowed(data: np.ndarray, prefix: np.ndarray, want: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """``want``, runs of documents that begin at ``begin``, as runs of at most STEP starts, keyed by the bytes these share."""
    lo, n, off = (want["lo"] & PLACE).astype(np.int64), want["n"].astype(np.int64), want["off"].astype(np.int64)
    low, count = (off - n) // STEP, off // STEP - (off - n) // STEP + 1
    row = np.repeat(np.arange(len(want)), count)
    k = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    core = (lo + off)[row] - STEP * k
    a, z = np.maximum(lo[row], core - (STEP - 1)), np.minimum((lo + n)[row], core)
    base, out = begin[row], np.zeros(len(row), RUN)
    with np.errstate(over="ignore"):
        shared = span_hash(prefix, base + core, base + core - (STEP - 1) + LENGTH)
        out["key"] = textnum.mix(shared + (k + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    out["context"] = context_of(prefix, base + a, base + z, core - a)
    out["doc"], out["lo"], out["n"] = want["doc"][row], (want["lo"][row] & ~PLACE) | a.astype(np.uint64), z - a
    return out


def beginnings(data: np.ndarray, prefix: np.ndarray, want: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """All starts of the runs ``want`` with the first LENGTH bytes of their suffixes."""
    size = want["n"].astype(np.int64) + 1
    row = np.repeat(np.arange(len(want)), size)
    step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros(len(row), START)
    base = begin[row] + (want["lo"][row] & PLACE).astype(np.int64) + step
    strings = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[base] if len(row) else np.zeros((0, LENGTH), np.uint8)
    out["mark"] = np.ascontiguousarray(strings).view(START["mark"])[:, 0]
    out["doc"], out["at"] = want["doc"][row], want["lo"][row] + step.astype(np.uint64)
    return out


def string_hash(marks: np.ndarray) -> np.ndarray:
    """A hash of each string, by which suffixes are dealt."""
    words = np.ascontiguousarray(marks).view(np.uint32).reshape(len(marks), LENGTH // 4).astype(np.uint64)
    h = np.zeros(len(marks), np.uint64)
    with np.errstate(over="ignore"):
        for c in words.T:
            h = (h + c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return textnum.mix(h)


class Levels:
    """The family of suffix arrays: distinct beginnings in byte order, each with its first start."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []
        self.repeated: list[np.ndarray] = []

    def _distinct(self, both: np.ndarray) -> np.ndarray:
        both, first = firsts(both, "mark", "at")
        self.repeated.append(both[later(both, first, "at")])
        return both[np.unique(first)]

    def add(self, batch: np.ndarray) -> None:
        new = self._distinct(batch)
        for k, level in enumerate(self.levels):
            at = np.minimum(np.searchsorted(level["mark"], new["mark"]), len(level) - 1)
            met = level["mark"][at] == new["mark"] if len(level) else np.zeros(len(new), bool)
            own, old = new[met], level[at[met]]
            early = (own["doc"] < old["doc"]) | ((own["doc"] == old["doc"]) & (own["at"] < old["at"]))
            same = (own["doc"] == old["doc"]) & (own["at"] == old["at"])
            self.repeated += [own[~early & ~same], old[early]]
            level[at[met][early]] = own[early]
            self.levels[k], new = level, new[~met]
        if len(new):
            self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 > len(self.levels[-2]):
            self.levels[-2:] = [self._distinct(np.concatenate(self.levels[-2:]))]


def grouped(values: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    values, keys = values[order], keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    for a, b in zip(at, np.append(at[1:], len(keys)), strict=True):
        yield int(keys[a]), values[a:b]


def place_of(doc: np.ndarray, places: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (textnum.mix(doc.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(places)).astype(np.int64)


def unpacked(t: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("rows").to_pylist()), kind)


KINDS = "kind int, at int, rows binary"
KINDS_ARROW = pa.schema([("kind", pa.int32()), ("at", pa.int32()), ("rows", pa.binary())])


def packed(kind: int, values: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``values`` as one binary for each of ``keys``."""
    got = list(grouped(values, keys))
    for k in range(0, len(got), 256):
        part = got[k : k + 256]
        columns = [[kind] * len(part), [x for x, _ in part], [y.tobytes() for _, y in part]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, KINDS_ARROW, strict=True)], schema=KINDS_ARROW)


def ranges(r: np.ndarray) -> np.ndarray:
    out = np.zeros(len(r), RANGE)
    for c in RANGE.names:
        out[c] = r[c]
    return out


def looked_at(left: pa.Table, want: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The wanted runs, some ``rows`` at a time: bytes, their prefix hashes, runs, and where each one's document begins."""
    left = left.filter(pc.is_in(left.column("doc_id"), pa.array(np.unique(want["doc"]))))
    ids, tags = left.column("doc_id").to_numpy(), left.column("tag").to_numpy().astype(np.uint64)
    want = want[np.argsort(want["doc"], kind="stable")]
    data, offs = textnum.buffers(left.column("text"))
    for i, j in textnum.chunks(offs):
        part = data[offs[i] : offs[j]]
        a, b = np.searchsorted(want["doc"], ids[i:j], "left"), np.searchsorted(want["doc"], ids[i:j], "right")
        of = np.repeat(np.arange(j - i), b - a)
        row = np.arange(len(of)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[of]
        own = want["lo"][row] >> np.uint64(32) == tags[i:j][of]
        of, row = of[own], row[own]
        if len(row):
            prefix, begin = textnum.prefix_hash(part), (offs[i:j] - offs[i])[of]
            for k in range(0, len(row), rows):
                yield part, prefix, want[row[k : k + rows]], begin[k : k + rows]


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): kept is the text's remaining bytes.

    Tables between the steps hold packed rows by kind: 0 runs by key; 1 repeated ranges by document; 2 runs to be
    looked at closer, by document; 3 suffixes by hash.
    """
    spark = docs.sparkSession
    work = work_dir(spark)
    parts = int(docs.rdd.getNumPartitions())
    segments, places = 1 << max(6, (2 * parts).bit_length()), max(64, 12 * parts)
    shift = np.uint64(65 - segments.bit_length())
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").bitwiseAND(F.lit((1 << 32) - 1)).alias("tag"), "text")

    def by_key(kind: int, r: np.ndarray) -> Iterator[pa.RecordBatch]:
        return packed(kind, r, (r["key"] >> shift).astype(np.int64))

    def by_place(kind: int, r: np.ndarray) -> Iterator[pa.RecordBatch]:
        return packed(kind, ranges(r), place_of(r["doc"], places))

    def dealt(r: np.ndarray) -> Iterator[pa.RecordBatch]:
        again, some, more = folded(r)
        yield from by_key(0, some)
        yield from by_place(1, again)
        yield from by_place(2, more)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offs = textnum.buffers(batch.column("text"))
            ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy().astype(np.uint64) << np.uint64(32)
            for i, j in textnum.chunks(offs, 1 << 20):
                held.append(runs(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ids[i:j], tags[i:j]))
                size += int(offs[j] - offs[i])
                if size >= FOLD:
                    yield from dealt(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield from dealt(np.concatenate(held))

    def compared(t: pa.Table) -> pa.Table:
        """Of the runs of some keys: those whose context occurs before, and first ones of contexts whose key has others."""
        r, first = firsts(unpacked(t, RUN), "context", "lo")
        once = r[np.unique(first)]
        once = once[np.argsort(once["key"], kind="stable")]
        new = np.append(True, once["key"][1:] != once["key"][:-1])[: len(once)]
        alone = new & np.append(new[1:], True)[: len(once)]
        return pa.Table.from_batches([*by_place(1, r[later(r, first, "lo")]), *by_place(2, once[~alone])], KINDS_ARROW)

    def closer(left: pa.Table, right: pa.Table) -> pa.Table:
        held, size, out = [np.zeros(0, RUN)], 0, []
        for near in looked_at(left, unpacked(right, RANGE), 1 << 14) if left.num_rows and right.num_rows else ():
            held.append(narrowed(*near))
            size += len(held[-1])
            if size >= FOLD_RUNS:
                out += dealt(np.concatenate(held))
                held, size = [np.zeros(0, RUN)], 0
        return pa.Table.from_batches([*out, *dealt(np.concatenate(held))], KINDS_ARROW)

    def suffixes(left: pa.Table, right: pa.Table) -> pa.Table:
        held, size, out = [np.zeros(0, START)], 0, []

        def fold() -> Iterator[pa.RecordBatch]:
            r, first = firsts(np.concatenate(held), "mark", "at")
            yield from by_place(1, points(r[later(r, first, "at")]))
            once = r[np.unique(first)]
            yield from packed(3, once, (string_hash(once["mark"]) >> shift).astype(np.int64))

        for near in looked_at(left, unpacked(right, RANGE), 1 << 13) if left.num_rows and right.num_rows else ():
            held.append(beginnings(*near))
            size += len(held[-1])
            if size >= FOLD_STARTS:
                out += fold()
                held, size = [np.zeros(0, START)], 0
        return pa.Table.from_batches([*out, *fold()], KINDS_ARROW)

    def points(r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(r), RANGE)
        out["doc"], out["lo"] = r["doc"], r["at"]
        return out

    def scanned(t: pa.Table) -> pa.Table:
        index = Levels()
        for rows in t.column("rows").to_pylist():
            index.add(np.frombuffer(rows, START).copy())
        again = np.concatenate([np.zeros(0, START), *index.repeated])
        return pa.Table.from_batches(list(by_place(1, points(again))), KINDS_ARROW)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same place as ``by_place`` gives, for the joins with the documents."""
        for b in batches:
            at = pa.array(place_of(b.column("doc_id").to_numpy(), places).astype(np.int32))
            yield pa.RecordBatch.from_arrays([at, *b.columns], ["at", "doc_id", "tag", "text"])

    placed = docs.mapInArrow(place, "at int, doc_id long, tag long, text string")

    def at_texts(rows: DataFrame, look: object) -> DataFrame:
        return placed.groupBy("at").cogroup(rows.groupBy("at")).applyInArrow(look, KINDS)

    def both(table_: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """All repeated ranges found so far by step ``name``, and the runs that need the next one."""
        met = written(table_.where("kind = 0").groupBy("at").applyInArrow(compared, KINDS), f"{work}/{name}")
        all_ = table_.union(met)
        return all_.where("kind = 1"), all_.where("kind = 2")

    pieces = written(docs.mapInArrow(textnum.released(cut), KINDS), f"{work}/runs")
    gone, mixed = both(pieces, "compared_runs")
    cores = written(at_texts(mixed, closer), f"{work}/cores")
    gone_cores, mixed = both(cores, "compared_cores")
    starts = written(at_texts(mixed, suffixes), f"{work}/starts")
    repeated = written(starts.where("kind = 3").groupBy("at").applyInArrow(scanned, KINDS), f"{work}/repeated")
    gone = gone.union(gone_cores).union(starts.where("kind = 1")).union(repeated).select("at", "rows")

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        r = unpacked(right, RANGE) if right.num_rows else np.zeros(0, RANGE)
        r = r[np.argsort(r["doc"], kind="stable")]
        ids, tags = left.column("doc_id").to_numpy(), left.column("tag").to_numpy().astype(np.uint64)
        data, offs = textnum.buffers(left.column("text"))
        a, b = np.searchsorted(r["doc"], ids, "left"), np.searchsorted(r["doc"], ids, "right")
        rows = []
        for k in range(len(ids)):
            own, mine = data[offs[k] : offs[k + 1]], r[a[k] : b[k]]
            mine = mine[mine["lo"] >> np.uint64(32) == tags[k]]
            if len(mine):
                lo = (mine["lo"] & PLACE).astype(np.int64)
                cover = np.zeros(len(own) + 1, np.int64)
                np.add.at(cover, lo, 1)
                np.add.at(cover, lo + mine["n"] + LENGTH, -1)
                hit = np.cumsum(cover[:-1]) > 0
                kept = own[~hit].tobytes()
                spans = int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum())
                rows.append((len(own), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            else:
                kept = own.tobytes()
                rows.append((len(own), 0, 0, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        arrays = [pa.array(ids, pa.int64()), *(pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True))]
        return pa.table(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return placed.groupBy("at").cogroup(gone.groupBy("at")).applyInArrow(removed, result)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")
