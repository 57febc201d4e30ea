"""LM scoring: a log-frequency Bloom filter of quantised bigram counts, exact word counts, smoothed sums.

Words are runs of characters other than ASCII white space with A-Z lower-cased; an end follows each text and
stands before it as context. Training documents are counted in three steps: every task combines its own
n-grams, packs them by segment (the hash's high bits) and ships a few binary rows; every segment merges its
rows, keeps its exact word counts, and enters each bigram of count c into its own part of the filter under
levels 1 to 1 + log2(c); segments go to all workers in groups of at most ``GROUP_BYTES``. A bigram's count is
read back by probing level after level until one is absent.

P(w | v) = (c2(v, w) + MU * P1(w)) / (c1(v) + MU), P1(w) = (c1(w) + 1) / (N + V + 1), c2 from the filter.

While all segments fit one group, as they do up to about a gigabyte of text, documents are scored in one pass.
Beyond that each group is broadcast in its turn, every pass notes the counts of the tokens that its segments
hold, and a document's notes are put together by document: memory stays bounded, nothing is dropped.

Defined results: a null or empty text is one end token; very long texts are scored whole; rows with a null
doc_id are scored, with a null held_out, and train; repeated rows count each time; an empty table gives an
empty result; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import textnum
from tracelode.llm.common import crc32_mod, table, work_dir, written

MU, BITS_PER_KEY, PROBES, FLUSH, GROUP_BYTES = 4.0, 8, 4, 1 << 21, 256 << 20
#: Stands for the end of a text; words' hashes are mixed, so none is likely to equal it.
END = np.uint64(0x5EED0FE9D)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents' tokens, ends among them, and each document's first."""
    h, bounds = textnum.words(LOWER[data], offs)
    first = bounds + np.arange(len(bounds))
    out = np.empty(len(h) + len(bounds) - 1, np.uint64)
    end = np.zeros(len(out), bool)
    end[first[1:] - 1] = True
    out[end], out[~end] = END, h
    return out, first


def bigrams(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before; the end stands before the first."""
    before = np.concatenate((np.array([END], np.uint64), token[:-1]))
    before[first[:-1]] = END
    with np.errstate(over="ignore"):
        return textnum.mix(before * np.uint64(0x9E3779B97F4A7C15) + token * np.uint64(3))


def totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(counts, 1)) + 1e-12).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """A count that stands for a level: the middle of those that it holds, 0 for level 0."""
    return np.where(level > 0, np.where(level == 1, 1.0, 2.0 ** (level - 1) * 1.45), 0.0)


def positions(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """``PROBES`` places in a filter of ``bits`` for each key at a level."""
    with np.errstate(over="ignore"):
        h = textnum.mix((keys & np.uint64((1 << 40) - 1)) + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


def filled(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter of a segment's bigrams, as bytes."""
    level = levels(counts)
    bits = max(64, int(level.sum()) * BITS_PER_KEY)
    out = np.zeros(bits, bool)
    for k in range(1, int(level.max(initial=0)) + 1):
        out[positions(keys[level >= k], k, bits).ravel()] = True
    return np.concatenate((np.array([bits], "<u8").view(np.uint8), np.packbits(out, bitorder="little")))


def probed(filter_bytes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each key's level: the last before the first that is absent."""
    bits, body = int(filter_bytes[:8].view("<u8")[0]), filter_bytes[8:]
    out, left, k = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
    while len(left):
        k += 1
        p = positions(keys[left], k, bits)
        there = ((body[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
        left = left[there]
        out[left] = k
        if k > 60:
            break
    return out


def trained(docs: DataFrame, work: str) -> DataFrame:
    """(seg, words, n, keys, counts, filter) of the documents' n-grams; the segments cover all hashes."""
    bits = max(6, int(docs.rdd.getNumPartitions()).bit_length() + 1)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, own in enumerate(held):
                keys = np.concatenate(own) if own else np.zeros(0, np.uint64)
                keys.sort()
                at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
                counts = np.diff(np.append(at, len(keys))).astype("<u4")
                keys = keys[at]
                cut = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                cut = np.concatenate(([0], cut, [len(keys)]))
                width = 5 if kind else 8
                for s in np.flatnonzero(np.diff(cut)):
                    part = keys[cut[s] : cut[s + 1]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([kind], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([counts[cut[s] : cut[s + 1]].tobytes()], pa.binary())], ["seg", "kind", "keys", "counts"])

        for batch in batches:
            data, offs = textnum.buffers(batch.column("text"))
            for i, j in textnum.chunks(offs):
                token, first = tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                held[0].append(token)
                held[1].append(bigrams(token, first))
                size += len(token)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [[], []], 0
        if size:
            yield from flush()

    def merged(t: pa.Table) -> pa.Table:
        sums = []
        for kind, width in ((0, 8), (1, 5)):
            own = t.filter(pa.compute.equal(t.column("kind"), kind))
            raw = np.frombuffer(b"".join(own.column("keys").to_pylist()), np.uint8).reshape(-1, width)
            keys = np.zeros((len(raw), 8), np.uint8)
            keys[:, :width] = raw
            counts = np.frombuffer(b"".join(own.column("counts").to_pylist()), "<u4").astype(np.int64)
            sums.append(totals(keys.view("<u8").ravel(), counts))
        (keys, counts), pairs = sums
        row = [pa.array([t.column("seg")[0].as_py()], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())]
        row += [pa.array([x.tobytes()], pa.binary()) for x in (keys.astype("<u8"), counts.astype("<i8"), filled(*pairs))]
        return pa.table(row, ["seg", "words", "n", "keys", "counts", "filter"])

    shipped = docs.select("text").mapInArrow(textnum.released(packed), "seg int, kind int, keys binary, counts binary")
    schema = "seg int, words long, n long, keys binary, counts binary, filter binary"
    out = shipped.groupBy("seg").applyInArrow(merged, schema).withColumn("bits", F.lit(bits))
    return written(out, f"{work}/segments")


class Held:
    """A group of segments: exact counts of words, and the levels of bigrams, whose hashes fall in them."""

    def __init__(self, rows: list, bits: int) -> None:
        self.bits = bits
        rows = sorted(rows, key=lambda r: r["seg"])
        self.segments = {r["seg"]: np.frombuffer(r["filter"], np.uint8) for r in rows}
        self.keys = np.frombuffer(b"".join(r["keys"] for r in rows), "<u8")  # in order, as the segments are
        self.counts = np.frombuffer(b"".join(r["counts"] for r in rows), "<i8")

    def words(self, token: np.ndarray) -> np.ndarray:
        uniq, back = np.unique(token, return_inverse=True)
        at = np.searchsorted(self.keys, uniq)
        hit = np.flatnonzero(at < len(self.keys))
        hit = hit[self.keys[at[hit]] == uniq[hit]]
        out = np.zeros(len(uniq), np.int64)
        out[hit] = self.counts[at[hit]]
        return out[back]

    def pairs(self, key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        sort, out = key[order], np.zeros(len(key), np.uint8)
        seg = (sort >> np.uint64(64 - self.bits)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])) if len(seg) else np.zeros(0, np.int64)
        for a, b in zip(cut, np.append(cut[1:], len(seg)), strict=True):
            if (own := self.segments.get(int(seg[a]))) is not None:
                out[order[a:b]] = probed(own, sort[a:b])
        return out


def sums(c1: np.ndarray, level: np.ndarray, first: np.ndarray, ends: int, n: int, v: int) -> list[np.ndarray]:
    """Of each document: tokens, known tokens, base score, score."""
    lower = (c1 + 1.0) / (n + v + 1.0)
    before = np.concatenate(([ends], c1[:-1])).astype(float)
    before[first[:-1]] = ends
    p = (np.minimum(count_of(level), np.maximum(np.minimum(before, c1), 0)) + MU * lower) / (before + MU)
    add = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0)  # noqa: E731  every document has its end
    return [np.diff(first), add((c1 > 0).astype(np.int64)), add(np.log10(lower)), add(np.log10(p))]


def scored(docs: DataFrame, train: Column, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score); ``train`` says which rows to learn from."""
    spark = docs.sparkSession
    work = work_dir(spark)
    segments = trained(docs.where(train), work)
    meta = segments.select("seg", "words", "n", "bits", (F.length("keys") * 2 + F.length("filter")).alias("size")).collect()  # a row for each of 2**bits segments
    n, v = sum(r["n"] for r in meta), sum(r["words"] for r in meta)
    bits = meta[0]["bits"] if meta else 6
    groups: list[list[int]] = [[]]
    room = group_bytes
    for r in sorted(meta, key=lambda r: r["seg"]):
        if r["size"] > room and groups[-1]:
            groups.append([])
            room = group_bytes
        groups[-1].append(r["seg"])
        room -= r["size"]
    end_seg = int(END) >> (64 - bits)
    ends_row = segments.where(F.col("seg") == end_seg).select("keys", "counts").first()
    ends = int(Held([{"seg": end_seg, "filter": b"", **ends_row.asDict()}], bits).words(np.array([END]))[0]) if ends_row else 0

    def held(group: list[int]):
        own = segments.where(F.col("seg").between(min(group), max(group))) if group else segments.limit(0)
        return spark.sparkContext.broadcast(Held(list(own.toLocalIterator()), bits))

    ids = docs.select("doc_id", "text")
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def rows(doc_id: pa.Array, values: list[np.ndarray]) -> pa.RecordBatch:
        k = len(doc_id)
        return pa.RecordBatch.from_arrays([doc_id, pa.array(values[0].astype(np.int64)), pa.array(values[1].astype(np.int64)), pa.array(np.full(k, n)), pa.array(values[2].astype(float)), pa.array(values[3].astype(float))], names)

    if len(groups) == 1:
        only = held(groups[0])

        def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offs = textnum.buffers(batch.column("text"))
                for i, j in textnum.chunks(offs):
                    token, first = tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    got = sums(only.value.words(token), only.value.pairs(bigrams(token, first)), first, ends, n, v)
                    yield rows(batch.column("doc_id").slice(i, j - i).cast(pa.int64()), got)

        return ids.mapInArrow(textnum.released(one_pass), schema)

    ids = written(ids.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), f"{work}/texts")
    notes = None
    for k, group in enumerate(groups):
        part = held(group)

        def note(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offs = textnum.buffers(batch.column("text"))
                for i, j in textnum.chunks(offs):
                    token, first = tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    c1, level = part.value.words(token).astype("<i8"), part.value.pairs(bigrams(token, first))
                    cut = [(c1[a:b].tobytes(), level[a:b].tobytes()) for a, b in zip(first, first[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), batch.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array([x for x, _ in cut], pa.binary()), pa.array([x for _, x in cut], pa.binary())], ["row", "doc_id", "c1", "level"])

        got = written(ids.mapInArrow(textnum.released(note), "row long, doc_id long, c1 binary, level binary"), f"{work}/notes{k}")
        part.unpersist()
        notes = got if notes is None else notes.union(got)

    def together(t: pa.Table) -> pa.Table:
        c1 = sum(np.frombuffer(x, "<i8") for x in t.column("c1").to_pylist())
        level = sum(np.frombuffer(x, np.uint8) for x in t.column("level").to_pylist())
        got = sums(c1, level, np.array([0, len(c1)]), ends, n, v)
        return pa.Table.from_batches([rows(t.column("doc_id").slice(0, 1).combine_chunks(), got)])

    return notes.groupBy("row").applyInArrow(together, schema)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_mod(F.col("doc_id"), 7) == 2
    out = scored(docs, F.coalesce(~held_out, F.lit(True)))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
