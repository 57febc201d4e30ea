"""Token-ID / binary output: canonical length-limited Huffman coding of ids in independent blocks.

``encode`` tokenises whole texts where they lie, appends the end id to each document and writes the ids; counts
every id of all documents; builds one canonical prefix code of at most ``LONGEST`` bits by package-merge; moves the
ids (two bytes a token, not the texts) into ascending order of doc_id; and packs them. Three Parquet tables result:
``code`` (the length of each id's code), ``blocks`` and ``starts`` (the ids before each partition of ``blocks``).
Parquet is the envelope, so that any file system of Spark's will do and a task's output appears whole or not at all;
a block's bytes are this module's own format, all little-endian but the bits:

    "TLH2", documents u32, of these without doc_id (the first) u32, ids u32, ids between checkpoints u32,
    checkpoints u32, doc_id i64 each (0 without), ids of each document u32, bit offset of each checkpoint u32, code bits (high bit first)

``decode`` reads them back: all stretches between checkpoints of a block advance together, one id a step, by
a table of ``2**LONGEST`` entries that gives the next id and the length of its code.

A text is cut where the vocabulary's pattern always starts a match. Arrow finds the distinct pieces of a few
megabytes of text, and only those go to the library's model; each worker keeps the ids of ``CACHE_BYTES`` of pieces.

Defined results: a null or empty text is the end id alone; texts of any length are treated whole, in one block;
rows with a null doc_id come first, as the order of ids puts null before any, and have a null doc_id in the result;
repeated rows are written each; ties of doc_id are in the order of their ids' bytes, so reruns agree; an empty
table writes no block and gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import textnum
from tracelode.llm.common import table, work_dir, written

LONGEST, STEP, BLOCK_IDS, END_ID = 18, 64, 1 << 16, 0
#: Bytes of a worker's cache, and of text whose distinct pieces are found at once.
CACHE_BYTES, CHUNK = 128 << 20, 8 << 20
MAGIC = b"TLH2"

_loaded: dict[str, Encoder] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte: itself where it is printable Latin-1, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _kinds() -> np.ndarray:
    """Of bytes: unsure 0, letter 1, digit 2, other sign 3, apostrophe 4, space 5, part of a longer character 6, other white 7."""
    kinds = np.zeros(256, np.uint8)
    kinds[0x21:0x7F] = 3
    kinds[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
    kinds[0x30:0x3A], kinds[0x27], kinds[0x20], kinds[0x80:], kinds[0x09:0x0E] = 2, 4, 5, 6, 7
    return kinds


KINDS = _kinds()
#: Pairs of kinds between which a match always ends: a contraction may join an apostrophe with letters.
ENDS = np.zeros((8, 8), bool)
for _a, _b in ((1, 2), (1, 3), (1, 4), (1, 7), (2, 1), (2, 3), (2, 4), (2, 7), (3, 1), (3, 2), (3, 7), (4, 2), (4, 7)):
    ENDS[_a, _b] = True
#: Kinds that are never white space, and those that are it nowhere but in some longer characters.
PLAIN = np.array([False, True, True, True, True, False, False, False])
SOLID = np.array([False, True, True, True, True, False, True, False])


def cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pieces start: each text's first byte, and places where a match of the vocabulary's pattern always starts.

    These are changes between ASCII or Latin-1 letters, digits and signs, a single space between characters that
    are not white space, and either side of a single line end or tab. Where that isn't sure there is no cut, and the pattern itself divides the piece.
    """
    n = len(data)
    start = np.zeros(n + 1, bool)
    if n > 1:
        kind = KINDS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # two of that row are signs
        kind[lead] = kind[lead + 1] = 1
        start[1:n] = ENDS.ravel()[kind[:-1] * np.uint8(8) + kind[1:]]
        at = np.flatnonzero(kind == 5)
        at = at[(at > 0) & (at < n - 1)]
        before, after, next_byte = kind[at - 1], kind[at + 1], data[at + 1]
        sure = SOLID[before] & SOLID[after]
        # Some characters of these lead bytes are white space.
        sure &= ~((after == 6) & ((next_byte == 0xC2) | ((next_byte >= 0xE1) & (next_byte <= 0xE3))))
        wide = np.flatnonzero(sure & (before == 6))
        second, third = data[np.maximum(at[wide] - 2, 0)], data[np.maximum(at[wide] - 3, 0)]
        sure[wide[(second == 0xC2) | ((third >= 0xE1) & (third <= 0xE3))]] = False
        at = at[sure]
        last = np.zeros(n + 1, bool)
        last[offs[1:]] = True
        start[at[~last[at + 1]]] = True
        line = np.flatnonzero(kind == 7)  # one that stands alone is a match
        line = line[(line > 0) & (line < n - 1)]
        line = line[PLAIN[kind[line - 1]] & PLAIN[kind[line + 1]] & ~last[line]]
        start[line + 1] = True
    start[offs[:-1]] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Texts to the uint16 ids of each, by the library's model; each distinct match goes through it once while kept."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.matches = regex.compile(public_tokenizers.PATTERN).findall
        self.model, self.alphabet = self.tokenizer.model.tokenize, byte_alphabet()
        self.space = self.alphabet[0x20]
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.size = 0

    def match(self, m: str) -> bytes:
        own = m.replace(" ", self.space) if m.isascii() and m.isprintable() else m.encode().decode("latin-1").translate(self.alphabet)
        return array("H", [t.id for t in self.model(own)]).tobytes()

    def piece(self, raw: bytes) -> bytes:
        """The ids of a piece that isn't kept. Where the cache has half its bytes, what has been asked for before is older."""
        got = self.older.get(raw)
        if got is None:
            text = raw.decode()
            letters = text[1:] if text[0] == " " else text
            if letters.isalpha() and max(letters) < "\u0250":  # letters are one match, also after a space
                got = self.match(text)
            else:
                got = b"".join(map(self.match, self.matches(text)))
        size = len(raw) + len(got) + 200  # two objects and a place in the table
        if size < 400:
            if self.size + size > CACHE_BYTES // 2:
                self.older, self.kept, self.size = self.kept, {}, 0
            self.kept[raw] = got
            self.size += size
        return got

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin (one more than there are)."""
        start = cuts(data, offs)
        edges = np.append(start, len(data)).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        kind = pa.binary() if edges.dtype == np.int32 else pa.large_binary()
        pieces = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        own, at = textnum.buffers(pieces.dictionary)
        raw, at = own.tobytes(), at.tolist()
        got = []
        for a, b in zip(at, at[1:], strict=False):
            p = raw[a:b]
            got.append(self.kept.get(p) or self.piece(p))
        size = np.fromiter(map(len, got), np.int64, len(got)) // 2
        flat, at = np.frombuffer(b"".join(got), np.uint16), np.cumsum(size) - size
        which = pieces.indices.to_numpy()
        own = size[which]
        end = np.cumsum(own)
        out = flat[np.repeat(at[which] - (end - own), own) + np.arange(int(end[-1]) if len(end) else 0)]
        first = np.append(0, end)[np.searchsorted(start, offs)]
        whole = self._with_added(data, offs)
        if not whole:
            return out, first
        texts = [whole.get(k, out[first[k] : first[k + 1]]) for k in range(len(offs) - 1)]
        return np.concatenate(texts), np.cumsum([0, *map(len, texts)])

    def _with_added(self, data: np.ndarray, offs: np.ndarray) -> dict[int, np.ndarray]:
        """Texts that hold one of the added tokens go through the whole tokenizer."""
        raw, found = data.tobytes(), set()
        for t in self.added:
            at = raw.find(t)
            while at >= 0:
                k = int(np.searchsorted(offs, at, "right")) - 1
                if at + len(t) <= offs[k + 1]:
                    found.add(k)
                at = raw.find(t, at + 1)
        return {k: np.array(self.tokenizer.encode(raw[offs[k] : offs[k + 1]].decode(), add_special_tokens=False).ids, np.uint16) for k in found}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``longest`` bits, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    merged, levels = weight, [np.ones(len(weight), bool)]
    for _ in range(longest - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weight, pairs))
        at = np.argsort(both, kind="stable")
        merged = both[at]
        levels.append(at < len(weight))
    take = 2 * len(weight) - 2
    lengths = np.zeros(len(weight), np.int64)
    for own in reversed(levels):
        items = int(own[:take].sum())
        lengths[:items] += 1
        take = 2 * (take - items)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each one more than the last, shifted where the length grows."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for k in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == k)
        code <<= k - last
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code, last = code + len(ids), k
    return codes


def decoding_table(lengths: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length by the next ``longest`` bits."""
    ids, steps = np.zeros(1 << longest, np.uint16), np.zeros(1 << longest, np.uint8)
    at = 0
    for k in range(1, longest + 1):
        own = np.flatnonzero(lengths == k)
        width = len(own) << (longest - k)
        ids[at : at + width] = np.repeat(own, 1 << (longest - k))
        steps[at : at + width] = k
        at += width
    return ids, steps


def pack_block(doc_ids: np.ndarray, nulls: int, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    value = codes[ids]
    word, room = at >> 6, 64 - (at & 63) - size
    total = int(end[-1]) if len(end) else 0
    words = np.zeros((total >> 6) + 2, np.uint64)
    if len(ids):
        main = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[first]] = np.bitwise_or.reduceat(main, first)
        spill = np.flatnonzero(room < 0)
        words[word[spill] + 1] |= value[spill] << (64 + room[spill]).astype(np.uint64)
    marks = at[::STEP].astype(np.uint32)
    head = MAGIC + struct.pack("<5I", len(doc_ids), nulls, len(ids), STEP, len(marks))
    body = words.astype(">u8").tobytes()[: (total + 7) // 8]
    return b"".join((head, doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), marks.astype("<u4").tobytes(), body))


def unpack_block(block: bytes, ids_of: np.ndarray, step_of: np.ndarray) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """(doc_ids, how many of the first have none, sizes, ids) of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of this format")
    n_docs, nulls, n_ids, step, n_marks = struct.unpack_from("<5I", block, 4)
    at = 24
    doc_ids = np.frombuffer(block, "<i8", n_docs, at)
    at += 8 * n_docs
    sizes = np.frombuffer(block, "<u4", n_docs, at)
    at += 4 * n_docs
    position = np.frombuffer(block, "<u4", n_marks, at).astype(np.int64)
    at += 4 * n_marks
    raw = np.concatenate((np.frombuffer(block, np.uint8, -1, at), np.zeros(8, np.uint8))).astype(np.uint32)
    window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    out = np.zeros((n_marks, step), np.uint16)
    longest = int(len(ids_of)).bit_length() - 1
    for k in range(step):
        left = n_ids - step * (n_marks - 1) if n_marks else 0
        lanes = n_marks if k < left else n_marks - 1
        p = position[:lanes]
        bits = (window[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - longest)
        out[:lanes, k] = ids_of[bits]
        p += step_of[bits]
    return doc_ids, nulls, sizes, out.ravel()[:n_ids]


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n, ids): each document's ids with the end id, as uint16."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary_path(tokenizer))
        for batch in batches:
            data, offs = textnum.buffers(batch.column("text"))
            for i, j in textnum.chunks(offs, CHUNK):
                ids, first = own.ids(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                ids = np.insert(ids, first[1:], end_id)
                first += np.arange(len(first))
                column = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(2 * first), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(first)), column], ["doc_id", "n", "ids"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(textnum.released(tokens), "doc_id long, n long, ids binary")


def counts_of(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs: 2**16 numbers, whatever the input."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            raw, _ = textnum.buffers(batch.column("ids"))
            total += np.bincount(raw.view(np.uint16), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "c"])

    counts = np.zeros(1 << 16, np.int64)
    for r in tokens.select("ids").mapInArrow(textnum.released(counted), "id int, c long").groupBy("id").agg(F.sum("c").alias("c")).collect():
        counts[r["id"]] = r["c"]
    return counts


def encode(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID) -> None:
    """Writes ``folder``/blocks, ``folder``/starts and ``folder``/code from (doc_id, text)."""
    spark = docs.sparkSession
    work = work_dir(spark)
    tokens = written(tokenised(docs, tokenizer, end_id), f"{work}/tokens")
    lengths = code_lengths(counts_of(tokens))
    spark.createDataFrame([(LONGEST, lengths.tobytes())], "longest int, lengths binary").coalesce(1).write.parquet(f"{folder}/code")
    code = spark.sparkContext.broadcast((lengths, canonical(lengths)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of about BLOCK_IDS ids; ``start`` counts the ids of the partition before."""
        part, start = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def block() -> pa.RecordBatch:
            doc_ids = pa.concat_arrays([d for d, _, _ in held])
            sizes, ids = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
            raw = pack_block(doc_ids.fill_null(0).to_numpy(), doc_ids.null_count, sizes, ids, *code.value)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([start]), pa.array([size]), pa.array([raw], pa.binary())], ["part", "start", "n", "block"])

        for batch in batches:
            raw, offs = textnum.buffers(batch.column("ids"))
            for i, j in textnum.chunks(offs, 2 * BLOCK_IDS):
                ids = raw[offs[i] : offs[j]].view(np.uint16)
                held.append((batch.column("doc_id").slice(i, j - i), np.diff(offs[i : j + 1]) // 2, ids))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield block()
                    start, size, held = start + size, 0, []
        if held:
            yield block()

    # Equal ids are told apart by their bytes' hash, so that one id's rows can be split.
    order = ["doc_id", F.xxhash64("ids"), "n"]
    ordered = tokens.repartitionByRange(*order).sortWithinPartitions(*order, "ids")
    ordered.select("doc_id", "ids").mapInArrow(textnum.released(packed), "part int, start long, n long, block binary").write.option("compression", "none").parquet(f"{folder}/blocks")
    starts, at = [], 0  # a number for each partition
    for r in spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        starts.append((r["part"], at))
        at += r["n"]
    spark.createDataFrame(starts, "part int, before long").coalesce(1).write.parquet(f"{folder}/starts")


def decode(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) from the files; ids as little-endian uint32."""
    longest, lengths = spark.read.parquet(f"{folder}/code").first()
    tables = spark.sparkContext.broadcast(decoding_table(np.frombuffer(lengths, np.uint8), longest))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                start = batch.column("start")[k].as_py()
                doc_ids, nulls, sizes, ids = unpack_block(batch.column("block")[k].as_py(), *tables.value)
                last = np.cumsum(sizes.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                texts = [raw[4 * (b - s) : 4 * b] for b, s in zip(last.tolist(), sizes.tolist(), strict=True)]
                crc = [zlib.crc32(t) for t in texts]
                column = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.concatenate(([0], 4 * last))), pa.py_buffer(raw)]).cast(pa.binary())
                own = pa.array(doc_ids.astype(np.int64), mask=np.arange(len(doc_ids)) < nulls)
                yield pa.RecordBatch.from_arrays([own, pa.array(start + last - sizes), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64()), column], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    blocks = spark.read.parquet(f"{folder}/blocks").join(F.broadcast(spark.read.parquet(f"{folder}/starts")), "part")  # a row a partition
    placed = blocks.select((F.col("before") + F.col("start")).alias("start"), "block")
    return placed.mapInArrow(textnum.released(unpacked), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    folder = f"{work_dir(spark)}/tokens"
    encode(docs, folder)
    return decode(spark, folder).drop("ids")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def binary_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: (doc_id, start, n_tokens, ids_crc32) as read back from the files."""
    return digest(spark, docs.select("doc_id", "text"))
