"""MinHash near-dedup: ProbMinHash signatures of weighted word shingles, banding, exact verification.

A document is its five-word shingles, each weighing as often as it occurs (a shorter text is one shingle
of all its words). Each shingle is a Poisson process with its weight as rate; every arrival falls on one
of ``BANDS * ROWS`` components and the earliest arrival on a component signs it. Two signatures agree
on a component with the documents' probability Jaccard similarity. Processes are followed in rounds, and
a shingle leaves when its next arrival is later than the latest of the document's components.

Exact copies are folded first. A band's bucket proposes each member's pairs with the bucket's least
document and with the one that meets most others; these pairs are verified on whole texts and joined to
components. Where a bucket still holds several components, its members are compared block by block (no
pair list of a group is ever made), and pairs whose signatures can reach the threshold are verified as
well, unless a link found meanwhile has joined their components. Signatures only decide below ``FLOOR``: of
pairs at the threshold 5 in 10**10 agree on so few of 80 components, against 3 in 10**5 that share no bucket. Links are pairs at ``SIMILARITY`` or above; a class is a
connected component of links and copies.

Defined results: a null text is empty; documents without a word are in classes of their own by exact
text; texts of any length are read whole; repeated rows of one doc_id are one document, and where their texts
differ the one with the least digest stands for it; a class is named by its least doc_id, and a pair at exactly
the threshold is a link, so nothing depends on ties; rows with a null doc_id take no part in the result
(``one_of_each`` keeps them); an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import textnum
from tracelode.llm.common import components, table, work_dir, written

SHINGLE, SIMILARITY, FLOOR = 5, 0.8, 0.5
#: Bands of rows: a pair at 0.8 shares no bucket with a probability of (1 - 0.8**4)**20 = 3e-5.
BANDS, ROWS = 20, 4
#: Members of a bucket that are compared in one block.
BLOCK = 256


def weighted_shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by document in order: hash (48 bits), document, number of occurrences."""
    h, bounds = textnum.words(data, offs)
    g, doc = textnum.grams(h, bounds, SHINGLE)
    out = []
    for lo in range(0, len(offs) - 1, 1 << 16):  # 16 bits hold a document's number
        a, b = np.searchsorted(doc, (lo, lo + (1 << 16)))
        key = ((doc[a:b] - lo).astype(np.uint64) << np.uint64(48)) | (g[a:b] >> np.uint64(16))
        key.sort()
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        out.append((key[at] & np.uint64((1 << 48) - 1), (key[at] >> np.uint64(48)).astype(np.int64) + lo, np.diff(np.append(at, len(key)))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def prob_min_hash(shingle: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """n signatures of m components (uint32): for each the shingle with the earliest arrival; 0 without shingles."""
    first = np.full(n * m, np.inf)
    signed = np.zeros(n * m, np.uint32)
    at, own, rate, time = shingle, doc, weight.astype(float), np.zeros(len(shingle))
    with np.errstate(over="ignore"):
        salt = 0
        while len(at):
            salt += 1
            r = textnum.mix(at + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            time = time - np.log(((r >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / rate
            cell = own * m + ((r & np.uint64(2047)) * np.uint64(m) >> np.uint64(11)).astype(np.int64)
            np.minimum.at(first, cell, time)
            won = time == first[cell]
            signed[cell[won]] = (at[won] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
            alive = time < first.reshape(n, m).max(axis=1)[own]
            at, own, rate, time = at[alive], own[alive], rate[alive], time[alive]
    return signed.reshape(n, m)


def buckets(signed: np.ndarray) -> np.ndarray:
    """The bucket of each band: a hash of the band's rows and number."""
    with np.errstate(over="ignore"):
        out = np.zeros((len(signed), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            out = textnum.mix(out * np.uint64(0xD6E8FEB86659FD93) + signed[:, k::ROWS].astype(np.uint64))
    return out.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, sig, buckets) of (doc_id, key, text): key stands for the exact text; no buckets without words."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textnum.buffers(batch.column("text"))
            for i, j in textnum.chunks(offs):
                own, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                shingle, doc, weight = weighted_shingles(own, at)
                sig = prob_min_hash(shingle, doc, weight, j - i)
                full = np.bincount(doc, minlength=j - i) > 0
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(full * BANDS))).astype(np.int32), pa.array(buckets(sig)[full].ravel()))
                raw = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.arange(j - i + 1, dtype=np.int32) * sig.shape[1] * 4), pa.py_buffer(np.ascontiguousarray(sig))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("key").slice(i, j - i), raw, lists], ["doc_id", "key", "sig", "buckets"])

    return docs.select("doc_id", "key", "text").mapInArrow(textnum.released(signed), "doc_id long, key binary, sig binary, buckets array<long>")


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact similarity of two weighted sets (sorted elements, weights): sum over the common elements
    of 1 / sum over all of the larger of the two weights, each in proportion to the common element's."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    if wa[0] == wb[0] and (wa == wa[0]).all() and (wb == wa[0]).all():  # plain sets
        same = len(np.intersect1d(ha, hb, assume_unique=True))
        return same / (len(ha) + len(hb) - same)
    every = np.union1d(ha, hb)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, ha)], y[np.searchsorted(every, hb)] = wa, wb
    with np.errstate(divide="ignore"):
        order = np.argsort(x / y, kind="stable")  # y = 0: infinite, last
    x, y = x[order], y[order]
    above, below = np.cumsum(x[::-1])[::-1], np.cumsum(y) - y
    both = (x > 0) & (y > 0)
    return float((1 / (above[both] / x[both] + below[both] / y[both])).sum())


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) for the pairs whose whole texts reach SIMILARITY."""
    sides = [texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab"]

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[dict] = []
            for k in "ab":
                ids = batch.column(k).to_numpy()
                _, at = np.unique(ids, return_index=True)
                data, offs = textnum.buffers(batch.column(f"text_{k}").take(pa.array(at)))
                own: dict = {}
                for i, j in textnum.chunks(offs):
                    s, d, w = weighted_shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    cut = np.searchsorted(d, np.arange(j - i + 1))
                    own |= {ids[at[i + x]]: (s[cut[x] : cut[x + 1]], w[cut[x] : cut[x + 1]]) for x in range(j - i)}
                sets.append(own)
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            sim = np.array([probability_jaccard(sets[0][x], sets[1][y]) for x, y in zip(a, b, strict=True)])
            near = sim >= SIMILARITY - 1e-12
            yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near]), pa.array(sim[near])], ["a", "b", "similarity"])

    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(textnum.released(exact), "a long, b long, similarity double")


def across(members: DataFrame) -> DataFrame:
    """(a, b): links between a bucket's members in different components, verified on whole texts.

    ``members``: bucket, doc_id, root, sig, text, n (members of the bucket). Blocks of a bucket meet
    pairwise; a pair is looked at in the first bucket that its two share, if its signatures can reach the
    threshold and no link of the block has joined the two components yet. Only links leave a block.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cut = members.withColumn("parts", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select("bucket", "doc_id", "root", "sig", "text", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(t: pa.Table) -> pa.Table:
        i, j, bucket = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("bucket")[0].as_py()
        ids, roots, own = (t.column(c).to_numpy() for c in ("doc_id", "root", "own"))
        rows = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("sig")])
        places = buckets(rows)
        band = int(np.flatnonzero(places[0] == bucket)[0])
        data, offs = textnum.buffers(t.column("text"))
        sets: list[tuple[np.ndarray, np.ndarray]] = []
        for x, y in textnum.chunks(offs):
            s, d, w = weighted_shingles(data[offs[x] : offs[y]], offs[x : y + 1] - offs[x])
            c = np.searchsorted(d, np.arange(y - x + 1))
            sets += [(s[c[z] : c[z + 1]], w[c[z] : c[z + 1]]) for z in range(y - x)]
        plain = np.array([len(w) > 0 and int(w.max()) == 1 for _, w in sets])
        size = np.array([len(s) for s, _ in sets])
        right, links = np.flatnonzero(own == j), []
        joined = roots.copy()
        for k in np.flatnonzero(own == i):
            near = right[(joined[right] != joined[k]) & ((ids[right] > ids[k]) | (i != j))]
            near = near[(rows[near] == rows[k]).mean(axis=1) >= FLOOR]
            near = near[(places[near] == places[k]).argmax(axis=1) == band]
            if not len(near):
                continue
            sims = np.zeros(len(near))
            flat = np.flatnonzero(plain[near]) if plain[k] else np.zeros(0, np.int64)
            if len(flat):  # sets without repeats: all at once
                every = np.concatenate([sets[x][0] for x in near[flat]])
                at = np.minimum(np.searchsorted(sets[k][0], every), size[k] - 1)
                same = np.add.reduceat((sets[k][0][at] == every).astype(np.int64), np.cumsum(size[near[flat]]) - size[near[flat]])
                sims[flat] = same / (size[k] + size[near[flat]] - same)
            for x in np.setdiff1d(np.arange(len(near)), flat):
                sims[x] = probability_jaccard(sets[k], sets[near[x]])
            for x in near[sims >= SIMILARITY - 1e-12]:
                if joined[x] != joined[k]:
                    links.append((min(ids[k], ids[x]), max(ids[k], ids[x])))
                    joined[joined == joined[x]] = joined[k]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return cut.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, copy_of, class_id): the exact text's least document and the class's least document."""
    spark = docs.sparkSession
    work = work_dir(spark)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    signed = written(signatures(docs), f"{work}/signed")
    # Of a doc_id's texts one stands for it; such ids are few as a rule, and then they are broadcast.
    several = signed.groupBy("doc_id").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("doc_id", "least")
    several = written(several, f"{work}/several")
    one = lambda df: df.join(several, "doc_id", "left").where("least is null or least = key").drop("least")
    signed = one(signed)
    copies = written(signed.groupBy("key").agg(F.min("doc_id").alias("copy_of")), f"{work}/copies")
    single = signed.join(copies.select(F.col("copy_of").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "buckets")
    placed = written(single.select("doc_id", F.explode("buckets").alias("bucket")), f"{work}/placed")
    shared = placed.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most")
    shared = written(shared.select("bucket", "least", "n"), f"{work}/shared")
    members = written(placed.join(shared, "bucket"), f"{work}/members")
    met = written(members.groupBy("doc_id").agg(F.sum("n").alias("met")), f"{work}/met")
    texts = written(one(docs.join(met, "doc_id", "left_semi")).dropDuplicates(["doc_id"]).select("doc_id", "text"), f"{work}/texts")
    central = members.join(met, "doc_id").groupBy("bucket").agg(F.max_by("doc_id", F.struct("met", -F.col("doc_id"))).alias("centre"))
    centred = members.join(written(central, f"{work}/central"), "bucket")
    pairs = centred.select(F.explode(F.array("least", "centre")).alias("lead"), "doc_id").where("lead <> doc_id")
    pairs = pairs.select(F.least("lead", "doc_id").alias("a"), F.greatest("lead", "doc_id").alias("b")).distinct()
    links = written(verified(pairs, texts), f"{work}/links")
    roots = written(components(links.select("a", "b"), f"{work}/first"), f"{work}/roots")

    rooted = members.join(roots, members["doc_id"] == roots["id"], "left").select("bucket", "doc_id", "n", F.coalesce("root", "doc_id").alias("root"))
    rooted = written(rooted, f"{work}/rooted")
    mixed = written(rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket"), f"{work}/mixed")
    about_sig = signed.select("doc_id", "sig").distinct()
    split = rooted.join(mixed, "bucket", "left_semi").join(about_sig, "doc_id").join(texts, "doc_id")
    more = written(across(split), f"{work}/more")
    joined = roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more)
    roots = written(components(joined, f"{work}/last"), f"{work}/classes")

    about = copies.join(roots, copies["copy_of"] == roots["id"], "left").select("key", "copy_of", F.coalesce("root", "copy_of").alias("class_id"))
    found = signed.select("doc_id", "key").join(written(about, f"{work}/about"), "key")
    return found.select("doc_id", "copy_of", "class_id").distinct()


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the documents that are not their class's least.

    All rows of a doc_id stay or go together; rows with a null doc_id stay; blank texts are near duplicates of exact
    copies only; an empty table stays empty; the columns are those that came, whatever their names.
    """
    gone = near_duplicates(docs).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
