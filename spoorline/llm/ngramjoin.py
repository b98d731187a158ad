"""Exact Jaccard join of documents on word shingles: size-aware, heavy and light.

A document is the set of its distinct five-word shingles; two documents link when their sets
have a Jaccard similarity of at least 75 %. The join runs in these steps:

1. Shared shingles. Slabs of whole texts send every shingle once to the bucket of its hash, and
   get back how many of each text's shingles occur in any other text. A link needs at least
   three quarters of either set, so a text with fewer shared shingles has no partner and goes.
2. Classes. Equal sets are one class from here on; its members are never paired.
3. Candidates. Shingles are ordered by how many sets hold them. A light set (few shingles) posts
   all fixed-size subsets (pairs) of the start of its set; two similar light sets have such a
   subset in common. A heavy set posts and scans the inverted lists of single shingles of the
   start of its set. Shingles of one set alone are counted in, but need no list.
   The boundary is the size up to which the pairs of a set cost less than scanning its lists,
   from the mean length of all lists.
4. Verification. Sets that lists connect meet in blocks of bounded size, where inverted lists
   give the exact overlap of every two sets. In a connected part of few blocks every two blocks
   meet, so a set travels at most FEW_BLOCKS times. In a larger part sets with the same leading
   list share a block, two blocks meet only if some list spans them, and only the sets of such
   lists travel: copies follow the lists, not the square of the part. Every pair of classes in a
   common list is verified once. jaccard_links() returns all pairs of classes that link;
   jaccard_classes() sums each class's links within the tasks, so that thousands of near copies
   make no row for each pair.

In step 1 a slab's row for a bucket names only the texts that have a shingle there, so rows and
bytes follow the shingles; with more buckets than a slab has shingles, each shingle is a row.

Shingles are compared by 64-bit hash. Null or empty texts, and texts without words, have an
empty set and no link. Rows that repeat a doc_id are documents of their own; the component's
name is the smallest doc_id that it holds (nulls count only where there is nothing else).
Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.llm import textcore as tc
from spoorline.llm.common import discard, hot_keys, join_spread, partitions, sweep, written
from spoorline.llm.components import components

#: Similarity in hundredths, and how many hashes a bucket of step 1 holds about.
PERCENT = 75
BUCKET = 1_000_000
#: Sets and shingles of a block of step 4 about.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 18
#: Blocks of a connected part up to which every two of them meet.
FEW_BLOCKS = 16
#: Bytes of texts whose shingles are posted together, and shingles of a chunk of step 3 about.
POSTED_BYTES, CHUNK = 4 << 20, 250_000
#: Lists of a block longer than this are counted by a product of matrices, so many lists at once.
LONG_LIST, AT_ONCE = 64, 4096


def least_overlap(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles that a set of n has in common with any set it links to, at least."""
    return -((-n * percent) // 100)


# ---- step 1 -------------------------------------------------------------------------------

POSTED = "bucket int, chunk long, docs binary, counts binary, hashes binary, several binary, ids binary, nulls binary, marks binary, sizes binary, keys binary"
LOW48 = tc.U64(0xFFFFFFFFFFFF)


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _runs(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending numbers the distinct ones and how often each occurs."""
    docs, counts = np.unique(doc, return_counts=True)
    return docs.astype(np.uint32), counts.astype(np.uint32)


def _posted(ids: np.ndarray, nulls: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """One slab's rows: a row for its texts, and one for each bucket that has shingles of it."""
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64())] + [(k.split()[0], pa.binary()) for k in POSTED.split(", ")[2:]])
    sizes = np.array([len(s) for s in sets], np.uint32)
    keys = b"".join(_digest(s.tobytes()) for s in sets)
    chunk = int.from_bytes(_digest(ids.tobytes() + nulls.tobytes() + marks.tobytes() + keys)[:8], "little", signed=True)
    h = np.concatenate(sets) & LOW48
    doc = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    last = np.ones(len(h), bool)
    last[:-1] = new[1:]
    alone = new & last  # in one text of this slab
    docs, counts = _runs(np.sort(doc[~alone]))
    rows: dict[str, list] = {k: [] for k in schema.names}

    def add(**x):
        for k, v in rows.items():
            v.append(x.get(k))

    add(bucket=-1 - chunk % buckets, chunk=chunk, docs=docs.tobytes(), counts=counts.tobytes(), ids=ids.tobytes(), nulls=nulls.tobytes(), marks=marks.tobytes(), sizes=sizes.tobytes(), keys=keys)
    b = (h % tc.U64(buckets)).astype(np.int32)
    by = np.lexsort((doc, b))
    h, doc, alone, new, b = h[by], doc[by], alone[by], new[by], b[by]
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True]))) if len(b) else np.zeros(1, np.int64)
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
        hh, one = h[i:j], alone[i:j]
        docs, counts = _runs(doc[i:j][one])
        add(bucket=int(b[i]), chunk=chunk, docs=docs.tobytes(), counts=counts.tobytes(), hashes=tc.pack48(hh[one]), several=tc.pack48(hh[new[i:j] & ~one]))
    return pa.RecordBatch.from_pydict(rows, schema)


def _post(width: int, buckets: int):
    """(doc_id, text, mark) -> POSTED, a slab of about POSTED_BYTES at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, nulls, marks, sets, held = [], [], [], [], 0

        def slab() -> pa.RecordBatch:
            out = _posted(np.concatenate(ids), np.concatenate(nulls), np.concatenate(marks), list(sets), buckets)
            for x in (ids, nulls, marks, sets):
                x.clear()
            return out

        for batch in batches:
            for lo, hi, data, bounds in tc.slabs(batch.column(1)):
                own = batch.column(0).slice(lo, hi - lo)
                ids.append(np.asarray(own.fill_null(0), np.int64))
                nulls.append(np.asarray(own.is_null()).astype(np.uint8))
                marks.append(np.asarray(batch.column(2).slice(lo, hi - lo), np.int64))
                sets += tc.shingle_sets(data, bounds, width)
                held += len(data)
                if held >= POSTED_BYTES:
                    yield slab()
                    held = 0
        if sets:
            yield slab()

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """For a bucket: how many of each text's own hashes any other slab has too; texts with none are left out."""
    if pdf["bucket"].iloc[0] < 0:
        return pdf[["chunk", "docs", "counts", "ids", "nulls", "marks", "sizes", "keys"]]
    own = [tc.unpack48(x) for x in pdf["hashes"]]
    every = np.concatenate(own + [tc.unpack48(x) for x in pdf["several"]])
    every.sort()
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    chunks, docs, counts = [], [], []
    for chunk, h, d, c in zip(pdf["chunk"], own, pdf["docs"], pdf["counts"]):
        if not len(twice) or not len(h):
            continue
        at = np.searchsorted(twice, h)
        hit = twice[np.minimum(at, len(twice) - 1)] == h
        doc = np.repeat(np.frombuffer(d, np.uint32), np.frombuffer(c, np.uint32))[hit]
        if len(doc):
            one, times = _runs(doc)
            chunks.append(chunk)
            docs.append(one.tobytes())
            counts.append(times.tobytes())
    return pd.DataFrame({"chunk": chunks, "docs": docs, "counts": counts, "ids": None, "nulls": None, "marks": None, "sizes": None, "keys": None})


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """For a slab: a row for each text."""
    tops = pdf[pdf["ids"].notna()]
    total = np.zeros(max(len(x) for x in tops["nulls"]), np.int64)
    # A slab whose content another equals byte for byte has the same chunk name: all its rows count.
    if len(tops) > 1:
        total[:] = 1 << 40
    else:
        for docs, counts in zip(pdf["docs"], pdf["counts"]):
            total[np.frombuffer(docs, np.uint32)] += np.frombuffer(counts, np.uint32)
    out = []
    for _, top in tops.iterrows():
        ids = pd.Series(np.frombuffer(top["ids"], np.int64)).astype("Int64")
        ids[np.frombuffer(top["nulls"], np.uint8).astype(bool)] = pd.NA
        keys = top["keys"]
        out.append(pd.DataFrame({"doc_id": ids, "mark": np.frombuffer(top["marks"], np.int64), "n": np.frombuffer(top["sizes"], np.uint32).astype(np.int64), "key": [keys[i : i + 16] for i in range(0, len(keys), 16)], "shared": total[: len(ids)]}))
    return pd.concat(out)


def text_mark() -> Column:
    """A 64-bit hash of the text: with the id, what names a row."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def shingle_ledger(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, text) -> a written table (doc_id, mark, n, key, shared): the text's hash, set size,
    the set's hash, and at least as many of its shingles as occur in other texts."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * partitions(spark), math.ceil(size / 6 / BUCKET))
    posted = docs.select("doc_id", "text", text_mark().alias("mark")).mapInArrow(tc.tidied(_post(width, buckets)), POSTED)
    part = "chunk long, docs binary, counts binary, ids binary, nulls binary, marks binary, sizes binary, keys binary"
    counted = posted.groupBy("bucket").applyInPandas(tc.tidied_group(_shared), part)
    out = written(counted.groupBy("chunk").applyInPandas(_gather, "doc_id long, mark long, n long, key binary, shared long"), "shingle-ledger")
    del posted, counted
    sweep(spark)
    return out


# ---- steps 2 and 3 ------------------------------------------------------------------------


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in tc.slabs(batch.column(0)):
                sets = tc.shingle_sets(data, bounds, width)
                raw = [s.tobytes() for s in sets]
                yield pa.RecordBatch.from_pydict({"key": pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary()), "n": pa.array([len(s) for s in sets], pa.int64()), "hashes": pa.array(raw, pa.binary())})

    return run


def light_boundary(mean_list: float, percent: int = PERCENT, most: int = 4096) -> int:
    """The largest size up to which posting pairs costs no more than scanning lists."""
    n = np.arange(1, most)
    start = n - least_overlap(n, percent)
    pairs = (start + 2) * (start + 1) / 2
    fits = pairs <= (start + 1) * (1 + mean_list)
    return int(n[fits].max(initial=0))


def signatures(s: np.ndarray, df: np.ndarray, boundary: int, percent: int = PERCENT) -> np.ndarray:
    """What a set posts: pairs if it is light; single shingles if it is heavy or can meet one.

    s holds the set in the common order, rare shingles first; df 0 marks those of this set alone,
    which take their place in the start of the set but need no list.
    """
    n = len(s)
    spare = n - int(least_overlap(n, percent))
    out = []
    if n <= boundary:
        p = s[: spare + 2][df[: spare + 2] > 0]
        i, j = np.triu_indices(len(p), 1)
        a, b = np.minimum(p[i], p[j]), np.maximum(p[i], p[j])
        out.append(tc.mix(a * tc.PLACE[0] + b * tc.PLACE[1]))
    if n > boundary or 100 * n >= percent * (boundary + 1):
        out.append(tc.mix(s[: spare + 1][df[: spare + 1] > 0] + tc.PLACE[2]))
    return np.concatenate(out).view(np.int64)


def _by_bucket(pdf: pd.DataFrame, buckets: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's sets, its distinct 48-bit hashes by bucket, how many sets hold each, the buckets' bounds."""
    sets = [np.frombuffer(x, tc.U64) for x in pdf["hashes"]]
    h, c = np.unique(np.concatenate(sets) & LOW48, return_counts=True)
    by = np.argsort(h % tc.U64(buckets), kind="stable")
    h, c = h[by], c[by]
    return sets, h, c, np.searchsorted((h % tc.U64(buckets)).astype(np.int64), np.arange(buckets + 1))


def _count_out(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, h, c, cut = _by_bucket(pdf, buckets)
        rows = [(k, int(pdf["chunk"].iloc[0]), tc.pack48(h[i:j]), c[i:j].astype(np.uint32).tobytes()) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if i < j]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "hashes", "counts"])

    return run


def _count_back(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk's hashes of a bucket a byte: 0 for one set in all, else the logarithm of their number."""
    own = [tc.unpack48(x) for x in pdf["hashes"]]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["counts"]]).astype(np.int64)
    every, at = np.unique(np.concatenate(own), return_inverse=True)
    total = np.bincount(at, counts, minlength=len(every))
    level = np.minimum(np.where(total < 2, 0, 1 + 8 * np.log2(np.maximum(total, 2) / 2)), 255).astype(np.uint8)[at]
    cut = np.cumsum([0] + [len(x) for x in own])
    return pd.DataFrame({"bucket": pdf["bucket"], "chunk": pdf["chunk"], "levels": [level[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])]})


def _sign(buckets: int, boundary: int, percent: int):
    def run(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"sig": [], "key": [], "n": []})
        sets, h, _, _ = _by_bucket(pdf, buckets)
        level = np.frombuffer(b"".join(back.sort_values("bucket")["levels"]), np.uint8)
        order = np.argsort(h, kind="stable")
        h, level = h[order], level[order]
        sig = []
        for s in sets:
            df = level[np.searchsorted(h, s & LOW48)]
            by = np.argsort(df, kind="stable")  # equally rare ones in the order of their hashes
            sig.append(signatures(s[by], df[by], boundary, percent))
        n = [len(x) for x in sig]
        return pd.DataFrame({"sig": np.concatenate(sig), "key": np.repeat(pdf["key"].to_numpy(object), n), "n": np.repeat(pdf["n"].to_numpy(), n)})

    return run


def posts(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, n, hashes) -> (sig, key, n): the lists that hold more than one set.

    Shingles are ordered by how many sets hold them, rare ones first, as counted over all sets;
    passages that many texts share so come last, and seldom make a candidate.
    """
    size = sets.agg(F.sum("n"), F.count("*")).first()
    total = size[0] or 0
    buckets = max(partitions(sets.sparkSession), math.ceil(total / BUCKET))
    chunked = sets.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(max(partitions(sets.sparkSession), math.ceil(total / CHUNK)))))
    out = chunked.groupBy("chunk").applyInPandas(tc.tidied_group(_count_out(buckets)), "bucket int, chunk long, hashes binary, counts binary")
    levels = written(out.groupBy("bucket").applyInPandas(tc.tidied_group(_count_back), "bucket int, chunk long, levels binary"), "shingle-levels")

    def signed(boundary: int) -> DataFrame:
        return chunked.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInPandas(tc.tidied_group(_sign(buckets, boundary, percent)), "sig long, key binary, n long")

    lists = signed(0).agg(F.count("*"), F.approx_count_distinct("sig")).first()
    signs = signed(light_boundary(lists[0] / max(lists[1], 1), percent)).distinct()
    many = signs.groupBy("sig").agg(F.count("*").alias("c")).filter("c > 1").select("sig")
    found = written(signs.join(many, "sig"), "jaccard-lists")
    discard(levels)
    sweep(sets.sparkSession)
    return found


# ---- step 4 -------------------------------------------------------------------------------


def _overlaps(s: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sets with something in common and their overlaps, by scanning inverted lists."""
    k = len(s)
    who = np.repeat(np.arange(k, dtype=np.int64), [len(x) for x in s])
    every = np.concatenate(s) if s else np.zeros(0, tc.U64)
    order = np.argsort(every, kind="stable")
    every, who = every[order], who[order]
    cut = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1], [True])))
    length = np.diff(cut)
    count = np.zeros((k, k), np.int32)
    two = cut[:-1][length == 2]
    if len(two):
        count += np.bincount(who[two] * k + who[two + 1], minlength=k * k).reshape(k, k).astype(np.int32)
    some = (length > 2) & (length <= LONG_LIST)
    for a, n in zip(cut[:-1][some].tolist(), length[some].tolist()):
        i = who[a : a + n]
        count[i[:, None], i] += 1
    long = np.flatnonzero(length > LONG_LIST)
    for lo in range(0, len(long), AT_ONCE):
        part = long[lo : lo + AT_ONCE]
        holds = np.zeros((k, len(part)), np.float32)
        for column, (a, n) in enumerate(zip(cut[part].tolist(), length[part].tolist())):
            holds[who[a : a + n], column] = 1
        count += (holds @ holds.T).astype(np.int32)
    i, j = np.nonzero(np.triu(count, 1))
    return i, j, count[i, j]


def _block_links(percent: int, pairs: bool):
    """All pairs (u, v) that link; or links that join all that do, and (u, null, n): u has n links."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key")
        sets = [np.frombuffer(x, tc.U64) for x in pdf["hashes"]]
        keys, n = pdf["key"].tolist(), np.array([len(x) for x in sets], np.int64)
        i, j, o = _overlaps(sets)
        ok = 100 * o.astype(np.int64) >= percent * (n[i] + n[j] - o)
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:  # pairs within a block belong to the block's own task
            block = pdf["block"].to_numpy()
            ok &= block[i] != block[j]
        i, j = i[ok], j[ok]
        if pairs:
            return pd.DataFrame([(min(keys[a], keys[b]), max(keys[a], keys[b])) for a, b in zip(i.tolist(), j.tolist())], columns=["u", "v"])
        size = pdf["size"].to_numpy(np.int64)
        links = np.zeros(len(keys), np.int64)
        np.add.at(links, i, size[j])
        np.add.at(links, j, size[i])
        label = list(range(len(keys)))

        def top(x):
            while label[x] != x:
                label[x] = x = label[label[x]]
            return x

        out = [(keys[a], None, int(links[a])) for a in np.flatnonzero(links).tolist()]
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = top(a), top(b)
            if x != y:
                label[x] = y
                out.append((keys[a], keys[b], 0))
        return pd.DataFrame(out, columns=["u", "v", "n"])

    return run


def _in_blocks(member: DataFrame) -> DataFrame:
    """(key, part, blocks) -> (key, block, i, j): every two blocks of a part."""
    name = lambda b: F.xxhash64("part", b)
    each = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.select("key", name(F.pmod(F.xxhash64("key"), F.col("blocks"))).alias("block"), name(F.col("other")).alias("other"))
    return each.select("key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _along_lists(posted: DataFrame) -> DataFrame:
    """(sig, key, n) of the lists of large parts -> (key, block, i, j): blocks that a list spans."""
    lead = posted.groupBy("sig").agg(F.min("key").alias("v"))
    home = posted.join(lead, "sig").groupBy("key", "n").agg(F.min("v").alias("home"))
    need = home.groupBy("home").agg(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES).alias("need"))
    packs = max(1, math.ceil(need.filter("need < 0.5").agg(F.sum("need")).first()[0] or 0))
    packed = F.xxhash64(F.lit("packed"), F.pmod(F.xxhash64("home"), F.lit(packs)))
    own = F.xxhash64("home", F.pmod(F.xxhash64("key"), F.ceil("need").cast("long")))
    block = home.join(need, "home").select("key", F.when(F.col("need") < 0.5, packed).otherwise(own).alias("block"))
    at = written(posted.select("sig", "key").join(block, "key"), "jaccard-spans")
    other = at.select("sig", F.col("block").alias("other")).distinct()
    met = at.join(other, "sig").select("key", "block", "other").distinct()  # a block meets itself too
    return met.select("key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def meetings(posted: DataFrame) -> DataFrame:
    """(sig, key, n) of all lists -> (key, block, i, j): each set, its block, and the pairs of blocks it goes to.

    Blocks are named by 64-bit hashes; two of one name would be one larger block, nothing else.
    """
    lead = posted.groupBy("sig").agg(F.min("key").alias("v"))
    near = posted.select("sig", F.col("key").alias("u")).join(lead, "sig").select("u", "v").distinct()
    part = components(near).toDF("key", "part")
    member = posted.select("key", "n").distinct().join(part, "key")
    size = member.groupBy("part").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK_SETS, F.col("s") / BLOCK_SHINGLES)).cast("long")
    member = written(member.join(size.select("part", blocks.alias("blocks")), "part"), "jaccard-members")
    discard(part)
    met = _in_blocks(member.filter(F.col("blocks") <= FEW_BLOCKS))
    large = member.filter(F.col("blocks") > FEW_BLOCKS)
    return met if large.isEmpty() else met.unionByName(_along_lists(posted.join(large.select("key"), "key")))


def _met_in_blocks(posted: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """(sig, key, n) of all lists, (key, size) of classes -> what _block_links() finds in all blocks."""
    held = meetings(posted).join(sizes, "key").join(sets.select("key", "hashes"), "key")
    schema = "u binary, v binary" + ", n long" * (not pairs)
    return written(held.groupBy("i", "j").applyInPandas(_block_links(percent, pairs), schema), "jaccard-links")


def _linked(docs: DataFrame, width: int, percent: int, pairs: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> the ledger of shingle_ledger(), and what _met_in_blocks() finds."""
    ledger = shingle_ledger(docs, width)
    near = ledger.filter((F.col("n") > 0) & (F.col("shared") * 100 >= F.col("n") * percent))
    # One text of each class is fetched, by its row's id and hash, so rows without an id spread too.
    chosen = near.groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("x")).select(F.col("x.doc_id").alias("id"), F.col("x.mark").alias("own")).distinct()
    texts = docs.select("doc_id", "text", text_mark().alias("mark"))
    texts = texts.join(chosen.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("own")), "left_semi")
    sets = written(texts.select("text").mapInArrow(tc.tidied(_sets(width)), "key binary, n long, hashes binary").filter("n > 0"), "shingle-sets")
    posted = posts(sets, percent)
    found = _met_in_blocks(posted, sets, ledger.filter("n > 0").groupBy("key").agg(F.count("*").alias("size")), percent, pairs)
    discard(posted, sets)
    sweep(docs.sparkSession)
    return ledger, found


def jaccard_links(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> membership (doc_id, key), and all links (u, v) of different classes.

    A class is the documents of one shingle set, key its name; u < v, each pair once. Documents
    of one class all link. Documents without shingles have no key.
    """
    ledger, links = _linked(docs, width, percent, True)
    return ledger.select("doc_id", F.when(F.col("n") > 0, F.col("key")).alias("key")), links


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text) -> the ledger of shingle_ledger(), (key, component) of linked sets, and
    (key, n_links): how many documents of other classes each document of the class links to.

    component is the key of one set of the component; sets without a link don't appear.
    """
    ledger, found = _linked(docs, width, percent, False)
    comp = components(found.filter("v IS NOT NULL").select("u", "v")).toDF("key", "component")
    sweep(docs.sparkSession)
    return ledger, comp, found.filter("v IS NULL").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("n_links"))


def _groups(classes: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, top) of all classes: top is the key that names the class's component."""
    return classes.select("key").join(comp, "key", "left").select("key", F.coalesce("component", "key").alias("top"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) -> a row for each: doc_id, n_shingles, component_id, n_links.

    n_links is the number of other documents that the document links to.
    """
    ledger, comp, links = jaccard_classes(docs, width, percent)
    least = written(ledger.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")), "jaccard-classes")
    named = least.join(_groups(least, comp), "key")
    tops = named.groupBy("top").agg(F.min("least").alias("component_id"), F.sum("c").alias("all"))
    n = (F.col("c") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links")
    ids = named.join(tops.filter("all > 1").drop("all"), "top").join(links, "key", "left").select("key", "component_id", n)
    of = F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), "doc_id").alias("component_id")
    n_links = F.coalesce(F.when(F.col("n") > 0, F.col("n_links")), F.lit(0)).cast("long").alias("n_links")
    hot = hot_keys(least.select("key", F.col("c").alias("n")), ["key"], ledger.count(), "hot-classes")
    return join_spread(ledger, ids, ["key"], hot, "left").select("doc_id", F.col("n").alias("n_shingles"), of, n_links)


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, without those that link to one that stays.

    Of each group of linked rows the one with the least id stays (null ids last, then by the
    text's hash). Rows that repeat both id and text are one; of their other columns the least
    values in the order of the columns stay. Rows without shingles link with nothing and all stay.
    """
    ledger, comp, _ = jaccard_classes(docs, width, percent)
    rows = written(ledger.filter("n > 0").groupBy("key", "doc_id", "mark").agg(F.count("*").alias("c")), "jaccard-rows")
    total = rows.count()
    classes = written(rows.groupBy("key").agg(F.count("*").alias("n")), "jaccard-classes")
    rows = written(join_spread(rows, _groups(classes, comp), ["key"], hot_keys(classes, ["key"], total, "hot-classes")).select("top", "doc_id", "mark", "c"), "jaccard-rows")
    first = written(rows.groupBy("top").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "mark")).alias("x"), F.sum("c").alias("all"), F.count("*").alias("n")), "jaccard-groups")
    stays = first.filter("all > 1").select("top", F.col("x.doc_id").alias("id"), F.col("x.mark").alias("own"))
    met = join_spread(rows, stays, ["top"], hot_keys(first, ["top"], total, "hot-groups"))
    is_it = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("own"))
    gone = met.filter(~is_it).select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_text"))
    again = met.filter(is_it & (F.col("c") > 1)).select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_text"))
    named = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), text_mark().alias("_mark"))
    at = F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_mark") == F.col("_text"))
    some = not again.isEmpty()
    left = named.join((gone.unionByName(again) if some else gone).hint("shuffle_hash"), at, "left_anti")
    out = left.select("_row.*")
    if some:
        once = named.join(again, at, "left_semi").groupBy("_id", "_mark").agg(F.min("_row").alias("_row"))
        out = out.unionByName(once.select("_row.*"))
    return out


#: The same rows of the query over documents, for an independent engine.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))]
   ELSE list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) END) AS h FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM s a JOIN s b USING (h) WHERE a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT r, r AS at FROM d UNION SELECT c.r, e.v FROM c JOIN e ON e.u = c.at),
k AS (SELECT u AS r, count(*) AS k FROM e GROUP BY u)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(f.doc_id) AS component_id, coalesce(any_value(k.k), 0)::BIGINT AS n_links
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN k ON k.r = d.r JOIN c ON c.r = d.r JOIN d f ON f.r = c.at GROUP BY d.r, d.doc_id
"""
