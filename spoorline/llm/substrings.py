"""Exact removal of long repeated substrings by sorting suffixes, and passages that documents share.

Every byte goes that is covered by a string of 400 bytes that also starts anywhere else. Sorting
all suffixes of the corpus would move each text hundreds of times, so the order is built on tokens:

1. Leading tokens. Every 400-byte window names its anchor, the 100 bytes in it with the least
   hash. Equal windows have equal anchors at equal offsets, so the anchor serves as the leading
   token of the window's suffix. Windows whose leading token is found once repeat nowhere.
2. Runs of windows that share an anchor occurrence are compared as a whole first: a run that is
   found twice is covered. Only runs with equal tokens but different content go on, as bytes.
3. Splitters sampled by Spark range-partition these runs by leading token. Each bucket sorts its
   windows as token sequences (anchor, offset, four hashes of 100 bytes) by multikey quicksort:
   token by token, going on only within ties. Neighbours that tie to the end are repeats.
4. A token in more than HOT different runs would be one bucket's; its windows become rows that
   are range-partitioned by all tokens and, as the last, by text. Such a bucket's border can fall
   between equal windows, so the first and last windows of neighbouring buckets are compared.

The same order over words in place of bytes finds passages: strings of 51 words that another
document has too. They are counted only (n_passage_words), for a passage of some fifty words is
shorter than 400 bytes in most languages, and what is removed is judged by bytes.

Equality of 100-byte strings (17 words) is that of 64-bit hashes. Texts are UTF-8 bytes; matches
never cross texts. Null text is empty; texts under 400 bytes keep everything. Rows that repeat a
text count as occurrences each, but cost one text in each batch that holds them; rows that repeat
an id are rows (and documents) of their own. Empty input: no rows. Other columns of the input
aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm import textcore as tc
from spoorline.llm.anchors import anchors
from spoorline.llm.common import discard, hot_keys, join_spread, partitions, sweep, written

LENGTH, GRAM = 400, 100
#: Words of a passage, of its tokens, and of its anchors.
PASSAGE, PHRASE, ANCHOR = 51, 17, 8
#: Bytes of texts whose runs are found together: each takes some 150 bytes of memory meanwhile.
SLAB = 256 << 10
#: Different runs of one leading token that a single task takes.
HOT = 2000


class Kind(NamedTuple):
    """What strings are made of: their length, that of their tokens and of their anchors; across:
    only those count that another text has."""

    length: int
    gram: int
    anchor: int
    words: bool = False
    across: bool = False

    def units(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units of texts laid end to end, and the texts' bounds among them."""
        return tc.word_numbers(raw, bounds) if self.words else (raw, bounds)

    def read(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.uint64 if self.words else np.uint8)

    @property
    def columns(self) -> list[str]:
        return ["h", "d", *(f"g{k}" for k in range(self.length // self.gram))]


def byte_kind() -> Kind:
    return Kind(LENGTH, GRAM, GRAM)


def word_kind() -> Kind:
    return Kind(PASSAGE, PHRASE, ANCHOR, words=True, across=True)


def _runs(kind: Kind):
    """(text, t) -> the runs of windows of each batch's texts: h (anchor's hash), ch (content), t,
    a, s0, s1, n (copies of the text in the batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.asarray(batch.column(1), np.int64)
            ids, first, times = np.unique(every, return_index=True, return_counts=True)
            where = np.sort(first)
            number = times[np.searchsorted(ids, every[where])]
            for lo, _, data, bounds in tc.slabs(batch.column(0).take(pa.array(where)), SLAB):
                x, at = kind.units(data, bounds)
                a, h, s0, s1 = anchors(x, kind.length, kind.anchor, at)
                if not len(a):
                    continue
                c, down = tc.prefix_hashes(x)
                end = s1 + kind.length
                ch = tc.mix((c[end] - c[s0]) * down[s0] + (end - s0).astype(np.uint64))
                of = np.searchsorted(at, s0, "right") - 1
                base, doc = at[of], where[lo + of]
                cols = [h.view(np.int64), ch.view(np.int64), every[doc], number[lo + of], *((p - base).astype(np.int32) for p in (a, s0, s1))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["h", "ch", "t", "n", "a", "s0", "s1"])

    return run


CUT = "h long, v long, alone boolean, t long, a int, s0 int, bytes binary"


def _cut(kind: Kind):
    """(t, text, runs) -> the bytes (or words' numbers) of each run; a counts from the run's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                rows: list[tuple] = []
                part = batch.slice(lo, 64)
                for t, text, runs in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist()):
                    raw = np.frombuffer(text.as_buffer(), np.uint8)
                    x, _ = kind.units(raw, np.array([0, len(raw)]))
                    for r in runs:
                        rows.append((r["h"], r["v"], not r["many"], t, r["a"] - r["s0"], r["s0"], x[r["s0"] : r["s1"] + kind.length].tobytes()))
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=["h", "v", "alone", "t", "a", "s0", "bytes"])

    return run


def _windows(kind: Kind, h: np.ndarray, a: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of runs: each window's run, its start there, and its tokens."""
    units = kind.read(b"".join(raw))
    size = np.array([len(x) for x in raw], np.int64) // units.itemsize
    base = np.concatenate(([0], np.cumsum(size)))
    n = size - kind.length + 1
    run = np.repeat(np.arange(len(raw)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    c, down = tc.prefix_hashes(units)
    at = base[run] + start
    grams = []
    for k in range(kind.length // kind.gram):
        x = at + k * kind.gram
        grams.append(tc.mix((c[x + kind.gram] - c[x]) * down[x]))
    return run, start, [h[run].view(np.uint64), (a[run] - start).astype(np.uint64), *grams]


def multikey_ties(tokens: list[np.ndarray], owner: np.ndarray | None = None) -> np.ndarray:
    """Places of the token sequences that occur more than once; with owners, for more than one owner.

    Sorts by the first token, then each stretch of ties by the next one; what stands alone leaves.
    """
    live = np.arange(len(tokens[0]))
    part = np.zeros(len(live), np.int64)
    for token in tokens:
        x = token[live]
        order = np.lexsort((x, part))
        live, x, part = live[order], x[order], part[order]
        new = np.ones(len(live), bool)
        new[1:] = (x[1:] != x[:-1]) | (part[1:] != part[:-1])
        part = np.cumsum(new)
        tied = np.bincount(part)[part] > 1
        live, part = live[tied], part[tied]
    if owner is not None and len(live):
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        o = owner[live]
        several = np.minimum.reduceat(o, cut) != np.maximum.reduceat(o, cut)
        live = live[np.repeat(several, np.diff(np.append(cut, len(live))))]
    return live


def _stretches(t: np.ndarray, s: np.ndarray, length: int) -> pa.RecordBatch:
    """Sorted windows (text, start) -> the stretches that they cover."""
    new = np.ones(len(s), bool)
    new[1:] = (t[1:] != t[:-1]) | (s[1:] > s[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    last = last[: len(first)]
    return pa.RecordBatch.from_arrays([pa.array(t[first]), pa.array(s[first].astype(np.int32)), pa.array((s[last] + length).astype(np.int32))], names=["t", "lo", "hi"])


SPAN = "t long, lo int, hi int"


def _sorted_bucket(kind: Kind):
    """Runs in the order of their leading tokens -> repeated stretches; equal tokens stay together."""

    def solved(rows: pa.Table) -> pa.RecordBatch:
        h, a, t, s0 = (np.asarray(rows.column(k)).astype(np.int64) for k in ("h", "a", "t", "s0"))
        alone = np.asarray(rows.column("alone"))
        run, start, tokens = _windows(kind, h, a, rows.column("bytes").to_pylist())
        hit = multikey_ties(tokens, t[run] if kind.across else None)
        hit = hit[alone[run[hit]]]
        text, place = t[run[hit]], s0[run[hit]] + start[hit]
        order = np.lexsort((place, text))
        return _stretches(text[order], place[order], kind.length)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            if len(rows) < 2 * HOT:
                continue
            h = np.asarray(rows.column("h"))
            done = int(np.searchsorted(h, h[-1]))  # the last token may go on in the next batch
            if done:
                for lo in _token_cuts(h[:done]):
                    yield solved(rows.slice(*lo))
                held = rows.slice(done).to_batches()
            else:
                held = rows.to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            for lo in _token_cuts(np.asarray(rows.column("h"))):
                yield solved(rows.slice(*lo))

    return bucket


def _token_cuts(h: np.ndarray, most: int = HOT) -> Iterator[tuple[int, int]]:
    """Slices (start, length) of about most rows that don't part equal tokens."""
    lo = 0
    while lo < len(h):
        hi = min(lo + most, len(h))
        if hi < len(h):
            hi = int(np.searchsorted(h, h[hi - 1], "right"))
        yield lo, hi - lo
        lo = hi


def _hot_row(kind: Kind) -> str:
    return ", ".join(f"{c} long" for c in kind.columns) + ", t long, s int, alone boolean"


def _hot_windows(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                h, a, t, s0 = (np.asarray(part.column(k)).astype(np.int64) for k in ("h", "a", "t", "s0"))
                of, start, tokens = _windows(kind, h, a, part.column("bytes").to_pylist())
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in tokens), pa.array(t[of]), pa.array((s0[of] + start).astype(np.int32)), pa.array(np.asarray(part.column("alone"))[of])], names=[*kind.columns, "t", "s", "alone"])

    return run


def _hot_bucket(kind: Kind):
    """Sorted windows of a bucket -> those that tie with a neighbour, and both borders of the bucket."""
    columns = kind.columns
    names = [*columns, "t", "s", "alone", "place", "border"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        before: pa.RecordBatch | None = None  # the last row so far, and whether it tied
        tied = False
        ends = []
        first = True

        def out(rows, border: int):
            n = len(rows)
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array([place] * n, pa.int32()), pa.array([border] * n, pa.int32())], names=names)

        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([np.asarray(batch.column(c)) for c in columns])
            same = (key[:, 1:] == key[:, :-1]).all(axis=0)
            hit = np.zeros(len(batch), bool)
            hit[1:] |= same
            hit[:-1] |= same
            if before is not None and all(before.column(c)[0].as_py() == batch.column(c)[0].as_py() for c in columns):
                hit[0] = True
                if not tied:
                    yield out(before, 0)
            if first:
                ends.append((batch.slice(0, 1), 1))
                first = False
            yield out(batch.filter(pa.array(hit)), 0)
            before, tied = batch.slice(len(batch) - 1, 1), bool(hit[-1])
        if before is not None:
            ends.append((before, 2))
        for row, border in ends:
            yield out(row, border)

    return run


def _hot_spans(runs: DataFrame, kind: Kind) -> DataFrame:
    spark = runs.sparkSession
    columns, row = kind.columns, _hot_row(kind)
    by = [*columns, "t", "s"]
    rows = runs.select("h", "a", "t", "s0", "alone", "bytes").mapInArrow(_hot_windows(kind), row)
    dealt = rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)
    met = written(dealt.mapInArrow(_hot_bucket(kind), row + ", place int, border int"), "hot-windows")
    ends = met.filter("border > 0").orderBy("place", "border").collect()  # two rows for each bucket
    tie = [tuple(r[c] for c in [*by, "alone"]) for x, y in zip(ends, ends[1:]) if x["place"] != y["place"] and all(x[c] == y[c] for c in columns) for r in (x, y)]
    hits = met.filter("border = 0").select(*by, "alone").unionByName(spark.createDataFrame(tie, row))
    if kind.across:
        several = hits.groupBy(*columns).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo != hi").select(*columns)
        hits = hits.join(several, columns)
    return hits.filter("alone").select("t", "s").distinct().select("t", F.col("s").alias("lo"), (F.col("s") + kind.length).alias("hi"))


def repeated_spans(docs: DataFrame, kind: Kind | None = None) -> DataFrame:
    """(text) -> t (xxhash64 of a text), spans: stretches lo, hi to remove (or of passages), for texts that have any.

    Copies of a whole text count as repeats by bytes; with kind.across only other texts' do.
    """
    kind = kind or byte_kind()
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(text.alias("text"), F.xxhash64(text).alias("t"))
    runs = written(texts.mapInArrow(tc.tidied(_runs(kind)), "h long, ch long, t long, n long, a int, s0 int, s1 int"), "suffix-runs")
    # Most leading tokens are found once; what is left of the runs after them is small.
    tokens = runs.groupBy("h").agg(F.sum("n").alias("c"), F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high"))
    tokens = written(tokens.filter("low != high" if kind.across else "c > 1").select("h", "n"), "suffix-tokens")
    shared = written(join_spread(runs, tokens.select("h"), ["h"], hot_keys(tokens, ["h"], runs.count(), "hot-tokens"), "left_semi"), "suffix-shared")
    discard(runs, tokens)
    # Within tasks equal runs are counted first, so a very common one is a row for each task.
    kinds = shared.groupBy("h", "ch").agg(F.sum("n").alias("c"), F.min(F.struct("t", "s0")).alias("one"), F.min("t").alias("low"), F.max("t").alias("high"))
    many = (F.col("low") != F.col("high")) if kind.across else (F.col("c") > 1)
    kept = written(kinds.select("h", "ch", "one", many.alias("many")).join(kinds.groupBy("h").agg(F.count("*").alias("v")), "h"), "suffix-kinds")
    seen = shared.drop("n").join(kept, ["h", "ch"])
    # Of runs found twice all are covered; one stands for them where others share their token.
    whole = seen.filter("many").select("t", F.col("s0").alias("lo"), (F.col("s1") + kind.length).alias("hi"))
    asked = seen.filter("v > 1 AND (NOT many OR (t = one.t AND s0 = one.s0))")
    lists = asked.groupBy("t").agg(F.collect_set(F.struct("h", "v", "many", "a", "s0", "s1")).alias("runs"))
    once = texts.join(lists.select("t").hint("shuffle_hash"), "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    cut = written(once.join(lists, "t").select("t", "text", "runs").mapInArrow(tc.tidied(_cut(kind)), CUT), "suffix-bytes")
    few = cut.filter(F.col("v") <= HOT)
    dealt = few.repartitionByRange(partitions(docs.sparkSession), "h").sortWithinPartitions("h")
    spans = whole.unionByName(dealt.mapInArrow(tc.tidied(_sorted_bucket(kind)), SPAN)).unionByName(_hot_spans(cut.filter(F.col("v") > HOT), kind))
    found = written(spans.groupBy("t").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "suffix-spans")
    discard(shared, kept, cut)
    sweep(docs.sparkSession)
    return found


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Stretches that overlap or touch, as one; in order."""
    out: list[list[int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans, passages, copied) -> RESULT."""
    for batch in batches:
        rows = []
        for doc_id, text, spans, passages, copied in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(k).to_pylist() for k in (2, 3, 4))):
            raw = text.as_buffer().to_pybytes()
            gone = merged(spans or [])
            at, sha = 0, hashlib.sha256()
            for lo, hi in gone:
                sha.update(raw[at:lo])
                at = hi
            sha.update(raw[at:])
            if copied:  # another document has the whole text
                n = len(tc.word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])
                shared = n if n >= PASSAGE else 0
            else:
                shared = sum(b - a for a, b in merged(passages or []))
            rows.append((doc_id, len(raw), sum(b - a for a, b in gone), len(gone), sha.hexdigest(), shared))
        kinds = [*[pa.int64()] * 4, pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=[x.split()[0] for x in RESULT.split(", ")])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> RESULT for each row; n_passage_words: its words within strings of PASSAGE
    words that another document has too."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))
    none = F.lit(None)
    spans, passages = repeated_spans(docs), repeated_spans(docs, word_kind())
    kind = spans.schema["spans"].dataType
    copied = written(rows.groupBy("t").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-copies")
    each = spans.select("t", "spans", none.cast(kind).alias("passages"), none.cast("boolean").alias("copied"))
    each = each.unionByName(passages.select("t", none.cast(kind).alias("spans"), F.col("spans").alias("passages"), none.cast("boolean").alias("copied")))
    each = each.unionByName(copied.select("t", none.cast(kind).alias("spans"), none.cast(kind).alias("passages"), F.lit(True).alias("copied")))
    one = lambda c: F.first(c, ignorenulls=True).alias(c)
    found = written(each.groupBy("t").agg(one("spans"), one("passages"), one("copied")), "suffix-found")
    discard(spans, passages)
    out = join_spread(rows, found.hint("shuffle_hash"), ["t"], hot_keys(copied, ["t"], docs.count(), "hot-texts"), "left")
    return out.select("doc_id", "text", "spans", "passages", F.coalesce("copied", F.lit(False)).alias("copied")).mapInArrow(tc.tidied(_kept), RESULT)
