"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of a text.

A line is a paragraph. Its leaves end after a stop (. ! ?), after a blank behind one of the
letters of CUT, and, where neither comes, after 256 characters; so leaves are cut by content, and
an edit moves the cuts near it only. Paragraphs form sections; a section ends after an empty line
and after every paragraph whose hash is divisible by 4. Each node's hash is taken over its
children's, the root's over the sections' and the text's length and own hash. Equal roots so mean
equal texts, and where two trees differ, only the differing branches hold edits.

The fingerprint of a text is a string: the root, then for each section | and its hash, then for
each of its paragraphs ; with its hash and its leaves'. likeness() descends two fingerprints:
equal roots are 1, and only those; sections of equal hash are alike as a whole, then paragraphs
of equal hash in what is left, then leaves; the share of leaves that are alike, by number, of the
longer text's. differing() descends the same way and names the paragraphs that differ.

Null text is the empty text, whose tree is a root alone. Rows that repeat an id, and rows with a
null id, are documents of their own; they follow each other in the order of their texts' hashes,
null ids last. Empty input: no rows. Other columns of the input aren't read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.common import partitions
from spoorline.llm.textcore import tidied

#: Letters behind which a blank ends a leaf.
CUT = "lmz"
_end = re.compile(rf"\n|[.!?]+[ \t]*|(?<=[{CUT}])[ \t]+")
LONGEST, LEAF, NODE, ROOT = 256, 3, 6, 16
#: Bytes of texts of a range of ids about.
RANGE = 64 << 20


def _hash(data: bytes, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


Section = tuple[str, list[tuple[str, list[str]]]]


def tree(text: str) -> tuple[str, list[Section]]:
    """The root's hash, and for each section its hash and its paragraphs: hash and leaf hashes."""
    raw = text.encode("utf-8", "surrogatepass")
    sections: list[Section] = []
    paragraphs: list[tuple[str, list[str]]] = []
    leaves: list[str] = []
    blake = hashlib.blake2b

    def close_section() -> None:
        nonlocal paragraphs
        if paragraphs:
            sections.append((_hash("".join(h for h, _ in paragraphs).encode(), NODE).hex(), paragraphs))
            paragraphs = []

    def close_paragraph() -> None:
        nonlocal leaves
        h = _hash("".join(leaves).encode(), NODE)
        paragraphs.append((h.hex(), leaves))
        if not leaves or h[0] % 4 == 0:
            close_section()
        leaves = []

    def leaf(lo: int, hi: int) -> None:
        for at in range(lo, hi, LONGEST):
            leaves.append(blake(text[at : min(at + LONGEST, hi)].encode("utf-8", "surrogatepass"), digest_size=LEAF).hexdigest())

    at = 0
    for m in _end.finditer(text):
        if text[m.start()] == "\n":
            leaf(at, m.start())
            close_paragraph()
        else:
            leaf(at, m.end())
        at = m.end()
    leaf(at, len(text))
    if leaves:
        close_paragraph()
    close_section()
    root = _hash("".join(h for h, _ in sections).encode() + len(text).to_bytes(8, "big") + _hash(raw, ROOT), ROOT).hex()
    return root, sections


def written_out(root: str, sections: list[Section]) -> str:
    return "|".join([root, *(";".join([h, *(p + "".join(x) for p, x in paragraphs)]) for h, paragraphs in sections)])


def fingerprint(text: str) -> str:
    return written_out(*tree(text))


def _sections(fp: str) -> list[list[str]]:
    """Of a fingerprint each section's hash, then its paragraphs."""
    return [s.split(";") for s in fp.split("|")[1:]]


def _n_leaves(paragraph: str) -> int:
    return (len(paragraph) - 2 * NODE) // (2 * LEAF)


def _leaves(paragraphs: list[str]) -> Counter:
    k = 2 * LEAF
    return Counter(p[i : i + k] for p in paragraphs for i in range(2 * NODE, len(p), k))


def _left(x: list, y: list, name) -> tuple[list, list]:
    """What of either list the other has not, by name, as multisets; in order."""
    a, b = Counter(map(name, x)), Counter(map(name, y))
    both = a & b

    def rest(items: list) -> list:
        same, out = both.copy(), []
        for i in items:
            if same[name(i)] > 0:
                same[name(i)] -= 1
            else:
                out.append(i)
        return out

    return rest(x), rest(y)


def likeness(a: str, b: str) -> float:
    """Leaves alike over all leaves of the longer text; 1 for equal roots alone."""
    if a[: 2 * ROOT] == b[: 2 * ROOT]:
        return 1.0
    x, y = _sections(a), _sections(b)
    size = lambda sections: sum(_n_leaves(p) for s in sections for p in s[1:])
    most = max(size(x), size(y))
    if not most:
        return 0.0
    p, q = _left(x, y, lambda s: s[0])
    p, q = _left([i for s in p for i in s[1:]], [i for s in q for i in s[1:]], lambda i: i)
    left = sum(map(_n_leaves, p))
    alike = size(x) - left + (_leaves(p) & _leaves(q)).total()
    return min(alike / most, 0.999999)


def differing(a: str, b: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The paragraphs of either fingerprint, by section and place in it, that the other doesn't have."""
    if a[: 2 * ROOT] == b[: 2 * ROOT]:
        return [], []
    x, y = ([(i, s) for i, s in enumerate(_sections(f))] for f in (a, b))
    p, q = _left(x, y, lambda s: s[1][0])
    of = lambda sections: [((i, k), h) for i, s in sections for k, h in enumerate(s[1:])]
    p, q = _left(of(p), of(q), lambda h: h[1])
    return [at for at, _ in p], [at for at, _ in q]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, root, sections: hash, and paragraphs with hash and leaf hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("hash", pa.string()), ("paragraphs", pa.list_(pa.struct([("hash", pa.string()), ("leaves", pa.list_(pa.string()))])))]))
        for batch in batches:
            trees = [tree(t or "") for t in batch.column(1).to_pylist()]
            rows = [[{"hash": h, "paragraphs": [{"hash": g, "leaves": x} for g, x in p]} for h, p in s] for _, s in trees]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r for r, _ in trees], pa.string()), pa.array(rows, kind)], names=["doc_id", "root", "sections"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, root string, sections array<struct<hash: string, paragraphs: array<struct<hash: string, leaves: array<string>>>>>")


# ---- a document beside the next in descending order of ids ----------------------------------

EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_text(text: str, follower: str) -> str:
    """The last half (rounded down) replaced by as much of the start of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, doc_id, text, borrowed), sorted: borrowed rows serve as the next of the last."""
    names = [x.split()[0] for x in EDITED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None
    for batch in batches:
        rows = []
        for place, doc_id, text, borrowed in zip(*(c.to_pylist() for c in batch.columns)):
            text = text or ""
            now = fingerprint(text)
            if held is not None and held[0] == place:
                _, of, t, fp = held
                new = edited_text(t, text)
                efp = fingerprint(new)
                rows.append((of, len(t), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fp, efp, likeness(fp, efp), likeness(fp, now)))
            held = None if borrowed else (place, doc_id, text, now)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _range_of(splitters: np.ndarray):
    """Of rows (down, tie) the range that each lies in: the last splitter at or before it."""

    @F.pandas_udf("int")
    def place(down: pd.Series, tie: pd.Series) -> pd.Series:
        keys = np.empty(len(down), splitters.dtype)
        keys["down"], keys["tie"] = down, tie
        return pd.Series(np.maximum(np.searchsorted(splitters, keys, "right") - 1, 0).astype(np.int32))

    return place("down", "tie")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> EDITED for each row beside the next one; after the last comes the first.

    Ranges of ids (and, where many rows share one, of their texts' hashes) hold about RANGE bytes.
    Their splitters come from Spark's range partitioning of ids and hashes alone; each is a row's
    own key, the first of its range, and all of them come to the driver: 16 bytes a range. Ranges
    are sorted where they lie, and each borrows the first row of the next one, so every text moves
    once and a range's last row finds its next.
    """
    spark = docs.sparkSession
    # ~x orders as -x does and fits for every long; a null id comes after all others.
    down = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(2**63 - 1).cast("long"))
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", down.alias("down"), tie.alias("tie"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), math.ceil(size / RANGE))
    slim = df.select("down", "tie").repartitionByRange(n, "down", "tie").withColumn("p", F.spark_partition_id())
    firsts = sorted(tuple(r["x"]) for r in slim.groupBy("p").agg(F.min(F.struct("down", "tie")).alias("x")).collect())  # a row for each range
    if not firsts:
        return spark.createDataFrame([], EDITED)
    splitters = np.array(firsts, dtype=[("down", np.int64), ("tie", np.int64)])
    df = df.withColumn("place", _range_of(splitters))
    k = len(firsts)
    heads = spark.createDataFrame([(*first, (i - 1) % k) for i, first in enumerate(firsts)], "d long, t long, to int")
    lent = df.join(F.broadcast(heads), (F.col("down") == F.col("d")) & (F.col("tie") == F.col("t"))).dropDuplicates(["to"])
    lent = lent.select(F.col("to").alias("place"), "doc_id", "text", F.lit(True).alias("borrowed"), "down", "tie")
    own = df.select("place", "doc_id", "text", F.lit(False).alias("borrowed"), "down", "tie")
    dealt = own.unionByName(lent).repartitionById(k, "place").sortWithinPartitions("place", "borrowed", "down", "tie")
    return dealt.select("place", "doc_id", "text", "borrowed").mapInArrow(tidied(_pairs), EDITED)
