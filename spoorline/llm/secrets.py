"""Secret scans with an incremental ledger of blobs.

A blob is the content of a text, named by its SHA-256. scan() takes every version of every path,
scans each pair of blob and rule version that the ledger has not seen, once, appends what it
found to the ledger, and joins the findings back to all paths that ever held the blob. A second
run over old and new versions scans the new blobs only; a new rule version scans all blobs anew.

Ledger: a folder of Parquet files with columns blob, rules, spans (array of struct of kind, start,
end: code points, end exclusive). Spans of a kind never overlap. A blob without secrets has a row
with no spans, so it counts as seen.

Null text is scanned as the empty text. Empty input: no rows, the ledger stays. Rows that repeat
an id are versions of it and each gets its findings. Other columns of the input aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorline.llm.common import discard, fresh_path, written
from spoorline.llm.textcore import tidied

KINDS = ("assign", "access", "hex", "pem", "jwt", "token")
BASE = KINDS[:3]

_assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{24,}")
_pem = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
#: What parts the lines of a key: blanks, quotes, quoting marks, escaped line ends.
_PART = r"""(?:[\s"',>#*|]|\\[nrt])++"""
#: The rest of a key block without its END line: header lines, long base64 lines, a short last one that fills its line.
_body = re.compile(rf"""(?:{_PART}(?:Proc-Type|DEK-Info|Content-Domain|Version|Comment):[^\r\n\\]*+)*+(?:(?:{_PART})?[A-Za-z0-9+/]{{16,}}+={{0,2}})*+(?:(?<=[A-Za-z0-9+/])(?:\r?\n|\\n)[A-Za-z0-9+/]++={{0,2}}(?=[\r\n"'\\]|\Z))?(?:(?:{_PART})?-----END (?:[A-Z]+ )*PRIVATE KEY-----)?""")
_jwt = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_token = re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})")

Spans = list[tuple[str, int, int]]
#: Copies of a blob beyond which its text is taken from a chosen row.
HOT = 64


def spans_v1(text: str) -> Spans:
    """All secrets of a text by start, then kind."""
    out: Spans = []
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "api_key", "apikey")):
        out += [("assign", *m.span()) for m in _assign.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _access.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _hex.finditer(text)]
    if "PRIVATE KEY" in text:
        out += [("pem", *m.span()) for m in _pem.finditer(text)]
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in _jwt.finditer(text)]
    if "gh" in text or "xox" in text or "sk_live_" in text:
        out += [("token", *m.span()) for m in _token.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Private keys from their BEGIN line through the matching END line; to the end of the key body where there is none."""
    heads = list(_pem.finditer(text))
    for m, after in zip(heads, [*heads[1:], None]):
        limit = after.start() if after else len(text)
        end = m[0].replace("BEGIN", "END", 1)
        at = text.find(end, m.end(), limit)
        yield m.start(), at + len(end) if at >= 0 else _body.match(text, m.end(), limit).end()


def spans_v2(text: str) -> Spans:
    """As spans_v1(), with whole key blocks."""
    if "PRIVATE KEY" not in text:
        return spans_v1(text)
    out = [s for s in spans_v1(text) if s[0] != "pem"] + [("pem", a, b) for a, b in key_blocks(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


#: Rule versions by name: what finds the secrets of a blob.
RULES: dict[str, Callable[[str], Spans]] = {"secrets-1": spans_v1, "secrets-2": spans_v2}

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rules", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))])


def _scanner(rules: str):
    find = RULES[rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rules] * len(batch), pa.string()), pa.array(found, kind)], names=["blob", "rules", "spans"])

    return run


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at a path; a path that nothing was written to is an empty one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan(docs: DataFrame, ledger_path: str | None = None, rules: str = "secrets-2") -> DataFrame:
    """(doc_id, text) -> doc_id, blob, spans for every row; appends to the ledger.

    Without a path the ledger is a new one in the shared folder.
    """
    spark = docs.sparkSession
    old = ledger_path is not None
    ledger_path = ledger_path or fresh_path(spark, "secret-ledger")
    text = F.coalesce("text", F.lit(""))
    versions = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("blob"))
    seen = read_ledger(spark, ledger_path).filter(F.col("rules") == rules).select("blob").distinct()
    unseen = lambda rows: rows.join(seen, "blob", "left_anti") if old else rows
    # A blob of many copies is fetched from one row, chosen by its name alone: its copies move no text.
    hot = versions.groupBy("blob").agg(F.count("*").alias("n"), F.min("doc_id").alias("id")).filter(F.col("n") > HOT)
    hot = written(hot.select(F.col("blob").alias("hot"), "id"), "secret-hot")
    # Of the others one copy of each content crosses the network; copies within a task meet there first.
    few = unseen(versions.join(hot, F.col("blob") == F.col("hot"), "left_anti").select("blob", "text"))
    one = unseen(versions.join(hot, (F.col("blob") == F.col("hot")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("blob", "text"))
    first = lambda rows: rows.groupBy("blob").agg(F.first("text").alias("text"))
    first(few).unionByName(first(one)).mapInArrow(tidied(_scanner(rules)), LEDGER).write.mode("append").parquet(ledger_path)
    discard(hot)
    found = read_ledger(spark, ledger_path).filter((F.col("rules") == rules) & (F.size("spans") > 0))
    found = found.groupBy("blob").agg(F.first("spans").alias("spans"))  # a rerun after a failure may have written a blob twice
    none = F.array().cast(T.ArrayType(SPAN))
    return versions.select("doc_id", "blob").join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """scan()'s rows -> counts and digests of the base kinds, and all spans."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


MASK = "[secret]"


def redact(docs: DataFrame, ledger_path: str | None = None, rules: str = "secrets-2") -> DataFrame:
    """Replaces every secret of the texts by [secret], overlapping ones by a single one.

    Keeps all rows and columns, whatever their names; n_chars, where there is one, follows the text.
    """
    found = scan(docs, ledger_path, rules).filter(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
    # Written, so that Spark knows its size: a small list is broadcast and no text moves.
    found = written(found, "secret-blobs")
    text, spans = F.col("row.text"), F.col("spans")
    df = docs.select(F.struct("*").alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).join(found, F.col("sha") == F.col("blob"), "left")
    gap = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, s: Column) -> Column:
        head = F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(MASK))).otherwise(a["out"])
        return F.struct(head.alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    rest = lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text)))
    clean = F.when(spans.isNull(), text).otherwise(F.aggregate(spans, gap, step, rest))
    new = {"text": clean}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(spans.isNull(), F.col("row.n_chars")).otherwise(F.char_length(clean).cast("long"))
    return df.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


#: The same rows of the query over documents, for an independent engine.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT * FROM (VALUES
  ('assign', 0, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?', 6),
  ('access', 1, 'AKIA[A-Z0-9]+', '', 20), ('hex', 2, '[0-9a-f]+', '', 24), ('pem', 3, '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----', '', 1),
  ('jwt', 4, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', '', 1),
  ('token', 5, '(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})', '', 1)) v(kind, place, pattern, head, least)),
m AS (SELECT r, kind, place, head, least, regexp_extract_all(t, pattern) AS f, string_split_regex(t, pattern) AS g FROM d, k WHERE regexp_matches(t, pattern)),
x AS (SELECT r, kind, place, head, least, list_transform(f, lambda x: length(x)) AS fl, list_transform(g, lambda x: length(x)) AS gl, f, unnest(range(1, len(f) + 1)) AS i FROM m),
y AS (SELECT r, kind, place, f[i] AS s, list_sum(gl[1:i]) + coalesce(list_sum(fl[1:i - 1]), 0) AS lo, fl[i] AS n FROM x WHERE length(CASE WHEN head = '' THEN f[i] ELSE regexp_replace(f[i], head, '') END) >= least),
z AS (SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
  string_agg(kind || ':' || CAST(lo AS BIGINT) || ':' || CAST(lo + n AS BIGINT), ',' ORDER BY lo, place) FILTER (place < 3) AS base,
  string_agg(kind || ':' || CAST(lo AS BIGINT) || ':' || CAST(lo + n AS BIGINT), ',' ORDER BY lo, place) AS spans FROM y GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN z USING (r)
"""
