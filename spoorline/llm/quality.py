"""Quality rules as a bitmask ledger. DataFrame operations only.

ledger() measures every text once and evaluates every rule once; a row keeps the measurements and
one long, fails, with a bit for each rule that the text fails. Policies are versioned sets of
rules: a policy keeps a text if fails & mask is 0, so a new policy needs no new pass over text.
ablations() counts from the ledger alone, by bitwise aggregation, what each rule does in a policy.

Null and empty texts have no words and fail too_few_words. Measurements that divide by the number
of words or characters are 0 there. Rows that repeat an id are judged row by row. Other columns
of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.llm.common import SPACE, words

WINDOW = 8


#: Bit of each rule, and its test on the measurements. A bit is never given to another rule.
RULES: dict[str, tuple[int, str]] = {
    "too_few_words": (0, "n_words < 20"),
    "repeated_windows": (1, "100 * n_repeat_words > 30 * n_words"),
    "symbols": (2, "100 * n_symbols > 10 * n_words"),
    "repeated_lines": (3, "n_dup_lines >= 2 AND 100 * n_dup_lines > 40 * n_lines"),
    "word_length": (4, "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    "few_distinct_words": (5, "n_words >= 50 AND 100 * n_distinct_words < 3 * n_words"),
    "exclaiming": (6, "100 * n_exclaims > 30 * n_words"),
}
#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("too_few_words", "repeated_windows"),
    "prose-1": tuple(RULES),
}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES[r][0] for r in rules)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated(h: Column, width: int = WINDOW) -> Column:
    """Words that lie in windows of width words found at least twice; h: the words' hashes.

    Windows are compared by hash. Texts whose windows all differ end at one set of their hashes;
    only the others sort (hash, place) and add up the stretches that repeated windows cover.
    """
    last = F.size(h) - width

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get(h, i + k) for k in range(width)])

    def repeats(s: Column) -> Column:
        same = lambda e, i: F.coalesce(F.get(s, i - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["x"] == e["x"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))

    def stretch(p: Column) -> Column:
        each = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(each, F.lit(0), lambda a, b: a + b)

    def covered(g: Column) -> Column:
        s = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_let(_let(s, repeats), stretch))

    return F.when(last < 1, F.lit(0)).otherwise(_let(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window), covered))


def measures(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", text.alias("text"))
    df = df.select("doc_id", "text", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("h"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern))
    return df.select(
        "doc_id",
        F.size("h").cast("long").alias("n_words"),
        (F.char_length("text") - count(SPACE)).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated(F.col("h")).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct_words"),
        count("!").cast("long").alias("n_exclaims"),
    )


def ledger(docs: DataFrame, rules: Mapping[str, tuple[int, str]] = RULES) -> DataFrame:
    """(doc_id, text) -> measurements and fails, the bits of the rules that the text fails."""
    bits = F.lit(0).cast("long")
    for bit, test in rules.values():
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measures(docs).withColumn("fails", bits)


def judged(ledger: DataFrame, policy: str) -> DataFrame:
    """Adds kept and policy."""
    return ledger.withColumn("kept", F.col("fails").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0).withColumn("policy", F.lit(policy))


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: texts that fail it, that fail it alone, and that would be kept
    without it. Texts are first counted by their bits: at most one row for each set of bits."""
    m = mask(POLICIES[policy])
    by_bits = ledger.groupBy(F.col("fails").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = by_bits.select("bits", "n", F.inline(rules))
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    none = F.lit(0).cast("long")
    return each.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(none)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(none)).alias("failing_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(none)).alias("kept_without"),
    )


def quality(docs: DataFrame, policy: str = "prose-1") -> DataFrame:
    """(doc_id, text) -> the ledger with base_failed and kept under a policy that holds the base rules."""
    base = F.col("fails").bitwiseAND(F.lit(mask(POLICIES["base-1"])).cast("long")) != 0
    out = judged(ledger(docs), policy).withColumn("base_failed", base)
    return out.withColumn("kept", F.col("kept") & ~F.col("base_failed"))


#: The same rows of the query over documents, for an independent engine.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: md5(array_to_string(w[i:i + 7], ' ')))) AS v FROM d WHERE len(w) >= 8),
x AS (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS c FROM g),
y AS (SELECT r, i, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS s FROM x WHERE c > 1),
z AS (SELECT r, sum(s) AS n FROM y GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(dup, 0)::BIGINT AS n_dup_lines,
      coalesce(z.n, 0)::BIGINT AS n_repeat_words, len(list_distinct(w))::BIGINT AS n_distinct_words, len(regexp_extract_all(t, '!'))::BIGINT AS n_exclaims
      FROM d LEFT JOIN z USING (r) LEFT JOIN l USING (r)),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
      + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN n_dup_lines >= 2 AND 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
      + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
      + CASE WHEN n_words >= 50 AND 100 * n_distinct_words < 3 * n_words THEN 32 ELSE 0 END
      + CASE WHEN 100 * n_exclaims > 30 * n_words THEN 64 ELSE 0 END)::BIGINT AS fails FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fails & 3) <> 0 AS base_failed, fails = 0 AS kept, fails FROM f
"""
