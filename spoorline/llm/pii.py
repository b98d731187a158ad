"""Personal data: fixed patterns, and bootstrapped extraction from contexts. DataFrame operations only.

Base patterns find emails, addresses, card and phone numbers. What they find are the seeds of a
graph: instances (values) on one side, lexical patterns on the other. A pattern is one or two
words to the left, to the right or on both sides, or the nearest word beside the value's shape
(runs of digits, capitals and small letters as one each). Identifier-like tokens (with a digit) in
the same patterns are unlabelled instances. In each of ROUNDS rounds Spark scores patterns by the
share of their distinct instances that are known, as its lower confidence bound (Wilson), so that
few instances say little; patterns with few distinct seeds, or a bound below LEAST_SHARE, don't
count. An instance's score is that of the best pattern of each side, taken as independent. Values
whose score reaches CONFIDENT are identifiers too and become spans, with the kind of their seeds.

The joins by value are left to Spark, which broadcasts a side below its own size threshold only.

A span is kind, start, end in code points, end exclusive; spans of a kind don't overlap, and added
ones overlap no base match. Null text is empty. Rows that repeat an id and text get the same
spans. Empty input: no rows. Other columns of the input aren't read.

The patterns are written with possessive quantifiers and look-behinds so that Java finds the same
matches as with the plain ones in the README, in time linear in the text and without recursion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorline.llm.common import discard, written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't hold the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: An identifier-like token.
TOKEN = r"(?<![A-Za-z0-9_-])[A-Za-z_-]*+[0-9][A-Za-z0-9_-]{3,}+"
ROUNDS, LEAST_SEEDS, LEAST_SHARE, CONFIDENT, AROUND = 3, 3, 0.6, 0.8, 48
#: The quantile of the confidence bound (90 %), squared as it is used.
Z2 = 1.2816**2

FOUND = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("m", T.StringType()), T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _running(sizes: Column) -> Column:
    """For each element the sum of those before it; by blocks, so long arrays stay cheap."""
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda x, y: x + y)

    def by_blocks(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / 64).cast("int")), lambda b: total(F.slice(s, b * 64 + 1, F.lit(64))))
        before = _let(blocks, lambda x: F.transform(x, lambda _, i: total(F.slice(x, F.lit(1), i))))
        return _let(before, lambda p: F.transform(s, lambda _, i: F.get(p, F.floor(i / 64).cast("int")) + total(F.slice(s, (F.floor(i / 64) * 64 + 1).cast("int"), i % 64))))

    return _let(sizes, by_blocks)


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches of a pattern that never matches nothing: FOUND.

    The pieces between matches give their places; each piece is measured once.
    """

    def placed(x: Column) -> Column:
        gaps, found = x["gaps"], x["found"]
        length = lambda c: F.char_length(c).cast("long")
        sizes = F.transform(found, lambda m, i: length(F.get(gaps, i)) + length(m))

        def spans(before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                begin = F.get(before, i) + length(F.get(gaps, i))
                return F.struct(begin.alias("start"), (begin + length(m)).alias("end"), m.alias("m"), F.right(F.get(gaps, i), F.lit(AROUND)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(AROUND)).alias("right"))

            return F.transform(found, one)

        return F.when(F.size(found) == 0, F.array().cast(FOUND)).otherwise(_let(_running(sizes), spans))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return _let(both, placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits' check sum fits: from the right, every second one doubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    hint = F.instr(text, "@") > 0 if kind == "email" else text.rlike(HINTS[kind])
    return F.when(hint, F.filter(matches(text, PATTERNS[kind]), lambda s: _holds(kind, s["m"]))).otherwise(F.array().cast(FOUND))


def _blanked(text: Column) -> Column:
    """The text with its base spans made spaces, at the same places; other matches stay as they are."""
    letters = lambda t: F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))

    def without(kind: str) -> Column:
        pattern = PATTERNS[kind]
        x = F.struct(F.split(text, pattern, -1).alias("gaps"), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(m.alias("m"), _holds(kind, m).alias("holds"))).alias("found"))
        over = lambda f: F.coalesce(F.when(f["holds"], F.repeat(F.lit(" "), F.char_length(f["m"]))).otherwise(f["m"]), F.lit(""))
        blank = _let(x, lambda x: F.when(F.exists(x["found"], lambda f: f["holds"]), F.array_join(F.transform(x["gaps"], lambda g, i: F.concat(g, over(F.get(x["found"], i)))), "")))
        return F.when(F.instr(text, "@") > 0 if kind == "email" else text.rlike(HINTS[kind]), blank)

    def both(p: Column) -> Column:
        """Spans of several kinds may overlap: a place is blank where it is for any of them."""
        either = lambda a, x: F.zip_with(a, letters(x), lambda c, d: F.when(c == " ", c).otherwise(d))
        return F.array_join(F.aggregate(F.slice(p, F.lit(2), F.size(p)), letters(F.get(p, 0)), either), "")

    return _let(F.array_compact(F.array(*map(without, KINDS))), lambda p: F.when(F.size(p) == 0, text).when(F.size(p) == 1, F.get(p, 0)).otherwise(both(p)))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> a row for each base match and token: doc, text's hash, kind (null: token), place, value, patterns."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", text.alias("text")).filter(F.col("text").rlike("[0-9@]"))

    def tagged(spans: Column, kind: str | None) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(kind).cast("string").alias("kind"), s.alias("s")))

    kinds = [tagged(base_spans(F.col("text"), k), k) for k in KINDS]
    tokens = tagged(matches(_blanked(F.col("text")), TOKEN), None)
    rows = df.select("doc_id", F.md5("text").alias("sha"), F.explode(F.concat(*kinds, tokens)).alias("o")).select("doc_id", "sha", "o.kind", "o.s.*")
    word = lambda c, p: F.regexp_replace(F.regexp_extract(F.lower(c), p, 1), r"[^\p{L}]", "")
    l1, l2 = word(F.col("left"), r"(\S+)\s*$"), word(F.col("left"), r"(\S+)\s+\S+\s*$")
    r1, r2 = word(F.col("right"), r"^\s*(\S+)"), word(F.col("right"), r"^\s*\S+\s+(\S+)")
    shape = F.col("m")
    for run, one in (("[0-9]+", "9"), ("[A-Z]+", "A"), ("[a-z]+", "a")):
        shape = F.regexp_replace(shape, run, one)
    named = lambda tag, *parts: F.when(reduce(lambda a, b: a & b, [p != "" for p in parts]), F.concat_ws(" ", F.lit(tag), *parts))
    patterns = [named("around", l1, r1), named("left", l1), named("left2", l2, l1), named("left-shape", l1, shape), named("right", r1), named("right2", r1, r2), named("right-shape", r1, shape)]
    return rows.select("doc_id", "sha", "kind", "start", "end", F.col("m").alias("value"), F.array_compact(F.array(*patterns)).alias("patterns"))


def share_bound(known: Column, n: Column) -> Column:
    """The lower confidence bound of a share of known among n."""
    p = known / n
    return (p + Z2 / 2 / n - F.sqrt(F.lit(Z2)) * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n + Z2 / 4 / n / n)) / (1 + Z2 / n)


def discovered(seen: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, confident: float = CONFIDENT) -> DataFrame:
    """Occurrences -> (value, kind, score) of values that only their patterns give away."""
    links = written(seen.select("value", F.explode("patterns").alias("pattern")).distinct(), "pii-graph")
    sizes = links.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = seen.filter("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0)).withColumn("seed", F.lit(1))
    seeds = written(seeds, "pii-seeds")
    known = seeds
    for _ in range(rounds):
        # Sums within tasks come first, so a very common pattern is a row for each task.
        scored = links.join(known, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.sum("seed").alias("c"))
        good = scored.filter(F.col("c") >= least_seeds).join(sizes, "pattern").withColumn("p", share_bound(F.col("s"), F.col("n"))).filter(F.col("p") >= LEAST_SHARE)
        side = F.regexp_extract("pattern", "^(around|left|right)", 1).alias("side")
        best = links.join(good.select("pattern", "kind", "p"), "pattern").groupBy("value", "kind", side).agg(F.max("p").alias("p"))
        found = best.groupBy("value", "kind").agg((1 - F.product(1 - F.col("p"))).alias("score"))
        best = found.groupBy("value").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("b")).select("value", "b.kind", "b.score", F.lit(0).alias("seed"))
        after = written(best.join(seeds.select("value"), "value", "left_anti").unionByName(seeds), "pii-known")
        if known is not seeds:
            discard(known)
        known = after
    out = written(known.filter((F.col("seed") == 0) & (F.col("score") >= confident)).select("value", "kind", "score"), "pii-found")
    discard(links, seeds, known)
    return out


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, sha (md5 of the text), base and more: arrays of kind, start, end."""
    text = F.coalesce("text", F.lit(""))
    seen = written(occurrences(docs), "pii-seen")
    extra = seen.filter("kind IS NULL").drop("kind").join(discovered(seen), "value")
    span = F.struct("kind", "start", "end")
    key = ["doc_id", "sha"]
    # The spans of one text meet in one row, as the result has them; they are a small part of it.
    base = seen.filter("kind IS NOT NULL").groupBy(*key).agg(F.collect_set(span).alias("base"))
    more = extra.groupBy(*key).agg(F.collect_set(span).alias("more")).toDF("id2", "sha2", "more")
    both = base.join(more, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("sha") == F.col("sha2")), "full")
    both = both.select(F.coalesce("doc_id", "id2").alias("of"), F.coalesce("sha", "sha2").alias("of_sha"), "base", "more")
    df = docs.select("doc_id", F.md5(text).alias("sha"))
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")
    out = df.join(both, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("sha") == F.col("of_sha")), "left")
    return out.select("doc_id", "sha", F.coalesce("base", none).alias("base"), F.coalesce("more", none).alias("more"))


def digest(found: DataFrame) -> DataFrame:
    """personal_data()'s rows -> counts and digests of base spans, all spans, and how many they are."""
    place = F.expr("map('email', 0, 'ip', 1, 'card', 2, 'phone', 3)")
    ranked = lambda a: F.sort_array(F.transform(a, lambda s: F.struct(F.try_element_at(place, s["kind"]).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    base, every = ranked(F.col("base")), ranked(F.concat("base", "more"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))
