"""URL filters: rules for hosts and paths, and two character models for all other URLs.

A rule names a host, which it fits with all subdomains, and the start of a path; the longest that
fits decides. The URLs that rules decide are the labelled ones: accepted and rejected. For either
label a variable-order Markov model holds how often each character followed each context of up to
six characters, smoothed by backing off from longer contexts to shorter ones (Witten-Bell, to the
uniform distribution over all code points at last). A URL's score is the difference of its
log-likelihoods under the two models divided by its length. The threshold is calibrated on every
fourth labelled URL, in the order of their hashes, which the models haven't seen: of all cuts
between two of their scores the one with the best mean of both labels' shares of right verdicts,
the nearest to 0 among equals; 0 if a label has none.

All labelled URLs are counted or calibrated on, a URL that several pages have once. Digits count as
one character, so page numbers aren't learned, and URLs that differ in digits alone are one shape.
Spark counts the characters after each context of all shapes, computes the probabilities that the
shapes to judge need from the shortest contexts to the longest, and adds up their logarithms for
each shape; the cuts are counted range by range. The driver gets the sums of each range and the
threshold, and no task holds a model. Filter is the same for lists of URLs in memory.

Null urls and urls without :// have empty host and path; no rule fits them, and the models judge
them by their text (empty: score 0). A label without URLs has the uniform model. Empty input: no
rows. Repeated rows get the same verdict. Other columns of the input aren't read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.llm.common import ascii_lower, discard, hot_keys, join_spread, partitions, sweep, written

#: (verdict, host, path) of the fixed rules.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 6
#: Code points there are.
ALPHABET = 0x110000
#: Strings that a task counts or lists before it hands them on.
HELD = 100_000
#: Log-likelihoods are added as whole multiples of its reciprocal, so that sums don't depend on order.
UNIT = 1 << 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, url) -> page_id, url, host, path, rule, verdict; the last two null if no rule fits."""
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones override
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return df.select("*", rule.alias("rule"), verdict.alias("verdict"))


def shape(url: str) -> str:
    """What the models see: the URL without its scheme, every run of digits one 0."""
    return re.sub(r"[0-9]+", "0", url.split("://", 1)[-1])


def shaped(url: Column) -> Column:
    """shape() as a column; null: empty."""
    at, url = F.locate("://", url), F.coalesce(url, F.lit(""))
    return F.regexp_replace(F.when(at > 0, F.substr(url, at + 3)).otherwise(url), "[0-9]+", "0")


def windows(seen: str, order: int = ORDER) -> Iterator[str]:
    """Each character of a shape, and its end, after its context."""
    s = "\x02" + seen + "\x03"
    return (s[max(0, i - order) : i + 1] for i in range(1, len(s)))


class Markov:
    """Counts of characters after contexts of up to order characters."""

    def __init__(self, urls: Sequence[str], order: int = ORDER):
        self.order = order
        self.next: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for url in urls:
            for w in windows(shape(url), order):
                for k in range(len(w)):
                    self.next[w[k:-1]][w[-1]] += 1
        self.next = {c: dict(n) for c, n in self.next.items()}
        self.total = {c: sum(n.values()) for c, n in self.next.items()}

    def probability(self, context: str, char: str) -> float:
        p = 1.0 / ALPHABET
        for k in range(len(context) + 1):
            c = context[len(context) - k :]
            n = self.next.get(c)
            if n is None:
                break
            kinds, total = len(n), self.total[c]
            p = (n.get(char, 0) + kinds * p) / (total + kinds)
        return p

    def log_likelihood(self, url: str, seen: dict) -> float:
        out = 0.0
        for key in windows(shape(url), self.order):
            x = seen.get(key)
            if x is None:
                if len(seen) > 500_000:
                    seen.clear()
                x = seen[key] = math.log(self.probability(key[:-1], key[-1]))
            out += x
        return out


class Filter:
    """Both models and the calibrated threshold, for distinct URLs in hash_order: what judge() computes."""

    def __init__(self, accepted: Sequence[str], rejected: Sequence[str]):
        fit = lambda urls: [u for i, u in enumerate(urls) if i % 4]
        self.accept, self.reject = Markov(fit(accepted)), Markov(fit(rejected))
        self.seen: tuple[dict, dict] = ({}, {})
        self.threshold = best_cut([self.score(u) for u in accepted[::4]], [self.score(u) for u in rejected[::4]])

    def score(self, url: str) -> float:
        """Above the threshold: allowed."""
        n = len(shape(url))
        if not n:
            return 0.0
        return (self.accept.log_likelihood(url, self.seen[0]) - self.reject.log_likelihood(url, self.seen[1])) / n


def best_cut(good: Sequence[float], bad: Sequence[float]) -> float:
    """The cut above which most of good and least of bad lie, by one pass over the sorted scores."""
    if not good or not bad:
        return 0.0
    points = sorted([(x, 1) for x in good] + [(x, 0) for x in bad])
    best, above, below = (-1, 0.0, 0.0), len(good), 0
    for (x, is_good), (after, _) in zip(points, points[1:]):
        above -= is_good
        below += 1 - is_good
        if after > x:
            cut = (x + after) / 2
            best = max(best, (above * len(bad) + below * len(good), -abs(cut), cut))
    return best[2]


def hash_order(url: str) -> bytes:
    return hashlib.md5(url.encode("utf-8", "surrogatepass")).digest()


def dealt(df: DataFrame) -> DataFrame:
    """ruled() rows -> verdict, url, held: each labelled URL once, every fourth of a label in hash_order held out.

    Places are counted in 4,096 ranges of hashes for each label.
    """
    known = df.filter(F.col("verdict").isNotNull()).select("verdict", "url").distinct()
    known = written(known.withColumn("h", F.md5("url")).withColumn("lot", F.substring("h", 1, 3)), "url-labelled")
    sizes = known.groupBy("verdict", "lot").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("verdict").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1))
    lots = sizes.select("verdict", "lot", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    at = F.row_number().over(Window.partitionBy("verdict", "lot").orderBy("h", "url")) - 1
    out = written(known.withColumn("at", at).join(lots, ["verdict", "lot"]).select("verdict", "url", ((F.col("ahead") + F.col("at")) % 4 == 0).alias("held")), "url-dealt")
    discard(known)
    return out


def shapes_of(df: DataFrame) -> DataFrame:
    """ruled() rows -> id, seen (a shape), the labelled URLs of that shape that the models are fitted
    on (accept, reject) and that are held out (good, bad), and the rows to judge (open)."""
    one = lambda c: F.when(c, 1).otherwise(0)
    known = dealt(df)
    allowed, held = F.col("verdict") == "allow", F.col("held")
    parts = {"accept": one(allowed & ~held), "reject": one(~allowed & ~held), "good": one(allowed & held), "bad": one(~allowed & held), "open": F.lit(0)}
    rows = known.select(shaped(F.col("url")).alias("seen"), *(c.alias(n) for n, c in parts.items()))
    rest = df.filter(F.col("verdict").isNull()).select(shaped(F.col("url")).alias("seen"), *(F.lit(int(n == "open")).alias(n) for n in parts))
    out = written(rows.unionByName(rest).groupBy("seen").agg(*(F.sum(n).alias(n) for n in parts)).withColumn("id", F.monotonically_increasing_id()), "url-shapes")
    discard(known)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seen, accept, reject, used) -> the ends of all windows with these counts; used counts whole windows alone."""

    def out(n: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), *(pa.array(x, pa.int64()) for x in zip(*n.values()))], names=["gram", "accept", "reject", "used"])

    n: dict[str, list[int]] = {}
    for batch in batches:
        for seen, accept, reject, used in zip(*(c.to_pylist() for c in batch.columns)):
            for w in windows(seen):
                for k in range(len(w)):
                    x = n.setdefault(w[k:], [0, 0, 0])
                    x[0] += accept
                    x[1] += reject
                n[w][2] += used
                if len(n) > HELD:
                    yield out(n)
                    n = {}
    if n:
        yield out(n)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, seen) -> id, gram: the windows of each shape."""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.string())], names=["id", "gram"])

    ids: list[int] = []
    grams: list[str] = []
    for batch in batches:
        for i, seen in zip(*(c.to_pylist() for c in batch.columns)):
            for w in windows(seen):
                ids.append(i)
                grams.append(w)
                if len(grams) > HELD:
                    yield out()
                    ids, grams = [], []
    if grams:
        yield out()


def gains(shapes: DataFrame) -> DataFrame:
    """shapes_of() -> gram, gain, n: for each window of a shape to score the difference of its character's
    log-probabilities under the two models, in UNITs, and the number of those windows.

    The models' probabilities go from strings of one character to the whole windows: each meets the
    one of the string without its first character, which no more rows share than there are characters.
    """
    used = F.when(F.col("good") + F.col("bad") + F.col("open") > 0, 1).otherwise(0).cast("long")
    n = shapes.select("seen", "accept", "reject", used.alias("used")).mapInArrow(_counted, "gram string, accept long, reject long, used long")
    n = n.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("accept", "reject", "used"))).withColumn("size", F.char_length("gram"))
    after = Window.partitionBy(F.substr(F.col("gram"), F.lit(1), F.col("size") - 1))
    both = ("accept", "reject")
    n = n.select("*", *(F.sum(c).over(after).alias(f"{c}_all") for c in both), *(F.sum((F.col(c) > 0).cast("long")).over(after).alias(f"{c}_kinds") for c in both))
    n = written(n, "url-grams")

    def backed_off(c: str) -> Column:
        count, total, kinds, p = F.col(c), F.col(f"{c}_all"), F.col(f"{c}_kinds"), F.col(f"{c}_p")
        return F.when(total > 0, (count + kinds * p) / (total + kinds)).otherwise(p).alias(f"{c}_p")

    steps: list[DataFrame] = []
    for size in range(1, ORDER + 2):
        rows = n.filter(F.col("size") == size)
        if steps:
            rows = rows.withColumn("end", F.substring("gram", 2, size)).join(steps[-1].select(F.col("gram").alias("end"), *(f"{c}_p" for c in both)), "end")
        else:
            rows = rows.select("*", *(F.lit(1.0 / ALPHABET).alias(f"{c}_p") for c in both))
        steps.append(written(rows.select("gram", "used", *map(backed_off, both)), "url-model"))
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    gain = F.round((F.log("accept_p") - F.log("reject_p")) * UNIT).cast("long")
    out = written(out.filter("used > 0").select("gram", gain.alias("gain"), F.col("used").alias("n")), "url-gains")
    discard(n, *steps)
    return out


def scored(shapes: DataFrame) -> DataFrame:
    """shapes_of() -> seen, good, bad, open, score of the shapes that are held out or to judge."""
    gain = gains(shapes)
    asked = shapes.filter("good + bad + open > 0")
    listed = written(asked.select("id", "seen").mapInArrow(_listed, "id long, gram string"), "url-windows")
    hot = hot_keys(gain, ["gram"], gain.agg(F.sum("n")).first()[0] or 0, "hot-windows")
    sums = join_spread(listed, gain.select("gram", "gain"), ["gram"], hot).groupBy("id").agg(F.sum("gain").alias("gain"))
    size = F.char_length("seen")
    score = F.when(size == 0, 0.0).otherwise(F.col("gain") / F.lit(float(UNIT)) / size)
    out = written(asked.join(sums, "id").select("seen", "good", "bad", "open", score.alias("score")), "url-scores")
    discard(gain, listed)
    return out


def threshold(scores: DataFrame) -> float:
    """best_cut() of (score, good, bad), where good and bad are numbers of URLs.

    Scores are sorted in ranges, one for each partition; the driver adds up the ranges' sums.
    """
    spark = scores.sparkSession
    held = scores.filter("good + bad > 0").groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    held = written(held.repartitionByRange(partitions(spark), "score").withColumn("part", F.spark_partition_id()), "url-cuts")
    parts = held.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("score").alias("least")).orderBy("part").collect()
    good, bad = sum(r["good"] for r in parts), sum(r["bad"] for r in parts)
    best = None
    if good and bad:
        ahead, g, b = [], 0, 0
        for r, after in zip(parts, [*(r["least"] for r in parts[1:]), None]):
            ahead.append((r["part"], g, b, after))
            g, b = g + r["good"], b + r["bad"]
        rows = Window.partitionBy("part").orderBy("score")
        whole = lambda x: x.cast("decimal(19,0)")
        so_far = lambda c: whole(F.sum(c).over(rows.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"{c}_ahead"))
        right = (whole(F.lit(good)) - so_far("good")) * whole(F.lit(bad)) + so_far("bad") * whole(F.lit(good))
        cut = (F.col("score") + F.coalesce(F.lead("score").over(rows), F.col("next"))) / 2
        cuts = held.join(spark.createDataFrame(ahead, "part int, good_ahead long, bad_ahead long, next double"), "part")
        cuts = cuts.select(right.alias("right"), cut.alias("cut")).filter("cut is not null")
        best = cuts.agg(F.max(F.struct("right", (-F.abs("cut")).alias("near"), "cut")).alias("best")).first()["best"]
    discard(held)
    return best["cut"] if best else 0.0


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict, score (null where a rule decides)."""
    df = ruled(pages, rules).withColumn("page_id", F.col("page_id").cast("long"))
    shapes = shapes_of(df)
    scores = scored(shapes)
    discard(shapes)
    above = F.when(F.col("score") > threshold(scores), "allow").otherwise("block")
    asked = scores.select("seen", "score", F.col("open").alias("n")).filter("n > 0")
    hot = hot_keys(asked, ["seen"], asked.agg(F.sum("n")).first()[0] or 0, "hot-shapes")
    rest = df.filter(F.col("verdict").isNull()).select("page_id", "host", "path", "rule", shaped(F.col("url")).alias("seen"))
    rest = join_spread(rest, asked.drop("n"), ["seen"], hot).select("page_id", "host", "path", "rule", above.alias("verdict"), "score")
    sweep(df.sparkSession)
    return df.filter(F.col("verdict").isNotNull()).select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score")).unionByName(rest)
