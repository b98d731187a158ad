"""Jaccard join, repeated substrings, fingerprints, components: against plain versions."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spoorline.llm import anchors, common, components, merkle, ngramjoin, substrings

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(rows):
    sets = [shingles(r[1]) for r in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids and sets[i] else r[0]))
    return Counter(out)


@pytest.mark.parametrize("blocks", [512, 2])
def test_jaccard_join(docs, rows, monkeypatch, blocks):
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", blocks)
    got = ngramjoin.near_duplicates(docs).collect()
    assert Counter(tuple(r)[:3] for r in got) == plain_components(rows)


@pytest.mark.parametrize("blocks, few", [(512, 16), (2, 16), (2, 1)])
def test_jaccard_join_keeps_every_link(spark, docs, rows, monkeypatch, blocks, few):
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", blocks)
    monkeypatch.setattr(ngramjoin, "FEW_BLOCKS", few)
    words = [f"w{k}" for k in range(200)]
    group = [(1000 + i, " ".join(w if k != 10 * i else "edit" for k, w in enumerate(words))) for i in range(12)]
    every = [(r[0], r[1]) for r in rows] + group + group[:2]
    sets = [shingles(t) for _, t in every]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    df = docs.select("doc_id", "text").union(spark.createDataFrame(group + group[:2], "doc_id long, text string"))
    want = Counter((i, len(s), sum(linked(s, x) for x in sets) - bool(s)) for (i, _), s in zip(every, sets))
    assert Counter((r["doc_id"], r["n_shingles"], r["n_links"]) for r in ngramjoin.near_duplicates(df).collect()) == want
    of, links = ngramjoin.jaccard_links(df)
    name = {(r["doc_id"]): bytes(r["key"]) for r in of.filter("doc_id >= 1000").collect()}
    got = Counter((bytes(r["u"]), bytes(r["v"])) for r in links.collect())
    assert max(got.values()) == 1 and len(got) == sum(linked(a, b) for a in set(sets) for b in set(sets) if a != b) // 2
    assert {tuple(sorted((name[1000 + i], name[1000 + j]))) for i in range(12) for j in range(i)} <= set(got)


def test_long_lists_are_counted_as_short_ones(monkeypatch):
    rng = np.random.default_rng(4)
    s = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    for long in (64, 5):
        monkeypatch.setattr(ngramjoin, "LONG_LIST", long)
        i, j, o = ngramjoin._overlaps(s)
        assert {(a, b): n for a, b, n in zip(i.tolist(), j.tolist(), o.tolist())} == {(a, b): len(np.intersect1d(s[a], s[b])) for b in range(30) for a in range(b)}


def test_jaccard_join_of_nothing(empty):
    assert ngramjoin.near_duplicates(empty).collect() == [] and ngramjoin.one_of_each_group(empty).collect() == []


def test_posted_bytes_follow_the_shingles(rows):
    """However many buckets there are, and at whatever size of the input."""
    text = [r[1] for r in rows]

    def posted(times: int, buckets: int) -> tuple[int, int]:
        every = [f"{t} {k}" if t else t for k in range(times) for t in text]
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(every))), "text": pa.array(every, pa.string()), "mark": list(range(len(every)))})
        out = pa.Table.from_batches(list(ngramjoin._post(5, buckets)([batch])))
        return out.num_rows, out.nbytes

    hashes = sum(len(shingles(t)) for t in text)
    few, many, wide = posted(1, 8), posted(1, 1 << 14), posted(8, 1 << 17)
    assert few[0] <= 9 and many[0] <= hashes + 1 and wide[0] <= 8 * hashes + 8
    assert many[1] < 80 * hashes and wide[1] < 8 * 80 * hashes and few[1] < 20 * hashes


def test_sets_of_a_large_part_travel_along_their_lists(spark, monkeypatch):
    """One part of 3,000 sets, each in two lists of two: a set meets its neighbours' blocks alone."""
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", 4)
    key = lambda i: f"{i:04}".encode()
    lists = [(sig, key(i), 10) for sig in range(2999) for i in (sig, sig + 1)]
    met = ngramjoin.meetings(spark.createDataFrame(lists, "sig long, key binary, n long")).collect()
    assert len(met) <= 4 * 3000 and max(Counter((r["i"], r["j"]) for r in met).values()) < 100
    at = {}
    for r in met:
        at.setdefault(bytes(r["key"]), set()).add((r["i"], r["j"]))
    assert all(at[key(i)] & at[key(i + 1)] for i in range(2999))


def test_one_row_of_each_group_stays(spark, docs, rows):
    long = " ".join(f"w{k}" for k in range(40))
    more = [(900, long, "en", "a", 1), (901, long + " x", "en", "a", 1), (None, long, "en", "a", 1), (902, "one text here", "en", "b", 1), (902, "another text there", "en", "b", 1), (903, "twice the same", "de", "b", 2), (903, "twice the same", "de", "a", 3), (904, None, None, None, None), (904, None, None, None, None), (None, "no id", "en", "b", 0), (None, "no id", "en", "b", 0), (905, "No ID ", "en", "c", 0)]
    df = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long").withColumn("key", F.lit("mine"))
    out = ngramjoin.one_of_each_group(df)
    assert out.columns == df.columns
    assert Counter(tuple(r) for r in out.collect()) == Counter([*((*x, "mine") for x in (more[0], more[3], more[4], more[6], more[7], more[8], more[11]))])
    kept = Counter(r["doc_id"] for r in ngramjoin.one_of_each_group(docs).collect())
    of = {(i, n): c for i, n, c in plain_components(rows)}
    assert kept == Counter(i for i in {r[0] for r in rows} if any(i == k and (n == 0 or c == i) for (k, n), c in of.items()))


def test_signatures_meet_for_every_similar_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(3, 60))
        base = rng.choice(10**6, n + 20, replace=False).astype(np.uint64)
        a = base[:n]
        cut = int(rng.integers(0, n // 4 + 1))
        b = np.concatenate((a[cut:], base[n : n + int(rng.integers(0, n // 5 + 1))]))
        o = len(np.intersect1d(a, b))
        if 100 * o < 75 * (len(a) + len(b) - o) or o == len(a) == len(b):
            continue
        df = {x: 1 + int(x) % 5 * (x in set(a.tolist()) & set(b.tolist())) for x in {*a.tolist(), *b.tolist()}}
        for boundary in (0, 10, 30, 100):
            sig = []
            for s in (a, b):
                level = np.array([df[x] for x in s.tolist()])
                by = np.lexsort((s, level))
                sig.append(set(ngramjoin.signatures(s[by], level[by], boundary).tolist()))
            assert sig[0] & sig[1], (n, cut, boundary)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 50), (60, 60), (70, 69)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50, 69: 69, 70: 69}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_substrings(rows):
    raw = [(r[1] or "").encode() for r in rows]
    words = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    holders = Counter(s for w in words for s in {tuple(w[i : i + 51]) for i in range(len(w) - 50)})
    out = []
    for r, b, w in zip(rows, raw, words):
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i + 1 : i + 401] = True
        keep = bytes(x for x, g in zip(b, gone[1:]) if not g)
        shared = {i + k for i in range(len(w) - 50) if holders[tuple(w[i : i + 51])] > 1 for k in range(51)}
        out.append((r[0], len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(keep).hexdigest(), len(shared)))
    return Counter(out)


@pytest.mark.parametrize("hot, rows_of_a_key", [(2000, 1000), (2, 1000), (2000, 1)])
def test_repeated_substrings(docs, rows, monkeypatch, hot, rows_of_a_key):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(common, "HOT_ROWS", rows_of_a_key)
    got = Counter(tuple(r) for r in substrings.without_repeats(docs).collect())
    assert got == plain_substrings(rows) and any(x[2] for x in got) and any(x[5] for x in got)


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeats_within_one_text_overlap(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    short = " ".join(f"w{k}" for k in range(54))
    rows = [(1, "ab" * 300), (2, "xyz" * 100), (3, "q" * 399), (4, "so " * 200), (5, "one two three " * 40), (6, f"{short} and {short} more"), (7, f"x {short} y"), (8, f"{short}  y"), (9, "na " * 60 + "once"), (10, "na\n" * 55)]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == plain_substrings(rows)
    assert {r["doc_id"] for r in got if r["n_passage_words"]} == {6, 7, 8, 9, 10}


def test_no_substrings_of_nothing(empty):
    assert substrings.without_repeats(empty).collect() == []


def test_multikey_ties():
    a, b = np.array([1, 2, 1, 1, 2], np.uint64), np.array([5, 6, 5, 7, 9], np.uint64)
    assert sorted(substrings.multikey_ties([a, b])) == [0, 2]


def test_anchors_depend_on_content_alone():
    rng = np.random.default_rng(1)
    x = rng.integers(97, 100, 900).astype(np.uint8)
    y = np.concatenate((rng.integers(97, 100, 77).astype(np.uint8), x[100:800]))
    at = {}
    for data, shift in ((x, 0), (y, 23)):
        a, h, s0, s1 = anchors.anchors(data, 400, 100)
        for p, lo, hi in zip(a, s0, s1):
            for s in range(lo, hi + 1):
                at.setdefault(data[s : s + 400].tobytes(), set()).add(p - s)
    assert all(len(v) == 1 for v in at.values())


def plain_leaves(line):
    """Cut by walking over the characters."""
    out, now, i = [], "", 0
    while i < len(line):
        now += line[i]
        stop = line[i] in ".!?" and (i + 1 == len(line) or line[i + 1] not in ".!?")
        blank = line[i] in " \t" and len(now.rstrip(" \t")) > 0 and now.rstrip(" \t")[-1] in "lmz"
        if stop or blank:
            while i + 1 < len(line) and line[i + 1] in " \t":
                i += 1
                now += line[i]
            out.append(now)
            now = ""
        i += 1
    return [x[k : k + 256] for x in [*out, now] for k in range(0, len(x), 256)]


def plain_tree(text):
    h = lambda x, n: hashlib.blake2b(x.encode(), digest_size=n).hexdigest()
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    sections, now = [], []
    for line in lines:
        leaves = [h(x, 3) for x in plain_leaves(line)]
        now.append((h("".join(leaves), 6), leaves))
        if not leaves or int(now[-1][0][:2], 16) % 4 == 0:
            sections.append(now)
            now = []
    sections += [now] if now else []
    named = [(h("".join(p for p, _ in s), 6), s) for s in sections]
    own = hashlib.blake2b(text.encode(), digest_size=16).digest()
    root = hashlib.blake2b("".join(n for n, _ in named).encode() + len(text).to_bytes(8, "big") + own, digest_size=16).hexdigest()
    return root, named


def plain_likeness(a, b):
    """Leaves of equal sections, paragraphs and leaves, crossed off one by one."""
    if a == b:
        return 1.0
    x, y = ([[list(p) for p in s] for _, s in plain_tree(t)[1]] for t in (a, b))
    count = lambda s: sum(len(p[1]) for p in s)
    most, alike = max(sum(map(count, x)), sum(map(count, y))), 0

    def cross_off(x, y, weight):
        nonlocal alike
        for i in list(x):
            if i in y:
                y.remove(i)
                x.remove(i)
                alike += weight(i)

    cross_off(x, y, count)
    x, y = [p for s in x for p in s], [p for s in y for p in s]
    cross_off(x, y, lambda p: len(p[1]))
    x, y = [i for p in x for i in p[1]], [i for p in y for i in p[1]]
    cross_off(x, y, lambda _: 1)
    return min(alike / most, 0.999999) if most else 0.0


TEXTS = ["", "z", "\n", "\n\n", " ", "a b. c!? d\n", "no end here", "x" * 1000, "日本語。テキスト\n" * 9, "a  . b\t\tc\n.", "z? \n z? \n z?"]


def test_trees_match_a_plain_walk(rows):
    for t in [*TEXTS, *(r[1] or "" for r in rows)]:
        assert merkle.tree(t) == plain_tree(t)


def test_likeness_matches_crossing_off(rows):
    texts = [*TEXTS, *(r[1] or "" for r in rows[:40])]
    texts += [t[len(t) // 3 :] + t[: len(t) // 3] for t in texts[-20:]]
    for i, a in enumerate(texts):
        for b in texts[i % 3 :: 3]:
            assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) == plain_likeness(a, b)


def test_fingerprints_of_equal_and_edited_texts():
    a = "One sentence here. Another one there.\nA second line.\n\nA third part! With more words in it, and more.\n" * 4
    assert merkle.fingerprint(a) == merkle.fingerprint(a) and merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(a)) == 1
    b = a.replace("Another one there", "Another one where", 1)
    x, y = merkle.fingerprint(a), merkle.fingerprint(b)
    assert 0.8 < merkle.likeness(x, y) < 1 and x != y
    assert merkle.differing(x, y) == ([(0, 0)], [(0, 0)]) or all(len(side) == 1 for side in merkle.differing(x, y))
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("z")) == 0


def test_one_character_more_changes_few_leaves():
    words = "so that each of these seven hollow stones might well be older than the river that once carried them".split()
    line = " ".join(words[(7 * k) % len(words)] for k in range(80))
    for more in ("x" + line, line[:100] + "q" + line[100:], line + "."):
        assert 0.75 < merkle.likeness(merkle.fingerprint(line), merkle.fingerprint(more)) < 1


def test_edits_are_located_to_the_paragraph():
    lines = [f"line number {k} of the text, with its own words here" for k in range(60)]
    edited = [x if k != 37 else x.replace("own", "new") for k, x in enumerate(lines)]
    a, b = "\n".join(lines), "\n".join(edited)
    places = [(i, k) for i, (_, s) in enumerate(plain_tree(a)[1]) for k in range(len(s))]
    left, right = merkle.differing(merkle.fingerprint(a), merkle.fingerprint(b))
    assert left == [places[37]] and len(right) == 1


@pytest.mark.parametrize("size", [64 << 20, 2000])
def test_with_next_matches_a_plain_walk(docs, rows, monkeypatch, size):
    monkeypatch.setattr(merkle, "RANGE", size)
    got = merkle.with_next(docs).collect()
    text = {}
    for r in rows:
        text.setdefault(r[0], set()).add(r[1] or "")
    ids = sorted({r[0] for r in rows if r[0] is not None}, reverse=True)
    ids = [i for i in ids for _ in range(sum(r[0] == i for r in rows))] + [None] * sum(r[0] is None for r in rows)
    assert all(len(x) == 1 for x in text.values())  # so the order among repeated rows doesn't matter
    want = Counter()
    for i, j in zip(ids, ids[1:] + ids[:1]):
        t, f = min(text[i]), min(text[j])
        half = len(t) // 2
        e = t[: len(t) - half] + f[:half]
        out = lambda x: merkle.written_out(*plain_tree(x))
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), out(t), out(e), plain_likeness(t, e), plain_likeness(t, f)] += 1
    assert Counter(tuple(r) for r in got) == want


def test_many_rows_of_one_id_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE", 200)
    rows = [(7, f"text {k} of one id") for k in range(60)] + [(None, f"text {k} of none") for k in range(60)] + [(8, "the first"), (-(2**63), "the least"), (2**63 - 1, "the most")]
    out = merkle.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows) and len({r["fingerprint"] for r in out}) == len(rows)
    after = {merkle.edited_text(t, f) for t in ("the most",) for f in ("the first",)}
    assert hashlib.sha256(after.pop().encode()).hexdigest() in {r["edited_sha256"] for r in out if r["doc_id"] == 2**63 - 1}


def test_with_next_of_one_and_none(spark, empty):
    assert merkle.with_next(empty).collect() == []
    one = merkle.with_next(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_trees_as_rows(docs, rows):
    trees = merkle.fingerprints(docs).collect()
    assert {(t["doc_id"], t["root"]) for t in trees} == {(r[0], plain_tree(r[1] or "")[0]) for r in rows}
    assert all(t["sections"] for t in trees if t["doc_id"] == 0)


def test_rows_of_hot_keys_join_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(400).selectExpr("id AS v", "CASE WHEN id % 2 = 0 THEN 0 ELSE id END AS k")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (3, "c"), (-1, "d")], "k long, w string")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    hot = common.hot_keys(counts, ["k"], 400, "test-hot")
    assert [r["k"] for r in hot.collect()] == [0] and common.hot_keys(counts.filter("k > 0"), ["k"], 400, "test-hot") is None
    for how in ("inner", "left", "left_semi"):
        want = Counter(map(tuple, rows.join(small, ["k"], how).collect()))
        assert Counter(map(tuple, common.join_spread(rows, small, ["k"], hot, how).collect())) == want
