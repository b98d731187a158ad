"""The pipeline against a plain version of it, stage by stage, and the guard around this folder."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from test_joins import plain_components
from test_rows import WORD, plain_phrases, plain_secrets, plain_targets

import corpus_pipeline
from spoorline.llm import langid, pieces

SF = "/root/testdata/sf0.001"


def plain_language(rows, samples):
    """The language whose sample needs the fewest phrases; the first by name of equals."""
    out = []
    for i, text, _, source, n in rows:
        if text is None or not any(c.isalpha() for c in text):
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        s = langid.symbols(raw, np.array([0, len(raw)]))[0].tobytes()
        bits = {k: plain_phrases(s, v) * math.log2(len(v)) / len(s) for k, v in samples.items()}
        out.append((i, text, min(sorted(bits), key=bits.get), source, n))
    return out


def plain_near_copies(rows):
    of = {(i, n): c for i, n, c in plain_components(rows)}
    size = {r: n for r, n in zip(map(str, rows), (len(WORD.findall(r[1] or "")) for r in rows))}
    kept, seen = [], set()
    for r in rows:
        if size[str(r)] and (r[0], r[1]) in seen:
            continue
        seen.add((r[0], r[1]))
        component = next(c for (i, n), c in of.items() if i == r[0])
        if not size[str(r)] or r[0] is None or component == r[0]:
            kept.append(r)
    return kept


def plain_redaction(text):
    out, at = "", 0
    for _, a, b in plain_secrets(text):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def plain_mix(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    target = plain_targets(sizes)
    out = []
    for s in sizes:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        part, before = target[s] - whole * sizes[s], 0
        place = lambda r: int(hashlib.md5(f"mix-1:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16)
        for r in sorted((r for r in rows if r[3] == s), key=place):
            n = len(WORD.findall(r[1] or ""))
            out += [r] * (whole + (before + n / 2 < part))
            before += n
    return out


def plain_pipeline(rows, samples):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    stages = [plain_language(rows, samples)]
    stages.append(plain_near_copies(stages[-1]))
    clean = [(r, plain_redaction(r[1])) for r in stages[-1]]
    stages.append([(r[0], t, r[2], r[3], r[4] if t == r[1] else len(t)) for r, t in clean])
    stages.append(plain_mix(stages[-1]))
    return stages, [(r[0], tuple(sp.encode(r[1]))) for r in stages[-1]]


@pytest.mark.parametrize("table", ["fixture", "sf0.001"])
def test_stages_in_turn(spark, docs, rows, table):
    if table == "fixture":
        now, start = docs, rows
    else:
        now = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
        start = [tuple(r) for r in now.collect()]
    want, ids = plain_pipeline(start, langid.samples(now.filter(~langid.held_out(now.doc_id)).select("doc_id", "text", "lang")))
    for (name, stage), plain in zip(corpus_pipeline.STAGES, want):
        now = stage(spark, now, "")
        assert now.columns == list(corpus_pipeline.COLUMNS)
        assert Counter(tuple(r) for r in now.collect()) == Counter(plain), name
    last = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in last) == Counter(ids) and all(r["round_trip"] for r in last)


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    start = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _, ids = plain_pipeline(start, langid.samples(docs.filter(~langid.held_out(docs.doc_id)).select("doc_id", "text", "lang")))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out.collect()) == Counter(ids)


def test_different_texts_under_one_id_stay(spark):
    rows = [(1, "one text of five words here", "en", "a", 1), (1, "another one that nobody copied yet", "en", "a", 1), (2, "one text of five words here", "en", "b", 1), (3, "alone in the whole wide world", "en", "b", 1), (3, "alone in the whole wide world", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = Counter(tuple(r)[:2] for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert out == Counter([rows[0][:2], rows[1][:2], rows[3][:2]])


def test_empty_documents(spark, empty):
    now = empty
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
    assert now.collect() == []


def test_no_import_of_this_folder_elsewhere():
    import pathlib

    top = pathlib.Path(corpus_pipeline.__file__).parent
    users = [p for p in top.rglob("*.py") if "llm" not in p.parts and p.name not in ("corpus_pipeline.py", "__spark_entry__.py") and re.search(r"spoorline\.llm|import llm", p.read_text())]
    assert users == []
