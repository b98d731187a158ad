"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a sample of its labelled text accepts exactly the strings
that occur in the sample. A text is parsed from left to right into the longest phrases that occur
there (an unknown symbol is a phrase of its own). Phrases times log2 of the sample's length, over
the text's length, estimate the cross entropy in bits; the language with the fewest wins, ties
going to the first by name. The score is the winner's lead: 1 - bits / bits of the second.

Symbols are the bytes of the text with ASCII and Latin-1 letters lower-cased (others as they are),
every stretch without letters one space. Whole texts are parsed by table look-ups, thousands of
lanes of LANE symbols at once. A long text's lanes first all start at the automaton's start; then
each one whose text before it ended within a phrase is parsed again from that phrase's state,
until no lane's beginning changes: the count is that of the text parsed in one piece.

The models are fitted on a bounded sample of labelled rows: for each language SLOTS slots, in each
SNIPPET characters, from a place that its hash chooses, of the row with the least hash of its id.
Only text and lang are read there, lang nowhere else.

Null texts and texts without a letter are `und` with score 0; so is every text if no row is
labelled. With one language the score is 1. Rows that repeat an id are judged row by row. Empty
input: no rows. Other columns of the input aren't read; predict() hands them on, and its own
two columns take the place of any of the same names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorline.llm import textcore as tc
from spoorline.llm.common import hashed

SLOTS, SNIPPET, LANE = 32, 512, 512
UNKNOWN = "und"
FOLDS = 5


def automaton(s: bytes) -> list[dict[int, int]]:
    """The suffix automaton of s: for each state its transitions; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts and their bounds: lower case, other than letters one space each."""
    s = tc.LOWER[data]
    letter = (s >= 97) & (s <= 122) | (s >= 128)
    lead = np.zeros(len(s), bool)
    lead[1:] = data[:-1] == 0xC3
    up = lead & (s >= 0x80) & (s <= 0x9E) & (s != 0x97)
    s = np.where(letter, s, 32).astype(np.uint8)
    s[up] += 32
    keep = np.ones(len(s), bool)
    if len(s):
        keep[1:] = (s[1:] != 32) | (s[:-1] != 32)
        keep[bounds[:-1][bounds[:-1] < len(s)]] = True
    at = np.zeros(len(s) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return s[keep], at[bounds]


class Parser:
    """All languages' automata as tables over the symbols that their samples hold."""

    def __init__(self, samples: Mapping[str, bytes]):
        self.names = sorted(samples)
        joined = b"".join(samples.values())
        used = sorted(set(joined))
        self.code = np.full(256, len(used), np.int32)  # the last code is in no automaton
        self.code[used] = np.arange(len(used))
        self.width = len(used) + 1
        self.tables, self.cost = [], []
        for name in self.names:
            step = automaton(samples[name])
            t = np.full((len(step), self.width), -1, np.int32)
            for i, x in enumerate(step):
                t[i, self.code[list(x)]] = list(x.values())
            # Rows are named by their first cell, so a look-up is one addition.
            t[t >= 0] *= self.width
            self.tables.append(t.ravel())
            self.cost.append(math.log2(max(len(samples[name]), 2)))

    def _parse(self, t: np.ndarray, code: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lanes (start, size, longest first) from their states: phrases ended, and the last states."""
        state, count = state.copy(), np.zeros(len(start), np.int32)
        active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # lanes longer than k
        for k, m in enumerate(active.tolist()):
            c = code[start[:m] + k]
            nxt = t[state[:m] + c]
            bad = np.flatnonzero(nxt < 0)
            if len(bad):
                again = t[c[bad]]
                count[bad] += (state[bad] != 0).astype(np.int32) + (again < 0)
                nxt[bad] = np.maximum(again, 0)
            state[:m] = nxt
        return count, state

    def phrases(self, s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) for each language (columns)."""
        n = np.diff(bounds)
        lanes = -(-n // LANE)
        doc = np.repeat(np.arange(len(n)), lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = bounds[:-1][doc] + LANE * nth
        size = np.minimum(LANE, bounds[1:][doc] - start)
        code = self.code[s]
        out = np.zeros((len(n), len(self.names)), np.int64)
        for j, t in enumerate(self.tables):
            begun = np.zeros(len(doc), np.int32)
            count, state = np.zeros(len(doc), np.int32), np.zeros(len(doc), np.int32)
            todo = np.arange(len(doc))
            while len(todo):
                todo = todo[np.argsort(-size[todo], kind="stable")]
                count[todo], state[todo] = self._parse(t, code, start[todo], size[todo], begun[todo])
                before = np.where(nth > 0, np.roll(state, 1), 0)
                todo = np.flatnonzero(before != begun)
                begun[todo] = before[todo]
            ends = nth == lanes[doc] - 1
            out[:, j] = np.bincount(doc, count + (ends & (state != 0)), minlength=len(n))
        return out

    def predict(self, data: np.ndarray, bounds: np.ndarray) -> tuple[list[str], list[float]]:
        s, at = symbols(data, bounds)
        n = np.maximum(np.diff(at), 1)[:, None]
        low = tc.LOWER[data]
        plain = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))[bounds]
        has = np.diff(plain) > 0
        for i in np.flatnonzero(~has & (np.diff(bounds) > 0)):
            has[i] = any(c.isalpha() for c in data[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace"))
        if not self.names:
            return [UNKNOWN] * len(has), [0.0] * len(has)
        bits = self.phrases(s, at) * np.array(self.cost) / n
        best = bits.argmin(axis=1)
        if len(self.names) == 1:
            lead = np.ones(len(has))
        else:
            two = np.partition(bits, 1, axis=1)
            lead = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-12)
        return [self.names[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, np.clip(lead, 0, 1), 0.0).tolist()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def samples(labelled: DataFrame, slots: int = SLOTS, snippet: int = SNIPPET) -> dict[str, bytes]:
    """(doc_id, text, lang) -> symbols of each language's sample; slots rows a language come to the driver."""
    h = hashed(F.col("doc_id"), 52, "lang-1")
    at = F.pmod(hashed(F.col("doc_id"), 52, "lang-2"), F.greatest(F.char_length("text") - snippet + 1, F.lit(1))) + 1
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", h.alias("h"), F.substr("text", at.cast("int"), F.lit(snippet)).alias("t"))
    least = rows.groupBy("lang", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min(F.struct("h", "t")).alias("x"))
    out: dict[str, bytes] = {}
    for r in sorted(least.collect(), key=lambda r: (r["lang"], r["slot"])):
        raw = np.frombuffer(r["x"]["t"].encode("utf-8", "surrogatepass"), np.uint8)
        s, _ = symbols(raw, np.array([0, len(raw)]))
        out[r["lang"]] = out.get(r["lang"], b"") + s.tobytes() + b" "
    return out


def fit(docs: DataFrame) -> Parser:
    return Parser(samples(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")))


def predict(docs: DataFrame, parser: Parser) -> DataFrame:
    """(text) -> all columns as they are, and _lang_pred, _score."""
    model = docs.sparkSession.sparkContext.broadcast(parser)  # bounded by languages, slots and snippet
    docs = docs.drop("_lang_pred", "_score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        for batch in batches:
            for lo, hi, data, bounds in tc.slabs(batch.column(at), 4 << 20):
                pred, score = p.predict(data, bounds)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "_lang_pred", "_score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_lang_pred", T.StringType()), T.StructField("_score", T.DoubleType())])
    return docs.mapInArrow(tc.tidied(run), schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) -> doc_id, held_out, lang_pred, score."""
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))
