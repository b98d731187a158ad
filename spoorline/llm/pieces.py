"""SentencePiece encoding and decoding with a streaming Viterbi search.

The ids of a text are those that the model's pair merges give. They are found left to right: the
merges of a text end in piece t after piece s exactly if s+t alone merges to (s, t), so among the
pieces that can end at a place just one path survives, found from back pointers at most one piece
length away. The search keeps a window of that length. Whenever all paths in the window pass
through one boundary, the ids before it are committed and leave memory; no later text can change
them. Every text goes through this stream, with or without spaces, in the same bounded memory.

No piece has a space after another character, so the paths always meet before a space that follows
another character, and the stream commits there; a bounded memory of finished words between such
boundaries skips the search for words seen before. The other words of several texts are searched
side by side, place by place, in NumPy arrays: a word's search needs no other word. Characters
without a piece become their UTF-8 bytes' pieces.

Null text: null ids. Empty text: no ids. The model's normalisation is the identity with a space
put before the text; decoding takes it away, so a text comes back as it was, apart from U+2581,
which the model can't tell from a space: round_trip is false for such a text. Rows are independent;
ids of rows may repeat.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.textcore import BASE, U64, tidied

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Words remembered by a worker, their longest length, and how many the stream commits at a time.
REMEMBERED, STRETCH, COMMITTED = 250_000, 64, 4096
_spaced = re.compile(" *[^ ]+| +")
PAIRS = 1_000_000
#: Ids decoded at a time.
DECODED = 1 << 16
#: Words searched side by side, and characters of texts whose words are looked up together.
LANES, TOGETHER = 1 << 13, 1 << 18


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def reject_other_models(path: str) -> None:
    """Raises for a model whose ids the search can't give: not BPE, or a piece that spans a space."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.trainer_spec
    if spec.model_type != spec.BPE:
        raise ValueError(f"{path} is no BPE model: its ids need a search by scores")
    normal = model.pieces and [p.piece for p in model.pieces if p.type in (p.NORMAL, p.USER_DEFINED)]
    if wide := next((p for p in normal if SPACE in p.lstrip(SPACE)), None):
        raise ValueError(f"{path} has a piece with a space after another character: {wide}")


class Numbers:
    """Numbers of 0 and more by others: open addressing in arrays."""

    def __init__(self, bits: int):
        self.shift, self.n = U64(64 - bits), 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or would be."""
        at = (keys.view(U64) * BASE >> self.shift).view(np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[at[left]]
            left = left[(there != keys[left]) & (there != -1)]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        return at

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        at = self.slots(keys)
        return np.where(self.keys[at] == keys, self.values[at], -1)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct new keys; the table must stay far from full."""
        self.n += len(keys)
        while len(keys):
            at = self.slots(keys)
            self.keys[at] = keys
            won = self.keys[at] == keys  # of keys that meet in a slot, one
            self.values[at[won]] = values[won]
            keys, values = keys[~won], values[~won]


class Pieces:
    """A model's pieces: exact merges of short strings, and the streaming search."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        reject_other_models(path)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.longest = max(map(len, self.id), default=1)
        self.unknown = sp.unk_id()
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = {i: p for p, i in self.id.items()}
        #: What each id stands for, as UTF-8 in one pool; nothing for others, of which n is one.
        self.n = n
        means = {i: p.replace(SPACE, " ").encode() for p, i in self.id.items()}
        if self.byte[0] != self.unknown:
            means |= {i: bytes([b]) for b, i in enumerate(self.byte)}
        spelt = [means.get(i, b"") for i in range(n + 1)]
        self.pool, self.size = np.frombuffer(b"".join(spelt), np.uint8), np.fromiter(map(len, spelt), np.int64, n + 1)
        self.start = np.cumsum(self.size) - self.size
        #: Finds all pieces that end at each place of a text, in one pass.
        self.found = ahocorasick.Automaton()
        for piece in self.id:
            self.found.add_word(piece, piece)
        self.found.make_automaton()
        self.alone = frozenset(p for p in self.id if len(p) == 1)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.pairs = Numbers(PAIRS.bit_length() + 1)
        self._plant()

    def _plant(self) -> None:
        """The pieces as a tree of characters, in arrays."""
        #: The number of each code point in pieces; 0: in none.
        letters = sorted(set().union(*self.id))
        self.letter = np.zeros(max(map(ord, letters), default=0) + 2, np.int64)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        nodes = {"": 0}
        for p in self.id:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        self.node_id = np.array([self.id.get(x, -1) for x in nodes], np.int64)
        edges = [nodes[x[:-1]] * self.letters + int(self.letter[ord(x[-1])]) for x in nodes if x]
        self.tree = Numbers((4 * len(nodes)).bit_length())
        self.tree.add(np.array(edges, np.int64), np.arange(1, len(nodes)))
        self.chars = np.zeros(self.n + 1, np.int64)
        self.chars[self.n] = 1  # n: the start of a text, or a character without a piece
        for p, i in self.id.items():
            self.chars[i] = len(p)
        #: Whether each character in pieces is one.
        self.covered = self.alone.issuperset(letters)

    def merged(self, s: str) -> list[str]:
        """The pieces of a short string by merging the best pair first, the leftmost of equals."""
        part: list[str] = list(s)
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(s) and (p := part[i] + part[after[i]]) in self.score:
                heapq.heappush(heap, (-self.score[p], i, p))

        for i in range(len(s) - 1):
            offer(i)
        while heap:
            _, i, p = heapq.heappop(heap)
            if not part[i] or after[i] >= len(s) or part[i] + part[after[i]] != p:
                continue
            j = after[i]
            part[i], part[j], after[i] = p, "", after[j]
            if after[i] < len(s):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p]

    def ends(self, text: str) -> Iterator[tuple[int, str]]:
        """(place, piece) for each piece and unknown character that ends there, places in order."""
        if self.alone.issuperset(text):
            yield from ((i + 1, p) for i, p in self.found.iter(text))
            return
        at = 0
        for i, p in self.found.iter(text):
            while at <= i:  # characters come first, so that each place has one
                at += 1
                if text[at - 1] not in self.alone:
                    yield at, text[at - 1]
            yield i + 1, p
        for k in range(at, len(text)):
            if text[k] not in self.alone:
                yield k + 1, text[k]

    def side_by_side(self, words: list[str]) -> list[bytes]:
        """Ids of short words, each with the space before it, as 4-byte numbers.

        The words' places are numbered one after the other, from the start to the end of each. last
        holds for each place the piece that ends there on the one path to it, as in search().
        """
        text = SPACE + SPACE.join(words).replace(" ", SPACE)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        first = np.cumsum(size + 1) - size - 1
        places = int(first[-1] + size[-1] + 1)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        inside = np.ones(places, bool)
        inside[first + size] = False
        letter = np.full(places + 1, -1)
        letter[:-1][inside] = self.letter[np.minimum(code, len(self.letter) - 1)]
        # All pieces that begin at each place.
        at, node = np.flatnonzero(letter > 0), 0
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(self.longest):
            node = self.tree.find(node * self.letters + letter[at + k])
            at, node = at[node >= 0], node[node >= 0].astype(np.int64)
            piece = self.node_id[node]
            found.append((at[piece >= 0], piece[piece >= 0]))
            more = letter[at + k + 1] > 0
            at, node = at[more], node[more]
        begin, piece = (np.concatenate(x) for x in zip(*found))
        end = begin + self.chars[piece]
        # Paths, by places from the start of each word.
        last = np.full(places, -1)
        last[first] = self.n
        last[np.flatnonzero(letter == 0) + 1] = self.n
        place = np.arange(places) - np.repeat(first, size + 1)
        order = np.argsort(place[begin].astype(np.int16), kind="stable")
        begin, piece, end = begin[order], piece[order], end[order]
        cuts = np.searchsorted(place[begin], np.arange(int(size.max()) + 1))
        for lo, hi in zip(cuts, cuts[1:]):
            to = end[lo:hi]
            free = np.flatnonzero(last[to] < 0) + lo  # pieces from nearer the start come first
            fit = free[self.follow(last[begin[free]], piece[free])]
            last[end[fit]] = piece[fit]
        # Back from the ends.
        taken, at = np.zeros(places, bool), first + size
        start = first
        while len(at):
            taken[at] = True
            at = at - self.chars[last[at]]
            more = at > start
            at, start = at[more], start[more]
        ids = last[taken]
        counts = np.add.reduceat(taken.astype(np.int64), first)
        if len(unknown := np.flatnonzero(ids == self.n)):
            chars = np.empty(places, np.uint32)
            chars[1:][inside[:-1]] = code
            missing = chars[taken][unknown]
            if self.byte[0] == self.unknown:
                ids[unknown] = self.unknown
            else:
                spelt = np.frombuffer(missing.tobytes().decode("utf-32-le").encode(), np.uint8)
                each = np.ones(len(ids), np.int64)
                each[unknown] = 1 + (missing > 0x7F) + (missing > 0x7FF) + (missing > 0xFFFF)
                word = np.repeat(np.arange(len(words)), counts)
                spread = np.repeat(ids, each)
                spread[spread == self.n] = np.array(self.byte)[spelt]
                ids, counts = spread, np.bincount(np.repeat(word, each), minlength=len(words))
        flat = ids.astype("<i4").tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each b can be the piece after a; a is n at the start and after a character without a piece."""
        keys = a * self.n + b
        known = self.pairs.find(keys)
        if len(new := np.flatnonzero(known < 0)):
            pairs, back = np.unique(keys[new], return_inverse=True)
            fits = np.array([self.fit(*divmod(k, self.n)) for k in pairs.tolist()], np.int32)
            if self.pairs.n + len(pairs) > PAIRS:
                self.pairs = Numbers(PAIRS.bit_length() + 1)
            self.pairs.add(pairs[:PAIRS], fits[:PAIRS])
            known[new] = fits[back]
        return known > 0

    def fit(self, a: int, b: int) -> bool:
        q = self.text[b]
        before = [self.text[a]] if a < self.n else []
        return self.merged("".join(before) + q) == [*before, q]

    def search(self, text: str) -> Iterator[str]:
        """The pieces of a stretch, committed as soon as they are certain.

        last holds the window: for each place the piece that ends there on the one path to it. Once
        it is longer than the longest piece, it is looked at every few places for a boundary that
        all paths share.
        """
        size, fits = self.longest, self.fits
        done, last = 0, {0: ""}
        now, look = 0, size
        for end, p in self.ends(text):
            if end != now:
                now = end
                if end > look:
                    upto = self._met(last, done, end - 1)
                    if upto > done:
                        yield from self._path(last, done, upto)
                        done = upto
                        last = {k: v for k, v in last.items() if k >= upto}
                    look = max(done + size, end + 3)
            if end not in last:
                before = last.get(end - len(p))
                if before is not None:
                    ok = fits.get((before, p))
                    if ok or ok is None and self.follows(before, p):
                        last[end] = p
        yield from self._path(last, done, len(text))

    @staticmethod
    def _path(last: dict[int, str], done: int, upto: int) -> list[str]:
        out = []
        while upto > done:
            out.append(last[upto])
            upto -= len(last[upto])
        out.reverse()
        return out

    def _met(self, last: dict[int, str], done: int, end: int) -> int:
        """The last boundary that the paths to all places from which a piece can start share."""
        common: set[int] | None = None
        for at in range(end, max(done, end - self.longest), -1):
            if at in last:
                path = set()
                while at > done:
                    path.add(at)
                    at -= len(last[at])
                common = path if common is None else common & path
        return max(common or {done}, default=done)

    def follows(self, a: str, b: str) -> bool:
        """Whether b can be the piece after a; a is empty at the start."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        x = self.fits[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return x

    def ids_of(self, pieces: Iterable[str]) -> array:
        if isinstance(pieces, list):
            try:
                return array("i", [self.id[p] for p in pieces])
            except KeyError:  # a character without a piece
                pass
        out = array("i")
        for p in pieces:
            if (i := self.id.get(p)) is not None:
                out.append(i)
            else:
                out.extend([self.byte[b] for b in p.encode()] if self.byte[0] != self.unknown else [self.unknown])
        return out

    def learn(self, words: Iterable[str]) -> list[str]:
        """Makes the ids of all these words known, and returns those that are too long to stay so.

        A word counts with the space before it; its ends are certain boundaries.
        """
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        new = set(words).difference(self.known)
        seen = [w for w in new if w in self.older]
        self.known.update((w, self.older[w]) for w in seen)
        new.difference_update(seen)
        side = [w for w in new if len(w) <= STRETCH] if self.covered else []
        for lo in range(0, len(side), LANES):
            part = side[lo : lo + LANES]
            self.known.update(zip(part, self.side_by_side(part)))
        new.difference_update(side)
        for w in new:
            self.known[w] = self.ids_of(self.search(SPACE + w.replace(" ", SPACE))).tobytes()
        return [w for w in new if len(w) > STRETCH]

    def joined(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of texts, given as their words."""
        long = self.learn(chain.from_iterable(texts))
        out = [b"".join(map(self.known.__getitem__, words)) for words in texts]
        for w in long:
            del self.known[w]
        return out

    @staticmethod
    def words(text: str) -> list[str]:
        """The words of a text. Spaces in a row belong to the word behind them."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        words = text.split(" ")
        return [w[1:] for w in _spaced.findall(" " + text)] if "" in words else words

    def stream(self, text: str) -> Iterator[bytes]:
        """The ids of a text from left to right, COMMITTED words at a time: a word's end is a certain boundary."""
        words = self.words(text)
        for lo in range(0, len(words), COMMITTED):
            yield self.joined([words[lo : lo + COMMITTED]])[0]

    def encode_all(self, texts: list[str | None]) -> Iterator[list[bytes | None]]:
        """The ids of texts as 4-byte numbers, in lists for texts in a row: of TOGETHER characters, or of one text by its stream."""
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi] or "") <= TOGETHER):
                chars += len(texts[hi] or "")
                hi += 1
            part = texts[lo:hi]
            if hi == lo + 1:
                found = [b"".join(self.stream(part[0] or ""))]
            else:
                found = self.joined([self.words(t or "") for t in part])
            yield [None if t is None else x for t, x in zip(part, found)]
            lo = hi

    def encode(self, text: str) -> array:
        """The ids of a text."""
        out = array("i")
        if text:
            for part in self.stream(text):
                out.frombytes(part)
        return out

    def decode(self, ids) -> str:
        """The text of ids; those of no piece and no byte have none."""
        x = np.minimum(np.asarray(ids, np.int32).view(np.uint32), self.n)
        parts = np.split(x, np.flatnonzero(self.size[x] == 0))  # bytes beside such an id make no character together
        text = "".join(b"".join(self.spelt(part)).decode(errors="replace") for part in parts)
        return text.replace(SPACE, " ")[1:]

    def spelt(self, ids: np.ndarray) -> Iterator[bytes]:
        """What ids stand for, DECODED at a time."""
        for lo in range(0, len(ids), DECODED):
            x = ids[lo : lo + DECODED]
            n = self.size[x]
            end = np.cumsum(n)
            yield self.pool[np.repeat(self.start[x] - end + n, n) + np.arange(end[-1])].tobytes()


@lru_cache(4)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str | None = None, ids: bool = True) -> DataFrame:
    """(doc_id, text) -> doc_id, n_ids, ids_sha256 (of 4-byte little-endian ids), round_trip, and ids."""
    path = path or model_path()
    fields = "doc_id long, n_ids long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * ids
    names = ["doc_id", "n_ids", "ids_sha256", "round_trip"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(path)
        for batch in batches:
            texts, lo = batch.column(1).to_pylist(), 0
            for found in m.encode_all(texts):
                part = batch.slice(lo, len(found))
                rows = []
                for t, x in zip(texts[lo : lo + len(found)], found):
                    if x is None:
                        rows.append((None, None, None))
                    else:
                        rows.append((len(x) // 4, hashlib.sha256(x).hexdigest(), m.decode(np.frombuffer(x, np.int32)) == t))
                n, sha, back = zip(*rows)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.bool_())]
                if ids:
                    at = np.cumsum([0, *(x or 0 for x in n)])
                    flat = pa.array(np.frombuffer(b"".join(x for x in found if x), np.int32))
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat, mask=pa.array([x is None for x in found])))
                yield pa.RecordBatch.from_arrays(cols, names=names)
                lo += len(found)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), fields)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) -> doc_id, text. Null ids: null text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(path)
        for batch in batches:
            text = [None if x is None else m.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(tidied(run), "doc_id long, text string")
