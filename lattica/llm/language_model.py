"""Language-model scores from a weighted backoff automaton of trigrams.

Documents are gathered into packs, streams of word numbers. A pack counts its words, word pairs and triples and
hands them, in slices, to the slices' reducers, which return the corpus-wide training counts in the same order.
Each pack then builds exactly the part of the automaton that its texts can visit: states for the histories of two
words, one word and none; arcs for the n-grams seen in training, weighted by their smoothed log-probabilities; and
a failure arc from each state to the state of its history without the first word. One walk from left to right
carries the state over the stream and adds up the weights. All n-grams of the training documents are counted;
nothing is pruned, sampled or sent to the driver but totals.

P(w) = (c(w) + 1/2) / (N + (V + 1)/2) in the root, and P(w|h) = (c(hw) + MU P(w|h')) / (c(h) + MU) in a state h
whose shorter history is h', so its failure arc weighs MU / (c(h) + MU).

Words travel as they are, so their counts are exact. Pairs and triples travel as fingerprints of so many bits that
an n-gram meets another's with a chance of 2 ** -SPARE, however large the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut

#: Weights of the shorter history in the states of one and two words.
MU = (2000.0, 10.0)
#: Bytes of text in a pack, and tokens of the corpus for each slice of the n-grams.
PACK_BYTES, SLICE_TOKENS = 8_000_000, 2_000_000
#: Bits of a fingerprint beyond those that number the corpus's tokens.
SPARE = 17
#: Places of a stream that are walked at once.
CURSORS = 4096
_START, _END = 0, 1
#: No word holds a space.
_MARKS = (b" start", b" end")


def tokens(text: str | None) -> list[bytes]:
    """A text's words: runs without ASCII white space, A-Z in lower case. Null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x7F4A7C15F39CC060))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _squeeze(x: np.ndarray) -> bytes:
    """An integer array: its bytes by significance, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def _expand(raw: bytes, kind) -> np.ndarray:
    b = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(b.T).reshape(-1).view(kind)


def _pairs(left: np.ndarray, right: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (left, right) and the number of each place's."""
    code, at = np.unique(left * width + right, return_inverse=True)
    return code // width, code % width, at


def numbered(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """(distinct words, numbered from 2; the texts as one stream of numbers)."""
    number: dict[bytes, int] = {}
    stream: list[int] = []
    for t in texts:
        stream.append(_START)
        stream.extend([number.setdefault(w, len(number) + 2) for w in tokens(t)])
        stream.append(_END)
    return list(number), np.array(stream, np.int64)


def packed(words: list[bytes], stream: np.ndarray) -> bytes:
    """A stream in few bytes: frequent words get small numbers."""
    order = np.argsort(-np.bincount(stream, minlength=len(words) + 2)[2:], kind="stable")
    rank = np.arange(len(words) + 2)
    rank[order + 2] = np.arange(2, len(rank))
    names = zstandard.compress(b"\n".join(words[k] for k in order), 3)
    return len(names).to_bytes(4, "little") + names + _squeeze(rank[stream].astype(np.int32))


class Stream:
    """Some texts as one stream of word numbers, each text between a start and an end."""

    def __init__(self, words: list[bytes], stream: np.ndarray, train: np.ndarray):
        self.words, self.stream, self.size = words, stream, len(words) + 2
        self.doc = np.cumsum(stream == _START) - 1
        self.train = train
        here = np.nonzero(stream != _START)[0]
        self.here, self.word, self.prev = here, stream[here], stream[here - 1]
        self.counted = train[self.doc[here]]
        # pairs, and triples of a pair and a word; the word after the start has no pair before it
        self.first, self.second, self.pair = _pairs(self.prev, self.word, self.size)
        later = np.nonzero(self.prev != _START)[0]
        self.later = later
        self.before, self.third, self.triple = _pairs(self.pair[later - 1], self.word[later], self.size)

    @classmethod
    def of(cls, texts: list[str | None], train: np.ndarray) -> Stream:
        return cls(*numbered(texts), train)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.word[self.counted], minlength=self.size)

    def counts(self) -> np.ndarray:
        """Of the pairs, then the triples, in the training texts."""
        return np.concatenate([np.bincount(self.pair[self.counted], minlength=len(self.first)), np.bincount(self.triple[self.counted[self.later]], minlength=len(self.before))])

    def fingerprints(self, bits: int) -> np.ndarray:
        """Of the pairs, then the triples."""
        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in (*_MARKS, *self.words)), np.uint64, self.size)
        two = _mix(own[self.first], own[self.second])
        three = _mix(two[self.before], _mix(own[self.third], np.uint64(3)))
        return np.concatenate([two, three]) >> np.uint64(64 - bits)

    @classmethod
    def unpacked(cls, raw: bytes, train: np.ndarray) -> Stream:
        n = int.from_bytes(raw[:4], "little")
        words = zstandard.decompress(raw[4 : 4 + n])
        return cls(words.split(b"\n") if words else [], _expand(raw[4 + n :], np.int32).astype(np.int64), train)


_PACK = "pack long, ids array<long>, held array<boolean>, tokens long, stream binary"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some documents of a partition a row."""
    pack = TaskContext.get().partitionId() << 32
    ids, held, texts, size = [], [], [], 0

    def flush():
        words, stream = numbered(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([pack], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([len(stream) - len(ids)], pa.int64()), pa.array([packed(words, stream)], pa.binary())],
            names=["pack", "ids", "held", "tokens", "stream"],
        )

    for b in batches:
        for i, h, t in zip(*[c.to_pylist() for c in b.columns]):
            ids.append(i)
            held.append(bool(h))
            texts.append(t)
            size += len(t or "")
            if size >= PACK_BYTES:
                yield flush()
                pack, ids, held, texts, size = pack + 1, [], [], [], 0
    if ids:
        yield flush()


def _slice_of(x: np.ndarray, bits: int, slices: int) -> np.ndarray:
    return ((x >> np.uint64(bits - 32)) * np.uint64(slices)) >> np.uint64(32)


def _by_slice(s: Stream, bits: int, slices: int):
    """(order of the words, their bounds by slice, order of the distinct fingerprints, their bounds, each n-gram's among them)."""
    own = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in s.words), np.uint64, len(s.words))
    word_order = np.argsort(own, kind="stable")
    word_cuts = np.searchsorted(_slice_of(own[word_order], 64, slices), np.arange(slices + 1))
    keys, at = np.unique(s.fingerprints(bits), return_inverse=True)
    return word_order, word_cuts, keys, np.searchsorted(_slice_of(keys, bits, slices), np.arange(slices + 1)), at


_COUNTED = "pack long, slice int, words binary, word_counts binary, keys binary, counts binary"


def _counted(bits: int, slices: int):
    """Each pack's n-grams and their counts, a row for each slice."""
    shape = pa.schema([("pack", pa.int64()), ("slice", pa.int32()), *[(c, pa.binary()) for c in ("words", "word_counts", "keys", "counts")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, held, raw in zip(*[c.to_pylist() for c in b.columns]):
                s = Stream.unpacked(raw, ~np.array(held, bool))
                order, word_cuts, keys, cuts, at = _by_slice(s, bits, slices)
                word_counts = s.word_counts()[2:][order].astype(np.uint64)
                counts = np.bincount(at, weights=s.counts(), minlength=len(keys)).astype(np.uint32)
                out = []
                for k in range(slices):
                    w, g = slice(word_cuts[k], word_cuts[k + 1]), slice(cuts[k], cuts[k + 1])
                    if w.start < w.stop or g.start < g.stop:
                        words = zstandard.compress(b"\n".join(s.words[j] for j in order[w]), 1)
                        out.append((pack, k, words, _squeeze(word_counts[w]), _squeeze(np.diff(keys[g], prepend=np.uint64(0))), _squeeze(counts[g])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)] if out else [pa.array([], f.type) for f in shape], schema=shape)

    return run


_TOTAL = "pack long, slice int, word_counts binary, counts binary, n long, v long"


def _total(t: pa.Table) -> pa.Table:
    """One slice: for each pack, the corpus's counts of its words and n-grams; and the slice's totals of words."""
    packs = t.column("pack").to_pylist()
    keys = [np.cumsum(_expand(k, np.uint64), dtype=np.uint64) for k in t.column("keys").to_pylist()]
    counts = [_expand(c, np.uint32) for c in t.column("counts").to_pylist()]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(every)).astype(np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    words = [w.split(b"\n") if (w := zstandard.decompress(x)) else [] for x in t.column("words").to_pylist()]
    sums: dict[bytes, int] = {}
    for own, c in zip(words, t.column("word_counts").to_pylist()):
        for w, x in zip(own, _expand(c, np.uint64).tolist()):
            sums[w] = sums.get(w, 0) + x
    n = len(packs)
    return pa.table(
        {
            "pack": pa.array(packs, pa.int64()), "slice": t.column("slice"),
            "word_counts": pa.array([_squeeze(np.array([sums[w] for w in own], np.uint64)) for own in words], pa.binary()),
            "counts": pa.array([_squeeze(total[at[bounds[k] : bounds[k + 1]]]) for k in range(n)], pa.binary()),
            "n": pa.array([sum(sums.values())] + [0] * (n - 1), pa.int64()),
            "v": pa.array([sum(x > 0 for x in sums.values())] + [0] * (n - 1), pa.int64()),
        }
    )


class BackoffAutomaton:
    """States: 0 the root, 1 + w the history of a word, and one for each pair; arcs sorted by state and word."""

    def __init__(self, s: Stream, word_counts: np.ndarray, pairs: np.ndarray, triples: np.ndarray, n: int, v: int, starts: int, mu: tuple[float, float] = MU):
        """Counts of training: of the stream's words (start and end first), pairs and triples; N, V and the number of texts."""
        self.s, size = s, s.size
        self.known = word_counts > 0
        p1 = (np.where(self.known, word_counts, 0) + 0.5) / (n + 0.5 * (v + 1))
        seen = word_counts.astype(float)
        seen[_START] = starts
        p2 = (pairs + mu[0] * p1[s.second]) / (seen[s.first] + mu[0])
        # the shorter history of a triple is a pair of the stream, too
        code = s.first * size + s.second
        suffix = np.searchsorted(code, s.second[s.before] * size + s.third)
        p3 = (triples + mu[1] * p2[suffix]) / (pairs[s.before] + mu[1])
        # what the root does on each word, and where it leads
        self.root, self.enter = np.log10(p1), np.where(self.known, np.arange(size) + 1, 0)
        self.fail = np.concatenate([[0], np.zeros(size, np.int64), s.second + 1])
        self.fail_weight = np.concatenate([[0.0], np.log10(mu[0] / (seen + mu[0])), np.log10(mu[1] / (pairs + mu[1]))])
        two, three = np.nonzero(pairs > 0)[0], np.nonzero(triples > 0)[0]
        self.arc = np.concatenate([(s.first[two] + 1) * size + s.second[two], (size + 1 + s.before[three]) * size + s.third[three], [np.iinfo(np.int64).max]])
        self.weight = np.concatenate([np.log10(p2[two]), np.log10(p3[three]), [0.0]])
        self.target = np.concatenate([size + 1 + two, size + 1 + suffix[three], [0]])

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, weights) of reading a word in each state: failure arcs until an arc has the word."""
        state, out = state.copy(), np.zeros(len(state))
        todo = np.arange(len(state))
        while len(todo):
            now, w = state[todo], word[todo]
            code = now * self.s.size + w
            at = np.searchsorted(self.arc, code)
            found = self.arc[at] == code
            base = (now == 0) & ~found
            lost = ~found & ~base
            out[todo] += np.where(found, self.weight[at], np.where(base, self.root[w], self.fail_weight[now]))
            state[todo] = np.where(found, self.target[at], np.where(base, self.enter[w], self.fail[now]))
            todo = todo[lost]
        return state, out

    def traverse(self) -> np.ndarray:
        """The weight of each place of the stream, by one walk from left to right (0 at starts).

        The stream is walked from many places at once. A state is the longest known history of two words at
        most, so two words read before its first place, from the root, bring a cursor into its state.
        """
        stream = self.s.stream
        out = np.zeros(len(stream))
        length = max(2, -(-len(stream) // CURSORS))
        heads = np.arange(0, len(stream), length)
        state = np.zeros(len(heads), np.int64)
        for k in range(-2, length):
            at = heads + k
            live = np.nonzero((at >= 0) & (at < len(stream)))[0]
            word = stream[at[live]]
            state[live[word == _START]] = _START + 1
            live, word = live[word != _START], word[word != _START]
            state[live], weight = self.step(state[live], word)
            if k >= 0:
                out[at[live]] = weight
        return out


def _scored(bits: int, slices: int, n: int, v: int, starts: int, ends: int, mu: tuple[float, float]):
    def run(t: pa.Table) -> pa.Table:
        at = np.array(t.column("slice").to_pylist())
        own = int(np.nonzero(at == -1)[0][0])
        ids, held = t.column("ids")[own].as_py(), np.array(t.column("held")[own].as_py(), bool)
        s = Stream.unpacked(t.column("stream")[own].as_py(), ~held)
        order, _, keys, _, place = _by_slice(s, bits, slices)
        rows = [int(k) for k in np.argsort(at, kind="stable") if at[k] >= 0]
        blobs, word_blobs = t.column("counts").to_pylist(), t.column("word_counts").to_pylist()
        words = np.zeros(s.size, np.uint64)
        words[order + 2] = np.concatenate([np.zeros(0, np.uint64), *[_expand(word_blobs[k], np.uint64) for k in rows]])
        words[_END] = ends
        total = np.concatenate([np.zeros(0, np.uint64), *[_expand(blobs[k], np.uint64) for k in rows]])
        if len(total) != len(keys):
            raise RuntimeError("a pack's counts are incomplete")
        total = total[place].astype(float)
        machine = BackoffAutomaton(s, words.astype(float), total[: len(s.first)], total[len(s.first) :], n, v, starts, mu)
        m, doc = len(ids), s.doc[s.here]
        sums = lambda x: np.bincount(doc, weights=x, minlength=m)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(np.bincount(doc, minlength=m), pa.int64()),
                "n_known": pa.array(sums(machine.known[s.word]).astype(np.int64)), "train_tokens": pa.array([n] * m, pa.int64()),
                "base_score": pa.array(sums(machine.root[s.word])), "score": pa.array(sums(machine.traverse()[s.here])),
            }
        )

    return run


def scores(docs: DataFrame, held_out, mu: tuple[float, float] = MU) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out is a condition on docs' columns; null counts as false, and all rows for which it is false
    train the model. A null or empty text is one token, the end. Repeated rows train, and are scored, as
    often as they stand; no rows give no rows; without training rows every token is unknown. Other
    columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), "text")
    packed = cut(src.mapInArrow(_gather, _PACK))
    trained = F.size(F.filter("held", lambda h: ~h)).cast("long")
    size, starts = packed.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(trained), F.lit(0))).first()
    bits = min(64, SPARE + max(16, math.ceil(math.log2(max(2, size)))))
    slices = int(max(32, size // SLICE_TOKENS))
    totals = packed.select("pack", "held", "stream").mapInArrow(_counted(bits, slices), _COUNTED).groupBy("slice").applyInArrow(_total, _TOTAL)
    totals = cut(totals)
    n, v = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = n + starts, v + (starts > 0)  # each training text has one end
    none = lambda kind: F.lit(None).cast(kind)
    both = packed.select("pack", F.lit(-1).alias("slice"), "ids", "held", "stream", none("binary").alias("word_counts"), none("binary").alias("counts"))
    both = both.unionByName(totals.select("pack", "slice", none("array<long>").alias("ids"), none("array<boolean>").alias("held"), none("binary").alias("stream"), "word_counts", "counts"))
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.groupBy("pack").applyInArrow(_scored(bits, slices, int(n), int(v), int(starts), int(starts), mu), shape)
