"""Lexical retrieval packing: a sharded BM25 inverted index fills windows with related documents.

A first pass counts document frequencies of hashed terms over all documents (a table of fixed size). A
second pass tokenises; consecutive documents of a partition form shards of bounded size, each with its
own inverted index over the corpus's statistics. Each seed document retrieves its nearest unused
neighbours, which fill its window greedily; a document that doesn't fit is cut, and its rest seeds the
next window. Only a shard's last sequence can hold padding.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a window.
WINDOW = 1024
#: A shard ends at so many documents or tokens.
SHARD_DOCS, SHARD_TOKENS = 1024, 4_000_000
#: Buckets of hashed terms; slices in which their counts are summed.
BUCKETS, SLICES = 1 << 18, 16
#: BM25's constants, and the neighbours taken from a retrieval before the next one.
K1, B, NEIGHBOURS = 1.2, 0.75, 32


class Tokenizer:
    """The ids of byte_bpe_50k.json, each four little-endian bytes, ended by id 0.

    The tiktoken form of the same vocabulary encodes, as it does so faster with the same result; texts
    that name the special token go to the json file's own tokenizer.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.whole = json_path, None

    def encode(self, text: str | None) -> bytes:
        t = text or ""
        if self.SPECIAL in t:
            if self.whole is None:
                from tokenizers import Tokenizer as Whole

                self.whole = Whole.from_file(self.json_path)
            ids = self.whole.encode(t, add_special_tokens=False).ids
        else:
            ids = self.enc.encode_ordinary(t)
        return array("I", ids).tobytes() + bytes(4)


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(json_path: str, ranks_path: str, pattern: str) -> Tokenizer:
    """One tokenizer a worker."""
    if json_path not in _TOKENIZERS:
        _TOKENIZERS[json_path] = Tokenizer(json_path, ranks_path, pattern)
    return _TOKENIZERS[json_path]


_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(distinct hashed terms, their counts, the number of words)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & np.uint32(BUCKETS - 1)
    t, c = np.unique(h, return_counts=True)
    return t.astype(np.int64), c, len(words)


def term_statistics(docs: DataFrame) -> tuple[np.ndarray, int, float]:
    """(documents that hold each bucket, documents, mean words a document) over all of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, words = np.zeros(BUCKETS, np.int64), 0, 0
        for b in batches:
            for t in b.column(0).to_pylist():
                k, _, w = terms(t)
                df[k] += 1
                n, words = n + 1, words + w
        if n:
            parts = np.split(df, SLICES)
            yield pa.RecordBatch.from_pydict({"part": list(range(SLICES)), "df": [zlib.compress(p.tobytes(), 1) for p in parts], "n": [n] * SLICES, "words": [words] * SLICES}, schema=pa.schema([("part", pa.int32()), ("df", pa.binary()), ("n", pa.int64()), ("words", pa.int64())]))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for part, df, n, words in zip(*[c.to_pylist() for c in b.columns]):
                s = sums.setdefault(part, [np.zeros(BUCKETS // SLICES, np.int64), 0, 0])
                s[0] += np.frombuffer(zlib.decompress(df), np.int64)
                s[1] += n
                s[2] += words
        for part, (df, n, words) in sums.items():
            yield pa.RecordBatch.from_pydict({"part": [part], "df": [zlib.compress(df.tobytes(), 1)], "n": [n], "words": [words]}, schema=pa.schema([("part", pa.int32()), ("df", pa.binary()), ("n", pa.int64()), ("words", pa.int64())]))

    shape = "part int, df binary, n long, words long"
    rows = docs.select("text").mapInArrow(count, shape).repartition(SLICES, "part").mapInArrow(total, shape).collect()
    df = np.zeros(BUCKETS, np.int64)
    for r in rows:
        df[r.part * (BUCKETS // SLICES) : (r.part + 1) * (BUCKETS // SLICES)] = np.frombuffer(zlib.decompress(r.df), np.int64)
    n, words = (rows[0].n, rows[0].words) if rows else (0, 0)
    return df, n, words / max(1, n)


def pack_shard(ids: list[bytes], texts: list[str | None], idf: np.ndarray, mean_words: float, window: int = WINDOW):
    """Pieces (document, start, length, sequence, offset) of one shard, numbered from 0."""
    n = len(ids)
    length = np.array([len(x) // 4 for x in ids], np.int64)
    vectors = [terms(t) for t in texts]
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(v[0]) for v in vectors])
    term = np.concatenate([v[0] for v in vectors]) if n else np.zeros(0, np.int64)
    freq = np.concatenate([v[1] for v in vectors]).astype(np.float64) if n else np.zeros(0)
    # only terms that several documents hold and that weigh something have postings
    holders = np.bincount(term, minlength=BUCKETS)
    keep = (holders[term] > 1) & (idf[term] > 0)
    owner, term, freq = owner[keep], term[keep], freq[keep]
    norm = np.array([K1 * (1 - B + B * v[2] / max(1e-9, mean_words)) for v in vectors])
    weight = idf[term] * freq * (K1 + 1) / (freq + norm[owner])
    by = np.argsort(term.astype(np.int32), kind="stable")
    post, weight = owner[by], weight[by]
    sizes = np.where(idf > 0, np.where(holders > 1, holders, 0), 0)
    heads = np.concatenate([[0], np.cumsum(sizes)])
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    left = length > 0
    done = np.zeros(n, np.int64)
    pieces, seq, offset, nxt = [], 0, 0, 0
    queue: list[int] = []
    cur = -1
    while True:
        if cur < 0:
            if offset:
                # the window has room: the neighbours of its seed, nearest first
                while queue and not left[queue[-1]]:
                    queue.pop()
                if not queue:
                    q = term[at[seed] : at[seed + 1]]
                    score = np.zeros(n)
                    if len(q):
                        cnt = sizes[q]
                        idx = np.repeat(heads[q] - np.concatenate([[0], np.cumsum(cnt)[:-1]]), cnt) + np.arange(cnt.sum())
                        score = np.bincount(post[idx], weights=weight[idx], minlength=n)
                    score[~left] = -1
                    k = min(NEIGHBOURS, n)
                    best = np.argpartition(-score, k - 1)[:k]
                    best = best[np.lexsort((best, -score[best]))]
                    queue = [int(x) for x in best[::-1] if left[x] and score[x] > 0]
                if queue:
                    cur = queue.pop()
            if cur < 0:
                while nxt < n and not left[nxt]:
                    nxt += 1
                if nxt == n:
                    break
                cur = nxt
            left[cur] = False
        if offset == 0:
            seed, queue = cur, []
        take = min(window - offset, int(length[cur] - done[cur]))
        pieces.append((cur, int(done[cur]), take, seq, offset))
        done[cur] += take
        offset += take
        if offset == window:
            seq, offset = seq + 1, 0
        if done[cur] == length[cur]:
            cur = -1
    return pieces, seq + (offset > 0)


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """Packs docs(doc_id, text) into sequences of at most `window` tokens; a row per piece.

    A document is its ids and an ending 0, so null and empty texts are one token. Each token lies in one
    piece. sequence_id is unique and offset has no gaps from 0. Repeated rows are packed each; null ids
    stay null; no rows give no pieces. Columns: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and ids, the piece's tokens.
    """
    df, n, mean_words = term_statistics(docs)
    # BM25's idf; a term in more than half of the documents weighs nothing
    idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5))).astype(np.float32)
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(json_path, ranks_path, pattern)
        first = TaskContext.get().partitionId() << 36
        used = 0
        doc, ids, texts, size = [], [], [], 0

        def shard():
            nonlocal used
            pieces, sequences = pack_shard(ids, texts, idf, mean_words, window)
            for lo in range(0, len(pieces), 8192):
                part = pieces[lo : lo + 8192]
                raw = [ids[d][4 * s : 4 * (s + k)] for d, s, k, _, _ in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc[p[0]] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64()),
                        pa.array([p[2] for p in part], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                        pa.array([len(ids[p[0]]) // 4 for p in part], pa.int64()),
                        pa.array([first + used + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64()),
                        pa.array(raw, pa.binary()),
                    ],
                    names=names,
                )
            used += sequences

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc.append(d)
                texts.append(t)
                ids.append(tok.encode(t))
                size += len(ids[-1]) // 4
                if len(doc) >= SHARD_DOCS or size >= SHARD_TOKENS:
                    yield from shard()
                    doc, ids, texts, size = [], [], [], 0
        if doc:
            yield from shard()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, shape)
