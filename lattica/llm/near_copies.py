"""Near copies by the Jaccard similarity of five-word shingle sets, 0.8 or more, among those that SimHash and min-hash bring together.

Texts get operator 8's fingerprint, of five-word shingles, and whatever its byte-position index with count filtering
links lies in one bucket. As two texts of similarity 0.8 may differ in more bits than that index bears, each distinct
shingle set also gets BANDS keys of ROWS min-hashes; sets that share a key meet in a bucket, and a
pair of similarity 0.8 meets in none with a chance of (1 - 0.8 ^ 5) ^ 32, about 3e-6. Within a bucket the exact
similarity is tested along a search tree: a set reached is compared with all sets not reached yet, so copies in
large groups make as many links as sets, not pairs. Buckets of the same members count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import components, cut
from lattica.llm.simhash import fingerprint, links

#: Words of a shingle; keys of a set, and min-hashes of a key.
WORDS, BANDS, ROWS = 5, 32, 5
_SLICE = 512
_R = np.random.default_rng(42)
_A, _B = _R.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_A |= np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's word shingles."""
    return np.unique(every_shingle(text, words))


def every_shingle(text: str | None, words: int = WORDS) -> np.ndarray:
    """The XXH64 (seed 42) values of a text's word shingles, repeats included.

    Words are maximal runs without ASCII white space, A-Z lower-cased. Fewer words than a shingle: the
    whole sequence is one shingle; no words or null: none.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    parts = [w[k : max(1, len(w) - words + 1) + k] for k in range(words)] if len(w) >= words else None
    values = [xxhash.xxh64_intdigest(s, 42) for s in (map(b" ".join, zip(*parts)) if parts else [b" ".join(w)])]
    return np.array(values, np.uint64)


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit hash of a shingle set."""
    return xxhash.xxh64_intdigest(s.tobytes(), 42) - (1 << 63)


def bands(s: np.ndarray) -> np.ndarray:
    """BANDS keys of a shingle set as signed longs; none for the empty set."""
    if not len(s):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), _SLICE):
        np.minimum(least, (_A * s[lo : lo + _SLICE] + _B).min(1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def tree(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect the same sets as all pairs with a similarity of 0.8 or more do."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(at, np.cumsum(sizes)[:-1])
    left, live, out = np.ones(n, bool), 2 * n + 1, []
    for root in range(n):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo and left.any():
            p = todo.pop()
            if 2 * left.sum() < live:  # postings of the sets that are not reached yet
                rest = np.nonzero(left)[0]
                live, flat = len(rest), np.concatenate([own[k] for k in rest])
                holders = np.repeat(rest, sizes[rest])[np.argsort(flat, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(values)))])
            both = np.bincount(np.concatenate([holders[ends[k] : ends[k + 1]] for k in own[p]]), minlength=n)
            near = np.nonzero(left & (9 * both >= 4 * (sizes + sizes[p])))[0].tolist()
            left[near] = False
            out += [(p, q) for q in near]
            todo += near
    return out


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t) for t in b.column(0).to_pylist()]
            keys = pa.array([set_key(s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["key", "held"])

    return docs.select("text").mapInArrow(run, "key long, held array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, fps, found = [], [], []
            for t in b.column(2).to_pylist():
                h = every_shingle(t)
                s = np.unique(h)
                keys.append(set_key(s))
                fps.append(int(np.uint64(fingerprint(h)).view(np.int64)) if len(h) else None)
                found.append(bands(s))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(keys, pa.int64()), pa.array(fps, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "key", "fp", "bands"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), "text")
    return own.mapInArrow(run, "doc_id long, text_key long, key long, fp long, bands array<long>")


def _text_key():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _edges(t: pa.Table) -> pa.Table:
    keys = t.column("key").to_pylist()
    found = tree([np.array(x, np.int64) for x in t.column("held").to_pylist()])
    return pa.table({"src": pa.array([keys[p] for p, _ in found], pa.int64()), "dst": pa.array([keys[q] for _, q in found], pa.int64())})


def _linked(distinct: DataFrame) -> DataFrame:
    """(key, band) of the sets whose fingerprints are equal or connected by operator 8's links; alone, a set has a band, too."""
    own = distinct.select("key", F.explode("fps").alias("fp"))
    roots = components(links(own))
    return own.join(roots, own["fp"] == roots["node"], "left").select("key", F.coalesce("root", "fp").alias("band")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group that similarities of 0.8 or more connect, the smallest doc_id; columns unchanged.

    Texts without words are copies of each other. Repeated rows stay as one; rows with a null doc_id stay.
    """
    known = docs.where("doc_id is not null")
    rows = _keyed(known).groupBy("key", "doc_id", "text_key").agg(F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    distinct = cut(rows.groupBy("key").agg(F.min(F.struct("doc_id", "text_key", "n")).alias("first"), F.collect_set("fp").alias("fps"), F.first("bands").alias("bands")))
    met = distinct.select("key", F.explode("bands").alias("band")).union(_linked(distinct)).groupBy("band").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    met = met.where(F.size("keys") > 1).select("keys").distinct()
    members = cut(met.select(F.xxhash64("keys").alias("bucket"), F.explode("keys").alias("key")))
    asked = cut(distinct.join(members.select("key").distinct(), "key", "left_semi").select("key", F.col("first.doc_id").alias("_first_id"), F.col("first.text_key").alias("_first_key")))
    here = known.select("doc_id", "text", _text_key().alias("_text_key"))
    here = here.join(asked, (here["doc_id"] == F.col("_first_id")) & (here["_text_key"] == F.col("_first_key")), "left_semi")
    sets = _sets(here).dropDuplicates(["key"])
    edges = members.join(sets, "key").groupBy("bucket").applyInArrow(_edges, "src long, dst long")
    roots = components(edges)
    joined = distinct.join(roots, distinct.key == roots.node, "left").select("first", F.coalesce("root", "key").alias("root"))
    kept = cut(joined.groupBy("root").agg(F.min("first").alias("first")).select("first.*"))
    kept_keys = kept.select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key"))
    keyed = docs.withColumn("_text_key", _text_key())
    out = keyed.join(kept_keys, (keyed["doc_id"] == F.col("_kept_id")) & (keyed["_text_key"] == F.col("_kept_key")), "left_semi")
    if not kept.where("n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "_text_key"])
    return out.drop("_text_key").unionByName(docs.where("doc_id is null"))
