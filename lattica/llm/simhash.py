"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes; two that differ in at most two bits share six or more. The index posts
every distinct fingerprint under the fourteen planes of four byte positions: any two positions lie together in
three planes, so fingerprints that share six bytes meet in three postings at least, and those that share five or
fewer in one at most. Meetings are tallied for each pair, pairs that reach the three that are guaranteed are
kept and verified by their differing bits.

A posting longer than LONG would make pairs in the square of its length. Its members are posted again under
six bytes, their plane and two more positions: that is the guaranteed minimum, and such a posting holds at most
65,536 fingerprints, which a task links without pairing them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import components, cut

#: Members of a posting whose meetings are tallied pair by pair.
LONG = 64
#: Four byte positions whose numbers cancel out in an exclusive or.
PLANES = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
#: Postings in which fingerprints that share six bytes meet at least, and the bits in which they may differ.
MEETINGS, BITS = 3, 2
_SLICE = 1 << 16


def simhash(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the XXH64 (seed 42) values of a text's word shingles, repeats included.

    Words are maximal runs without ASCII white space, A-Z lower-cased. Fewer words than a shingle: the
    whole sequence is one shingle; no words or null: zero.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        return digest(b" ".join(w), 42)
    ones, n = np.zeros(64, np.int64), len(w) - words + 1
    for lo in range(0, n, _SLICE):
        hi = min(n, lo + _SLICE)
        part = [w[lo + k : hi + k] for k in range(words)]
        h = np.array([digest(s, 42) for s in map(b" ".join, zip(*part))], np.uint64)
        ones += _ones(h)
    return _over_half(ones, n)


def _ones(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _over_half(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(h: np.ndarray) -> int:
    """The SimHash of a text whose shingles, repeats included, have these values; zero if there are none."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), _SLICE):
        ones += _ones(h[lo : lo + _SLICE])
    return _over_half(ones, len(h))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _byte(k: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(0xFF))


def _postings(distinct: DataFrame) -> DataFrame:
    """(fp, plane, bytes): a row for each plane."""
    keys = []
    for n, plane in enumerate(PLANES):
        four = _byte(plane[0])
        for k in plane[1:]:
            four = F.shiftleft(four, 8).bitwiseOR(_byte(k))
        keys.append(F.struct(F.lit(n).alias("plane"), four.alias("bytes")))
    return distinct.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.plane", "key.bytes")


def _refined(long: DataFrame) -> DataFrame:
    """(fp, plane, bytes, more): members of long postings under each two of their plane's other positions."""
    rows = []
    for n, plane in enumerate(PLANES):
        rest = [k for k in range(8) if k not in plane]
        two = [F.shiftleft(_byte(i), 8).bitwiseOR(_byte(j)).bitwiseOR(F.lit((i * 8 + j) << 16)) for i, j in combinations(rest, 2)]
        rows.append(F.array(*two))
    return long.select("fp", "plane", "bytes", F.explode(F.get(F.array(*rows), F.col("plane"))).alias("more"))


def linked(values: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join fingerprints of six equal bytes as all pairs within BITS bits do."""
    v = values.view(np.uint64)
    order = np.argsort(v)
    v = v[order]
    where = {int(x): k for k, x in enumerate(v)}
    free = np.bitwise_or.reduce(v ^ v[0])
    bits = [1 << b for b in range(64) if int(free) >> b & 1]
    masks = bits + [a | b for a, b in combinations(bits, 2)]
    left, out = np.ones(len(v), bool), []
    for root in range(len(v)):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            p = todo.pop()
            if len(v) <= len(masks):
                near = np.nonzero(left & (np.bitwise_count(v ^ v[p]) <= BITS))[0].tolist()
            else:
                own = int(v[p])
                near = [k for m in masks if (k := where.get(own ^ m)) is not None and left[k]]
            left[near] = False
            out += [(p, q) for q in near]
            todo += near
    at = v.view(np.int64)
    return [(int(at[p]), int(at[q])) for p, q in out]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [e for fps in b.column(0).to_pylist() for e in linked(np.array(fps, np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["src", "dst"])


def links(fps: DataFrame) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints fp that connect all within two bits; nulls are ignored."""
    distinct = cut(fps.where("fp is not null").select("fp").distinct())
    post = _postings(distinct)
    sizes = cut(post.groupBy("plane", "bytes").agg(F.count("*").alias("n")).where("n > 1"))
    short = post.join(sizes.where(f"n <= {LONG}").select("plane", "bytes"), ["plane", "bytes"], "left_semi")
    met = short.groupBy("plane", "bytes").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    each = met.select(F.explode("fps").alias("src"), "fps").select("src", F.explode("fps").alias("dst")).where("src < dst")
    tally = each.groupBy("src", "dst").agg(F.count("*").alias("met")).where(F.col("met") >= MEETINGS)
    pairs = tally.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= BITS).select("src", "dst")
    # whoever meets in a long posting is found there; whoever meets in none has all meetings tallied above
    long = post.join(sizes.where(f"n > {LONG}").select("plane", "bytes"), ["plane", "bytes"], "left_semi")
    six = _refined(long).groupBy("plane", "bytes", "more").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return pairs.union(six.select("fps").mapInArrow(_members, "src long, dst long")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs(doc_id, text).

    Fingerprints link at two or fewer differing bits; component_id is the smallest doc_id reachable.
    Null and empty texts have fingerprint zero and link like any other. Repeated rows give repeated
    results; a null doc_id gets the component of its fingerprint (null if alone). Other columns of docs
    are ignored, whatever their names; no rows give no rows.
    """
    fps = cut(fingerprints(docs, words))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(fps))
    joined = first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    joined = cut(joined)
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its near-duplicate group; columns unchanged.

    Repeated rows of a kept doc_id stay as one; rows with a null doc_id stay.
    """
    near = near_duplicates(docs.where("doc_id is not null"), words)
    kept = near.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = cut(kept)
    out = docs.join(kept.select(F.col("doc_id").alias("_kept_id")), docs["doc_id"] == F.col("_kept_id"), "left_semi")
    if not kept.where("n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.where("doc_id is null"))
