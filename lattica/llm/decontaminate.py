"""Benchmark decontamination by Wu-Manber multi-pattern search.

Documents and test items are reduced to their words, joined by single spaces with one space before and
after. Every window of WINDOW consecutive item words becomes a pattern over these bytes. Patterns are
grouped by length class; for each class a table of shifts, indexed by a hash of the last BLOCK bytes
before the cursor, tells how far the cursor may jump, and where it may not, buckets of pattern suffix
hashes select the patterns that are compared byte by byte. Many cursors run over one buffer at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut

#: Words of a window.
WINDOW = 10
#: Bytes whose hash indexes a shift table, the most that leave room for jumps first.
BLOCKS = (8, 4, 2, 1)
#: Bytes of benchmark text that one pass over the documents searches; more text takes more passes.
PASS_BYTES = 16_000_000
#: Bytes of reduced text that are searched at once.
BUFFER = 4_000_000
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def reduce_text(text: str | None) -> bytes:
    """A text's words (ASCII letters in lower case, digits, anything beyond ASCII), joined by single spaces."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())


def item_windows(text: str | None, window: int = WINDOW) -> list[bytes]:
    """The windows of an item: runs of `window` words; a shorter item with any words is one window."""
    w = reduce_text(text).split()
    if not w:
        return []
    return [b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))]


class WuManber:
    """Finds all occurrences of byte patterns in a buffer; all cursors advance together."""

    def __init__(self, patterns: list[bytes]):
        self.classes = []
        by_class: dict[int, list[int]] = {}
        for k, p in enumerate(patterns):
            by_class.setdefault(0 if len(p) < 8 else 1 if len(p) < 28 else 2, []).append(k)
        for ids in by_class.values():
            self.classes.append(self._tables([patterns[k] for k in ids], np.array(ids)))

    @staticmethod
    def _hash(blocks: np.ndarray, bits: int) -> np.ndarray:
        return ((blocks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    @staticmethod
    def _blocks(text: np.ndarray, block: int) -> np.ndarray:
        """The block that begins at each byte, as a number; a view."""
        return np.ndarray((max(0, len(text) - block + 1),), f"<u{block}", text.tobytes(), 0, (1,))

    def _tables(self, patterns: list[bytes], ids: np.ndarray) -> dict:
        m = min(map(len, patterns))
        block = next(b for b in BLOCKS if 3 * b <= m or b == 1)
        every = self._blocks(np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8), block)
        heads = np.arange(len(patterns)) * m
        bits = int(min(22, max(12, (len(patterns) * (m - block + 1) * 8 - 1).bit_length())))
        shift = np.full(1 << bits, m - block + 1, np.int32)
        for end in range(block, m + 1):
            h = self._hash(every[heads + end - block], bits)
            np.minimum.at(shift, h, m - end)
        # suffix buckets: patterns in the order of their last block's hash
        order = np.argsort(h, kind="stable")
        lens = np.array([len(patterns[k]) for k in order], np.int64)
        flat = np.frombuffer(b"".join(patterns[k] for k in order), np.uint8)
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        return {"m": m, "block": block, "bits": bits, "shift": shift, "keys": h[order], "lens": lens, "flat": flat, "starts": starts, "ids": ids[order]}

    def find(self, buf: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(starts, pattern indices) of all occurrences in buf."""
        at, which = [], []
        text = np.frombuffer(buf, np.uint8)
        for t in self.classes:
            a, w = self._search(text, t)
            at.append(a)
            which.append(w)
        return (np.concatenate(at), np.concatenate(which)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _search(self, text: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
        n, m, block = len(text), t["m"], t["block"]
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = int(min(max(1, n // 512), 1 << 13))
        bounds = np.linspace(m, n + 1, lanes + 1).astype(np.int64)
        pos, stop = bounds[:-1].copy(), bounds[1:].copy()
        found = []
        every = self._blocks(text, block)
        while len(pos):
            live = pos < stop
            if not live.all():
                pos, stop = pos[live], stop[live]
                continue
            h = self._hash(every[pos - block], t["bits"])
            s = t["shift"][h]
            zero = s == 0
            if zero.any():
                found.append(np.stack([pos[zero] - m, h[zero]]))
            pos = pos + np.maximum(s, 1)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, h = np.concatenate(found, axis=1)
        lo, hi = np.searchsorted(t["keys"], h, "left"), np.searchsorted(t["keys"], h, "right")
        out_s, out_p = [], []
        while (more := lo < hi).any():
            start, lo, hi = start[more], lo[more], hi[more]
            ok = self._equal(text, start, lo, t)
            out_s.append(start[ok])
            out_p.append(t["ids"][lo[ok]])
            lo = lo + 1
        if not out_s:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_s), np.concatenate(out_p)

    @staticmethod
    def _equal(text: np.ndarray, start: np.ndarray, pat: np.ndarray, t: dict) -> np.ndarray:
        """Compares whole patterns directly, eight bytes of all candidates at a time."""
        length = t["lens"][pat]
        ok = start + length <= len(text)
        k = 0
        idx = np.nonzero(ok)[0]
        while len(idx):
            span = np.arange(k, k + 8)
            inside = span[None, :] < length[idx][:, None]
            a = text[np.minimum(start[idx][:, None] + span, len(text) - 1)]
            b = t["flat"][np.minimum(t["starts"][pat[idx]][:, None] + span, len(t["flat"]) - 1)]
            same = ((a == b) | ~inside).all(1)
            ok[idx[~same]] = False
            k += 8
            idx = idx[same & (length[idx] > k)]
        return ok


def _prepare(items: list[tuple], window: int) -> tuple[WuManber, list[bytes], list[list[str]]]:
    owners: dict[bytes, set[str]] = {}
    for item_id, text in items:
        for w in item_windows(text, window):
            owners.setdefault(b" " + w + b" ", set()).add(str(item_id))
    patterns = sorted(owners)
    return WuManber(patterns), patterns, [sorted(owners[p]) for p in patterns]


def _scan(texts: list[str | None], wm: WuManber, patterns: list[bytes]):
    """Per text: number of words, hit flags of the words (None if no hit), indices of the patterns found."""
    lens = np.array([len(p) for p in patterns], np.int64)
    group: list[bytes] = []
    size = 0

    def flush():
        if not group:
            return
        buf = b"\n".join(group)
        bounds = np.concatenate([[0], np.cumsum([len(g) + 1 for g in group])])
        at, which = wm.find(buf)
        order = np.argsort(at, kind="stable")
        at, which = at[order], which[order]
        cutp = np.searchsorted(at, bounds)
        for k, g in enumerate(group):
            a, w = at[cutp[k] : cutp[k + 1]] - bounds[k], which[cutp[k] : cutp[k + 1]]
            n_words = g.count(b" ") - 1 if len(g) > 1 else 0
            if not len(a):
                yield n_words, None, w
                continue
            spaces = np.nonzero(np.frombuffer(g, np.uint8) == 32)[0]
            first, last = np.searchsorted(spaces, a), np.searchsorted(spaces, a + lens[w] - 1)
            delta = np.zeros(n_words + 1, np.int64)
            np.add.at(delta, first, 1)
            np.add.at(delta, last, -1)
            yield n_words, np.cumsum(delta)[:n_words] > 0, w

    for t in texts:
        r = reduce_text(t)
        group.append(b" " + r + b" " if r else b" ")
        size += len(group[-1])
        if size >= BUFFER:
            yield from flush()
            group, size = [], 0
    yield from flush()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words: maximal runs of ASCII letters (lower-cased), digits and characters beyond ASCII. A word is hit
    inside any occurrence of a window of benchmark(item_id, text). n_items counts, and items_sha256
    digests, the items with occurring windows. Null or empty texts have no words and are clean; items with a null
    text or item_id and items without words are ignored; an empty benchmark hits nothing. Repeated rows give repeated
    results, and other columns are ignored.

    The benchmark is searched in passes of about PASS_BYTES of its text. A pass's rows are written to the shared
    folder before the next one starts, so the driver and the executors hold one pass's patterns at a time.
    """
    items = benchmark.select("item_id", "text").where("text is not null and item_id is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = int(total // PASS_BYTES) + 1
    cur = docs.select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    for p in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p)
        cur = cur.mapInArrow(_pass([tuple(r) for r in part.collect()], window, last=p == passes - 1), cur.schema)
        if p < passes - 1:
            cur = cut(cur)
    return cur.select(
        "doc_id", "n_words",
        F.coalesce(F.conv(F.hex("hits"), 16, 10).cast("long"), F.lit(0).cast("long")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def _pass(rows: list[tuple], window: int, last: bool):
    """One pass: adds its hits to the packed flags and its items to the list; the last one drops the text."""
    made: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(_prepare(rows, window))
        wm, patterns, owners = made[0]
        for b in batches:
            texts, hits, items = b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()
            n_words = np.zeros(len(texts), np.int64)
            for k, (n, flags, which) in enumerate(_scan(texts, wm, patterns)):
                n_words[k] = n
                if flags is not None:
                    old = np.unpackbits(np.frombuffer(hits[k], np.uint8))[:n].astype(bool) if hits[k] else False
                    hits[k] = np.packbits(flags | old).tobytes()
                    found = {o for w in set(which.tolist()) for o in owners[w]}
                    items[k] = sorted(found.union(items[k]))
                if last and hits[k]:
                    hits[k] = int(np.unpackbits(np.frombuffer(hits[k], np.uint8))[:n].sum()).to_bytes(8, "big")
            text = pa.nulls(len(texts), pa.string()) if last else b.column(1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), text, pa.array(n_words), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "text", "n_words", "hits", "items"],
            )

    return run


def clean_only(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that no benchmark window occurs in; columns and their order unchanged. See contamination()."""
    items = benchmark.select("item_id", "text").where("text is not null and item_id is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = int(total // PASS_BYTES) + 1
    out = docs
    for p in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p)
        out = out.mapInArrow(_drop([tuple(r) for r in part.collect()], window, docs.columns.index("text")), docs.schema)
        if p < passes - 1:
            out = cut(out)
    return out


def _drop(rows: list[tuple], window: int, text_at: int):
    made: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(_prepare(rows, window))
        wm, patterns, _ = made[0]
        for b in batches:
            clean = [flags is None for _, flags, _ in _scan(b.column(text_at).to_pylist(), wm, patterns)]
            yield b.filter(pa.array(clean, pa.bool_()))

    return run


def digest(items: list[str]) -> str:
    """The digest of a list of items, as contamination() gives it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
