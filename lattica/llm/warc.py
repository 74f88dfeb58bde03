"""WARC archives with a two-level capture index.

write() range-partitions the captures by their reversed-host URL key and page id, so one task writes one
archive and its index in key order. An index is compressed blocks of sorted lines; its tail is a sparse
directory with each block's first key, place and length. read() finds an index by the parts' first keys,
binary-searches its directory, range-reads the block, and range-reads the records it names.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, shared_dir

#: Lines of an index block; the date of all records (a parameter of the crawl, not of the clock).
BLOCK_LINES = 256
DATE = "2024-01-01T00:00:00Z"
#: Captures with shared payloads up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 50_000
#: Bytes of payload that one archive holds, about.
ARCHIVE_BYTES = 64_000_000
_MAGIC = b"CIDX"


def surt(url: Column) -> Column:
    """The reversed-host key of a URL: com,example,www)/path?query, host in lower case, without scheme, user, port, fragment."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rest = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^#]*)", 1)
    reversed_host = F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ",")
    return F.when(host == "", u).otherwise(F.concat(reversed_host, F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest)))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None, url: str | None) -> uuid.UUID:
    """A record's name: its page's id, or its URL where it has none."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"url:{url}" if page_id is None else f"page:{page_id}")


def record_bytes(url: str | None, payload: bytes, page_id: int | None, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member of its own; a revisit holds no payload, but its length and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    name = _name(page_id, url)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {json.dumps(url or '', ensure_ascii=True)[1:-1]}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:uuid:{_name(refers_to, None)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    raw = ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    return gzip.compress(raw, 4, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record; the lengths and the digest of a response are verified."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(rest) != len(block) + 4 or len(block) != int(fields["Content-Length"]):
        raise ValueError("a record's length is wrong")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and f"sha1:{base32_sha1(payload)}" != fields["WARC-Payload-Digest"]:
        raise ValueError("a payload's digest is wrong")
    return fields, payload


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) with payload, same (its SHA-256), first: the smallest page_id of the payload if several rows hold it.

    Only payloads of least_bytes or more are shared. Digests are grouped and joined without their payloads, and come
    back by page id and digest, which no payload that many pages share can gather in one task; captures that share
    theirs are broadcast if they are counted to be few.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    src = src.withColumn("same", F.sha2("payload", 256))
    long = src.where(F.length("payload") >= least_bytes).select("page_id", "same")
    shared = long.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    refs = cut(long.join(shared, "same").distinct())
    if refs.count() <= BROADCAST_ROWS:
        refs = F.broadcast(refs)
    refs = refs.select(F.col("page_id").alias("_id"), F.col("same").alias("_same"), "first")
    return src.join(refs, src["page_id"].eqNullSafe(F.col("_id")) & (src["same"] == F.col("_same")), "left").drop("_id", "_same")


def _fs(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


_PART = "part long, first_key string, first_id long, records long"


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes the archives and indexes of pages(page_id, url, html) below folder, a shared one; a row per part.

    A null html is an empty payload, a null url an empty key, repeated rows are records each. Of equal
    payloads of least_bytes or more, rows with the smallest page_id are responses and the others revisit
    it; a null page_id is never the smallest unless all are null. No rows give no parts. A task writes
    under names of its own attempt and renames at its end, so a repeated attempt leaves whole files.
    """
    rows = revisits(pages, least_bytes).select("page_id", "url", "payload", "first", surt(F.col("url")).alias("key"))
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    rows = rows.repartitionByRange(int(max(1, size // ARCHIVE_BYTES, pages.sparkSession.sparkContext.defaultParallelism)), "key", "page_id")
    rows = rows.sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        own = f"{base}/.{part:06d}-{uuid.uuid4().hex}"
        out, at, n, first = None, 0, 0, None
        blocks, lines, directory = [], [], []

        def close_block():
            if lines:
                raw = zlib.compress("\n".join(x for _, x in lines).encode(), 6)
                directory.append([*lines[0][0], sum(map(len, blocks)), len(raw)])
                blocks.append(raw)
                lines.clear()

        for b in batches:
            for page_id, url, payload, shared, key in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    out, first = fs.open_output_stream(f"{own}.warc.gz", compression=None), (key, page_id)
                revisit = shared is not None and page_id != shared
                raw = record_bytes(url, payload, page_id, shared, revisit)
                out.write(raw)
                lines.append(([key, page_id], json.dumps([key, page_id, at, len(raw)])))
                at, n = at + len(raw), n + 1
                if len(lines) == BLOCK_LINES:
                    close_block()
        if out is None:
            return
        close_block()
        out.close()
        tail = zlib.compress(json.dumps(directory).encode(), 6)
        with fs.open_output_stream(f"{own}.idx", compression=None) as f:
            f.write(b"".join(blocks) + tail + struct.pack("<q", len(tail)) + _MAGIC)
        fs.move(f"{own}.warc.gz", f"{base}/{part:06d}.warc.gz")
        fs.move(f"{own}.idx", f"{base}/{part:06d}.idx")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "first_key": [first[0]], "first_id": pa.array([first[1]], pa.int64()), "records": pa.array([n], pa.int64())})

    return cut(rows.mapInArrow(run, _PART))


def _order(key: str, page_id: int | None) -> tuple:
    """Spark's order: keys by bytes, null ids first."""
    return key.encode("utf-8", "surrogatepass"), page_id is not None, page_id or 0


class Index:
    """An index part: its directory in memory, a block at a time from the file."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        length, magic = struct.unpack("<q4s", self.file.read_at(12, size - 12))
        if magic != _MAGIC:
            raise ValueError("not a capture index")
        self.blocks = json.loads(zlib.decompress(self.file.read_at(length, size - 12 - length)))
        self.first = [_order(b[0], b[1]) for b in self.blocks]
        self.at, self.entries = -1, {}

    def find(self, key: str, page_id: int | None) -> list[tuple[int, int]]:
        """(offset, length) of the captures of a key and page id; repeated captures may span blocks."""
        want = _order(key, page_id)
        k = max(0, bisect.bisect_left(self.first, want) - 1)
        found = []
        while k < len(self.blocks) and (self.first[k] <= want):
            if self.at != k:
                _, _, at, length = self.blocks[k]
                self.entries = {}
                for line in zlib.decompress(self.file.read_at(length, at)).decode().split("\n"):
                    e = json.loads(line)
                    self.entries.setdefault((e[0], e[1]), []).append((e[2], e[3]))
                self.at = k
            found += self.entries.get((key, page_id), [])
            k += 1
        return found


_SHAPE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read(wanted: DataFrame, folder: str, parts: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of wanted(page_id, url), read through the index that write() gave parts for.

    A row per record: page_id, payload_bytes and payload_digest of the full payload, record_type,
    refers_to, url, payload (null for revisits). Captures that the archives lack give no row; a wanted
    row that is repeated reads its records once.
    """
    # the parts are as many as write()'s partitions, whatever the input holds in each
    starts = sorted((_order(r.first_key, r.first_id), r.part) for r in parts.collect())
    if not starts:
        return wanted.sparkSession.createDataFrame([], _SHAPE)
    bounds = [s for s, _ in starts]
    asked = wanted.select(F.col("page_id").cast("long").alias("page_id"), surt(F.col("url")).alias("key")).distinct()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            at, lo, hi = [], [], []
            for i, k in zip(ids, keys):
                want = _order(k, i)
                # equal captures may reach over several parts
                first, last = max(0, bisect.bisect_left(bounds, want) - 1), max(0, bisect.bisect_right(bounds, want) - 1)
                for p in range(first, last + 1):
                    at.append(starts[p][1])
                    lo.append(i)
                    hi.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.string())], names=["part", "page_id", "key"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        open_part, index, archive = None, None, None
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for part, page_id, key in zip(*[c.to_pylist() for c in b.columns]):
                if part != open_part:
                    index, archive, open_part = Index(fs, f"{base}/{part:06d}.idx"), fs.open_input_file(f"{base}/{part:06d}.warc.gz"), part
                for at, length in index.find(key, page_id):
                    fields, payload = parse_record(archive.read_at(length, at))
                    response = fields["WARC-Type"] == "response"
                    rows.append((page_id, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], None if response else int(fields["X-Refers-To-Page"]), json.loads(f'"{fields["WARC-Target-URI"]}"'), payload if response and with_payload else None))
                    held += len(payload)
                if held > 8_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    placed = asked.mapInArrow(place, "part long, page_id long, key string")
    near = placed.repartition(len(starts), "part").sortWithinPartitions("part", "key", "page_id")
    return near.mapInArrow(fetch, _SHAPE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _SHAPE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads all records back; see write() and read()."""
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    parts = write(pages, folder, least_bytes)
    return read(pages, folder, parts, with_payload=False)
