"""WARC archives: written with an index first, read back by coalesced byte ranges.

Records follow WARC/1.1, one gzip member each. Payloads are ``html`` in UTF-8 (null: empty). Of records
with equal payloads of at least REVISIT_BYTES bytes the one with the largest page_id is a response and
the others revisit it; all smaller ones are responses.

``write`` makes one archive a task, in the cluster's shared folder, and gives the index: archive, offset
and length of each record, URL, digest. A repeated task writes an archive of its own name, and the index
that Spark commits names only the archives of tasks that ended well, so lost executors do no harm.
``fetch`` takes index rows, sorts them by archive and offset, joins neighbouring ranges up to RANGE_BYTES
with gaps of up to GAP_BYTES, and cuts the records out of what it has read. Every response's digest is
verified against its payload. Archives are reached through pyarrow's file systems (file, hdfs, s3, gs, abfs);
Hadoop's names for them (s3a, s3n, viewfs, wasb, wasbs, abfss, dbfs) are mapped to those.

Large payloads meet their digest's holder by a join. A digest with more than a share of 1 / HOT of all rows is
broadcast, HOT rows at most, and its rows stay where they are, so no page that is found everywhere gathers in one task.

Defined cases: null URLs have an empty target, control characters in a target are percent-encoded, while
the index keeps the URL itself. A null page_id has a record id of its own kind and reads back as null; it
is a response only if no row of its payload has an id. Rows that repeat both the largest page_id and the
payload are all responses. An empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ..session import new_path
from ._spark import saved, small_batches

REVISIT_BYTES = 1000
HOT = 1000
RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
#: Archives are read in parts of this size, so that a large one is not one task's work.
PART_BYTES = 32 << 20
#: Tasks that read, at most; each takes as many parts as that leaves it, one after the other.
MAX_TASKS = 20_000
DATE = "2024-01-01T00:00:00Z"
_ID, _NULL_ID = 0x7370616E6C6F4F00, 0x7370616E6C6F4E00

INDEX = "page_id long, url string, digest string, record_type string, archive string, offset long, length long"


def _urn(page_id: int | None) -> str:
    number = _NULL_ID << 64 if page_id is None else (_ID << 64) | (page_id & 0xFFFFFFFFFFFFFFFF)
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def _page_id(urn: str) -> int | None:
    number = uuid.UUID(urn.strip("<>")[len("urn:uuid:") :]).int
    low = number & 0xFFFFFFFFFFFFFFFF
    return None if number >> 64 == _NULL_ID else low - (1 << 64) if low >> 63 else low


def _target(url: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x21 or ord(c) == 0x7F else c for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit_of: int | None, revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit with the payload's length only."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_target(url)}", f"WARC-Payload-Digest: sha1:{b32}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(revisit_of)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's type, ids, URL, payload and digest; a response whose digest is wrong is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} fails its digest")
    refers = _page_id(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return {"page_id": _page_id(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": refers, "payload": payload if response else None}


#: Hadoop's names of file systems, and pyarrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfs", "abfss": "abfs", "viewfs": "hdfs"}


def located(archive: str) -> str:
    """A Hadoop path as a URI that pyarrow knows."""
    scheme, colon, rest = archive.partition(":")
    if not colon or "/" in scheme:
        return f"file://{archive}"
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    if scheme == "dbfs":  # mounted for every process of such a cluster
        return "file:///dbfs/" + rest.lstrip("/")
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def _open(archive: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(located(archive))


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) and return the index."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    payload = F.col("html").cast("binary")
    # payloads count as equal if a second hash and the length agree as well
    rows = rows.withColumn("digest", F.sha1(payload)).withColumn("same", F.concat_ws(":", "digest", F.octet_length(payload).cast("string"), F.xxhash64("html").cast("string")))
    large = rows.where(F.octet_length(payload) >= REVISIT_BYTES)
    shared = saved(large.groupBy("same").agg(F.count("*").alias("n"), F.max("page_id").alias("holder")).where("n > 1 and holder is not null"), "payloads")
    least = (shared.agg(F.sum("n")).first()[0] or 0) // HOT
    hot = F.broadcast(shared.where(F.col("n") > least).select("same", F.col("holder").alias("hot_holder")))  # HOT rows at most
    met = rows.join(hot, "same", "left").withColumn("key", F.when(F.col("hot_holder").isNull(), F.col("same")).otherwise(F.xxhash64("page_id", "url").cast("string")))
    rest = shared.where(F.col("n") <= least).select(F.col("same").alias("key"), "holder")
    judged = met.join(rest, "key", "left").withColumn("holder", F.coalesce("hot_holder", "holder")).withColumn("revisit", F.coalesce(F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder")), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        system, path = _open(name)
        out, at = None, 0
        for batch in _text.slices(batches, "html"):
            if out is None:
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(path, compression=None)
            offsets, lengths = [], []
            for page_id, url, html, digest, holder, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "holder", "revisit")), strict=True):
                packed = zlib.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, holder, revisit), 1, 31)
                out.write(packed)
                offsets.append(at)
                lengths.append(len(packed))
                at += len(packed)
            kinds = pc.if_else(batch.column("revisit"), "revisit", "response")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "digest")), kinds, pa.array([name] * batch.num_rows, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["page_id", "url", "digest", "record_type", "archive", "offset", "length"])
        if out is not None:
            out.close()

    return saved(judged.select("page_id", "url", "html", "digest", "holder", "revisit").mapInArrow(run, INDEX), "warc-index")


def ranges(offsets: np.ndarray, lengths: np.ndarray, most: int = RANGE_BYTES, gap: int = GAP_BYTES) -> list[tuple[int, int]]:
    """Sorted record places -> (first, past the last) of the records that one read covers."""
    out, first = [], 0
    for i in range(1, len(offsets) + 1):
        end = offsets[i - 1] + lengths[i - 1]
        if i == len(offsets) or offsets[i] - end > gap or offsets[i] + lengths[i] - offsets[first] > most:
            out.append((first, i))
            first = i
    return out


def fetch(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Read the records that ``index`` rows (archive, offset, length) name; with payloads if asked."""
    small_batches(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = None, None
        for batch in batches:
            archives, offsets, lengths = batch.column("archive"), *(batch.column(c).to_numpy() for c in ("offset", "length"))
            codes = archives.dictionary_encode()
            which = codes.indices.to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(np.diff(which)) + 1), len(which)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                name = codes.dictionary[int(which[a])].as_py()
                if place != name:
                    if held is not None:
                        held.close()
                    system, path = _open(name)
                    held, place = system.open_input_file(path), name
                for first, last in ranges(offsets[a:b], lengths[a:b]):
                    start = int(offsets[a + first])
                    data = held.read_at(int(offsets[a + last - 1] + lengths[a + last - 1]) - start, start)
                    found = [parse(zlib.decompress(data[o : o + n], 31)) for o, n in zip((offsets[a + first : a + last] - start).tolist(), lengths[a + first : a + last].tolist(), strict=True)]
                    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                    columns = [pa.array([x[n] for x in found], k) for n, k in zip(names, kinds, strict=True)]
                    if payloads:
                        names, columns = [*names, "payload"], [*columns, pa.array([x["payload"] for x in found], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names)
        if held is not None:
            held.close()

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if payloads else "")
    rows = index.select("archive", "offset", "length", F.floor(F.col("offset") / PART_BYTES).alias("part"))
    # index rows are small and what they name is not: the tasks are counted by the bytes to be read
    parts = min(MAX_TASKS, max(1, rows.select("archive", "part").distinct().count()))
    return rows.repartition(parts, "archive", "part").sortWithinPartitions("archive", "offset").mapInArrow(run, schema)


def digest(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives."""
    return fetch(write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
