"""Deterministic sharded WARC writer and its reader.

Records are dealt out to shards by ranges of page_id, whose limits follow from exact byte counts,
and sorted inside each. Every shard is written as files that roll over at a compressed size; each
record is a gzip member of its own. Headers, record ids and digests are made anew from the rows,
so the same rows and parameters give the same bytes. A file is written under a temporary name and
renamed when whole; a manifest table, written last, names the files that count, so what lost
executors leave behind is never read.

Of rows with equal payloads of at least `least_revisit` bytes, those with the smallest page_id
are responses and the others revisit it; smaller payloads are always responses. Null html is an
empty payload, a null url becomes urn:page:<id>. Rows without an id are responses. Rows that
repeat an id are records of their own. Extra columns are ignored; an empty table gives an empty
manifest.
"""

import base64
import hashlib
import math
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.shared import runs, stage
from sparkgauge.session import run_dir

#: Payload bytes per shard, about, and compressed bytes at which a file is closed.
SHARD_BYTES, ROLL_BYTES = 32 << 20, 16 << 20
#: Neighbouring shards that one task writes, and files that one reads (about, by hash), at most.
SHARDS_A_TASK, FILES_A_TASK = 8, 8
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Cells of the id range whose sizes reach the driver at once.
MOST_CELLS = 1 << 20


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _member(data: bytes) -> bytes:
    """A gzip member without a time of its own."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr(parts))}>"


def page_record(page_id, url, html, refers_to) -> bytes:
    """Uncompressed record of one row."""
    payload = (html or "").encode()
    digest = _base32(hashlib.sha1(payload).digest())
    target = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    block = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    kind, more = "response", []
    if refers_to is not None:
        kind = "revisit"
        more = [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", _record_id(refers_to, digest)),
            ("X-Refers-To-Page-Id", str(refers_to)),
        ]
    else:
        block += payload
    headers = [
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Target-URI", target),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}"),
        ("Content-Type", "application/http; msgtype=response"),
        *more,
    ]
    return _record(kind, headers, block)


def shard_limits(sizes: DataFrame, shard_bytes: int) -> np.ndarray:
    """First page_id of every shard but the first. `sizes` is (page_id, payload_bytes).

    The id range is cut into cells of equal width whose bytes are summed exactly; a cell beyond
    the shard size is cut again, until it is small enough or holds one id.
    """
    ends = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("payload_bytes")).first()
    if ends[0] is None:
        return np.zeros(0, np.int64)
    most = min(MOST_CELLS, max(1024, 4 * ends[2] // shard_bytes))
    todo, cells = [(int(ends[0]), int(ends[1]) + 1)], []
    while todo:
        lo, hi = todo.pop()
        width = math.ceil((hi - lo) / most)
        cell = F.floor((F.col("page_id") - F.lit(lo)) / F.lit(width)).cast("long")
        inside = sizes.where((F.col("page_id") >= lo) & (F.col("page_id") < hi))
        rows = inside.groupBy(cell.alias("c")).agg(F.sum("payload_bytes").alias("b"))
        for row in rows.collect():  # at most MOST_CELLS rows
            start = lo + row["c"] * width
            if row["b"] > shard_bytes and width > 1:
                todo.append((start, start + width))
            else:
                cells.append((start, row["b"]))
    limits, now = [], 0
    for start, total in sorted(cells):
        if now and now + total > shard_bytes:
            limits.append(start)
            now = 0
        now += total
    return np.array(limits, np.int64)


def typed_pages(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for responses."""
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    )
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = rows.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    keyed = stage(keyed, "payloads")
    first = keyed.where((F.col("n") >= least_revisit) & F.col("page_id").isNotNull())
    first = stage(
        first.groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1"),
        "first_payloads",
    )
    revisits = stage(
        keyed.join(first, "digest")
        .where((F.col("page_id") > F.col("first")) & (F.col("n") >= least_revisit))
        .select("page_id", F.col("digest").alias("d"), F.col("first").alias("refers_to"))
        .distinct(),
        "revisits",
    )
    both = rows.withColumn("digest", F.sha1(payload)).alias("p")
    on = (F.col("p.page_id") == F.col("r.page_id")) & (F.col("p.digest") == F.col("r.d"))
    return both.join(revisits.alias("r"), on, "left").select(
        "p.page_id", "p.url", "p.html", "r.refers_to"
    )


def _tasks(spark, pieces: int, most: int) -> int:
    """Tasks for so many pieces of work: as the session has them, more if one got over `most`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(pieces / most))


def _file_system(folder: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(folder)


def write(
    pages: DataFrame, folder: str, least_revisit: int = 0,
    shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Write `pages` as WARC files in `folder` and return the manifest (file, records, bytes,
    sha256, first_id, last_id). `folder` is a URI of a file system that pyarrow reaches.

    A task writes up to SHARDS_A_TASK neighbouring shards, whatever the size of the table. Files of
    attempts that failed stay below a temporary name and are removed once the manifest stands."""
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("long") + 512
    sizes = pages.select(F.col("page_id").cast("long"), size.alias("payload_bytes"))
    limits = shard_limits(stage(sizes.where("page_id is not null"), "sizes"), shard_bytes)
    known = pages.sparkSession.sparkContext.broadcast(limits)

    def number(batches):
        for batch in batches:
            ids = batch.column("page_id").fill_null(np.iinfo(np.int64).min).to_numpy(False)
            shard = np.searchsorted(known.value, ids, "right")
            yield batch.append_column("shard", pa.array(shard.astype(np.int64)))

    schema = "page_id long, url string, html string, refers_to long, shard long"
    numbered = typed_pages(pages, least_revisit).mapInArrow(number, schema)
    shards = len(limits) + 1
    each = math.ceil(shards / _tasks(pages.sparkSession, shards, SHARDS_A_TASK))
    task = F.floor(F.col("shard") / each).cast("int")
    ordered = numbered.repartitionById(math.ceil(shards / each), task).sortWithinPartitions(
        "shard", "page_id", "url", "html", "refers_to"
    )

    def writer(batches):
        files, base = _file_system(folder)
        files.create_dir(f"{base}/_temporary", recursive=True)
        state: dict = {"shard": None, "turn": 0, "out": None}

        def close():
            if state["out"] is None:
                return None
            state["out"].close()
            name = f"part-{state['shard']:06d}-{state['turn']:04d}.warc.gz"
            files.move(state["path"], f"{base}/{name}")
            state["out"] = None
            row = [name, state["n"], state["bytes"], state["sha"].hexdigest(), *state["ids"]]
            names = ["file", "records", "bytes", "sha256", "first_id", "last_id"]
            kinds = [pa.string(), *[pa.int64()] * 2, pa.string(), *[pa.int64()] * 2]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names
            )

        def put(data: bytes):
            state["out"].write(data)
            state["sha"].update(data)
            state["bytes"] += len(data)

        for row in (row for batch in batches for run in runs(batch, "html") for row in run.to_pylist()):
            new = row["shard"] != state["shard"]
            if state["out"] is not None and (new or state["bytes"] >= roll_bytes):
                yield close()
            if state["out"] is None:
                turn = 0 if new else state["turn"] + 1
                path = f"{base}/_temporary/{uuid.uuid4().hex}"
                state = {
                    "shard": row["shard"], "turn": turn, "path": path, "bytes": 0, "n": 0,
                    "out": files.open_output_stream(path, compression=None),
                    "sha": hashlib.sha256(), "ids": [row["page_id"], None],
                }
                put(_member(_record("warcinfo", [("WARC-Record-ID", _record_id(row["shard"], turn))],
                                    b"format: WARC File Format 1.1\r\n")))
            put(_member(page_record(row["page_id"], row["url"], row["html"], row["refers_to"])))
            state["n"] += 1
            state["ids"][1] = row["page_id"]
        last = close()
        if last is not None:
            yield last

    manifest = ordered.mapInArrow(
        writer,
        "file string, records long, bytes long, sha256 string, first_id long, last_id long",
    )
    manifest.write.option("compression", "zstd").parquet(f"{folder}/manifest")
    files, base = _file_system(folder)
    if files.get_file_info(f"{base}/_temporary").type == pfs.FileType.Directory:
        files.delete_dir(f"{base}/_temporary")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def _records(stream):
    """(headers, block) of every record of an open archive, one gzip member at a time."""
    unpacker, data, rest = zlib.decompressobj(31), bytearray(), b""
    while True:
        chunk = rest or stream.read(1 << 20)
        if not chunk:
            break
        data += unpacker.decompress(chunk)
        rest = unpacker.unused_data
        if unpacker.eof:
            head, _, block = bytes(data).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")[1:]
            headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
            yield headers, block[: int(headers["Content-Length"])]
            unpacker, data = zlib.decompressobj(31), bytearray()
    if data:
        raise ValueError("the archive ends inside a record")


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, file) of all page
    records in the files of a manifest. A digest that does not fit its content is an error."""

    def reader(batches):
        files, base = _file_system(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for headers, block in _records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        found = _base32(hashlib.sha1(block).digest())
                        if headers["WARC-Block-Digest"] != f"sha1:{found}":
                            raise ValueError(f"digest of a record in {name} does not fit")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = headers["WARC-Type"]
                        if kind == "response" and digest != _base32(hashlib.sha1(payload).digest()):
                            raise ValueError(f"payload digest of a record in {name} does not fit")
                        ids = headers["X-Page-Id"], headers.get("X-Refers-To-Page-Id", "")
                        own, other = (int(x) if x else None for x in ids)
                        rows.append((own, size, digest, kind, other, headers["WARC-Target-URI"], name))
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(),
                         pa.string()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                         "url", "file"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
                )

    parts = _tasks(manifest.sparkSession, manifest.count(), FILES_A_TASK)
    return manifest.select("file").repartition(parts, "file").mapInArrow(
        reader,
        "page_id long, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, url string, file string",
    )


def round_trip(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """Archive `pages` in a new folder of this run's shared folder, and read the records back."""
    folder = f"{run_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_back(write(pages, folder, least_revisit), folder)
