"""WARC archives of pages, and a two-level index of what was captured.

``write_archives`` writes a record for every page, each compressed by itself, into files of bounded size in
the shared folder, and lists where each is.  Of pages with equal payloads the one with the smallest id is a
``response``; the others are ``revisit`` records that refer to it and hold no payload.  ``build_index`` sorts
the list by URL key (the host's labels in reverse, then the path) and packs it into compressed blocks; a
sparse directory holds the first and last key of each block.  ``look_up`` finds the part of the index by
its first key, blocks by binary search in the part's directory, and entries by binary search in each block.
``read_records`` reads the listed ranges of the archives and parses them.

Inputs: a null payload counts as empty; a null URL or one without ``://`` has no host in its key and is
captured like any other.  A null id comes after all others; rows that share the smallest id and the payload
are all responses.  Repeated pages are captures of their own, and a look-up returns all captures of a key.
Empty tables give empty tables; other columns are ignored.  Payloads of any size are written whole, a page
at a time.
"""

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesift.llm.common import frugal, written
from tracesift.llm.url_rules import host_and_path
from tracesift.sources.scratch import shared_path

#: Bytes after which the next archive file is begun.
FILE_BYTES = 64 << 20
#: Entries in a block of the index.
BLOCK_ENTRIES = 2_000
#: Date of the records; the tables have none.
DATE = "2024-01-01T00:00:00Z"

_ENTRIES = "key string, page_id long, file string, offset long, length long"
_RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
_ID = "urn:capture:"


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query`` for sorting."""
    host, path = host_and_path(url)
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)\z", 1), F.lit(""))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def header(lines: list[tuple[str, str]]) -> bytes:
    """Header lines; line breaks within a value are written as percent codes."""
    safe = [(name, value.replace("\r", "%0D").replace("\n", "%0A")) for name, value in lines]
    return "".join(f"{name}: {value}\r\n" for name, value in safe).encode("utf-8", "surrogatepass")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed.  A revisit keeps the HTTP header, with the length of the full payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\n" + header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    if not revisit:
        block += payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", url or ""),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if revisit:
        lines += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{_ID}{'' if refers_to is None else refers_to}>"),
        ]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + header(lines) + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The fields of ``_RECORDS`` from one uncompressed record, checked against its digest and lengths."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = version == "WARC/1.1" and end == b"\r\n\r\n"
    if kind == "response":
        whole = whole and len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
    if not whole:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")

    def number(name: str) -> int | None:
        value = fields.get(name, "<>").strip("<>").removeprefix(_ID)
        return int(value) if value else None

    stored = payload if kind == "response" else None
    return number("WARC-Record-ID"), fields["WARC-Target-URI"], kind, stored, size, digest, number("WARC-Refers-To")


def file_system(path: str):
    """The file system of a folder that all executors see, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_archives(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """The list of records written: ``key``, ``page_id``, ``file``, ``offset``, ``length``.

    A task that runs again writes files of other names; only those that the list names are ever read.
    """
    folder = shared_path(pages.sparkSession, "warc")
    text = F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload")
    held = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text)
    held = held.withColumn("same", F.unhex(F.sha2("payload", 256)))
    # written, so that Spark may split the pages of one payload over several tasks when it joins them
    first = written(held.groupBy("same").agg(F.min("page_id").alias("first")), "first-payloads")
    typed = held.join(first, "same").select("page_id", "url", "payload", "first", url_key(F.col("url")).alias("key"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows: dict[str, list] = {"key": [], "page_id": [], "file": [], "offset": [], "length": []}
                for page_id, address, text, of, where in zip(*(batch.column(i) for i in range(5)), strict=True):
                    if out is None or offset >= FILE_BYTES:
                        if out:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{place}/{name}", compression=None)
                    page_id, of = page_id.as_py(), of.as_py()
                    made = record(page_id, address.as_py(), text.as_buffer().to_pybytes(), of, page_id != of)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(made) + packer.flush()
                    out.write(data)
                    for column, value in zip(rows, (where.as_py(), page_id, name, offset, len(data)), strict=True):
                        rows[column].append(value)
                    offset += len(data)
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))
        finally:
            if out:
                out.close()

    entries = written(typed.mapInArrow(run, _ENTRIES), "warc-entries")
    return entries.withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))


def build_index(entries: DataFrame, parts: int | None = None) -> DataFrame:
    """The index as a written table: ``part``, ``block``, ``first``, ``last`` (keys), ``n`` and ``data``.

    All but ``data`` is the sparse directory.  Parts are ranges of keys; captures of one key may fill several
    blocks and parts.  There are as many parts as the session has shuffle partitions, unless given.
    """
    parts = parts or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartitionByRange(parts, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    dealt = dealt.withColumn("part", F.spark_partition_id())
    schema = "part int, block int, first string, last string, n int, data binary"

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else 0
            for start in range(0, batch.num_rows, BLOCK_ENTRIES):
                some = batch.slice(start, BLOCK_ENTRIES)
                lines = list(zip(*(some.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True))
                data = zlib.compress("\n".join(json.dumps(line) for line in lines).encode(), 6)
                values = ([part], [number], [lines[0][0]], [lines[-1][0]], [len(lines)], [data])
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["part", "block", "first", "last", "n", "data"])
                number += 1

    return written(dealt.mapInArrow(run, schema), "warc-index")


def overlapping(firsts: list[str], lasts: list[str], key: str) -> range:
    """The ranges, in order, that may hold a key."""
    return range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))


def look_up(index: DataFrame, keys: DataFrame) -> DataFrame:
    """All captures of the keys (column ``key``): the fields of the list of records."""
    ranges = index.groupBy("part").agg(F.min("first").alias("first"), F.max("last").alias("last")).orderBy("first", "last").collect()
    parts, firsts, lasts = ([r[i] for r in ranges] for i in range(3))  # as many as the index has parts

    @frugal
    def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(parts[i], key) for key in batch.column("key").to_pylist() for i in overlapping(firsts, lasts, key)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.string())], ["part", "key"])

    wanted = keys.select("key").where(F.col("key").isNotNull()).distinct().mapInArrow(to_parts, "part int, key string")
    directory = index.select("part", "first", "last", "block")

    def to_blocks(keys: pa.Table, blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by([("first", "ascending"), ("last", "ascending"), ("block", "ascending")])
        part = blocks.column("part")[0].as_py() if blocks.num_rows else None
        firsts, lasts, numbers = (blocks.column(c).to_pylist() for c in ("first", "last", "block"))
        found = [(numbers[i], key) for key in keys.column("key").to_pylist() for i in overlapping(firsts, lasts, key)]
        kinds = (pa.int32(), pa.int32(), pa.string())
        columns = ([part] * len(found), [f[0] for f in found], [f[1] for f in found])
        return pa.table([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=["part", "block", "key"])

    asked = wanted.groupBy("part").cogroup(directory.groupBy("part")).applyInArrow(to_blocks, "part int, block int, key string")
    asked = asked.groupBy("part", "block").agg(F.collect_list("key").alias("keys"))

    @frugal
    def to_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, own in zip(batch.column("data"), batch.column("keys"), strict=True):
                entries = [json.loads(line) for line in zlib.decompress(data.as_py()).split(b"\n")]
                order = [e[0] for e in entries]
                found = [e for key in own.as_py() for e in entries[bisect.bisect_left(order, key) : bisect.bisect_right(order, key)]]
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([e[i] for e in found], t) for i, t in enumerate(kinds)], ["key", "page_id", "file", "offset", "length"]
                )

    return index.select("part", "block", "data").join(asked, ["part", "block"]).mapInArrow(to_entries, _ENTRIES)


def read_records(entries: DataFrame) -> DataFrame:
    """The records at the listed ranges, file by file."""
    sorted_entries = entries.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
        names = [part.split()[0] for part in _RECORDS.split(", ")]
        path, source = None, None
        try:
            for batch in batches:
                rows, held = [], 0
                for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if name != path:
                        if source:
                            source.close()
                        system, place = file_system(name)
                        path, source = name, system.open_input_file(place)
                    rows.append(parse(zlib.decompress(source.read_at(length, offset), 31)))
                    held += rows[-1][4]
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        finally:
            if source:
                source.close()

    return sorted_entries.mapInArrow(run, _RECORDS)
