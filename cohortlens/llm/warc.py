"""op5: WARC archives with a two-level capture index.

Pages are written as gzip members into archives under the shared folder, one
or more per task.  Captures are sorted by reversed-host URL key into index
files of compressed blocks; every index file ends with its sparse directory
(first key, place and length of each block), and a top level of one row per
index file is checked for its size before tasks get it.  A lookup finds the
index file by binary search in the top level, the block by binary search in
the directory, reads the block and then the archive by byte range.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.common import cut, hot_salt, pin_splits, scratch

CAPTURE = "key string, page_id long, rid long, file string, offset long, length long"
TAIL = ">QQ8s"
MAGIC = b"CDXDIR01"
BLOCK_LINES = 1000
ARCHIVE_BYTES = 64 << 20
#: Most index files whose first keys go to every task (about 100 bytes each).
MAX_TOP = 200_000
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://m.a.org:80/x?y#z`` gives ``org,a,m)/x?y``; null gives an empty key."""
    if not url:
        return ""
    rest = url.split("#", 1)[0]
    rest = rest.split("://", 1)[-1]
    cut_at = re.search(r"[/?]", rest)
    host, path = (rest[:cut_at.start()], rest[cut_at.start():]) if cut_at else (rest, "/")
    host = host.rsplit("@", 1)[-1].lower()
    host = re.sub(r":(80|443)?$", "", host)
    return ",".join(reversed(host.split("."))) + ")" + path


def _header_url(url: str | None) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")


def digest32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_bytes(page_id, url, payload: bytes, sha1_hex: str, original) -> bytes:
    """One WARC record; ``original``: (page_id, url) of the response that a revisit refers to, or None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if original else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            f"WARC-Target-URI: {_header_url(url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest32(sha1_hex)}"]
    if original:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{original[0]}>", f"WARC-Refers-To-Target-URI: {_header_url(original[1])}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one WARC record; checks lengths and, for responses, the payload digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page = lambda k: None if k not in fields or fields[k] == "<urn:page:None>" else int(fields[k][10:-1])
    return {"page_id": page("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": page("WARC-Refers-To"), "payload": payload}


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """rid, sha1, original: of equal payloads of ``least_bytes`` or more, the largest page_id is the original.

    The winner is found and sent back in two steps over a salted key, so one
    payload that a third of all pages share does not meet in one task.
    """
    rows = pages.select("rid", "page_id", "url", "sha1", "size", hot_salt("rid").alias("salt"))
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "rid", "url")).alias("best")
    level = rows.where(F.col("size") >= least_bytes).groupBy("sha1", "size", "salt").agg(best)
    top = level.groupBy("sha1", "size").agg(F.max("best").alias("best"))
    level = level.select("sha1", "size", "salt").join(top, ["sha1", "size"])
    out = rows.join(level, ["sha1", "size", "salt"], "left")
    return out.select("rid", F.when(F.col("best.rid") != F.col("rid"), F.struct("best.page_id", "best.url")).alias("original"))


def _write_archives(folder: str):
    def run(batches):
        from pyspark import TaskContext
        context = TaskContext.get()
        files, root = fs.FileSystem.from_uri(folder)
        # the attempt is part of the name: a lost or repeated task never touches what another one wrote
        stem, part, out, at = f"{context.partitionId():05d}-{context.taskAttemptId()}", 0, None, 0
        try:
            for batch in batches:
                found = []
                for page_id, rid, url, html, sha1, original in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out:
                            out.close()
                        name, part, at = f"pages-{stem}-{part:04d}.warc.gz", part + 1, 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    original = original and (original["page_id"], original["url"])
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    data = packer.compress(record_bytes(page_id, url, (html or "").encode(), sha1, original)) + packer.flush()
                    out.write(data)
                    found.append((url_key(url), page_id, rid, name, at, len(data)))
                    at += len(data)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _CAPTURE_TYPES)], _CAPTURE_NAMES)
        finally:
            if out:
                out.close()
    return run


_CAPTURE_NAMES = ["key", "page_id", "rid", "file", "offset", "length"]
_CAPTURE_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _write_index(folder: str):
    def run(batches):
        from pyspark import TaskContext
        context = TaskContext.get()
        files, root = fs.FileSystem.from_uri(folder)
        name = f"index-{context.partitionId():05d}-{context.taskAttemptId()}.cdx"
        out, at, directory, lines = None, 0, [], []

        def close_block():
            nonlocal at
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            directory.append([lines[0][0], lines[0][1], at, len(data)])
            out.write(data)
            at += len(data)
            lines.clear()

        for batch in batches:
            for line in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if out is None:
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            data = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data + struct.pack(TAIL, at, len(data), MAGIC))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([name])],
                                             ["first_key", "first_rid", "file"])
    return run


def write_archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> tuple[str, DataFrame]:
    """Writes archives and index of ``pages`` (page_id, url, html); returns the folder and the index's top level.

    ``pages`` must be a table read from storage, as its rows are numbered in
    two scans; write the result of a computation to a table first.
    Null html is an empty payload; a null url has an empty key; a null page_id
    is written as such and is an original only among its like; of repeated
    page ids the last row is the original.  Other columns are not read.  An
    empty table writes no file.
    """
    spark = pages.sparkSession
    pin_splits(spark)
    folder = folder or scratch(spark, "warc")
    if folder.startswith("/"):
        folder = f"file://{folder}"
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"), html.alias("html"))
    digests = cut(rows.select("rid", "page_id", "url", F.sha1(F.encode("html", "UTF-8")).alias("sha1"),
                              F.octet_length("html").alias("size")), "payloads")
    # both sides number the same scan alike; rids are dealt evenly whatever the payloads are
    decided = decide(digests, least_bytes).join(digests.select("rid", "sha1"), "rid")
    records = rows.join(decided, "rid").select("page_id", "rid", "url", "html", "sha1", "original")
    captures = cut(records.mapInArrow(_write_archives(folder), CAPTURE), "captures")
    ordered = captures.select("key", "rid", "page_id", "file", "offset", "length")
    ordered = ordered.repartitionByRange("key", "rid").sortWithinPartitions("key", "rid")
    top = ordered.mapInArrow(_write_index(folder), "first_key string, first_rid long, file string")
    return folder, cut(top, "index")


def _read(source, at: int, length: int) -> bytes:
    source.seek(at)
    return source.read(length)


def _find_captures(folder: str):
    """Keys of one index file, sorted: each block is found in the directory and read once."""
    def run(key, group):
        files, root = fs.FileSystem.from_uri(folder)
        found = []
        with files.open_input_file(f"{root}/{key[0].as_py()}") as source:
            size = source.size()
            at, length, magic = struct.unpack(TAIL, _read(source, size - struct.calcsize(TAIL), struct.calcsize(TAIL)))
            if magic != MAGIC:
                raise ValueError("not an index file")
            directory = json.loads(zlib.decompress(_read(source, at, length)))
            firsts = [(k, r) for k, r, _, _ in directory]
            held, block = -1, {}
            for k, r in sorted(zip(group["key"].to_pylist(), group["rid"].to_pylist())):
                b = bisect.bisect_right(firsts, (k, r)) - 1
                if b < 0:
                    continue
                if b != held:
                    held, block = b, {}
                    for line in zlib.decompress(_read(source, *directory[b][2:])).decode().split("\n"):
                        line = json.loads(line)
                        block[(line[0], line[1])] = line[3:]
                if (k, r) in block:
                    found.append((k, r, *block[(k, r)]))
        names, types = ["key", "rid", "file", "offset", "length"], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.table([pa.array([x[i] for x in found], t) for i, t in enumerate(types)], names)
    return run


def _read_records(folder: str):
    def run(batches):
        files, root = fs.FileSystem.from_uri(folder)
        held, source = None, None
        for batch in batches:
            out = []
            for rid, name, at, length in zip(*(batch.column(c).to_pylist() for c in ("rid", "file", "offset", "length"))):
                if name != held:
                    if source:
                        source.close()
                    held, source = name, files.open_input_file(f"{root}/{name}")
                r = parse_record(zlib.decompress(_read(source, at, length), 31))
                out.append((rid, r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            names = ["rid", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)
        if source:
            source.close()
    return run


def lookup(keys: DataFrame, folder: str, top: DataFrame, payload: bool = True) -> DataFrame:
    """Records of the captures named by ``keys`` (key, rid).

    Keys without a capture, null keys and null rids give no row; a pair that
    is asked for several times gives one; other columns of ``keys`` are not
    read; an empty ``keys`` or archive gives no rows.
    """
    n = top.count()
    if n > MAX_TOP:
        raise ValueError(f"{n} index files; write fewer, larger ones (at most {MAX_TOP})")
    firsts = sorted(((r["first_key"], r["first_rid"], r["file"]) for r in top.collect()), key=lambda x: (x[0].encode(), x[1]))
    shared = keys.sparkSession.sparkContext.broadcast(firsts)

    @F.arrow_udf("string")
    def index_file(key: pa.Array, rid: pa.Array) -> pa.Array:
        at = [(k.encode(), r) for k, r, _ in shared.value]
        places = [bisect.bisect_right(at, (k.encode(), r)) - 1 for k, r in zip(key.to_pylist(), rid.to_pylist())]
        return pa.array([shared.value[p][2] if p >= 0 else None for p in places], pa.string())

    asked = keys.select("key", "rid").where("key IS NOT NULL AND rid IS NOT NULL").distinct().withColumn("index_file", index_file("key", "rid")).where(F.col("index_file").isNotNull())
    found = asked.groupBy("index_file").applyInArrow(_find_captures(folder), "key string, rid long, file string, offset long, length long")
    found = found.repartition("file").sortWithinPartitions("file", "offset")
    schema = "rid long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    out = found.mapInArrow(_read_records(folder), schema)
    return out if payload else out.drop("payload")


def url_keys(urls: Column) -> Column:
    """The index key of every URL."""
    @F.arrow_udf("string")
    def keys(urls: pa.Array) -> pa.Array:
        return pa.array([url_key(u) for u in urls.to_pylist()], pa.string())
    return keys(urls)
