"""Operator 8: monolithic gzip WARC files made into one member a record, with an offset index.

write_monolithic() writes one WARC file a partition as a single gzip stream. normalise()
inflates each such file once, in pieces, rewrites every record as a gzip member of its own and
writes a sidecar index (offset, length and main headers of each record). read_records() fetches
records by the index alone.

Of records with equal payloads (SHA-256 and length) of at least `revisit_from` bytes the one
with the smallest page id is a response and the others are revisits that refer to it.

Files are written under an attempt's own name and moved into place, and a partition's rows
depend on the page id only, so a repeated task writes the same file again.

Cases: a null html is an empty payload, a null url gives no target URI. Rows that share the
smallest id of a payload are all responses. A null id is a revisit if a row with an id has the
same payload, else a response. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkglass.llm.common import SharedFile, cut, file_system, fits, join_groups, new_folder, small_batches

PIECE = 1 << 20
LEVEL = 6
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1\r\n"
REVISIT = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2020-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A response with its payload, or a revisit with the HTTP head only."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:page:%s>" % (b"null" if page_id is None else str(page_id).encode()),
        b"WARC-Date: " + DATE,
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
        b"WARC-Payload-Digest: sha1:" + digest_of(payload).encode(),
    ]
    if url is not None:
        head.append(b"WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n").encode())
    if revisit:
        head += [b"WARC-Profile: " + REVISIT, b"WARC-Refers-To: <urn:page:%s>" % str(refers_to).encode()]
    return VERSION + b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def head_of(data: bytes, at: int = 0) -> tuple[dict[str, str], int] | None:
    """A record's headers and where its block begins; None if the head isn't whole yet."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    first, *lines = data[at:end].split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC record here")
    return {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}, end + 4


def records_of(pieces):
    """(headers, whole record) from pieces of an inflated stream. Memory: one record and one piece."""
    data = bytearray()
    for piece in pieces:
        data += piece
        at = 0
        while (head := head_of(data, at)) is not None:
            stop = head[1] + int(head[0]["content-length"]) + 4
            if len(data) < stop:
                break
            yield head[0], bytes(data[at:stop])
            at = stop
        del data[:at]
    if data:
        raise ValueError("the stream ends within a record")


def inflated(stream):
    """An inflated gzip stream in pieces; further members, if any, follow."""
    inflate = zlib.decompressobj(31)
    while piece := stream.read(PIECE):
        while piece:
            out = inflate.decompress(piece, 4 * PIECE)
            if out:
                yield out
            piece = inflate.unconsumed_tail
            if inflate.eof:
                piece = inflate.unused_data
                inflate = zlib.decompressobj(31)
    if not inflate.eof and (out := inflate.flush()):
        yield out


def with_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to (null for responses)."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumn("same", F.unhex(F.sha2("payload", 256))).withColumn("size", F.octet_length("payload"))
    # grouped without the payloads; those that occur once need no join, only groups come back
    first = own.groupBy("same", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("size") >= revisit_from)).select("same", "size", "first", "n")
    first = cut(first, "warc-first")
    # too many groups to broadcast: those with a thousandth of all pages still come to them, so no task gets all pages of one payload
    both = own.join(F.broadcast(first), ["same", "size"], "left") if fits(first) else join_groups(own, first, ["same", "size"], "n")
    return both.select("page_id", "url", "payload", F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write_monolithic(records: DataFrame, folder: str, files: int) -> DataFrame:
    """One gzip stream a partition; returns path and number of records of each file."""
    import pyarrow as pa

    def write(batches):
        from pyspark import TaskContext

        path, n = f"{folder}/whole-{TaskContext.get().partitionId():06d}.warc.gz", 0
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        first = next(rows, None)
        if first is None:
            return
        with SharedFile(path) as f:
            deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            while first is not None:
                f.write(deflate.compress(record(*first)))
                n += 1
                first = next(rows, None)
            f.write(deflate.flush())
        yield pa.RecordBatch.from_pydict({"path": [path], "n": [n]})

    placed = records.repartition(files, F.xxhash64("page_id", F.octet_length("payload"))).select("page_id", "url", "payload", "refers_to").sortWithinPartitions("page_id", "refers_to", "url")
    return cut(placed.mapInArrow(write, "path string, n long"), "warc-whole")


def normalise(files: DataFrame, n_files: int) -> DataFrame:
    """Rewrites each file beside the old one; returns path, index path and number of records."""
    import pyarrow as pa

    def rewrite(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                new = path.replace("/whole-", "/members-")
                fs, name = file_system(path)
                index, at = [], 0
                with fs.open_input_stream(name, compression=None) as stream, SharedFile(new) as out, SharedFile(f"{new}.idx") as side:
                    for head, data in records_of(inflated(stream)):
                        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        size = out.write(deflate.compress(data) + deflate.flush())
                        index.append(json.dumps({"offset": at, "length": size, "id": head["warc-record-id"], "type": head["warc-type"], "digest": head["warc-payload-digest"], "uri": head.get("warc-target-uri")}))
                        at += size
                        if len(index) == 1000:
                            side.write("".join(f"{x}\n" for x in index).encode())
                            index = []
                    side.write("".join(f"{x}\n" for x in index).encode())
                yield pa.RecordBatch.from_pydict({"path": [new], "index": [f"{new}.idx"]})

    return cut(files.select("path").repartition(n_files, "path").mapInArrow(rewrite, "path string, index string"), "warc-members")


def page_of(urn: str | None):
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name not in ("", "null") else None


def read_records(files: DataFrame, n_files: int, payloads: bool = False) -> DataFrame:
    """Each record of the normalised files, found by its index: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url, file, offset, length (and the payload). A response's digest and
    length are those of the payload read; a revisit's are its headers'."""
    import pyarrow as pa

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file", "offset", "length"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def read(batches):
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = file_system(path)
                rows = []
                with fs.open_input_stream(file_system(index)[1], compression=None) as f:
                    entries = [json.loads(x) for x in f.read().decode().split("\n") if x]
                with fs.open_input_file(name) as data:
                    for e in entries:
                        data.seek(e["offset"])
                        whole = zlib.decompress(data.read(e["length"]), 31)
                        head, at = head_of(whole)
                        block = whole[at : at + int(head["content-length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        response = head["warc-type"] == "response"
                        told = head["warc-payload-digest"].removeprefix("sha1:")
                        if response and digest_of(payload) != told:
                            raise ValueError(f"{path}: payload and digest differ at {e['offset']}")
                        size = len(payload) if response else int(http.rpartition(b"Content-Length: ")[2])
                        rows.append((page_of(head["warc-record-id"]), size, told, head["warc-type"], page_of(head.get("warc-refers-to")), head.get("warc-target-uri"), path, e["offset"], e["length"], payload if payloads else None))
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names) + payloads)], names=names + ["payload"] * payloads)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names) + payloads)], names=names + ["payload"] * payloads)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, offset long, length long" + ", payload binary" * payloads
    return files.select("path", "index").repartition(n_files, "path").mapInArrow(read, schema)


def archive(pages: DataFrame, folder: str | None = None, file_bytes: int = 16_000_000, payloads: bool = False, **options) -> DataFrame:
    """Writes all pages, normalises the files and reads them back. A file gets about file_bytes of payload."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or new_folder(spark, "warc")
    html = options.get("html_col", "html")
    total = pages.agg(F.coalesce(F.sum(F.octet_length(html) + 500), F.lit(0))).first()[0]
    n = max(1, min(-(-int(total) // file_bytes), 1_000_000))
    whole = write_monolithic(with_types(pages, **options), folder, n)
    return read_records(normalise(whole, n), n, payloads)
