"""WARC archives with one Zstandard frame a record and an embedded dictionary."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.arrow_text import each, frugal, quoted
from threadloom.plans.scratch import cut, scratch_path

#: First bytes of the frame that holds the dictionary (fixed by the format).
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are stored again rather than referred to.
LEAST_REVISIT = 1000
#: Bounds of the sample that the dictionary is built from (rows in expectation, characters of one), and of the dictionary.
SAMPLE_ROWS, SAMPLE_TEXT, DICTIONARY_BYTES = 1000, 1 << 16, 112 << 10
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
#: Date of all records unless another is given.
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI or absolute path, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def record(name: str, kind: str, page: int | None, uri: str | None, payload: bytes, digest: str, size: int, refers: int | None, date: str) -> bytes:
    """One WARC record; a revisit carries the HTTP header only. ``name`` is its id, which no other record may have; the page that it
    stands for, and the one that it revisits, have fields of their own, as pages may repeat."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + payload if kind == "response" else http
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri or f"urn:x-page:{page}")
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:x-record:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{sha}",
    ]
    if page is not None:
        lines.append(f"X-Page: {page}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def parse(data: bytes) -> dict:
    """Page, type, length and digest of the full payload, what it refers to, uri and payload of a record."""
    head, _, rest = data.partition(_END)
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != _END:
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(_END)
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a record's payload does not match its digest")
    page = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": page("X-Page"),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": page("X-Refers-To-Page"),
        "uri": fields["WARC-Target-URI"],
        "payload": payload if kind == "response" else None,
    }


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary trained on the samples; none where there are too few to train on."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def open_archive(dictionary: bytes) -> tuple[bytes, zstandard.ZstdCompressor]:
    """First bytes of an archive and the compressor of its records."""
    if not dictionary:
        return b"", zstandard.ZstdCompressor(level=LEVEL)
    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=LEVEL)
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary, zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)


def records(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """Records of an archive, one frame at a time; memory holds a record and a chunk."""
    head = stream.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
        dictionary = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", head)[1]))
        head = b""
    unpack = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    data = head
    while data or (data := stream.read(chunk)):
        frame, parts = unpack.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            data = stream.read(chunk)
            if not data:
                raise ValueError("an archive ends within a record")
        yield b"".join(parts)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id``, ``uri``, ``html``, ``size``, ``digest``, ``kind`` and ``refers`` of every row.

    Of rows with equal payloads (by SHA-256; ``digest`` is the SHA-1 that the format wants) of at least ``least`` bytes those with
    the largest id are responses and the others revisit it; all smaller ones are responses. A null payload is empty. A
    null id is never the largest; where all are null, all are responses. Rows that repeat the largest id are responses
    each, with records of their own. Only ids and digests are aggregated; rows below the limit take no part in the
    join. A very long payload is one record and has to fit a task's memory. Other columns, of any name, are not archived. An empty
    table has no records.
    """
    html = F.coalesce(F.col(quoted(html_col)).cast("string"), F.lit(""))
    rows = pages.select(F.col(quoted(id_col)).cast("long").alias("page_id"), F.col(quoted(url_col)).cast("string").alias("uri"), html.alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha1(F.encode("html", "UTF-8"))})
    large = rows.where(F.col("size") >= least).withColumn("same", F.unhex(F.sha2(F.encode("html", "UTF-8"), 256)))
    heads = cut(large.groupBy("same").agg(F.max("page_id").alias("head")), "heads")
    first = F.col("head").isNull() | F.col("page_id").eqNullSafe(F.col("head"))
    known = large.join(heads, "same").select(
        *rows.columns, F.when(first, "response").otherwise("revisit").alias("kind"), F.when(~first, F.col("head")).alias("refers")
    )
    small = rows.where(F.col("size") < least).select(*rows.columns, F.lit("response").alias("kind"), F.lit(None).cast("long").alias("refers"))
    return known.unionByName(small)


def dictionary_sample(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rows: int = SAMPLE_ROWS, date: str = DATE) -> list[bytes]:
    """Records, as they are archived, of about ``rows`` rows with payloads of at most ``SAMPLE_TEXT`` characters, picked by a hash
    of id and payload; rows that the pick leaves out never travel."""
    html = F.col(quoted(html_col)).cast("string")
    given = pages.select(F.col(quoted(id_col)).cast("long").alias("i"), F.substring(F.col(quoted(url_col)).cast("string"), 1, 2048).alias("u"), html.alias("t"))
    fit = given.where((F.length("t") > 0) & (F.length("t") <= SAMPLE_TEXT))
    share = rows / max(rows, fit.select("t").count())
    picked = fit.where(F.pmod(F.xxhash64("i", "t"), F.lit(1 << 30)) < int(share * (1 << 30))).collect()
    found = sorted((r.t.encode(), r.i or 0, r.u or "") for r in picked)
    return [record(f"{k:032x}:{k}", "response", i, u, t, hashlib.sha1(t).hexdigest(), len(t), None, date) for k, (t, i, u) in enumerate(found)]


def write(planned: DataFrame, dictionary: bytes, folder: str, date: str = DATE, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes planned records into archives in ``folder`` and returns their manifest (``path``, ``records``, ``bytes``).

    Each task attempt writes files of its own; the manifest is a Parquet table that Spark commits, so it names only the
    files of attempts that succeeded, and a lost executor leaves at most a file that no reader opens. ``folder``
    is any store that pyarrow opens and all executors share.
    """
    spark = planned.sparkSession
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, pack = open_archive(shared.value)
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        out, name, own, n, size = None, "", "", 0, 0
        done: list[tuple[str, int, int]] = []
        for b in batches:
            ids, uris, sizes, digests, kinds, refers = (b.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6))
            for i, html in enumerate(each(b.column(2))):
                if out is None:
                    own = uuid.uuid4().hex
                    name, n, size = f"{TaskContext.get().partitionId():06d}-{own}.warc.zst", 0, len(head)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(head)
                frame = pack.compress(record(f"{own}:{n}", kinds[i], ids[i], uris[i], html, digests[i], sizes[i], refers[i], date))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= most:
                    out.close()
                    out = None
                    done.append((name, n, size))
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    named = planned.select("page_id", "uri", "html", "size", "digest", "kind", "refers")
    return cut(named.mapInArrow(frugal(run), "path string, records long, bytes long"), "manifest")


def read(manifest: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Records of the archives: ``page_id``, ``record_type``, ``payload_bytes``, ``payload_digest``, ``refers_to``, ``uri`` and, if
    asked for, ``payload``. A response's payload is checked against its length and digest."""
    names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "uri", *["payload"] * payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows: list[dict] = []
                    size = 0
                    for data in records(stream):
                        rows.append(parse(data))
                        size += len(data)
                        if len(rows) >= 2000 or size > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds)], names)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds)], names)

    files = manifest.select("path").repartition(max(1, min(10_000, manifest.count())))
    schema = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, uri string" + ", payload binary" * payload
    return files.mapInArrow(frugal(run), schema)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes one record for each row; gives the manifest and the folder."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return write(plan_records(pages, id_col, url_col, html_col), build_dictionary(dictionary_sample(pages, id_col, url_col, html_col)), folder), folder
