"""WARC archives with a Zstandard dictionary, written and read by Spark tasks.

An archive starts with a skippable frame that holds a dictionary trained on the
first records it stores; every record is a frame of its own, compressed with
that dictionary. Equal payloads are stored once, later ones as revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import shared_dir, stage

SKIPPABLE = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id, url, payload: bytes, digest: str, refers_to, is_response: bool, date: str) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if is_response else head
    name = "none" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if not is_response:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{'none' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes], size: int):
    """A trained dictionary, or the samples' end as a raw one where there are
    too few for training; None without samples."""
    import zstandard

    samples = [s for s in samples if s]
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _write(folder, date, level, dict_bytes, sample_records, sample_bytes, most_bytes):
    def run(batches):
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        store.create_dir(base, recursive=True)
        done, waiting, held, out, name, count, size = [], [], 0, None, None, 0, 0

        def begin():
            nonlocal out, name, count, size, packer, waiting, held
            # a name of the attempt's own, so a second attempt never shares a file
            name = f"{base}/part-{task.partitionId():05d}-{len(done):04d}-{task.taskAttemptId()}.warc.zst"
            out = store.open_output_stream(name, compression=None)
            made = dictionary_of(waiting, dict_bytes)
            body = made.as_bytes() if made else b""
            out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
            packer = zstandard.ZstdCompressor(level=level, dict_data=made) if made else zstandard.ZstdCompressor(level=level)
            count, size = 0, len(body) + 8
            first, waiting, held = waiting, [], 0
            for r in first:
                put(r)

        def put(r):
            nonlocal count, size
            frame = packer.compress(r)
            out.write(frame)
            count += 1
            size += len(frame)

        def end():
            nonlocal out
            out.close()
            done.append((name, count, size))
            out = None

        packer = None
        for b in batches:
            c = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for page_id, url, html, sha1, refers_to, is_response in zip(*c, strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                r = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to, is_response, date)
                if out is None:
                    waiting.append(r)
                    held += len(r)
                    if len(waiting) >= sample_records or held >= sample_bytes:
                        begin()
                else:
                    put(r)
                if out is not None and size >= most_bytes:
                    end()
        if waiting:
            begin()
        if out is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([folder.split(":", 1)[0] + "://" + n if ":" in folder else n for n, _, _ in done], pa.string()), pa.array([n for _, n, _ in done], pa.int64()), pa.array([s for _, _, s in done], pa.int64())], ["path", "records", "bytes"])

    return run


def frames(data: bytes):
    """The records of an archive, each decompressed."""
    import zstandard

    at, made = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        n = struct.unpack_from("<I", data, 4)[0]
        made = zstandard.ZstdCompressionDict(data[8 : 8 + n]) if n else None
        at = 8 + n
    reader = zstandard.ZstdDecompressor(dict_data=made) if made else zstandard.ZstdDecompressor()
    while at < len(data):
        one, parts = reader.decompressobj(), []
        while not one.eof and at < len(data):
            piece = data[at : at + 32768]
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple:
    """A record's FIELDS. The digest of a response is that of its payload as
    read; intact tells whether it is the one in the header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    names = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        k, _, v = line.partition(": ")
        names[k] = v
    block = rest[: int(names["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(http.rpartition(b"Content-Length: ")[2])
    digest = names["WARC-Payload-Digest"].removeprefix("sha1:")

    def page(value):
        value = value.removeprefix("<urn:page:").removesuffix(">")
        return None if value == "none" else int(value)

    if names["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        return page(names["WARC-Record-ID"]), names.get("WARC-Target-URI"), len(payload), found, "response", None, found == digest and len(payload) == said
    return page(names["WARC-Record-ID"]), names.get("WARC-Target-URI"), said, digest, "revisit", page(names["WARC-Refers-To"]), True


def _read(batches):
    from pyarrow import fs

    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    for b in batches:
        for path in b.column(0).to_pylist():
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_stream(name, compression=None) as f:
                data = f.read()
            rows = []
            for raw in frames(data):
                rows.append(parse(raw))
                if len(rows) == 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3, dict_bytes: int = 32_768, sample_records: int = 200, sample_bytes: int = 4_000_000, most_bytes: int = 64_000_000) -> DataFrame:
    """Write a record for each row of pages under folder (a URI that all
    executors reach). Returns path, records, bytes of each archive.

    Of rows with equal payloads (UTF-8 of html, null as empty) of at least
    least_bytes, those with the smallest id are responses and the others
    revisits; smaller payloads are all responses. Null ids are later than all
    others; a group of null ids alone is all responses. A dictionary of up to
    dict_bytes is trained on the first sample_records records, or sample_bytes
    of them, of each archive; too few give a raw dictionary. Archives end after
    most_bytes. Extra columns are ignored. No rows give no archives.

    Digests are grouped without the pages, so a payload with very many copies
    is a sum per task; pages are shuffled once, by id."""
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("sha1"), F.octet_length(body).alias("n"))
    small = rows.select("page_id", "sha1", "n")
    first = small.filter(F.col("n") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"))
    # rows of one payload are dealt by a salt, so very many copies are many tasks
    small = small.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(64)))
    first = small.select("sha1", "salt").distinct().join(first, "sha1")
    told = stage(small.join(first, ["sha1", "salt"], "left").select("page_id", "sha1", F.when(F.col("page_id") != F.col("first"), F.col("first")).when(F.col("page_id").isNull(), F.col("first")).alias("refers_to")).distinct(), "digests")
    revisits = told.filter("refers_to is not null")
    key = (F.col("page_id").eqNullSafe(F.col("r_id"))) & (F.col("sha1") == F.col("r_sha"))
    out = rows.join(revisits.select(F.col("page_id").alias("r_id"), F.col("sha1").alias("r_sha"), "refers_to"), key, "left")
    out = out.select("page_id", "url", "html", "sha1", "refers_to", F.col("refers_to").isNull().alias("response"))
    return out.mapInArrow(_write(folder, date, level, dict_bytes, sample_records, sample_bytes, most_bytes), "path string, records long, bytes long")


def read_warc(archives: DataFrame) -> DataFrame:
    """FIELDS of every record of the archives named in column path, one task
    for some archives each; one archive and one record is held at a time."""
    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(_read, FIELDS)


def archive_folder(spark) -> str:
    folder = shared_dir(spark)
    return f"{folder if ':' in folder else 'file://' + folder}/evidentia/warc-{uuid.uuid4().hex}"
