"""Zstandard WARC archives: one frame per record, the dictionary in a leading skippable frame.

``write_warc`` writes archives of bounded size from the executors and returns one row per archive;
``read_warc`` streams archives back, a frame at a time: the dictionary is taken from the skippable frame,
each further frame must hold exactly one record with the headers it needs and the length it states.

Duplicates become revisit records before anything is written. Payloads meet by SHA-1 and length: the
largest page id per payload is a map-side combined aggregate, and only repeated payloads of the least
length are joined back, by a plain shuffled join that adaptive execution splits at a hot payload.

Archives go to a folder that executors share, through pyarrow's file systems (file, HDFS, S3). A task
writes under a name of its own attempt, and only archives listed in the result count: a retried or
repeated task leaves files that nobody reads. The list is checkpointed, so archives are written once.

Defined cases: null html is an empty payload; null url is an empty target; rows with the largest page id
of a payload all are responses, also when repeated; null page ids lose against others.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stage, table, text_batches

#: An archive is closed when it holds so many payload bytes.
ARCHIVE_BYTES = 16 << 20
#: A dictionary is trained on an archive's first records, up to so many bytes of them.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
# Fixed values of the format: the magic number of the dictionary's skippable frame, and of a Zstandard frame.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, error string"


def _record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record with its closing line breaks."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _archive(records: list[bytes]) -> bytes:
    """Records as frames, after a dictionary trained on the first of them where there are enough."""
    sample, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(r)
        size += len(r)
    trained = None
    if len(sample) >= 16 and size >= 8 * DICTIONARY_BYTES:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample)
        except zstandard.ZstdError:  # samples too alike to train on
            trained = None
    out = []
    if trained is not None:
        packed = zstandard.ZstdCompressor().compress(trained.as_bytes())
        out.append(DICTIONARY_MAGIC + len(packed).to_bytes(4, "little") + packed)
    packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True) if trained is not None else zstandard.ZstdCompressor(level=3)
    return b"".join([*out, *[packer.compress(r) for r in records]])


def _write(folder: str, date: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        held, size = [], 0

        def close() -> pa.RecordBatch:
            name = f"{path}/{uuid.uuid4().hex}.warc.zst"
            data = _archive(held)
            with store.open_output_stream(name, compression=None) as f:
                f.write(data)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())], names=["archive", "records", "bytes"])

        for batch in batches:
            for page, url, html, refers, revisit in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                held.append(_record(page, " ".join((url or "").split()), payload, refers, revisit, date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return run


def write_warc(pages: DataFrame, folder: str | None = None, least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives under ``folder`` (a URI); one row (archive, records, bytes) each.

    Of equal payloads of at least ``least_bytes`` the one with the largest id is a response and the
    others revisit it; all other payloads are responses.
    """
    spark = pages.sparkSession
    text_batches(spark)
    if folder is None:
        folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page"), pages[url_col].cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("size"))
    large = rows.where(F.col("size") >= least_bytes)
    first = large.groupBy("sha", "size").agg(F.max("page").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a table of its own, so the join is one of two plain shuffles, which adaptive execution splits at a hot payload
    met = large.join(stage(first), ["sha", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    ready = met.select("page", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    # small payloads, empty ones above all, revisit nothing and meet no one
    small = rows.where(F.col("size") < least_bytes).select("page", "url", "html", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    ready = ready.unionByName(small)
    return stage(ready.mapInArrow(_write(folder, date), "archive string, records long, bytes long"))


def _frames(data_of: Callable[[int], bytes]) -> Iterator[bytes]:
    """The content of each Zstandard frame of a stream, decoded with the leading dictionary if any."""
    data = data_of(8)
    trained = None
    if data[:4] == DICTIONARY_MAGIC:
        size = int.from_bytes(data[4:8], "little")
        packed = data_of(size)
        if len(packed) < size:
            raise ValueError("the dictionary frame is cut short")
        # the dictionary may itself be a Zstandard frame
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(packed) if packed[:4] == FRAME_MAGIC else packed
        trained = zstandard.ZstdCompressionDict(raw)
        data = b""
    decoder = zstandard.ZstdDecompressor(dict_data=trained) if trained is not None else zstandard.ZstdDecompressor()
    while True:
        if not data and not (data := data_of(1 << 16)):
            return
        frame, out = decoder.decompressobj(), []
        while True:
            out.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := data_of(1 << 16)):
                raise ValueError("a frame is cut short")
        yield b"".join(out)


def parse_record(record: bytes) -> dict:
    """The fields of a record that is checked; ``error`` says what is wrong with it, else it is null."""
    out = dict.fromkeys(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "error"))
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        return out | {"error": "no WARC header"}
    fields = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}
    if missing := [k for k in _NEEDED if k.lower() not in fields]:
        return out | {"error": f"without {', '.join(missing)}"}
    length = fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"error": "Content-Length does not fit the block"}
    page = lambda s: int(d) if (d := s.removeprefix("<urn:page:").removesuffix(">")).lstrip("-").isdigit() else None
    out |= {"record_type": fields["warc-type"], "page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri")}
    digest = fields.get("warc-payload-digest", "")
    if not digest.startswith("sha1:"):
        return out | {"error": "no SHA-1 payload digest"}
    try:
        out["payload_digest"] = base64.b32decode(digest[5:]).hex()
    except ValueError:
        return out | {"error": "no SHA-1 payload digest"}
    stated = fields.get("x-payload-length", "")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    if not gap:
        return out | {"error": "no HTTP header"}
    if out["record_type"] == "response":
        if hashlib.sha1(payload).hexdigest() != out["payload_digest"] or (stated and stated != str(len(payload))):
            return out | {"error": "the payload does not fit its digest or length"}
        return out | {"payload_bytes": len(payload), "payload": payload}
    if out["record_type"] == "revisit":
        if "warc-refers-to" not in fields or payload or not stated.isdigit():
            return out | {"error": "a revisit without reference or length, or with a payload"}
        return out | {"payload_bytes": int(stated), "refers_to": page(fields["warc-refers-to"])}
    return out | {"error": f"type {out['record_type']}"}


def _read(with_payload: bool) -> Callable:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(archive)
                with store.open_input_stream(path, compression=None) as f:
                    rows, size = [], 0
                    try:
                        for record in _frames(f.read):
                            rows.append(parse_record(record))
                            if not with_payload:
                                rows[-1]["payload"] = None
                            size += len(record)
                            if size >= 4 << 20:
                                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                                rows, size = [], 0
                    except (ValueError, zstandard.ZstdError) as e:
                        rows.append(dict.fromkeys(schema.names) | {"error": f"{archive}: {e}"})
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_warc(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives that the column ``archive`` names, one task a few archives.

    A record that fails a check keeps what could be read and says why in ``error``.
    """
    # their rows are tiny: a number keeps adaptive execution from giving all archives to one task
    tasks = max(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), archives.count() // 16)
    return archives.select("archive").repartition(tasks, "archive").mapInArrow(_read(with_payload), _READ)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    archives = write_warc(table(spark, sf_dir, "pages"))
    return read_warc(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


OP6_SQL = r"""
SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY coalesce(html, '')) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY coalesce(html, '')) THEN max(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to,
       NULL::VARCHAR AS error
FROM pages
"""
