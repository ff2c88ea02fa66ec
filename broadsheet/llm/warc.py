"""WARC archives whose records are Zstandard frames with a shared dictionary.

An archive begins with a skippable frame that holds the dictionary, then each record is one frame
compressed with it, so a record can be read on its own. The dictionary is built from the archive's own
first records. Archives are written by Spark's text writer, whose rows are the frames and whose line
separator is an empty skippable frame; so they land through Spark's commit protocol in any file system
Spark can write, and lost or repeated tasks leave no partial archive.

Of records with equal payloads (by SHA-1 and length) of at least ``min_bytes`` bytes the one with the
smallest page_id is a response, the others are revisits of it without a payload.

Defined results: null html is an empty payload; a null page_id sorts last, is written without an id and,
if no record of its group has one, makes a response; rows that share both the smallest page_id and the
payload are all responses; a null url is left out; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain, islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.scratch import scratch_path

#: Magic number of the dictionary's frame and of the frames between records (fixed values of the format).
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
#: Records of an archive, which is read whole, and the bytes of records after which it takes no more.
RECORDS, ARCHIVE_BYTES = 4_000, 128 << 20
#: Bytes of records a dictionary is built from, and its size.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 1 << 16
#: With fewer records than this their bytes themselves are the dictionary.
LEAST_SAMPLES = 16


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit keeps digest and length of the payload it leaves out."""
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Date", date),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", None if url is None else url.encode("unicode_escape").decode()),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    block = b"" if revisit else payload
    fields.append(("Content-Type", "text/html; charset=UTF-8"))
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    if len(samples) >= LEAST_SAMPLES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
        except zstandard.ZstdError:  # too little in the samples to train on
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def skippable_frame(content: bytes) -> bytes:
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def with_record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` with _payload (binary), _revisit and _refers_to."""
    keyed = pages.withColumn("_payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8")).withColumn("_sha", F.sha1("_payload"))
    keyed = keyed.withColumn("_size", F.octet_length("_payload"))
    first = keyed.groupBy("_sha", "_size").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = first.filter((F.col("_n") > 1) & (F.col("_size") >= min_bytes)).drop("_n")
    joined = keyed.join(first, ["_sha", "_size"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.withColumn("_revisit", revisit).withColumn("_refers_to", F.when(revisit, F.col("_first")))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, level: int = 3) -> None:
    """Writes archives of at most ``RECORDS`` records of ``pages`` (page_id, url, html) under ``path``.

    Records of together ``ARCHIVE_BYTES`` close an archive too: rows without a frame fill it up, each no more than a
    separator.
    """

    def frames(batches):
        records = chain.from_iterable(
            (record(*[column[i].as_py() for column in batch.columns]) for i in range(batch.num_rows)) for batch in batches
        )
        for first in records:
            yield from archive(bounded(chain([first], islice(records, RECORDS - 1))))

    def bounded(records):
        """``records`` until they hold ARCHIVE_BYTES, then a None for each that is lacking."""
        size = 0
        for count, one in enumerate(records, 1):
            size += len(one)
            yield one
            if size >= ARCHIVE_BYTES:
                yield from [None] * (RECORDS - count)
                return

    def archive(records):
        held, size, packer = [], 0, None

        def start():
            dictionary = build_dictionary(held)
            compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True)
            return compressor, [skippable_frame(dictionary.as_bytes()), *map(compressor.compress, held)]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

        for one in records:
            if one is None:
                if packer is None:
                    packer, held = start()
                held.append(b"")
            elif packer is not None:
                held.append(packer.compress(one))
                size += len(held[-1])
            else:
                held.append(one)
                size += len(one)
            if size >= SAMPLE_BYTES:
                if packer is None:
                    packer, held = start()
                yield out(held)
                held, size = [], 0
        if packer is None and held:
            packer, held = start()
        if held:
            yield out(held)

    typed = with_record_types(pages.select("page_id", "url", "html"), min_bytes).select("page_id", "url", "_payload", "_refers_to", "_revisit")
    packed = typed.mapInArrow(frames, "value binary")
    # The writer begins a file where a dictionary's frame does.
    packed.select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", RECORDS + 1).text(path)


def _frames(data: bytes):
    """(dictionary content or None, frame or None) for each frame of an archive, by its block headers."""
    at, view = 0, memoryview(data)
    while at < len(data):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if magic == DICTIONARY_MAGIC:
                yield bytes(view[at + 8 : at + 8 + size]), None
            at += 8 + size
            continue
        head = view[at : at + 18]
        end = at + zstandard.frame_header_size(head)
        while True:
            block = int.from_bytes(view[end : end + 3], "little")
            end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                break
        end += 4 * zstandard.get_frame_parameters(head).has_checksum
        yield None, view[at:end]
        at = end


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields["payload"] = rest[: int(fields["Content-Length"])]
    return fields


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, payload binary, payload_bytes, payload_digest, refers_to) per record.

    The digest and length of a response are those of the payload read; a revisit's are its fields'.
    """
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
    ])

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def rows(archive: bytes):
        unpacker = zstandard.ZstdDecompressor()
        for dictionary, frame in _frames(archive):
            if dictionary is not None:
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
                continue
            f = parse_record(unpacker.decompress(frame))
            payload, whole = f["payload"], f["WARC-Type"] == "response"
            url = f.get("WARC-Target-URI")
            yield {
                "page_id": number(f["WARC-Record-ID"]), "url": None if url is None else url.encode().decode("unicode_escape"), "record_type": f["WARC-Type"],
                "payload": payload if whole else None, "payload_bytes": len(payload) if whole else int(f["WARC-Payload-Length"]),
                "payload_digest": base32_sha1(payload) if whole else f["WARC-Payload-Digest"].removeprefix("sha1:"),
                "refers_to": number(f.get("WARC-Refers-To")),
            }

    def read(batches):
        for batch in batches:
            for archive in batch.column(0):
                some, size = [], 0
                for row in rows(archive.as_py()):
                    some.append(row)
                    size += len(row["payload"] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(some, schema=schema)
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema=schema)

    names = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(read, names)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and returns what reading them gives."""
    path = scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)
