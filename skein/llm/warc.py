"""Content-addressed WARC archive: payload bytes once, exact record headers apart, joined on reading.

An archive is a folder with two Parquet tables. ``payloads`` has each payload once, packed, under its
SHA-256 (the address) and its length. ``headers`` has every record's header block byte for byte, with the
address it needs. A record is its header block, the payload (responses only), and two line ends;
``records`` puts those bytes together again, and ``read_index`` says what the records put together say:
it parses them, hashes and measures their blocks, and follows WARC-Refers-To to the response.

Null payloads count as empty. A record's URN comes from key and address: rows that repeat a key with
another payload, or have none, are records of their own; rows that repeat both are equal records.
An empty table gives an empty archive. Only key, address and payload columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import cut

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight groups of five hex digits, four base32 digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def record_id(key: Column, address: Column) -> Column:
    """A stable URN from the record's key and its payload's address."""
    h = F.md5(F.concat_ws(":", F.lit("record"), F.coalesce(key.cast("string"), F.lit("")), address))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def one_line(value: Column) -> Column:
    """Header values can't hold line ends."""
    return F.translate(F.coalesce(value.cast("string"), F.lit("")), "\r\n", "  ")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        packed = [press.compress(p.as_py()) for p in b["payload"]]
        yield pa.record_batch([*b.columns[:3], pa.array(packed, pa.binary())], names=["key", "address", "n_bytes", "packed"])


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0) -> None:
    """Writes one record per row to ``folder``.

    Of records with equal payloads of ``least`` bytes or more, that with the smallest key is the
    response and the others revisit it; smaller payloads are all responses. Equality is that of
    SHA-256 and length. Groups are reduced before the shuffle, so a payload that a third of all
    pages share costs one row per task; only numbers join back. Rows that repeat both key and payload
    of a response are responses too.
    """
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).alias("key"), one_line(F.col(uri)).alias("uri"), raw.alias("payload"))
    addressed = rows.select("key", "uri", "payload", F.sha2("payload", 256).alias("address"), F.octet_length("payload").cast("long").alias("n_bytes"))
    packed = addressed.select("key", "address", "n_bytes", "payload").mapInArrow(_pack, f"key {pages.schema[key].dataType.simpleString()}, address string, n_bytes long, packed binary")
    stored = packed.groupBy("address", "n_bytes").agg(F.min("key").alias("first_key"), F.first("packed").alias("packed"))
    stored.write.mode("overwrite").parquet(f"{folder}/payloads")
    first = pages.sparkSession.read.parquet(f"{folder}/payloads").select(F.col("address").alias("a2"), F.col("n_bytes").alias("n2"), "first_key")
    facts = addressed.select("key", "uri", "address", "n_bytes", base32_sha1(F.col("payload")).alias("digest"))
    judged = facts.join(first, (F.col("address") == F.col("a2")) & (F.col("n_bytes") == F.col("n2"))).drop("a2", "n2")
    revisit = (F.col("n_bytes") >= least) & ~F.col("key").eqNullSafe(F.col("first_key"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("key"), F.col("address"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("uri")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), record_id(F.col("first_key"), F.col("address")))),
        F.concat(F.lit("X-Payload-Length: "), F.col("n_bytes").cast("string")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("n_bytes").cast("string"))),
    ]
    header = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)).cast("binary")
    judged.select("key", F.when(~revisit, F.col("address")).alias("address"), header.alias("header")).write.mode("overwrite").parquet(f"{folder}/headers")


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """``key, header, packed, address, n_bytes`` of every record; the last three are null for revisits."""
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = spark.read.parquet(f"{folder}/payloads").select(F.col("address").alias("a2"), "n_bytes", "packed")
    whole = headers.filter("address is not null").join(payloads, F.col("address") == F.col("a2"), "left").select("key", "header", "address", "n_bytes", "packed")
    bare = headers.filter("address is null").select("key", "header", "address", F.lit(None).cast("long").alias("n_bytes"), F.lit(None).cast("binary").alias("packed"))
    return whole.unionByName(bare)


def _record(b: pa.RecordBatch, i: int) -> bytes:
    """Row ``i`` of ``_stored`` as the record's bytes."""
    packed = b["packed"][i].as_py()
    return b["header"][i].as_py() + (zstandard.ZstdDecompressor().decompress(packed) if packed is not None else b"") + CRLF.encode() * 2


def records(spark: SparkSession, folder: str) -> DataFrame:
    """``key, record``: the original records byte for byte, headers and payloads joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b["key"], pa.array([_record(b, i) for i in range(b.num_rows)], pa.binary())], names=["key", "record"])

    stored = _stored(spark, folder)
    return stored.mapInArrow(run, f"key {stored.schema['key'].dataType.simpleString()}, record binary")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block, of a whole record; ValueError where it isn't one."""
    head, found, rest = record.partition(CRLF.encode() * 2)
    version, *lines = head.decode("utf-8").split(CRLF)
    fields = {n.lower(): v for n, _, v in (line.partition(": ") for line in lines)}
    size = int(fields.get("content-length", -1))
    if not found or not version.startswith("WARC/") or len(rest) != size + 4 or rest[size:] != CRLF.encode() * 2:
        raise ValueError("not a whole WARC record")
    return fields, rest[:size]


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """``key, record_type, digest, n_bytes, refers_to_key, sound``, one row per record, from the records' own bytes.

    Digest and length of a response are measured on its block; a revisit has those of the response
    that its WARC-Refers-To names. ``sound``: the header's digest and length agree with that, and a
    response's block has the SHA-256 and length under which it is stored. Payloads join once; what
    revisits join are four numbers a response.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                fields, block = parse(_record(b, i))
                said, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                if fields["warc-type"] == "response":
                    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
                    sound = (digest, len(block)) == (said, size) and (hashlib.sha256(block).hexdigest(), len(block)) == (b["address"][i].as_py(), b["n_bytes"][i].as_py())
                    out.append((fields["warc-type"], fields["warc-record-id"], None, digest, len(block), sound))
                else:
                    out.append((fields["warc-type"], fields["warc-record-id"], fields["warc-refers-to"], said, size, True))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.record_batch([b["key"], *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["key", "record_type", "id", "refers_to", "digest", "n_bytes", "sound"])

    stored = _stored(spark, folder)
    read = cut(stored.mapInArrow(run, f"key {stored.schema['key'].dataType.simpleString()}, record_type string, id string, refers_to string, digest string, n_bytes long, sound boolean"))
    response = read.filter("refers_to is null").groupBy("id").agg(F.first("key").alias("k2"), F.first("digest").alias("d2"), F.first("n_bytes").alias("n2"), F.bool_and("sound").alias("s2")).withColumnRenamed("id", "id2")
    met = read.filter("refers_to is not null").join(response, F.col("refers_to") == F.col("id2"), "left")
    agrees = F.coalesce(F.col("s2") & (F.col("digest") == F.col("d2")) & (F.col("n_bytes") == F.col("n2")), F.lit(False))
    revisits = met.select("key", "record_type", F.col("d2").alias("digest"), F.col("n2").alias("n_bytes"), F.col("k2").alias("refers_to_key"), agrees.alias("sound"))
    return read.filter("refers_to is null").select("key", "record_type", "digest", "n_bytes", F.lit(None).cast(read.schema["key"].dataType).alias("refers_to_key"), "sound").unionByName(revisits)
