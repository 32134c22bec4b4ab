"""WARC archives: writing, reading, and resolving repeated payloads into revisit records.

Archives are text files of Spark's writer (gzip unless another codec is asked for): a record is one row, and
the empty lines that end a record are the writer's line separator.  They are read back through Spark's
text reader in pieces cut at the same bytes, in order, and parsed as one stream of bytes by Content-Length;
so payloads may hold any bytes, record ends and record heads included, and any store that Spark reads will
do.  A task holds one batch and one record at a time.

Repeats are found on headers alone: a scan leaves (digest, id, place) of each record without its payload;
these rows are shuffled by digest, the first response of a digest is the original, and the others refer to
it.  Digests of more than a thousandth of all records, at most a thousand, are looked up by broadcast, the
others by a shuffled join.  A second scan writes the archives anew: the originals as they are under fresh
headers, repeats as revisit records without payload.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.llm.tables import saved, small_batches

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records below this many payload bytes are never revisits.
MIN_BYTES = 100
#: A digest is hot beyond this part of all records.
HOT_PART = 1000

HEADERS = "file string, at long, record_id string, record_type string, page_id long, url string, date string, payload_bytes long, payload_digest string, head_digest string, refers_to string, content_type string"
RECORDS = f"{HEADERS}, http string, payload binary"


def _line(name: str, value: Column) -> Column:
    """A header line with the line end before it; a null value leaves it out."""
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value.cast("string")), F.lit(""))


def _uri(url: str) -> Column:
    """A header holds no line ends: control characters and spaces are percent-encoded."""
    plain = out = F.col(url).cast("string")
    for c in (*range(33), 127):
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(plain.rlike(r"[\x00-\x20\x7F]"), out).otherwise(plain)


def _urn(*parts: str | Column) -> Column:
    """A record id made from what tells the record apart, so that a repeated task writes the same."""
    h = F.md5(F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("~")) for p in parts]))
    at = [0, 8, 12, 16, 20, 32]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a + 1, b - a) for a, b in zip(at, at[1:], strict=False)]), F.lit(">"))


def _record(kind: Column, block: Column, more: list[Column]) -> Column:
    """A whole record but for the empty lines at its end; ``block``: HTTP head and payload, as binary."""
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, *more, _line("Content-Length", F.octet_length(block)), F.lit(END))
    return F.concat(head.cast("binary"), block)


def _write(records: DataFrame, path: str, compression: str) -> None:
    """Bytes are written as they are: the cast to string does not look at them."""
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", payload: str = "html", compression: str = "gzip") -> None:
    """Writes a response record for each row to a new folder.

    The payload column may be a string (written in UTF-8) or binary; null is an empty payload.  A null page_id
    or url leaves its header out; control characters and spaces of an url are percent-encoded.  Repeated
    rows are records of their own.  Other columns are ignored.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), _uri(url).alias("url"), body.alias("body"), F.monotonically_increasing_id().alias("k"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit(END))
    digest = F.sha2("body", 256)
    more = [_line("WARC-Record-ID", _urn("k", "page_id", "url")), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)), _line("Page-Id", F.col("page_id")), _line("Content-Type", F.lit("application/http; msgtype=response"))]
    _write(rows.select(_record(F.lit("response"), F.concat(http.cast("binary"), "body"), more).alias("record")), path, compression)


class Archive:
    """Records of one archive, from pieces of its bytes."""

    def __init__(self, name: str):
        self.name, self.at, self.need = name, 0, 0
        self.held: list[bytes] = []
        self.size = 0

    def feed(self, piece: bytes) -> Iterator[tuple]:
        self.held.append(piece)
        self.size += len(piece)
        if self.size < self.need:  # a large payload: join its pieces once
            return
        data = b"".join(self.held)
        at = 0
        while True:
            while data[at : at + 2] == b"\r\n":  # ends of the record before
                at += 2
            stop = data.find(b"\r\n\r\n", at)
            if stop < 0:
                need = 0
                break
            head = data[at:stop].split(b"\r\n")
            if not head[0].startswith(b"WARC/"):
                raise ValueError(f"{self.name}: record {self.at} does not begin with a WARC line")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head[1:])}
            length = int(fields[b"content-length"])
            if len(data) < stop + 4 + length:
                need = stop + 4 + length - at
                break
            yield self._parsed(fields, data[stop + 4 : stop + 4 + length])
            at = stop + 4 + length
            self.at += 1
        self.held, self.size, self.need = [data[at:]], len(data) - at, need

    def close(self) -> None:
        if b"".join(self.held).strip(b"\r\n"):
            raise ValueError(f"{self.name}: record {self.at} is cut off")

    def _parsed(self, fields: dict[bytes, bytes], block: bytes) -> tuple:
        text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
        kind = text(b"warc-type")
        http, payload = "", block
        if block.startswith(b"HTTP/"):
            top, end, payload = block.partition(b"\r\n\r\n")
            http = (top + end).decode("latin-1")
        digest = hashlib.sha256(payload).hexdigest()
        given = (text(b"warc-payload-digest") or "").removeprefix("sha256:").lower() or None
        page = text(b"page-id")
        return (self.name, self.at, text(b"warc-record-id"), kind, int(page) if page else None, text(b"warc-target-uri"), text(b"warc-date"), len(payload), digest, given, text(b"warc-refers-to"), text(b"content-type"), http, payload)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives of a folder: HEADERS, the HTTP head and the payload.

    ``file`` and ``at`` tell where a record stands; ``payload_bytes`` and ``payload_digest`` are those of
    the bytes read, ``head_digest`` is what the header says.  A record that is cut off, or bytes that are
    none, raise an error that names the file.  So does an uncompressed archive that Spark would split: raise
    ``spark.sql.files.maxPartitionBytes`` above its size.  An empty folder has no records.
    """
    small_batches(spark)
    fields = [("file", pa.string()), ("at", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("head_digest", pa.string()), ("refers_to", pa.string()), ("content_type", pa.string()), ("http", pa.string()), ("payload", pa.binary())]
    schema = pa.schema(fields)
    full = 4 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size = None, [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], schema=schema)

        for b in batches:
            for name, start, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if now is None or name != now.name:
                    if now is not None:
                        now.close()
                    if start:
                        raise ValueError(f"{name} was split: raise spark.sql.files.maxPartitionBytes above its size")
                    now = Archive(name)
                elif start:
                    raise ValueError(f"{name} was split: raise spark.sql.files.maxPartitionBytes above its size")
                for record in now.feed(piece.as_buffer().to_pybytes() + b"\r\n\r\n"):
                    out.append(record)
                    size += len(record[-1]) + 500
                    if size >= full:
                        yield batch()
                        out, size = [], 0
        if now is not None:
            now.close()
        if out:
            yield batch()

    pieces = spark.read.option("lineSep", END).text(path)
    rows = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))
    return rows.mapInArrow(run, RECORDS)


def _lookup(rows: DataFrame, table: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row a key, with ``members``, how many rows it has)."""
    hot = table.where(F.col("members") * HOT_PART > n_rows).drop("members")  # fewer than HOT_PART keys
    names = [c for c in hot.columns if c != key]
    first = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), key, "left")
    done = first.where("hot").drop("hot")
    rest = first.where("hot IS NULL").drop("hot", *names)
    cool = table.where((F.col("members") * HOT_PART <= n_rows) & (F.col("members") > 1)).drop("members")
    return done.unionByName(rest.join(cool, key, "left"))


def resolve(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(file, at, verdict, original_id, original_page, original_url, original_date) for each record.

    Of the response records with one payload digest and at least ``min_bytes`` payload bytes, the one with the
    smallest page_id (null ids last, then by place) is the original: ``verdict`` response.  The others, and
    revisit records whose header names that digest, are ``revisit`` and have the original's columns, as long
    as there is one.  Smaller responses stay responses; other record types stay what they are.
    """
    digest = F.when(F.col("record_type") == "revisit", F.col("head_digest")).when((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes), F.col("payload_digest"))
    rows = saved(headers.select("file", "at", "record_type", "page_id", "url", "date", "record_id", digest.alias("digest")))
    mine = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "file", "at", "record_id", "url", "date")
    first = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.when(F.col("record_type") == "response", mine)).alias("o"), F.count("*").alias("members")).where("o IS NOT NULL")
    got = _lookup(rows.where("digest IS NOT NULL"), saved(first), "digest", rows.count()).unionByName(rows.where("digest IS NULL"), allowMissingColumns=True)
    repeat = F.coalesce((F.col("o.file") != F.col("file")) | (F.col("o.at") != F.col("at")), F.lit(False))
    of = lambda c, name: F.when(repeat, F.col(f"o.{c}")).alias(name)
    return got.select("file", "at", F.when(repeat, "revisit").otherwise(F.col("record_type")).alias("verdict"), of("record_id", "original_id"), of("page_id", "original_page"), of("url", "original_url"), of("date", "original_date"), F.when(repeat, F.col("digest")).alias("original_digest"))


def deduplicate(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES, compression: str = "gzip") -> None:
    """Reads the archives of ``source`` and writes them to the new folder ``target`` with repeats resolved.

    Every record gets fresh headers: record id, type, length, digest, and for a revisit the original's
    fresh id, uri and date and the payload digest; its block is the HTTP head only.  A revisit record whose
    original is not in ``source`` keeps what it refers to.  Payloads are not shuffled as long as the table
    of repeats is below Spark's broadcast limit; beyond it they are, by place.
    """
    records = read_archives(spark, source)
    headers = saved(records.drop("payload", "http"))
    verdicts = saved(resolve(headers, min_bytes))
    repeats = saved(verdicts.where("verdict = 'revisit'"))  # its size decides the join
    rows = records.join(repeats, ["file", "at"], "left")
    kind = F.coalesce("verdict", "record_type")
    gone = kind == "revisit"
    head = F.encode("http", "iso-8859-1")
    block = F.when(gone, head).otherwise(F.concat(head, "payload"))
    digest = F.when(gone, F.coalesce("original_digest", "head_digest")).otherwise(F.col("payload_digest"))
    fresh = _urn(F.lit("fresh"), "record_id", "page_id")
    of = F.coalesce(F.when(F.col("original_id").isNotNull(), _urn(F.lit("fresh"), "original_id", "original_page")), F.when(gone, F.col("refers_to")))
    more = [
        _line("WARC-Record-ID", fresh),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _line("WARC-Refers-To", of),
        _line("WARC-Refers-To-Target-URI", F.col("original_url")),
        _line("WARC-Refers-To-Date", F.col("original_date")),
        _line("WARC-Profile", F.when(gone, F.lit(PROFILE))),
        _line("Page-Id", F.col("page_id")),
        _line("Content-Type", F.col("content_type")),
    ]
    _write(rows.select(_record(kind, block, more).alias("record")), target, compression)


def replayed(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each response and revisit record.

    A revisit record has the size and digest of its original's payload, found by the digest and checked by the
    record id, and the original's page_id; without one its size is null.
    """
    headers = saved(read_archives(spark, path).drop("payload", "http").where("record_type IN ('response', 'revisit')"))
    again = F.col("record_type") == "revisit"
    rows = headers.select("page_id", "record_id", "record_type", "refers_to", "payload_bytes", F.when(again, F.col("head_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"))
    responses = rows.where(~again).select("payload_digest", F.col("record_id").alias("refers_to"), F.struct("page_id", "payload_bytes").alias("o"))
    revisits = rows.where(again)
    # one response a digest is an original; a digest without a revisit does not matter
    asked = revisits.groupBy("payload_digest", "refers_to").agg(F.count("*").alias("members"))
    originals = saved(asked.join(responses, ["payload_digest", "refers_to"]).groupBy("payload_digest", "refers_to").agg(F.min("o").alias("o"), F.max("members").alias("members")))
    key = F.concat_ws(" ", "payload_digest", "refers_to")
    table = originals.select(key.alias("key"), "o", (F.col("members") + 1).alias("members"))
    found = _lookup(revisits.withColumn("key", key), table, "key", headers.count())
    mine = found.select("page_id", F.col("o.payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("o.page_id").alias("refers_to"))
    return rows.where(~again).select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(mine)
