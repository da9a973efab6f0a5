"""WARC archives as a Spark data source: a splittable reader of gzip members, a writer, and records with revisits.

Reading: a task scans its byte range for the gzip magic and validates each candidate by decoding it: the member must
begin with a WARC version line and a whole header. From the first valid member on it follows the members one by one,
owns the records that start inside its range and reads the last one beyond the range's end. Magic bytes inside
compressed data don't decode to a header and are passed over. A valid member may still lie inside another record (an
archive stored in a response): `read_warc(nested=True)` drops records that start before an earlier range's records end.

Writing: every task writes gzip members, one for each record, to files of its own in a hidden folder; the commit in
the driver gives the files of the attempts that counted their names.

Defined results: a null payload counts as empty; null ids come after all others, so they are responses only where no
other id has the payload; of rows that repeat id and payload the one with the smallest uri is the response (a null
uri first), and of rows that repeat all three one is; records of repeated ids share a record id. Ids are stored in
the record id, a null one as a record id without it. Line breaks in a uri are percent-encoded, a null uri is left
out. A member with a WARC header that can't be decoded to its end comes out as a row of type `damaged` without a
payload. An empty table gives no archive, and reading a folder without archives gives an empty result; further input
columns are ignored. Payloads are compared by SHA-256.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage

from annolake.llm.common import small_batches
from annolake.sources.ranges import RANGE_BYTES, ByteRange, Staged, file_system, ranges_of

#: Fixed values of the formats: a gzip member's first bytes, the version line, and the profile of a revisit with an equal payload.
MAGIC, VERSION, REVISIT = b"\x1f\x8b\x08", "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes looked at to reject a candidate, bytes of one read, bytes that a record's header may take, bytes and rows of a batch, bytes of an archive before the next is begun.
PEEK, READ, HEADER, BATCH_BYTES, BATCH, ARCHIVE = 4096, 1 << 20, 1 << 20, 8 << 20, 512, 1 << 30
ID = "urn:x-record"

RECORD = "archive string, range_start long, offset long, length long, record_id string, type string, target_uri string, refers_to string, payload_digest string, payload_length long, headers map<string,string>, payload binary"
SPAN = "archive string, range_start long, last_end long"
_ARROW = pa.schema(
    [("archive", pa.string()), ("range_start", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string())]
    + [("payload_digest", pa.string()), ("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


class _Bytes:
    """A file's bytes around a moving place: what lies before the place asked for is let go."""

    def __init__(self, stream, start: int, size: int):
        self.stream, self.at, self.held, self.size = stream, start, b"", size
        stream.seek(start)

    def read(self, place: int, n: int) -> bytes:
        """Up to n bytes from place on, which never goes back by more than what is held."""
        if place < self.at or place > self.at + len(self.held):
            self.at, self.held = place, b""
            self.stream.seek(place)
        if self.at + len(self.held) < min(place + n, self.size):
            self.held = self.held[place - self.at :] + self.stream.read(max(READ, n))
            self.at = place
        return self.held[place - self.at : place - self.at + n]

    def find(self, place: int, stop: int) -> int:
        """Where the next magic begins from place on and before stop, or -1."""
        while place < stop:
            data = self.read(place, READ)
            if len(data) < len(MAGIC):
                return -1
            found = data.find(MAGIC)
            if found >= 0:
                return place + found if place + found < stop else -1
            place += len(data) - len(MAGIC) + 1
        return -1


def parse_header(head: bytes) -> dict[str, str] | None:
    """Fields of a record's header by lower-case name; None if it isn't one. Repeated fields are joined by commas, folded lines unfolded."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    if not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
        return None
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        key = name.decode("utf-8", "replace").strip().lower()
        text = value.decode("utf-8", "replace").strip()
        out[key] = f"{out[key]}, {text}" if key in out else text
    return out if "warc-type" in out and re.fullmatch(r"\d+", out.get("content-length", "")) else None


@dataclass
class Member:
    """A decoded member: fields of its header, the record's block (None if damaged), and where the member ends."""

    fields: dict[str, str]
    block: bytes | None
    end: int


def _header_before_damage(chunk: bytes) -> dict[str, str] | None:
    """The header of a member that breaks off inside its first bytes, if all of it comes before that."""
    inflate, out = zlib.decompressobj(31), bytearray()
    try:
        while chunk:
            out += inflate.decompress(chunk, 64)
            chunk = inflate.unconsumed_tail
    except zlib.error:
        pass
    head, end, _ = bytes(out).partition(b"\r\n\r\n")
    return parse_header(head) if end else None


def decode_member(data: _Bytes, start: int) -> Member | None:
    """The WARC member that starts there; None if the bytes are no gzip member, or one without a WARC header."""
    inflate, out, place, fields, body = zlib.decompressobj(31), bytearray(), start, None, 0
    while True:
        chunk = data.read(place, PEEK if place == start else READ)
        try:
            out += inflate.decompress(chunk) if chunk else inflate.flush()
        except zlib.error:
            fields = fields or _header_before_damage(chunk)
            return Member(fields, None, start) if fields else None
        if fields is None:
            if not b"WARC/".startswith(bytes(out[:5])) and not out.startswith(b"WARC/"):
                return None
            body = out.find(b"\r\n\r\n") + 4
            if body > 3:
                fields = parse_header(bytes(out[: body - 4]))
                if fields is None:
                    return None
            elif len(out) > HEADER or inflate.eof or not chunk:
                return None
        if inflate.eof:
            length = int(fields["content-length"])
            block = bytes(out[body : body + length])
            return Member(fields, block if len(block) == length else None, place + len(chunk) - len(inflate.unused_data))
        if not chunk:
            return Member(fields, None, start)
        place += len(chunk)


def members_of(part: ByteRange) -> Iterator[tuple[int, Member]]:
    """(offset, member) of the members that start in the range, in order."""
    system, _ = file_system(part.root)
    with system.open_input_file(part.path) as stream:
        data, place = _Bytes(stream, part.start, part.size), part.start
        while 0 <= (place := data.find(place, part.stop)):
            member = decode_member(data, place)
            if member is None:
                place += 1
                continue
            yield place, member
            place = member.end if member.block is not None else place + 1


def _angle(text: str | None) -> str | None:
    return text[1:-1] if text and text.startswith("<") and text.endswith(">") else text


def _row(part: ByteRange, offset: int, member: Member) -> dict:
    fields, block = member.fields, member.block
    payload, length = block, None if block is None else len(block)
    if block is not None and fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        length = len(payload)
        if fields["warc-type"] == "revisit":  # its block has the header of the response only, which tells the payload's length
            told = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", head)
            payload, length = None, int(told[1]) if told else None
    return {
        "archive": part.path, "range_start": part.start, "offset": offset, "length": None if block is None else member.end - offset, "record_id": _angle(fields.get("warc-record-id")),
        "type": fields["warc-type"] if block is not None else "damaged", "target_uri": _angle(fields.get("warc-target-uri")), "refers_to": _angle(fields.get("warc-refers-to")),
        "payload_digest": fields.get("warc-payload-digest"), "payload_length": length, "headers": list(fields.items()), "payload": payload,
    }


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("range_bytes", RANGE_BYTES))
        self.spans = options.get("spans", "false").lower() == "true"

    def partitions(self):
        return ranges_of(self.path, self.size) or [ByteRange(self.path, "", 0, 0, 0)]

    def read(self, partition: ByteRange):
        if not partition.path:
            return
        if self.spans:
            last = max((m.end for _, m in members_of(partition) if m.block is not None), default=0)
            yield pa.RecordBatch.from_pydict({"archive": [partition.path], "range_start": [partition.start], "last_end": [last]}, schema=pa.schema([("archive", pa.string()), ("range_start", pa.int64()), ("last_end", pa.int64())]))
            return
        rows, held = [], 0
        for offset, member in members_of(partition):
            rows.append(_row(partition, offset, member))
            held += len(member.block or b"")
            if len(rows) >= BATCH or held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def encode_record(row: dict, date: str) -> bytes:
    """A record's bytes: header, and a block that holds an HTTP header and, but for revisits, the payload."""
    clean = lambda s: s.replace("\r", "%0D").replace("\n", "%0A")
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    block = http if row["type"] == "revisit" else http + payload
    fields = [("WARC-Type", row["type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date)]
    if row["target_uri"] is not None:
        fields.append(("WARC-Target-URI", clean(row["target_uri"])))
    fields.append(("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"))
    if row["type"] == "revisit":
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{row['refers_to']}>")]
        if row["refers_uri"] is not None:
            fields.append(("WARC-Refers-To-Target-URI", clean(row["refers_uri"])))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.staged, self.overwrite = Staged(options["path"]), overwrite
        self.level, self.date, self.most = int(options.get("level", 4)), options.get("date", "1970-01-01T00:00:00Z"), int(options.get("archive_bytes", ARCHIVE))

    def write(self, iterator):
        files, stream, written = [], None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                if stream is None:
                    name, stream = self.staged.open(".warc.gz")
                    files.append(name)
                deflate = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                member = deflate.compress(encode_record({c: batch.column(c)[i].as_py() for c in batch.schema.names}, self.date)) + deflate.flush()
                stream.write(member)
                written += len(member)
                if written >= self.most:
                    stream.close()
                    stream, written = None, 0
        if stream is not None:
            stream.close()
        return _Written(files)

    def commit(self, messages):
        if self.overwrite:
            self.staged.clear()
        for i, message in enumerate(m for m in messages if m is not None):
            for name in message.files:
                self.staged.move(name, f"part-{i:05d}-{name}")
        self.staged.end()

    def abort(self, messages):
        self.staged.end()


class WarcSource(DataSource):
    """Format `warc`. Reading: path, range_bytes. Writing rows of `warc_records`: path, level, date, archive_bytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SPAN if self.options.get("spans", "false").lower() == "true" else RECORD

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, nested: bool = True) -> DataFrame:
    """A row for each record (RECORD). nested: drop records that lie inside another, by a second scan that only keeps where each range's records end."""
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("range_bytes", range_bytes)
    records = reader.load(path)
    if not nested:
        return records
    before = Window.partitionBy("archive").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    reach = spark.read.format("warc").option("range_bytes", range_bytes).option("spans", "true").load(path)
    reach = reach.select("archive", "range_start", F.coalesce(F.max("last_end").over(before), F.lit(0)).alias("reach"))  # a row for each range
    return records.join(reach, ["archive", "range_start"]).where(F.col("offset") >= F.col("reach")).select(*records.columns)


def _record_id(value: Column) -> Column:
    return F.when(value.isNull(), F.lit(ID)).otherwise(F.concat(F.lit(f"{ID}:"), F.url_encode(value.cast("string"))))


def id_of(record_id: Column, kind: str = "string") -> Column:
    """The id that warc_records put into a record id; null if it has none."""
    return F.when(record_id.startswith(f"{ID}:"), F.url_decode(F.substring(record_id, len(ID) + 2, 2_000_000_000))).cast(kind)


def warc_records(df: DataFrame, id_col: str, uri_col: str, payload_col: str, min_bytes: int = 100) -> DataFrame:
    """A record for each row: record_id, type, target_uri, refers_to, refers_uri, payload_digest, payload_length, payload.

    Of equal payloads of at least min_bytes the row with the smallest id is the response, the others are revisits without
    a payload. Whole rows that repeat are counted before the shuffle, so that a frequent one doesn't gather in a task;
    payloads move once, dealt by (digest, id, uri); the few columns that tell revisits move by digest.
    """
    raw = F.col(payload_col)
    payload = F.coalesce(raw if dict(df.dtypes)[payload_col] == "binary" else F.encode(raw.cast("string"), "UTF-8"), F.lit(b""))
    shown = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.select("*", shown("id").alias("id_key"), shown("uri").alias("uri_key"), F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_length"))
    keys = ["payload_digest", "id_key", "uri_key"]
    light = rows.where(F.col("payload_length") >= min_bytes).groupBy(*keys).agg(F.first("id").alias("id"), F.first("uri").alias("uri"), F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uri").alias("uri"), "id_key", "uri_key"))
    firsts = light.groupBy("payload_digest").agg(first.alias("to"), F.sum("n").alias("all")).where("all > 1")
    verdicts = light.join(firsts, "payload_digest").select(*keys, "to")
    whole = rows.groupBy(*keys).agg(F.first("id").alias("id"), F.first("uri").alias("uri"), F.first("payload").alias("payload"), F.first("payload_length").alias("payload_length"), F.count("*").alias("n"))
    each = whole.join(verdicts, keys, "left").withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    response = F.col("to").isNull() | ((F.col("id_key") == F.col("to.id_key")) & (F.col("uri_key") == F.col("to.uri_key")) & (F.col("no") == 1))
    return each.select(
        _record_id(F.col("id")).alias("record_id"),
        F.when(response, "response").otherwise("revisit").alias("type"),
        F.col("uri").alias("target_uri"),
        F.when(~response, _record_id(F.col("to.id"))).alias("refers_to"),
        F.when(~response, F.col("to.uri")).alias("refers_uri"),
        "payload_digest",
        "payload_length",
        F.when(response, F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str, level: int = 4, mode: str = "append") -> None:
    """Rows of warc_records as archives below path: a file, or more of bounded size, for each task."""
    small_batches(records.sparkSession)
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode(mode).option("level", level).save(path)


def captures(records: DataFrame, id_col: str = "id", kind: str = "string") -> DataFrame:
    """id_col, payload_bytes, payload_digest (recomputed where the payload is there), record_type, refers_to of records that read_warc gave."""
    digest = F.when(F.col("type") == "revisit", F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.sha2("payload", 256))
    return records.where("type IN ('response', 'revisit')").select(id_of(F.col("record_id"), kind).alias(id_col), F.col("payload_length").alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), id_of(F.col("refers_to"), kind).alias("refers_to"))
