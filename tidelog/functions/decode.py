"""Bytes of a log: little-endian fields with Spark's functions, variable-length bodies in Arrow batches."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAGIC = b"\xfebin"
FORMAT_DESCRIPTION, GTID, ANONYMOUS, PREVIOUS, TAGGED = 15, 33, 34, 35, 42


def little_endian(binary: Column, offset: int, length: int) -> Column:
    """An unsigned number of up to 7 bytes at a byte offset; null if the bytes are not there."""
    pairs = F.regexp_extract_all(F.hex(F.substring(binary, offset + 1, length)), F.lit("(..)"), F.lit(1))
    return F.when(F.octet_length(binary) >= offset + length, F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("long"))


def number_hex(value: Column, length: int) -> Column:
    """The bytes of a number, lowest first, as hexadecimal digits."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * length, "0")
    return F.regexp_replace(digits, "(..)" * length, "".join(f"${i}" for i in range(length, 0, -1)))


def encoded_number(value: Column, length: int) -> Column:
    """The bytes of a number, lowest first."""
    return F.unhex(number_hex(value, length))


def header_bytes(timestamp: Column, kind: Column, server: Column, length: Column, next_pos: Column, flags: Column) -> Column:
    """The 19 bytes of an event header."""
    return F.concat(encoded_number(timestamp, 4), encoded_number(kind, 1), encoded_number(server, 4), encoded_number(length, 4), encoded_number(next_pos, 4), encoded_number(flags, 2))


def header_fields(binary: Column) -> list[Column]:
    """Timestamp, type, server, length, next position and flags."""
    at = {"timestamp": (0, 4), "type": (4, 1), "server_id": (5, 4), "event_length": (9, 4), "next_pos": (13, 4), "flags": (17, 2)}
    return [little_endian(binary, o, n).alias(name) for name, (o, n) in at.items()]


def rotate_bytes(position: Column, name: Column) -> Column:
    return F.concat(encoded_number(position, 8), F.encode(name, "UTF-8"))


def without_trailer(body: Column, checksum_bytes: int) -> Column:
    """A body without its checksum; null if it is shorter than that."""
    return F.when(F.octet_length(body) >= checksum_bytes, F.substring(body, F.lit(1), F.octet_length(body) - checksum_bytes))


def with_crc32(event: Column) -> Column:
    """C11: the bytes of an event and its checksum, lowest byte first."""
    return F.concat(event, encoded_number(F.crc32(event), 4))


def rotate_fields(body: Column, checksum_bytes: int = 0) -> list[Column]:
    """Position and name of the next file; null if the body ends before them. Positions above 2^55 are refused."""
    content = without_trailer(body, checksum_bytes)
    position = F.when(F.hex(F.substring(content, 8, 1)) == "00", little_endian(content, 0, 7))
    return [position.alias("position"), F.when(F.octet_length(content) >= 8, F.decode(F.substring(content, 9, 1 << 20), "UTF-8")).alias("name")]


def heartbeat_name(body: Column, checksum_bytes: int = 0) -> Column:
    """The name that is a heartbeat's first form; empty if there is nothing but a checksum."""
    return F.decode(F.coalesce(without_trailer(body, checksum_bytes), F.when(body.isNotNull(), F.lit(b""))), "UTF-8")


# --- small decoders of one body; they raise ValueError on malformed bytes ---------------------


class Reader:
    """A cursor over bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("bytes end early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def packed(self) -> int | None:
        """One byte below 251, else 2, 3 or 8 that follow; 251 is null."""
        first = self.number(1)
        if first == 0xFB:
            return None
        if first == 0xFF:
            raise ValueError("no such length")
        return self.number({0xFC: 2, 0xFD: 3, 0xFE: 8}[first]) if first > 0xFB else first

    def varint(self) -> int:
        """The ones that lead in the first byte (from its low end) count the bytes that follow."""
        first = self.number(1)
        more = 0
        while more < 8 and first >> more & 1:
            more += 1
        low = first >> (more + 1) if more < 8 else 0
        return low | self.number(more) << max(0, 7 - more) if more else low

    def signed(self) -> int:
        value = self.varint()
        return -(value >> 1) - 1 if value & 1 else value >> 1


def packed_bytes(value: int | None) -> bytes:
    if value is None:
        return b"\xfb"
    if value < 0xFB:
        return bytes([value])
    for mark, size in ((0xFC, 2), (0xFD, 3), (0xFE, 8)):
        if value < 1 << 8 * size:
            return bytes([mark]) + value.to_bytes(size, "little")
    raise ValueError("too large")


def varint_bytes(value: int) -> bytes:
    size = next(n for n in range(1, 10) if n == 9 or value < 1 << 7 * n)
    return b"\xff" + value.to_bytes(8, "little") if size == 9 else (value << size | (1 << size - 1) - 1).to_bytes(size, "little")


def content(body: bytes, checksum_bytes: int) -> bytes:
    """A body without its checksum."""
    if len(body) < checksum_bytes:
        raise ValueError("shorter than its checksum")
    return body[: len(body) - checksum_bytes]


#: The kind of clock that a transaction's body has, the only one there is.
LOGICAL_CLOCK = 2


def transaction_fields(body: bytes, checksum_bytes: int = 0) -> tuple[bytes, int, int | None]:
    """Uuid, gno and the transaction's length, null if the body ends before it or has another clock. A clock cut short is refused."""
    r = Reader(content(body, checksum_bytes))
    r.take(1)
    uuid, gno = r.take(16), int.from_bytes(r.take(8), "little", signed=True)
    length = None
    if r.at < len(r.data) and r.number(1) == LOGICAL_CLOCK:
        r.take(16)
        if r.at + 7 <= len(r.data):
            if r.number(7) >> 55 & 1:  # a second time follows
                r.take(7)
            if r.at < len(r.data):
                length = r.packed()
                if length is None:
                    raise ValueError("null length")
    return uuid, gno, length


def set_bytes(intervals: list[tuple[bytes, list[tuple[int, int]]]]) -> bytes:
    """The untagged set of (uuid, [start, end) intervals), sorted and merged."""
    sources = (uuid + struct.pack("<Q", len(own)) + b"".join(struct.pack("<QQ", a, b) for a, b in own) for uuid, own in sorted(intervals))
    return struct.pack("<Q", len(intervals)) + b"".join(sources)


TAG = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,31}")


def tagged_set_rows(data: bytes) -> list[tuple[bytes, str, int, int]]:
    """(uuid, tag, start, end) of a set in either form, the tag empty where there is none. Overlapping or adjacent
    intervals of one entry, a tag that is none and bytes left over are refused. A source may come twice."""
    r, out = Reader(data), []
    header = r.number(8)
    form = header >> 56
    if form > 1:
        raise ValueError("no such form")
    sources = (header & (1 << 56) - 1) >> 8 if form else header
    for _ in range(sources):
        uuid, tag, last = r.take(16), "", 0
        if form:
            size = r.number(1)
            if size & 1:
                raise ValueError("tag too long")
            if size:
                tag = r.take(size >> 1).decode("latin-1").lower()
                if not TAG.fullmatch(tag):
                    raise ValueError("no tag")
        for _ in range(r.number(8)):
            start, end = r.number(8), r.number(8)
            if start <= last or end <= start or end >= 1 << 63:
                raise ValueError("intervals out of order")
            out.append((uuid, tag, start, end))
            last = end
    if r.at != len(data):
        raise ValueError("bytes are left over")
    return out


def set_rows(data: bytes) -> list[tuple[bytes, int, int]]:
    """(uuid, start, end) of an untagged set."""
    rows = tagged_set_rows(data)
    if any(tag for _, tag, _, _ in rows):
        raise ValueError("a tag")
    return [(uuid, start, end) for uuid, _, start, end in rows]


def encoded_sets(intervals: DataFrame, keys: list[str], tagged: bool = True) -> DataFrame:
    """(keys, encoded) of merged intervals (keys, uuid, tag, start, end), ordered by uuid and tag. The tagged form is
    written where a set has a tag; with tagged=False tagged sources are left out."""
    rows = intervals if tagged else intervals.where("tag = ''")
    number = lambda c: number_hex(c, 8)
    # digits are joined at once and become bytes at the end: adding bytes entry by entry would copy a set for each of its entries
    joined = lambda xs, f: F.array_join(F.transform(F.sort_array(xs), f), "")
    pairs = joined(F.collect_list(F.struct("start", "end")), lambda x: F.concat(number(x["start"]), number(x["end"])))
    size = F.concat(number_hex(F.octet_length("tag") * 2, 1), F.hex(F.encode("tag", "UTF-8")))
    sources = rows.groupBy(*keys, "uuid", "tag").agg(F.unhex(F.concat(number(F.count(F.lit(1))), pairs)).alias("own")).withColumn("size", F.unhex(size))
    sets = sources.groupBy(*keys).agg(F.collect_list(F.struct("uuid", "tag", "size", "own")).alias("all"), (F.max("tag") > "").alias("has_tag"))
    plain = F.concat(number(F.size("all")), joined(F.col("all"), lambda x: F.hex(F.concat(x["uuid"], x["own"]))))
    with_tags = F.concat(F.lit("01"), number_hex(F.size("all"), 6), F.lit("01"), joined(F.col("all"), lambda x: F.hex(F.concat(x["uuid"], x["size"], x["own"]))))
    return sets.select(*keys, F.unhex(F.when(F.col("has_tag"), with_tags).otherwise(plain)).alias("encoded"))


#: Rows of a batch that a task gives back at once.
BATCH_ROWS = 50_000


def decode_sets(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, uuid, tag, start, end) of a column of encoded sets, a row an interval; uuid is null where a set is malformed."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full(rows: list, kinds: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [key, "uuid", "tag", "start", "end"])

        for batch in batches:
            rows, kinds = [], [batch.column(0).type, pa.binary(), pa.string(), pa.int64(), pa.int64()]
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                k = k.as_py()
                try:
                    own = [(k, *x) for x in tagged_set_rows(data.as_py() or b"")]
                except ValueError:
                    own = [(k, None, None, None, None)]
                # a large set leaves in parts, small ones together
                while len(rows) + len(own) >= BATCH_ROWS:
                    cut = BATCH_ROWS - len(rows)
                    yield full(rows + own[:cut], kinds)
                    rows, own = [], own[cut:]
                rows += own
            yield full(rows, kinds)

    return df.select(key, column).mapInArrow(run, f"{key} {kind}, uuid binary, tag string, start long, end long")


def description_bytes(version: Column, created: Column, algorithm: Column) -> Column:
    """A format description body: log version 4, server version in 50 bytes, creation time, header length 19, checksum algorithm and room."""
    padded = F.concat(F.encode(version, "UTF-8"), F.unhex(F.repeat(F.lit("00"), 50 - F.octet_length(version))))
    return F.concat(encoded_number(F.lit(4), 2), padded, encoded_number(created, 4), encoded_number(F.lit(19), 1), encoded_number(algorithm, 1), F.unhex(F.lit("00000000")))


def description_fields(body: Column) -> list[Column]:
    """Log version, server version up to its first zero byte, created, header length; null where the header is shorter than 19."""
    length = little_endian(body, 56, 1)
    version = F.regexp_extract(F.decode(F.substring(body, 3, 50), "ISO-8859-1"), r"^([^\x00]*)", 1)
    fields = {"log_version": little_endian(body, 0, 2), "server_version": version, "created": little_endian(body, 52, 4), "header_length": length}
    return [F.when(length >= 19, c).alias(n) for n, c in fields.items()]


def equal_for_resume(stored: Column, resent: Column, checksum_bytes: int = 4) -> Column:
    """Two description bodies are the same but for the time of creation and the checksum."""
    masked = lambda b: F.concat(F.substring(b, 1, 52), F.substring(b, 57, F.octet_length(b) - 56 - checksum_bytes))
    return masked(stored) == masked(resent)


#: Field numbers of a tagged transaction's body; they only ascend.
TAG_FLAGS, TAG_UUID, TAG_GNO, TAG_TAG, TAG_LENGTH, MOST_TAG = 0, 1, 2, 3, 8, 32


def tagged_bytes(uuid: bytes, gno: int, tag: str, length: int | None) -> bytes:
    """A tagged transaction's body: version, size, last field that must be known, then fields."""
    fields = varint_bytes(TAG_FLAGS) + varint_bytes(1) + varint_bytes(TAG_UUID) + b"".join(map(varint_bytes, uuid)) + varint_bytes(TAG_GNO) + varint_bytes(gno << 1)
    fields += varint_bytes(TAG_TAG) + varint_bytes(len(tag)) + tag.encode()
    fields += b"" if length is None else varint_bytes(TAG_LENGTH) + varint_bytes(length)
    return varint_bytes(1) + varint_bytes(len(fields) + 3) + varint_bytes(TAG_TAG) + fields


def tagged_fields(body: bytes, checksum_bytes: int = 0) -> tuple[bytes, int, str, int | None]:
    """Uuid, gno, tag and length (null if absent). Fields out of order, missing or overlong are refused."""
    body = content(body, checksum_bytes)
    r = Reader(body)
    if r.varint() != 1 or r.varint() > len(body):
        raise ValueError("no such message")
    r.varint()
    found: dict[int, object] = {}
    last = -1
    while r.at < len(body) and last < TAG_LENGTH:
        field = r.varint()
        if field <= last:
            raise ValueError("fields out of order")
        if field > TAG_LENGTH:
            break
        last = field
        if field == TAG_UUID:
            found[field] = bytes(r.varint() for _ in range(16))
        elif field == TAG_GNO:
            found[field] = r.signed()
        elif field == TAG_TAG:
            size = r.varint()
            if size > MOST_TAG:
                raise ValueError("tag too long")
            found[field] = r.take(size).decode()
        else:
            found[field] = r.varint()
    if not {TAG_UUID, TAG_GNO, TAG_TAG} <= set(found):
        raise ValueError("fields are missing")
    return found[TAG_UUID], found[TAG_GNO], found[TAG_TAG], found.get(TAG_LENGTH)


def heartbeat_bytes(name: str, position: int) -> bytes:
    """(type, length, value) of the name and of the position, then the end mark."""
    raw, inner = name.encode(), packed_bytes(position)
    return b"\x01" + packed_bytes(len(raw)) + raw + b"\x02" + packed_bytes(len(inner)) + inner + b"\x00"


def heartbeat_fields(body: bytes, checksum_bytes: int = 0) -> tuple[str | None, int | None]:
    """Name and position of a heartbeat's second form; other fields are stepped over."""
    r, name, position = Reader(content(body, checksum_bytes)), None, None
    while (field := r.packed()) != 0:
        if field is None:
            raise ValueError("null field")
        size = r.packed()
        if size is None:
            raise ValueError("null length")
        value = r.take(size)
        if field == 1:
            name = value.decode()
        elif field == 2:
            position = Reader(value).packed()
            if position is None:
                raise ValueError("null position")
    return name, position


def map_bodies(df: DataFrame, key: str, columns: list[str], f: Callable[..., tuple], schema: str) -> DataFrame:
    """(key, *fields) of f over columns, in Arrow batches; the fields are null where f refuses a row."""
    kind = df.schema[key].dataType.simpleString()
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    types = [kinds[part.strip().split(" ")[1]] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for args in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                try:
                    found.append(f(*args))
                except ValueError:
                    found.append((None,) * len(names))
            cells = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, t) for c, t in zip(cells, types, strict=True))], [key, *names])

    return df.select(key, *columns).mapInArrow(run, f"{key} {kind}, {schema}")


def decode_transactions(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, uuid, gno, txn_length) of a column of bodies."""
    return map_bodies(df, key, [column], transaction_fields, "uuid binary, gno long, txn_length long")


FILE_HEADER = "name string, size long, created_at long, server_id long, in_use boolean, server_version string, checksum string, header_length long, previous binary, error string"
#: Bytes of an event's header, of a checksum, and the flag of a file that is being written.
HEADER_BYTES, CHECKSUM_BYTES, IN_USE = 19, 4, 1
#: The version from which on events have checksums, as digits of base 256.
CHECKSUMS_SINCE = 5 << 16 | 6 << 8 | 1


def checksum_algorithm(version: str, mark: int) -> str:
    """What a server of this version calls the algorithm that the mark stands for."""
    parts = re.match(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})", version)
    numbers = [int(x) for x in parts.groups()] if parts else [0, 0, 0]
    if max(numbers) > 255 or numbers[0] << 16 | numbers[1] << 8 | numbers[2] < CHECKSUMS_SINCE:
        return "UNDEF"
    return {0: "OFF", 1: "CRC32"}.get(mark, f"UNKNOWN({mark})")


def file_header(read: Callable[[int, int], bytes], name: str, size: int) -> tuple:
    """The fields of FILE_HEADER after name and size, but for the error, from a function that reads bytes at an offset."""
    if not re.fullmatch(r".+\.[0-9]{6,}", name):
        raise ValueError("not the name of a log")
    if read(0, len(MAGIC)) != MAGIC:
        raise ValueError("no magic")

    def event(at: int, kind: int) -> tuple[tuple, bytes]:
        head = read(at, HEADER_BYTES)
        if len(head) < HEADER_BYTES:
            raise ValueError("file ends in a header")
        fields = struct.unpack("<IBIIIH", head)
        if fields[1] != kind:
            raise ValueError({FORMAT_DESCRIPTION: "no description first", PREVIOUS: "no previous sets after the description"}[kind])
        if fields[3] < HEADER_BYTES or at + fields[3] > size:
            raise ValueError("event runs past the end")
        return fields, read(at + HEADER_BYTES, fields[3] - HEADER_BYTES)

    head, body = event(len(MAGIC), FORMAT_DESCRIPTION)
    if len(body) < 57 or body[56] < HEADER_BYTES:
        raise ValueError("description too short")
    version = body[2:52].split(b"\0")[0].decode("latin-1")
    checksum = checksum_algorithm(version, body[-5])
    after, sets = event(len(MAGIC) + head[3], PREVIOUS)
    sets = content(sets, CHECKSUM_BYTES if checksum == "CRC32" else 0)
    tagged_set_rows(sets)
    return head[0], head[2], bool(head[5] & IN_USE), version, checksum, len(MAGIC) + head[3] + after[3], sets


def file_headers(files: DataFrame) -> DataFrame:
    """A row a log file (FILE_HEADER) of spark.read.format("binaryFile"): its description and the sets before it, error null;
    or, where the file is malformed, only name, size and error. Only paths and lengths come from Spark, so that it
    does not load the files; a task reads the two events at a file's start, by its path. Spark lists no empty files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        parts = [part.strip().split(" ") for part in FILE_HEADER.split(",")]
        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        for batch in batches:
            rows = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                name = unquote(path.rsplit("/", 1)[-1])
                with store.open_input_file(place) as f:
                    try:
                        rows.append((name, size, *file_header(lambda at, n: f.read_at(n, at), name, size), None))  # noqa: B023
                    except ValueError as e:
                        rows.append((name, size, *[None] * 7, str(e)))
            columns = list(zip(*rows, strict=True)) or [()] * len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, parts, strict=True)], [n for n, _ in parts])

    return files.select("path", "length").mapInArrow(run, FILE_HEADER)


def write_files(contents: DataFrame, folder: str) -> None:
    """Writes (name, content) rows as files of a folder that all executors share; a task that runs again replaces its files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(re.sub(r"^file:/+|^/+", "file:///", folder))
        store.create_dir(place, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{place}/{name}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    contents.select("name", "content").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def scan_log_bytes(files: DataFrame) -> DataFrame:
    """The events of whole log files, as spark.read.format("binaryFile") gives them: (path, pos, timestamp, type, server_id, event_length, next_pos, flags).

    A file without the magic gives no rows; the walk stops where an event is not whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = len(MAGIC) if content[:4] == MAGIC else len(content)
                while at + 19 <= len(content):
                    head = struct.unpack_from("<IBIIIH", content, at)
                    if head[3] < 19 or at + head[3] > len(content):
                        break
                    rows.append((path, at, *head))
                    at += head[3]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.string(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "pos", "timestamp", "type", "server_id", "event_length", "next_pos", "flags"])

    return files.select("path", "content").mapInArrow(run, "path string, pos long, timestamp long, type long, server_id long, event_length long, next_pos long, flags long")
