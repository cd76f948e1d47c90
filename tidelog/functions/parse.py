"""Text that configuration, names and sets come in, parsed and written with Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = "KMGTPE"
#: gno, inclusive.
MOST_GNO = 2**63 - 2


def byte_size(text: Column) -> Column:
    """Digits and an optional K, M, G, T, P or E (powers of 1024, any case) as decimal(20,0); null if malformed or over 2^64-1."""
    digits = F.regexp_extract(text, r"^([0-9]{1,20})[KMGTPEkmgtpe]?$", 1)
    unit = F.upper(F.regexp_extract(text, r"^[0-9]{1,20}([KMGTPEkmgtpe])$", 1))
    power = F.lit(1).cast("decimal(20,0)")
    for i, u in enumerate(UNITS, 1):
        power = F.when(unit == u, F.lit(str(1024**i)).cast("decimal(20,0)")).otherwise(power)
    number = F.when(digits != "", digits).cast("decimal(20,0)")
    most = F.lit(str(2**64 - 1)).cast("decimal(20,0)")
    return F.when(number <= F.floor(most / power).cast("decimal(20,0)"), (number * power).cast("decimal(20,0)"))


def duration_seconds(text: Column) -> Column:
    """C20: a positive number with s, m, h or d, in seconds; null if malformed."""
    number = F.regexp_extract(text, r"^0*([1-9][0-9]{0,9})[smhd]$", 1)
    unit = F.regexp_extract(text, r"([smhd])$", 1)
    scale = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).otherwise(86400)
    return F.when(number != "", F.when(number != "", number).cast("long") * scale)


def delay_microseconds(text: Column) -> Column:
    """C20: 0, or a number with us or ms, in microseconds; null if malformed."""
    number = F.regexp_extract(text, r"^([0-9]{1,10})(?:us|ms)$", 1)
    return F.when(text == "0", F.lit(0).cast("long")).when(number != "", F.when(number != "", number).cast("long") * F.when(text.endswith("ms"), 1000).otherwise(1))


def file_base(name: Column) -> Column:
    """What precedes the last stop of base.digits."""
    return F.nullif(F.regexp_extract(name, r"^(.+)\.([0-9]{6,})$", 1), F.lit(""))


def file_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^(.+)\.([0-9]{6,})$", 2), F.lit("")).cast("long")


def version_product(version: Column) -> Column:
    """A.b.c as digits of base 256; 0 if it can't be parsed."""
    part = lambda i: F.regexp_extract(version, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})", i)
    number = lambda i: F.when(part(i) != "", part(i)).cast("long")
    return F.coalesce(number(1) * 65536 + number(2) * 256 + number(3), F.lit(0).cast("long"))


def version_number(version: Column) -> Column:
    """Major * 10000 + minor * 100 + patch; null if it can't be parsed."""
    part = lambda i: F.regexp_extract(version, r"^([0-9]{1,4})\.([0-9]{1,2})\.([0-9]{1,2})", i)
    number = lambda i: F.when(part(i) != "", part(i)).cast("long")
    return number(1) * 10000 + number(2) * 100 + number(3)


def checksum_name(algorithm: Column, product: Column) -> Column:
    """C4: what a version with trailers (5.6.1 on) calls its algorithm."""
    return F.when(product < 5 * 65536 + 6 * 256 + 1, "UNDEF").when(algorithm == 0, "OFF").when(algorithm == 1, "CRC32").otherwise(F.concat(F.lit("UNKNOWN("), algorithm.cast("string"), F.lit(")")))


def uuid_bytes(text: Column) -> Column:
    """C14: 16 bytes of a UUID in either case; null if malformed."""
    return F.when(text.rlike(r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"), F.unhex(F.replace(text, F.lit("-"), F.lit(""))))


def uuid_text(binary: Column) -> Column:
    h = F.lower(F.hex(binary))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def tag(text: Column) -> Column:
    """Lower-cased; null if it is none."""
    return F.when(text.rlike(r"^[A-Za-z_][A-Za-z0-9_]{0,31}$"), F.lower(text))


def ipv4_number(text: Column) -> Column:
    """An address without leading zeros as a number; null if malformed."""
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    number = lambda i: F.split_part(text, F.lit("."), F.lit(i)).cast("long")
    return F.when(text.rlike("^" + r"\.".join([octet] * 4) + "$"), ((number(1) * 256 + number(2)) * 256 + number(3)) * 256 + number(4))


def in_ipv4_range(address: Column, network: Column, bits: Column) -> Column:
    """The first `bits` bits of two numbers are equal."""
    divisor = F.pow(F.lit(2.0), 32 - bits).cast("long")
    return F.floor(address / divisor) == F.floor(network / divisor)


def is_ipv4_range(network: Column, bits: Column) -> Column:
    """The bits behind the prefix are zero."""
    return bits.between(0, 32) & (network % F.pow(F.lit(2.0), 32 - bits).cast("long") == 0)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _groups(half: Column) -> Column:
    """The colon-separated groups of one side of "::"."""
    return F.filter(F.split(half, ":", -1), lambda g: (g != "") | (half != ""))


def ipv6_hex(text: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address; null if malformed or with a zone. The last 32 bits may be an IPv4 address."""
    dotted = ipv4_number(F.nullif(F.regexp_extract(text, r"^.*:([0-9.]+)$", 1), F.lit("")))
    tail = _let(dotted, lambda v: F.concat(F.hex(F.shiftright(v, 16)), F.lit(":"), F.hex(v.bitwiseAND(F.lit(65535)))))
    plain = F.when(text.contains("."), F.concat(F.regexp_extract(text, r"^(.*:)[0-9.]+$", 1), tail)).otherwise(text)

    def filled(front: Column, back: Column) -> Column:
        return F.concat(front, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(front) - F.size(back), F.lit(1))), back)

    # "::" stands for one group or more and comes once at most
    sides = lambda h: F.when(F.size(h) == 1, _groups(h[0])).when(F.size(h) == 2, _let(F.struct(_groups(F.get(h, F.lit(0))).alias("f"), _groups(F.get(h, F.lit(1))).alias("b")), lambda x: filled(x["f"], x["b"])))
    whole = lambda g: F.when((F.size(g) == 8) & F.forall(g, lambda d: d.rlike("^[0-9A-Fa-f]{1,4}$")), F.lower(F.array_join(F.transform(g, lambda d: F.lpad(d, 4, "0")), "")))
    return _let(_let(F.split(plain, "::", -1), sides), whole)


def address_hex(text: Column) -> Column:
    """An address of either family as 8 or 32 hexadecimal digits; null if malformed."""
    return F.when(text.contains(":"), ipv6_hex(text)).otherwise(F.lower(F.lpad(F.hex(ipv4_number(text)), 8, "0")))


def address_bits(digits: Column) -> Column:
    """At most 32 hexadecimal digits as text of zeros and ones."""
    eight = lambda at: F.substring(digits, at, 8)
    return F.concat(*(F.when(F.length(digits) < at, "").otherwise(F.lpad(F.conv(eight(at), 16, 2), 4 * F.length(eight(at)), F.lit("0"))) for at in (1, 9, 17, 25)))


def address_range(text: Column) -> Column:
    """address[/prefix] as the bits that its addresses begin with; null if malformed, if the prefix is too long or if a
    bit behind it is set. Without a prefix the range is the address alone. The family is that of the text."""
    written = F.regexp_extract(text, r"^[^/]*/([0-9]+)$", 1).try_cast("int")
    bits = _let(address_hex(F.split_part(text, F.lit("/"), F.lit(1))), address_bits)
    length = lambda b: F.when(text.contains("/"), written).otherwise(F.length(b))
    cut = lambda x: F.when((x["n"] <= F.length(x["b"])) & ~F.substring(x["b"], x["n"] + 1, F.length(x["b"])).contains("1"), F.substring(x["b"], F.lit(1), x["n"]))
    return _let(bits, lambda b: _let(F.struct(b.alias("b"), length(b).alias("n")), cut))


def in_address_range(address: Column, network: Column) -> Column:
    """Whether an address is in a range, both as text and of one family; null if either is malformed."""
    inside = _let(address_hex(address), address_bits).startswith(address_range(network))
    # named twice, so computed once: each mention would parse both texts again
    return _let(inside, lambda i: F.when(i.isNotNull(), i & (address.contains(":") == network.contains(":"))))


def set_text(intervals) -> Column:
    """C17: intervals, an array of structs (start, end) half-open, as a or a-b inclusive, colon-joined."""
    one = lambda x: F.when(x["end"] == x["start"] + 1, x["start"].cast("string")).otherwise(F.concat(x["start"].cast("string"), F.lit("-"), (x["end"] - 1).cast("string")))
    return F.array_join(F.transform(F.array_sort(intervals), one), ":")


def _gno(digits: Column) -> Column:
    """A transaction number from its digits; null if it is none or out of range."""
    number = digits.try_cast("decimal(38,0)")
    return F.when(number.between(1, MOST_GNO), number).cast("long")


def _interval(part: Column) -> Column:
    """a or a-b as a half-open struct (start, end); null if malformed, descending or out of range."""
    first = _gno(F.regexp_extract(part, r"^([0-9]+)(?:-[0-9]+)?$", 1))
    last = F.when(part.contains("-"), _gno(F.regexp_extract(part, r"^[0-9]+-([0-9]+)$", 1))).otherwise(first)
    return F.when(last >= first, F.struct(first.alias("start"), (last + 1).alias("end")))


def set_intervals(text: Column) -> Column:
    """A source's text name:a-b:c as array of structs (start, end), half-open; null if an interval is malformed, descending or out of range."""
    parts = F.slice(F.split(text, ":", -1), F.lit(2), F.greatest(F.size(F.split(text, ":", -1)) - 1, F.lit(0)))
    return F.when(F.forall(parts, lambda x: _interval(x).isNotNull()), F.transform(parts, _interval))


SET_ROW = "struct<uuid:string,tag:string,start:bigint,end:bigint>"


def set_rows(text: Column) -> Column:
    """uuid[:tag][:a[-b]]..., comma-joined, as an array of (uuid, tag, start, end), half-open; null if any part is malformed.

    A tag holds for the intervals behind it, up to the next tag. Spaces may only follow a comma. A uuid without
    intervals adds none, an empty text is the empty set. Intervals stay as they are written: merge_intervals joins them.
    """
    entries = F.filter(F.split(text, r",[ \t\n\x0B\f\r]*", -1), lambda e: e != "")
    shape = r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}(?::(?:[0-9]+(?:-[0-9]+)?|[A-Za-z_][A-Za-z0-9_]{0,31}))*\z"

    def rows(entry: Column) -> Column:
        parts = F.split(F.substring(entry, 38, 1 << 30), ":", -1)
        uuid = F.lower(F.substring(entry, 1, 36))
        start = F.struct(F.lit("").alias("tag"), F.array().cast(f"array<{SET_ROW}>").alias("rows"))

        def take(state: Column, part: Column) -> Column:
            x = _interval(part)
            row = F.struct(uuid.alias("uuid"), state["tag"].alias("tag"), x["start"].alias("start"), x["end"].alias("end")).cast(SET_ROW)
            is_tag = part.rlike("^[A-Za-z_]")
            return F.struct(F.when(is_tag, F.lower(part)).otherwise(state["tag"]).alias("tag"), F.when(is_tag | (part == ""), state["rows"]).otherwise(F.array_append(state["rows"], row)).alias("rows"))

        return F.aggregate(parts, start, take, lambda s: s["rows"])

    all_rows = F.flatten(F.transform(entries, rows))
    good = F.forall(entries, lambda e: e.rlike(shape)) & F.forall(all_rows, lambda r: r["start"].isNotNull())
    return F.when(good, all_rows)


def request_line(line: Column) -> Column:
    """Method, path and query of an HTTP request line; null if malformed."""
    pattern = r"^([A-Z]+) (/[^ ?]*)(?:\?([^ ]*))? HTTP/1\.[01]$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    return F.when(line.rlike(pattern), F.struct(part(1).alias("method"), part(2).alias("path"), part(3).alias("query")))


def statement_kind(sql: Column) -> Column:
    """K1: select, set, show_events or unsupported (error 1235)."""
    trimmed = F.upper(F.trim(sql))
    return F.when(trimmed.rlike(r"^SELECT\s"), "select").when(trimmed.rlike(r"^SET\s"), "set").when(trimmed.rlike(r"^SHOW\s+BINLOG\s+EVENTS\s+IN\s"), "show_events").otherwise("unsupported")


def select_items(sql: Column) -> Column:
    """K2, H5: the expressions of a list of variables, a trailing LIMIT 1 taken off."""
    body = F.regexp_replace(F.regexp_replace(F.trim(sql), r"(?i)^SELECT\s+", ""), r"(?i)\s+LIMIT\s+1\s*$", "")
    return F.transform(F.split(body, ","), lambda x: F.trim(x))
