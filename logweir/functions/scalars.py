"""Scalars of the query surface: names, durations, counters by key, and others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nanoseconds of each unit of a duration text.
UNITS = {
    "ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "min": 60 * 10**9, "mins": 60 * 10**9, "h": 3600 * 10**9, "hr": 3600 * 10**9,
    "d": 86400 * 10**9, "day": 86400 * 10**9, "days": 86400 * 10**9, "w": 604800 * 10**9, "week": 604800 * 10**9, "weeks": 604800 * 10**9,
}


def column_name(header: Column) -> Column:
    """A header as a column name: lower case, other than letters and digits to single underscores, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(header), "[^a-z0-9]+", "_"), F.lit("_"))


def duration_ns(text: Column) -> Column:
    """Nanoseconds of ``<number><unit>``, ``min`` or ``max``; null if it isn't one or vanishes in rounding."""
    t = F.lower(F.trim(text))
    number = F.regexp_extract(t, r"^([0-9]*\.?[0-9]+)\s*[a-z]+$", 1).try_cast("double")
    unit = F.regexp_extract(t, r"^[0-9.]+\s*([a-z]+)$", 1)
    factor = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])[unit]
    ns = F.floor(number * factor)
    return F.when(t == "max", F.lit((1 << 63) - 1)).when(t == "min", F.lit(-(1 << 63))).when((ns == 0) & (number > 0), F.lit(None)).otherwise(ns).cast("long")


def log2(x: Column) -> Column:
    """Base-2 logarithm with the C library's results at and below zero."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log2(x))


def total(x: Column) -> Column:
    """Sum as a double, 0 of no rows."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def all_greatest(*columns: Column) -> Column:
    """Greatest value, null if any is null."""
    out = F.greatest(*columns)
    for c in columns:
        out = F.when(c.isNotNull(), out)
    return out


# Offsets: maps from a counter's number to a sum.


def offsets_merged(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def offsets_difference(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))


def offsets_greatest(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y))


def offsets_scaled(a: Column, by: Column) -> Column:
    return F.transform_values(a, lambda _, x: x * by)


def pretty_time(ms: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS.mmm`` of milliseconds since the epoch, in the session's zone."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS")


def duration_text(ns: Column) -> Column:
    """Nanoseconds as a whole number of the largest unit that divides them: ``90s``, ``2min``, ``1d``; ``max`` and ``min`` for the ends."""
    out = F.when(ns == (1 << 63) - 1, "max").when(ns == -(1 << 63), "min")
    for unit in ("w", "d", "h", "min", "s", "ms", "us"):
        out = out.when((ns % UNITS[unit] == 0) & (ns != 0), F.concat((ns / UNITS[unit]).cast("long").cast("string"), F.lit(unit)))
    return out.otherwise(F.concat(ns.cast("string"), F.lit("ns")))


def hex_payload(payload: Column) -> Column:
    """Bytes as upper-case hexadecimal digits."""
    return F.hex(payload.cast("binary"))


# Batches of payloads as one value: the checksum, then the count and each payload behind its length, as big-endian 32-bit numbers.


# Both work on a value that is bound once: what it is made from is put in wherever a column is named, and with a name in
# each step, a batch was made again for each of its numbers.


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def encoded_batch(payloads: Column) -> Column:
    """A batch as bytes, from an array of binary payloads; null for null, or if a payload is null."""
    number = lambda n: F.lpad(F.hex(n.cast("long")), 8, "0")
    part = lambda p: F.concat(number(F.octet_length(p)), F.hex(p.cast("binary")))

    def body(p: Column) -> Column:
        digits = F.concat(number(F.size(p)), F.array_join(F.transform(p, part), ""))
        return F.when(p.isNotNull() & ~F.exists(p, lambda x: x.isNull()), F.unhex(digits))

    return bound(bound(payloads, body), lambda b: F.concat(F.unhex(number(F.crc32(b))), b))


def decoded_batch(batch: Column) -> Column:
    """The payloads of an encoded batch as an array of binaries; null if its checksum, count or lengths don't hold."""

    def decoded(data: Column) -> Column:
        number = lambda at: F.conv(F.hex(F.substring(data, at, F.lit(4))), 16, 10).cast("long")
        whole = (F.octet_length(data) >= 8) & (number(F.lit(1)) == F.crc32(F.substring(data, F.lit(5), F.octet_length(data))))
        n = number(F.lit(5))
        start = F.struct(F.lit(9).cast("int").alias("at"), F.array().cast("array<binary>").alias("out"))

        def step(acc: Column, _: Column) -> Column:
            return bound(number(acc["at"]).cast("int"), lambda size: F.struct((acc["at"] + 4 + size).cast("int").alias("at"), F.concat(acc["out"], F.array(F.substring(data, acc["at"] + 4, size))).alias("out")))

        payloads = lambda read: F.when(read["at"] == F.octet_length(data) + 1, read["out"])
        read = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<bigint>")), start, step, payloads)
        return F.when(whole, read)

    return bound(batch, decoded)


def fnv1a_64(data: Column) -> Column:
    """FNV-1a over the bytes of a binary or string column, as a signed long."""
    prime = F.lit(0x100000001B3).cast("decimal(38,0)")
    whole = F.lit(str(1 << 64)).cast("decimal(38,0)")
    raw = data.cast("binary")
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int"))

    def step(acc: Column, byte: Column) -> Column:
        low = acc.cast("decimal(38,0)") % F.lit(256).cast("decimal(38,0)")
        mixed = acc.cast("decimal(38,0)") - low + low.cast("int").bitwiseXOR(byte).cast("decimal(38,0)")
        # the product in two halves, so that it stays within 38 digits
        high, rest = F.floor(mixed / F.lit(1 << 32)), mixed % F.lit(1 << 32).cast("decimal(38,0)")
        return (((high * prime) % F.lit(1 << 32).cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(38,0)") + rest * prime) % whole).cast("decimal(20,0)")

    start = F.lit(str(0xCBF29CE484222325)).cast("decimal(20,0)")
    unsigned = F.when(F.octet_length(raw) == 0, start).otherwise(F.aggregate(codes, start, step))
    return F.when(unsigned >= F.lit(str(1 << 63)).cast("decimal(20,0)"), unsigned - F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(unsigned).cast("long")
