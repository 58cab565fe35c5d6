"""Log sequence numbers: an epoch in the high 32 bits and a number within the epoch in the low ones.

Columns are signed longs; the two highest values, and epochs from 2**31 on, keep their bit pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LSN_INVALID, LSN_OLDEST, LSN_MAX = 0, 1, -1  # the last as a signed long: all bits set
ESN_MASK = 0xFFFFFFFF


def compose_lsn(epoch: Column, esn: Column) -> Column:
    return F.shiftleft(epoch.cast("long"), 32).bitwiseOR(esn.cast("long"))


def lsn_to_epoch(lsn: Column) -> Column:
    return F.shiftrightunsigned(lsn, 32)


def lsn_to_esn(lsn: Column) -> Column:
    return lsn.bitwiseAND(F.lit(ESN_MASK).cast("long"))


def lsn_to_string(lsn: Column) -> Column:
    """``e<epoch>n<esn>``, or the name of the invalid and the greatest number; null for null."""
    pretty = F.concat(F.lit("e"), lsn_to_epoch(lsn).cast("string"), F.lit("n"), lsn_to_esn(lsn).cast("string"))
    return F.when(lsn == LSN_INVALID, "LSN_INVALID").when(lsn == LSN_MAX, "LSN_MAX").otherwise(pretty)


def string_to_lsn(text: Column) -> Column:
    """The reverse: ``eXnY`` in either case, a leading whole number, or a name; null for anything else."""
    t = F.lower(F.trim(text))
    part = lambda i: F.regexp_extract(t, r"^e([0-9]+)n([0-9]+)$", i).try_cast("decimal(20,0)")
    number = F.regexp_extract(t, r"^([0-9]+)", 1).try_cast("decimal(20,0)")
    unsigned = lambda d: F.when(d >= F.lit(str(1 << 63)).cast("decimal(20,0)"), d - F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(d).try_cast("long")
    fits = lambda d: d <= ESN_MASK
    return (
        F.when(t == "lsn_invalid", F.lit(LSN_INVALID).cast("long"))
        .when(t == "lsn_oldest", F.lit(LSN_OLDEST).cast("long"))
        .when(t == "lsn_max", F.lit(LSN_MAX).cast("long"))
        .when(t.rlike("^e[0-9]+n[0-9]+$"), F.when(fits(part(1)) & fits(part(2)), compose_lsn(part(1).cast("long"), part(2).cast("long"))))
        .when(t.rlike("^[0-9]"), unsigned(number))
    )


def is_metadata_log(log_id: Column) -> Column:
    """Metadata logs are shown as the negated number of their data log."""
    return log_id < 0
