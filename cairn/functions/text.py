"""Labels for people: sizes and time spans; and the page size that fits a typical block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit names and sizes, largest first.
BINARY = (("TiB", 1 << 40), ("GiB", 1 << 30), ("MiB", 1 << 20), ("KiB", 1 << 10))
DECIMAL = (("TB", 10**12), ("GB", 10**9), ("MB", 10**6), ("kB", 10**3))
SPANS = (("year", 31536000), ("week", 604800), ("day", 86400), ("hour", 3600), ("minute", 60), ("second", 1))


def format_size(size: Column, units: tuple = BINARY) -> Column:
    """1023 -> '1023 bytes', 1024 -> '1 KiB', 1536 -> '1.50 KiB'."""
    out = F.concat(size.cast("string"), F.lit(" bytes"))
    for name, unit in reversed(units):
        whole = F.concat((size / unit).cast("long").cast("string"), F.lit(f" {name}"))
        part = F.concat(F.format_string("%.2f", F.bround(size / F.lit(float(unit)), 2)), F.lit(f" {name}"))
        out = F.when(size >= unit, F.when(size % unit == 0, whole).otherwise(part)).otherwise(out)
    return out


def format_timespan(seconds: Column) -> Column:
    """93603 -> '1 day, 2 hours and 3 seconds'; under one second -> 'less than a second'."""
    rest, parts = seconds.cast("long"), []
    for name, unit in SPANS:
        n = F.floor(rest / unit).cast("long")
        parts.append(F.when(n == 1, F.lit(f"1 {name}")).when(n > 1, F.concat(n.cast("string"), F.lit(f" {name}s"))))
        rest = rest - n * unit
    said = F.array_compact(F.array(*parts))
    n = F.size(said)
    joined = F.when(n > 1, F.concat(F.array_join(F.slice(said, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(said, -1))).otherwise(F.array_join(said, ""))
    return F.when(seconds < 1, F.lit("less than a second")).otherwise(joined)


def page_size(typical: Column) -> Column:
    """The next power of two from 512 to 65536 that holds a typical block."""
    return F.least(F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(typical, F.lit(1.0))))), F.lit(512.0)), F.lit(65536.0)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent, 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part * 100.0 / whole)
