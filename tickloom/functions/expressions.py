"""Column expressions that several operators share. All are built-ins, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-12


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is next to 0."""
    return F.when(F.abs(b) <= EPSILON, F.lit(0.0)).otherwise(F.try_divide(a, b))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def log_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.ln(F.try_divide(a, b)))


def logit(p: Column, edge: float = 1e-9) -> Column:
    q = clip(p, edge, 1 - edge)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def copysign(size: Column, sign: Column) -> Column:
    return F.when(sign < 0, -F.abs(size)).otherwise(F.abs(size))


def codes(*pairs: tuple[Column, str]) -> Column:
    """Array of the codes whose condition is true, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in pairs]))


def canonical_hash(entries: Column) -> Column:
    """SHA-256 of a string map as JSON with sorted keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries)))), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID of ``name`` (UTF-8) under a namespace UUID: SHA-1 with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant.substr(nibble, F.lit(1)), F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def pinned(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions read instead of copying: long chains of conditions stay linear in plan size."""
    for name, c in columns.items():
        rows = rows.select(*[F.col(x) for x in rows.columns if x != name], F.explode(F.array(c)).alias(name))
    return rows
