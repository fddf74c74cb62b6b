"""Column expressions on visits, queries, dates, sets and keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Bounds and exponent of the power law that visit lengths are drawn from.
LENGTH_LOW, LENGTH_HIGH, LENGTH_POWER = 600, 28_800, -2.5


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Strict overlap of two half-open intervals."""
    return F.greatest(a_start, b_start) < F.least(a_end, b_end)


def uniform(key: Column, seed: int) -> Column:
    """A number from 0 to below 1 that depends on an integer key and a seed only, alike in any engine: a multiplicative hash."""
    return (F.pmod(F.pmod(key, F.lit(1 << 31)) * F.lit(2_654_435_761 % (1 << 31)) + F.lit(seed * 40_503), F.lit(1 << 31)) / F.lit(float(1 << 31))).cast("double")


def power_law(y: Column, low: int = LENGTH_LOW, high: int = LENGTH_HIGH, power: float = LENGTH_POWER) -> Column:
    """Truncated power law by inversion of its distribution at y."""
    p = power + 1
    return F.pow((F.lit(float(low) ** p) - F.lit(float(high) ** p)) * y + F.lit(float(high) ** p), F.lit(1 / p))


def date_text(epoch: Column) -> Column:
    """UTC date as yyyy.MM.dd."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy.MM.dd")


def packed(high: Column, low: Column) -> Column:
    """Two 32-bit keys in one BIGINT."""
    return F.shiftleft(high.cast("bigint"), 32).bitwiseOR(low.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def merged_unique(*arrays: Column) -> Column:
    """Sorted union of arrays; null arrays count as empty."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(a, F.array()) for a in arrays]))))


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def file_stem(path: Column) -> Column:
    """Name of a path's file without folder and last extension."""
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def tokens(text: Column, separators: str = " \t") -> Column:
    """Non-empty parts of a text between any of the separators."""
    escaped = "".join("\\" + c if c in "\\]^-[" else c for c in separators)
    return F.filter(F.split(text, f"[{escaped}]+"), lambda x: x != "")


def interval_contains(pre_s: Column, last_s: Column, pre_t: Column) -> Column:
    """Tree-interval test: t lies below s, or is s, in the tree whose walk numbered them."""
    return pre_t.between(pre_s, last_s)


def not_refuted(down_s: Column, down_t: Column, f1_s: Column, f1_t: Column, f2_s: Column, f2_t: Column) -> Column:
    """False where levels or topological orders show that s cannot reach t."""
    return (down_s > down_t) & (f1_s < f1_t) & (f2_s < f2_t)
