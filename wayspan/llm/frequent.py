"""The most frequent values of a column, exactly, with few counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayspan.session import cut, small

#: Bits of the hash that each scan counts by. At most 2^12 counters for each prefix retained.
LEVELS = (12, 24, 36, 48, 64)
#: Prefixes that are worth a lookup; with more retained, values are counted by a shuffle.
MOST_PREFIXES = 1 << 20


def _prefix(bits: int):
    return F.shiftrightunsigned(F.xxhash64("x"), 64 - bits)


def _values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("x")).where("x IS NOT NULL")


def _counts(values: DataFrame, level: int) -> DataFrame:
    """Rows of each prefix: _p, n, and the least and greatest value under it, x and _top."""
    return values.groupBy(_prefix(level).alias("_p")).agg(F.count("*").alias("n"), F.min("x").alias("x"), F.max("x").alias("_top"))


def _refine(values: DataFrame, first: DataFrame, keep) -> DataFrame:
    """x, n of the values under the prefixes that keep() retains at each level; first holds the counts of the first."""
    bits, kept = LEVELS[0], cut(keep(first))
    for level in (*LEVELS[1:], None):
        if kept.where("x <> _top").isEmpty():  # each prefix holds a single value, so it is counted already
            return kept.select("x", "n")
        rows = values
        if kept.count() > MOST_PREFIXES:  # no filter worth its lookup: count values, spilling where they don't fit
            level = None
        else:
            rows = values.withColumn("_p", _prefix(bits)).join(small(kept.select("_p")), "_p", "left_semi")
        if level is None:
            return cut(keep(rows.groupBy("x").agg(F.count("*").alias("n"))))
        bits, kept = level, cut(keep(_counts(rows, level)))


def heavy_values(df: DataFrame, column: str, least: int) -> DataFrame:
    """All values held by at least so many rows: x, n (exact). Nulls don't count; ties all come out.

    A value's rows share every prefix of its hash, so a prefix with fewer than `least` rows
    holds none of them. At most rows / least prefixes are retained, each refined into at most
    2^12 counters, however many distinct values there are. Where least is so low that more than
    MOST_PREFIXES are retained, values are counted by a plain shuffle, whose counters spill.
    """
    values = _values(df, column)
    return _refine(values, cut(_counts(values, LEVELS[0])), lambda c: c.where(F.col("n") >= max(1, least)))


def shared_values(df: DataFrame, column: str, per_mille: int) -> DataFrame:
    """Values that hold at least per_mille thousandths of the rows with a value: x, n. The first level's counters tell how many rows those are."""
    values = _values(df, column)
    first = cut(_counts(values, LEVELS[0]))
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1, -(-total * per_mille // 1000))
    return _refine(values, first, lambda c: c.where(F.col("n") >= least))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, x and n, ties by the lesser x. Fewer than k distinct values: all.

    First the 4 k fullest prefixes of each level are followed down to values; their exact counts
    give a lower bound of the k-th count. Then every prefix that may hold a value at or above
    that bound is refined, so nothing is missed. With a flat tail that bound is near 1 and retains
    nearly all prefixes; see heavy_values for what happens then.
    """
    values = _values(df, column)
    first = cut(_counts(values, LEVELS[0]))
    scouts = _refine(values, first, lambda c: c.orderBy(F.desc("n"), "x").limit(4 * k))
    counts = [r["n"] for r in scouts.orderBy(F.desc("n")).limit(k).collect()]  # k numbers
    least = counts[-1] if len(counts) == k else 1
    found = _refine(values, first, lambda c: c.where(F.col("n") >= least))
    return found.orderBy(F.desc("n"), "x").limit(k)
