"""Exact selection of ranks within keys, of which a few hold most rows.

No task ever sees the rows of one key together: a round counts values by a dyadic
prefix (a mergeable histogram, combined before the shuffle), finds for each wanted
rank the bin that holds it, and the next round counts only the rows of those bins by
a longer prefix, until the bins are single values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayspan.session import cut, small

#: Bits of the value that one round resolves: at most 2^11 counters a key and open bin.
ROUND_BITS = 11


def select_ranks(df: DataFrame, wanted: DataFrame, key: str, value: str, round_bits: int = ROUND_BITS, every_key: bool = False) -> DataFrame:
    """Values at given ranks: one row (key, rank, value) for each row (key, rank) of wanted.

    df: key of any groupable type, value BIGINT; rows with a null in either are left out.
    wanted: distinct (key, rank), rank BIGINT counted from 0 in ascending order of value,
    ties counted singly. Ranks outside a key's rows, and keys without rows, yield no row.
    An empty df or wanted gives an empty result. every_key tells that wanted names all keys, so
    rows needn't be looked up in it. A rank is settled once its bin holds one value only; every
    round is one scan of the rows that are in bins still open, and there are at most
    ceil(bits of (max - min) / round_bits).
    """
    rows = df.select(F.col(key).alias("_k"), F.col(value).cast("bigint").alias("_x")).dropna()
    hint = (lambda side: side) if every_key else small  # ranks of all keys grow with the keys, those of hot ones don't
    state = cut(wanted.select(F.col(key).alias("_k"), F.col("rank").cast("bigint").alias("_r")).dropna().distinct())
    if not every_key:
        rows = rows.join(small(cut(state.select("_k").distinct())), "_k", "left_semi")
    low, high = rows.agg(F.min("_x"), F.max("_x")).first()
    if low is None:
        return state.limit(0).select(F.col("_k").alias(key), F.col("_r").alias("rank"), F.col("_r").alias(value))
    shift = 0
    while (high >> shift) - (low >> shift) >= 1 << round_bits:
        shift += 1
    #: _p: prefix of the open bin, _b: rows of the key below that bin.
    state, open_shift, done = state.withColumn("_b", F.lit(0).cast("bigint")), None, []
    while True:
        on, counted = ["_k"], rows
        if open_shift is not None:
            on, counted = ["_k", "_p"], rows.withColumn("_p", F.shiftright("_x", open_shift)).join(hint(cut(state.select("_k", "_p").distinct())), ["_k", "_p"], "left_semi")
        counts = counted.groupBy(*on, F.shiftright("_x", shift).alias("_q")).agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        upto = W.partitionBy(*on).orderBy("_q").rowsBetween(W.unboundedPreceding, 0)
        counts = counts.withColumn("_to", F.sum("_n").over(upto)).withColumn("_from", F.col("_to") - F.col("_n"))
        left = F.col("_r") - F.col("_b")
        found = cut(counts.join(hint(state), on).where((F.col("_from") <= left) & (left < F.col("_to"))).select("_k", "_r", F.col("_q").alias("_p"), (F.col("_b") + F.col("_from")).alias("_b"), "_low", "_high"))
        done.append(found.where("_low = _high").select(F.col("_k").alias(key), F.col("_r").alias("rank"), F.col("_low").alias(value)))
        state = found.where("_low < _high").select("_k", "_r", "_p", "_b")
        if shift == 0 or state.isEmpty():
            out = done[0]
            for more in done[1:]:
                out = out.unionByName(more)
            return out
        open_shift, shift = shift, max(0, shift - round_bits)


def quantile_rank(q: float, n: Column) -> Column:
    """Rank, from 0, of the q quantile of n rows: floor(q * (n - 1)), with q in parts of ten thousand."""
    return F.expr("0").cast("bigint") + F.floor(F.lit(round(q * 10_000)).cast("bigint") * (n - 1) / F.lit(10_000)).cast("bigint")


def key_quantiles(df: DataFrame, key: str, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of value for every key: key, n and one BIGINT column for each name in probs.

    Quantiles are taken values (no interpolation), at rank floor(q * (n - 1)). Rows with a
    null key or value don't count; a key without others has no row. Keys of any size go through
    select_ranks, so no task sees the rows of a key.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(value).cast("bigint").alias("_value")).dropna()
    sizes = cut(rows.groupBy("_key").agg(F.count("*").alias("n")))
    asked = sizes.select("_key", "n", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), quantile_rank(q, F.col("n")).alias("rank")) for c, q in probs.items()])).alias("a")).select("_key", "n", "a.*")
    found = select_ranks(rows, asked.select("_key", "rank"), "_key", "_value", every_key=True)
    named = asked.join(found, ["_key", "rank"]).groupBy("_key", "n").agg(*[F.max(F.when(F.col("name") == c, F.col("_value"))).alias(c) for c in probs])
    return named.withColumnRenamed("_key", key)


def key_splits(df: DataFrame, key: str, value: str, rows_per_bucket: int) -> DataFrame:
    """Split points that cut every key of more than rows_per_bucket rows into even ranges of value.

    One row (key, splits) for each such key, splits being the ascending distinct values that
    open a bucket after the first. Keys without a row there are one bucket. Meant for rows
    whose (key, value) are distinct, where no bucket exceeds rows_per_bucket. There are at most
    rows / rows_per_bucket splits in all.
    """
    hot = df.groupBy(F.col(key)).agg(F.count(value).alias("_n")).where((F.col("_n") > rows_per_bucket) & F.col(key).isNotNull())
    wanted = hot.select(key, F.explode(F.sequence(F.lit(rows_per_bucket).cast("bigint"), F.col("_n") - 1, F.lit(rows_per_bucket).cast("bigint"))).alias("rank"))
    return cut(select_ranks(df, wanted, key, value).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("splits")))


def bucket_of(splits: str, value: str, most: int) -> Column:
    """How many of the ascending splits (at most `most`) are at or below value, by bisection; null where splits is."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, most.bit_length())))])
    return F.when(F.col(splits).isNotNull(), F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(splits, low + step - 1) <= F.col(value), low + step).otherwise(low)))
