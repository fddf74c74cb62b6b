"""Items that appear together in baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayspan.session import cut, small

#: Items of a basket that one row may hold; larger baskets are cut into blocks.
BLOCK_ITEMS = 256


def cooccurrence(baskets: DataFrame, keys: list[str], item: str, min_together: int = 1, min_lift: int = 0) -> DataFrame:
    """Pairs of items and how often they share a basket.

    baskets: a row for each item of a basket, named by the columns keys; rows with a null in
    keys or item don't count, an item counts once in a basket, other columns are ignored.
    Result: a, b (a < b), n_ab, n_a, n_b, n (baskets in all), lift = n_ab * n / (n_a * n_b)
    and pmi = log2(lift), for the pairs with n_ab >= min_together and lift >= min_lift; the
    bounds are compared in integers. No baskets, or none with two items: no rows.

    Counting is exact. Since n_ab <= min(n_a, n_b), items in fewer than min_together baskets,
    or in more than n / min_lift, are in no such pair and leave before pairs are made. A pair
    of min_together baskets has one outside any min_together - 1 of them, so the largest
    min_together - 1 baskets emit nothing: their share is looked up for the pairs found in the
    others. Every other basket emits ordered pairs by blocks of about BLOCK_ITEMS items, so a
    long basket is spread over tasks; counts are combined before the shuffle.
    """
    rows = cut(baskets.select(*[F.col(k) for k in keys], F.col(item).alias("_item")).dropna().distinct())
    n = rows.select(*keys).distinct().count()
    singles = cut(rows.groupBy("_item").agg(F.count("*").alias("_n")).where((F.col("_n") >= min_together) & (F.lit(min_lift).cast("decimal(19,0)") * F.col("_n") <= n)))
    # an item takes the number of its baskets along, so pairs are never joined for it
    rows = rows.join(small(singles), "_item").select(*keys, F.struct("_item", "_n").alias("_item"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size")).where(F.col("_size") > BLOCK_ITEMS)
    sizes = cut(sizes)
    rare = sizes.orderBy(F.desc("_size"), *keys).limit(max(0, min_together - 1))
    rare = cut(rare)
    blocks = rows.join(small(sizes), keys, "left").join(small(rare.select(*keys)), keys, "left_anti")
    count = F.coalesce(F.ceil(F.col("_size") / BLOCK_ITEMS), F.lit(1)).cast("bigint")
    blocks = blocks.withColumn("_of", count).withColumn("_block", F.pmod(F.xxhash64("_item._item"), F.col("_of")))
    blocks = blocks.groupBy(*keys, "_of", "_block").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    within = blocks.where(F.size("_items") > 1).select("_items", F.posexplode("_items").alias("_k", "a"))
    within = within.where(F.col("_k") < F.size("_items") - 1).select("a", F.explode(F.expr("slice(_items, _k + 2, size(_items))")).alias("b"))
    made = within
    if not sizes.isEmpty():
        # each pair of blocks is a key of its own, so a long basket is spread over tasks here too
        parts = blocks.where("_of > 1")
        one = F.lit(1).cast("bigint")
        left = parts.where(F.col("_block") < F.col("_of") - 1).select(*keys, F.col("_block").alias("_i"), F.explode(F.sequence(F.col("_block") + one, F.col("_of") - one)).alias("_j"), "_items")
        right = parts.where("_block > 0").select(*keys, F.col("_block").alias("_j"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_block") - one)).alias("_i"), F.col("_items").alias("_items2"))
        across = left.join(right, [*keys, "_i", "_j"]).select(F.explode("_items").alias("x"), "_items2").select("x", F.explode("_items2").alias("y"))
        made = made.unionByName(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    pair = [F.col(f"{x}.{c}").alias(n) for x in "ab" for c, n in (("_item", x), ("_n", f"n_{x}"))]
    pairs = made.select(*pair).groupBy("a", "n_a", "b", "n_b").agg(F.count("*").alias("n_ab"))
    if not rare.isEmpty():
        pairs = cut(pairs)
        held = rows.join(small(rare.select(*keys)), keys, "left_semi").groupBy(F.col("_item._item").alias("_item")).agg(F.collect_set(F.struct(*keys)).alias("_in"))
        left, right = held.select(F.col("_item").alias("a"), F.col("_in").alias("_in_a")), held.select(F.col("_item").alias("b"), F.col("_in").alias("_in_b"))
        extra = F.coalesce(F.size(F.array_intersect("_in_a", "_in_b")), F.lit(0))
        more = F.when(F.col("_in_a").isNull() | F.col("_in_b").isNull(), 0).otherwise(extra)
        pairs = pairs.join(left, "a", "left").join(right, "b", "left").select("a", "n_a", "b", "n_b", (F.col("n_ab") + more).alias("n_ab"))
    pairs = pairs.where(F.col("n_ab") >= min_together)
    wide = lambda c: c.cast("decimal(19,0)")
    pairs = pairs.withColumn("n", F.lit(n).cast("bigint"))
    if min_lift:
        pairs = pairs.where(wide(F.col("n_ab")) * wide(F.col("n")) >= wide(F.col("n_a") * min_lift) * wide(F.col("n_b")))
    pairs = pairs.withColumn("lift", F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))
    return pairs.select("a", "b", "n_ab", "n_a", "n_b", "n", "lift", F.log2("lift").alias("pmi"))
