"""Readers and writers of the text formats of graphs, visits, queries and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayspan.operators.blocks import with_rank


def _numbers(spark: SparkSession, path: str, names: list[str], sep: str = " ") -> DataFrame:
    """Rows of integers parted by blanks; lines that begin with # and blank lines are no rows."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim(F.regexp_replace("value", r"[\s]+", sep)), sep)
    return lines.select(*[F.try_element_at(parts, F.lit(k + 1)).try_cast("bigint").alias(n) for k, n in enumerate(names)])


def unread_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """value of the lines of a file of numbers that are no comments, not blank and don't begin with n integers: those a reader gives nulls for."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim(F.regexp_replace("value", r"[\s]+", " ")), " ")
    sound = F.lit(True)
    for k in range(n):
        sound = sound & F.try_element_at(parts, F.lit(k + 1)).try_cast("bigint").isNotNull()
    return lines.where(~sound)


def read_visits(spark: SparkSession, path: str) -> DataFrame:
    """u, v, ts, te of a bipartite graph file. A missing path is an error, as is a file without rows."""
    rows = _numbers(spark, path, ["u", "v", "ts", "te"])
    if rows.isEmpty():
        raise ValueError(f"no visits in {path}")
    return rows


def read_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """u, ts, v of a file of starts without ends."""
    return _numbers(spark, path, ["u", "ts", "v"])


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid (from 0 in order of the lines), u, w, q_start, q_end."""
    rows = _numbers(spark, path, ["u", "w", "q_start", "q_end"])
    return with_line_numbers(rows, "qid")


def with_line_numbers(rows: DataFrame, name: str) -> DataFrame:
    """rows with their place in the file; one file, read in order."""
    marked = rows.withColumn("_at", F.monotonically_increasing_id())
    return with_rank(marked, ["_at"], name).select(name, *rows.columns)


def read_labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries of path_1 (reachable) and path_0 (not), with expected. No reachable ones: an error."""
    yes, no = read_queries(spark, f"{path}_1"), read_queries(spark, f"{path}_0")
    if yes.isEmpty():
        raise ValueError(f"no queries in {path}_1")
    return yes.withColumn("expected", F.lit(True)).unionByName(no.withColumn("expected", F.lit(False)))


def read_queries_by_label(spark: SparkSession, path: str, labels: str, wanted: bool, most: int = 100_000) -> DataFrame:
    """The first `most` queries whose line in a file of 0 and 1 is as wanted."""
    mark = with_line_numbers(_numbers(spark, labels, ["label"]), "qid")
    return read_queries(spark, path).join(mark.where(F.col("label") == int(wanted)).select("qid"), "qid").orderBy("qid").limit(most)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return with_line_numbers(_numbers(spark, path, ["u", "w"]), "qid")


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """a, b of a file whose first line is the number of vertices."""
    return _numbers(spark, path, ["a", "b"]).where("b IS NOT NULL")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """node (from 0) and part of a file with one part id a line."""
    return with_line_numbers(_numbers(spark, path, ["part"]), "node").select("node", "part")


def read_weighted(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, edge_id, weight of lines `src: dst[edge|weight] ...`."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+\s*:"))
    entry = F.explode(F.expr(r"regexp_extract_all(value, '(\\d+\\[\\d+\\|-?\\d+\\])', 1)"))
    rows = lines.select(F.regexp_extract("value", r"^\s*(\d+)\s*:", 1).cast("bigint").alias("src"), entry.alias("e"))
    pick = lambda k: F.regexp_extract("e", r"(\d+)\[(\d+)\|(-?\d+)\]", k).cast("bigint")
    return rows.select("src", pick(1).alias("dst"), pick(2).alias("edge_id"), pick(3).alias("weight"))


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """chain, place, node of lines `[id][id]...`."""
    lines = with_line_numbers(spark.read.text(path).where(F.col("value").contains("[")), "chain")
    return lines.select("chain", F.posexplode(F.expr(r"regexp_extract_all(value, '\\[(\\d+)\\]', 1)")).alias("place", "node")).select("chain", "place", F.col("node").cast("bigint"))


def visit_lines(visits: DataFrame) -> DataFrame:
    """value: lines `u v ts te`."""
    return visits.select(F.concat_ws(" ", "u", "v", "ts", "te").alias("value"))


def write_visits(visits: DataFrame, path: str) -> None:
    """A bipartite graph file as a folder of parts; the part `header` holds `# uppers lowers`, and each visitor's lines are in falling order of ts."""
    counts = visits.agg(F.coalesce(F.max("u") + 1, F.lit(0)).alias("a"), F.coalesce(F.max("v") + 1, F.lit(0)).alias("b"))
    counts.select(F.format_string("# %d %d", "a", "b").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/header")
    rows = visits.repartition("u").sortWithinPartitions("u", F.desc("ts"))
    visit_lines(rows).write.mode("overwrite").text(f"{path}/visits")


def write_queries(queries: DataFrame, path: str) -> None:
    queries.select(F.concat_ws(" ", "u", "w", "q_start", "q_end").alias("value")).write.mode("overwrite").text(path)


def adjacency_lines(nodes: DataFrame, edges: DataFrame, base: int = 0, end: str = " #") -> DataFrame:
    """node and line `node: child child ... #` for nodes id and edges a, b; base is added to every id. Children ascend."""
    kids = edges.select("a", "b").distinct().groupBy("a").agg(F.array_sort(F.collect_list(F.col("b") + base)).alias("kids"))
    rows = nodes.select("id").distinct().join(kids, F.col("id") == F.col("a"), "left")
    listed = F.concat_ws(" ", F.transform(F.coalesce("kids", F.array()), lambda x: x.cast("string")))
    return rows.select((F.col("id") + base).alias("node"), F.concat((F.col("id") + base).cast("string"), F.lit(":"), F.when(listed == "", "").otherwise(F.concat(F.lit(" "), listed)), F.lit(end)).alias("line"))


def metis_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and line of the undirected METIS format: neighbours from 1, ascending."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return adjacency_lines(nodes, both, 1, "").select("node", F.regexp_replace("line", r"^\d+: ?", "").alias("line"))


def graphviz_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string("%d -> %d;", "a", "b").alias("line"))


def graphviz_slots(slots: DataFrame, edges: DataFrame) -> DataFrame:
    """node and line of the form with labels: for each slot (id, slot_start, slot_end) its label, then an edge for each child, ascending."""
    kids = edges.select("a", "b").distinct().groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("kids"))
    rows = slots.join(kids, F.col("id") == F.col("a"), "left")
    label = F.format_string('{rank="same";%d[label = "id=%d|start=%d|end=%d"]};', "id", "id", "slot_start", "slot_end")
    text = F.array_join(F.transform(F.coalesce("kids", F.array()), lambda x: F.concat(F.col("id").cast("string"), F.lit("->"), x.cast("string"), F.lit(";"))), "")
    return rows.select(F.col("id").alias("node"), F.concat(label, text).alias("line"))


def event_graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and line `id degree child child ... ` of an event graph, as split_graph() gives it; ids are places in order of (vertex, time, kind)."""
    ids = with_rank(nodes.select("vertex", "time", "kind"), ["vertex", "time", "kind"], "id")
    a = ids.select(F.col("vertex").alias("from_v"), F.col("time").alias("from_t"), F.col("kind").alias("from_kind"), F.col("id").alias("a"))
    b = ids.select(F.col("vertex").alias("to_v"), F.col("time").alias("to_t"), F.col("kind").alias("to_kind"), F.col("id").alias("b"))
    links = edges.join(a, ["from_v", "from_t", "from_kind"]).join(b, ["to_v", "to_t", "to_kind"]).select("a", "b").distinct()
    kids = links.groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("kids"))
    rows = ids.join(kids, F.col("id") == F.col("a"), "left").withColumn("kids", F.coalesce("kids", F.array().cast("array<bigint>")))
    text = F.array_join(F.transform("kids", lambda x: F.concat(x.cast("string"), F.lit(" "))), "")
    return rows.select(F.col("id").alias("node"), F.concat(F.col("id").cast("string"), F.lit(" "), F.size("kids").cast("string"), F.lit(" "), text).alias("line"))


def event_info_lines(nodes: DataFrame) -> DataFrame:
    """vertex, kind and line `vertex count time time ... ` of the arrivals and of the starts of each vertex, ascending."""
    rows = nodes.groupBy("vertex", "kind").agg(F.array_sort(F.collect_set("time")).alias("times"))
    text = F.array_join(F.transform("times", lambda x: F.concat(x.cast("string"), F.lit(" "))), "")
    return rows.select("vertex", "kind", F.concat(F.col("vertex").cast("string"), F.lit(" "), F.size("times").cast("string"), F.lit(" "), text).alias("line"))


def chain_lines(chains: DataFrame) -> DataFrame:
    """chain and line `[id][id]...` of rows chain, place, node."""
    rows = chains.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("x"))
    return rows.select("chain", F.array_join(F.transform("x", lambda y: F.concat(F.lit("["), y["node"].cast("string"), F.lit("]"))), "").alias("line"))


def write_in_order(lines: DataFrame, path: str, order: str) -> None:
    """Lines as one file, sorted: for formats in which a line's number tells what it is of. One task writes it, as one reads it."""
    lines.repartition(1).sortWithinPartitions(order).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def weighted_lines(edges: DataFrame) -> DataFrame:
    """node and line `src: dst[edge|weight] ... #` of src, dst, edge_id, weight."""
    entry = F.struct("dst", "edge_id", "weight")
    text = lambda x: F.concat(x["dst"].cast("string"), F.lit("["), x["edge_id"].cast("string"), F.lit("|"), x["weight"].cast("string"), F.lit("]"))
    rows = edges.groupBy("src").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return rows.select(F.col("src").alias("node"), F.concat(F.col("src").cast("string"), F.lit(": "), F.concat_ws(" ", F.transform("e", text)), F.lit(" #")).alias("line"))


def gdl_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string('edge: { sourcename: "%d" targetname: "%d" label: "%d" }', "src", "dst", "weight").alias("line"))


def write_lines(lines: DataFrame, path: str, header: list[str] = ()) -> None:
    """Lines as a text folder; header lines in a part of their own."""
    spark = lines.sparkSession
    if header:
        spark.createDataFrame([("\n".join(header),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(f"{path}/lines")


def first_percent(rows: DataFrame, order: list[str], percent: int) -> DataFrame:
    """The first so many percent of rows in an order that parts them all; percent from 0 to 100."""
    n = rows.count()
    return with_rank(rows, order, "_rank").where(F.col("_rank") * 100 < F.lit(n) * percent).drop("_rank")


def write_report(metrics: DataFrame, path: str) -> None:
    """One-row metrics as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def as_json(row: DataFrame) -> Column:
    return F.to_json(F.struct(*row.columns))
