"""The time-slot graph of a table of visits.

visit(u, v, ts, te) -> components (v, c_start, c_end) of at least two visits -> elementary slots
(v, slot_start, slot_end) -> edges. A slot's key is (v, slot_start). All steps are windows over
blocks and equi-joins; no group is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayspan.functions import overlaps
from wayspan.operators.blocks import by_cells, with_next, with_running_max
from wayspan.operators.components import interval_components

#: Stands for a latency that bounds nothing.
UNBOUNDED = 630_720_000
CELL = 21_600


def clip_visits(visits: DataFrame) -> DataFrame:
    """u, v, ts, te of visits that don't overlap within a visitor.

    Rows with a null, or te <= ts, are left out; of those of one u and ts the one with the greatest
    (te, v) stays; a visit ends at the latest where the next of its u starts.
    """
    rows = visits.select(*[F.col(c).cast("bigint") for c in ("u", "v", "ts", "te")]).where("te > ts").dropna()
    rows = rows.groupBy("u", "ts").agg(F.max(F.struct("te", "v")).alias("x")).select("u", "x.v", "ts", "x.te")
    rows = with_next(rows, ["u"], "ts", {"_start": "ts"})
    return rows.select("u", "v", "ts", F.least("te", F.coalesce("_start", "te")).alias("te"))


def meeting_visits(visits: DataFrame, drop_touching: bool = False) -> tuple[DataFrame, DataFrame]:
    """Visits that are in a component with another, with its c_start and c_end; and those components.

    visits must be clipped. drop_touching repeats a defect of earlier engines, for parity: a visit
    that starts exactly where the running component ends is lost (see touching_kept).
    """
    if drop_touching:
        visits = touching_kept(visits)
    parts = interval_components(visits).where("n >= 2").select("v", "c_start", "c_end")
    last = visits.agg(F.max("ts")).first()[0]  # cells hold starts only
    cells = by_cells(parts, F.col("c_start"), F.least(F.col("c_end"), F.lit((last or 0) + 1)), CELL)
    rows = visits.withColumn("_cell", F.floor(F.col("ts") / F.lit(CELL)).cast("bigint"))
    rows = rows.join(cells, ["v", "_cell"]).where("c_start <= ts AND ts < c_end")
    return rows.select("u", "v", "ts", "te", "c_start", "c_end"), parts


def touching_kept(visits: DataFrame) -> DataFrame:
    """visits without those that touch the end of the running component of their v, in order of (ts, te, u).

    What is dropped depends on what was dropped before, so this is a fold over the visits of a v,
    by applyInPandas; it is for parity tests, and a v's visits must fit one task.
    """

    def fold(pdf):
        pdf = pdf.sort_values(["ts", "te", "u"], kind="stable")
        keep, end = [], None
        for ts, te in zip(pdf["ts"].tolist(), pdf["te"].tolist()):
            keep.append(end is None or ts != end)
            if keep[-1]:
                end = te if end is None or ts > end else max(end, te)
        return pdf[keep]

    return visits.select("u", "v", "ts", "te").groupBy("v").applyInPandas(fold, "u bigint, v bigint, ts bigint, te bigint")


def slots(meeting: DataFrame) -> DataFrame:
    """v, c_start, c_end, slot_start, slot_end: between consecutive distinct ends within a component."""
    at = meeting.select("v", "c_start", "c_end", F.explode(F.array("ts", "te")).alias("slot_start")).distinct()
    at = with_next(at, ["v", "c_start"], "slot_start", {"slot_end": "slot_start"})
    return at.where("slot_end IS NOT NULL").select("v", "c_start", "c_end", "slot_start", "slot_end")


def with_last_slot(meeting: DataFrame, slot: DataFrame) -> DataFrame:
    """meeting with last_start, the start of the last slot of each visit."""
    last = slot.select("v", F.col("slot_end").alias("te"), F.col("slot_start").alias("last_start"))
    return meeting.join(last, ["v", "te"])


def chain_edges(slot: DataFrame) -> DataFrame:
    """Edges from a slot to the next of its component; the next starts where the slot ends."""
    rows = slot.where("slot_end < c_end")
    return rows.select(F.col("v").alias("src_v"), F.col("slot_start").alias("src_start"), F.col("v").alias("dst_v"), F.col("slot_end").alias("dst_start"))


def moves(meeting: DataFrame) -> DataFrame:
    """Consecutive meeting visits of one visitor: u, ts, v, c_start, last_start and next_ts, next_v, next_c, gap.

    meeting must have last_start. gap runs from the start of the last slot to the next visit's start.
    """
    rows = with_next(meeting, ["u"], "ts", {"next_ts": "ts", "next_v": "v", "next_c": "c_start"})
    return rows.withColumn("gap", F.col("next_ts") - F.col("last_start"))


def move_edges(moved: DataFrame, delta: int = UNBOUNDED) -> DataFrame:
    """Edges from the last slot of a visit to the first of the same visitor's next, in another component, within delta."""
    rows = moved.where("next_ts IS NOT NULL AND NOT (v = next_v AND c_start = next_c)").where(F.col("gap") <= delta)
    return rows.select(F.col("v").alias("src_v"), F.col("last_start").alias("src_start"), F.col("next_v").alias("dst_v"), F.col("next_ts").alias("dst_start")).distinct()


def edges(slot: DataFrame, moved: DataFrame, delta: int = UNBOUNDED) -> DataFrame:
    """All edges with their kind, chain or move. Every edge leads to a later slot start."""
    chain = chain_edges(slot).withColumn("kind", F.lit("chain"))
    return chain.unionByName(move_edges(moved, delta).withColumn("kind", F.lit("move")))


def with_runs(moved: DataFrame, delta: int = UNBOUNDED) -> DataFrame:
    """meeting visits with run: the ts of the visit that opens its stretch of visits of u, joined by gap <= delta or the same component."""
    back = with_next_back(moved)
    opens = F.when(F.col("_gap").isNull() | ((F.col("_gap") > delta) & ~F.col("_same")), F.col("ts"))
    return with_running_max(back, ["u"], "ts", opens, "run").drop("_gap", "_same")


def with_next_back(moved: DataFrame) -> DataFrame:
    """moved with the gap from the visit before, and whether that was in the same component."""
    before = moved.where("next_ts IS NOT NULL").select("u", F.col("next_ts").alias("ts"), F.col("gap").alias("_gap"), ((F.col("v") == F.col("next_v")) & (F.col("c_start") == F.col("next_c"))).alias("_same"))
    rows = moved.drop("next_ts", "next_v", "next_c", "gap")
    return rows.join(before, ["u", "ts"], "left")


def degrees(slot: DataFrame, edge: DataFrame) -> DataFrame:
    """v, slot_start, n_in, n_out of every slot."""
    ends = edge.select(F.col("src_v").alias("v"), F.col("src_start").alias("slot_start"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(
        edge.select(F.col("dst_v").alias("v"), F.col("dst_start").alias("slot_start"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    ends = ends.unionAll(slot.select("v", "slot_start", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("v", "slot_start").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def contacts(visits: DataFrame, cell: int = 3_600) -> DataFrame:
    """Pairs of overlapping visits of two visitors at one place: v, a, a_ts, b, b_ts, o_start, o_end, with a < b.

    An equi-join on place and cell of time; a pair comes out in the cell in which its overlap starts.
    visits must be clipped.
    """
    # an overlap starts where a visit does, so no cell after the last start is needed
    last = visits.agg(F.max("ts")).first()[0]
    rows = by_cells(visits.select("u", "v", "ts", "te"), F.col("ts"), F.least(F.col("te"), F.lit((last or 0) + 1)), cell)
    left = rows.select("v", "_cell", F.col("u").alias("a"), F.col("ts").alias("a_ts"), F.col("te").alias("a_te"))
    right = rows.select("v", "_cell", F.col("u").alias("b"), F.col("ts").alias("b_ts"), F.col("te").alias("b_te"))
    both = left.join(right, ["v", "_cell"]).where((F.col("a") < F.col("b")) & overlaps(*[F.col(c) for c in ("a_ts", "a_te", "b_ts", "b_te")]))
    both = both.select("v", "_cell", "a", "a_ts", "b", "b_ts", F.greatest("a_ts", "b_ts").alias("o_start"), F.least("a_te", "b_te").alias("o_end"))
    return both.where(F.floor(F.col("o_start") / F.lit(cell)) == F.col("_cell")).drop("_cell")
