"""Problem 6: samples with wanted category proportions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.workspace import Workspace

CELLS = 1 << 12


def majority(counts: list[tuple[str, Column]], none: str | None) -> Column:
    """Name of the largest count, the first on ties; ``none`` where all are 0. Null and negative counts are 0."""
    n = [F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for _, c in counts]
    best = F.greatest(*n)
    out = F.when(best <= 0, F.lit(none))
    for (name, _), c in zip(counts, n):
        out = out.when(c == best, F.lit(name))
    return out


def category_of_picture(labels: str, classes: list[str], negative: str) -> Column:
    """Class with most boxes; ``negative`` for an empty list; null for a null list or stray boxes only."""
    boxes = F.col(labels)

    def count(i: int) -> Column:
        return F.size(F.filter(boxes, lambda b: b["cls"] == i))

    per = [(name, count(i)) for i, name in enumerate(classes)]
    return F.when(boxes.isNull(), F.lit(None)).when(F.size(boxes) == 0, F.lit(negative)).otherwise(majority(per, None))


def observed(records: DataFrame) -> DataFrame:
    """category, seen: records of each category, null categories left out."""
    return records.where("category is not null").groupBy("category").agg(F.count("*").alias("seen"))


def wanted(plan: DataFrame, seen: DataFrame) -> DataFrame:
    """Plan rows with what they want, find and lack, and the acceptance probability of their category."""
    need = F.greatest(F.coalesce(F.col("min_rows"), F.lit(0)), F.round(F.coalesce(F.col("share") * F.col("sample_size"), F.lit(0.0))).cast("long"))
    rows = plan.where("category is not null").withColumn("need", need).groupBy("plan_id", "category").agg(F.max("need").alias("need"))
    rows = rows.join(seen, "category", "left").withColumn("seen", F.coalesce("seen", F.lit(0)).cast("long"))
    take = F.least("need", "seen")
    # Six standard deviations above the wanted number, so that a second look at the table is hardly ever needed.
    p = F.when(F.col("seen") > 0, F.least(F.lit(1.0), (take + 6 * F.sqrt(take) + 10) / F.col("seen"))).otherwise(F.lit(0.0))
    return rows.withColumn("take", take).withColumn("lacking", F.col("need") - take).withColumn("p", p)


RANGE = 1 << 40


def draw_of(c: Column) -> Column:
    """A number below 2^40, the first ten digits of an MD5 sum, so that other engines draw the same."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 10), 16, 10).cast("long")


def _goal(plan: DataFrame, records: DataFrame, ws: Workspace) -> DataFrame:
    return ws.table(wanted(plan, observed(records)))


def proportional_sample(plan: DataFrame, records: DataFrame, seed: int = 0, ws: Workspace | None = None, goal: DataFrame | None = None) -> DataFrame:
    """plan_id, category, record_id: exactly min(need, seen) records of every plan row.

    ``records``: record_id, category, one row per record. ``plan``: plan_id, category, share, min_rows, sample_size;
    a null share, size or minimum counts as 0, repeated plan rows count once with the largest need, a plan row with a
    null category is left out.

    A record's draw for a plan is its own number plus that of plan and seed, modulo 2^40. The record is accepted where
    the draw lies below the probability of its category, which is the ratio of wanted to observed, slightly raised. What
    is accepted is written once, and the surplus is cut exactly: accepted records are counted in cells of the draw, whole
    cells below the cut are kept, and only the cell in which it falls is ranked, so that no task sorts a category. Should
    a category have too few accepted, it is drawn again with probability one. So the sample is that of the smallest draws.
    """
    ws = ws or Workspace(records.sparkSession)
    goal = goal if goal is not None else _goal(plan, records, ws)
    start = draw_of(F.concat_ws("/", F.lit("plan"), F.col("plan_id").cast("string"), F.lit(str(seed))))
    goal = goal.where("take > 0").select("plan_id", F.col("category").alias("c"), "take", "p", start.alias("start"))
    r = records.where("category is not null").select("record_id", "category", draw_of(F.col("record_id")).alias("own"))

    def accepted(goal: DataFrame) -> DataFrame:
        u = (F.col("own") + F.col("start")) % F.lit(RANGE)
        j = r.join(goal, (F.col("category") == F.col("c")) & (u < F.ceil(F.col("p") * RANGE)))
        return j.select("plan_id", "category", "record_id", u.alias("u"), F.floor(u / (F.col("p") * F.lit(RANGE / CELLS))).alias("cell"), "take")

    drawn = ws.table(accepted(goal))
    got = drawn.groupBy("plan_id", F.col("category").alias("c")).agg(F.count("*").alias("got"))
    short = ws.table(goal.join(got, ["plan_id", "c"], "left").where(F.coalesce("got", F.lit(0)) < F.col("take")).drop("got"))
    if short.count():
        again = accepted(short.withColumn("p", F.lit(1.0)))
        drawn = ws.table(drawn.join(short.select("plan_id", F.col("c").alias("category")), ["plan_id", "category"], "left_anti").unionByName(again))
    by_cell = drawn.groupBy("plan_id", "category", "cell").agg(F.count("*").alias("n"), F.first("take").alias("take"))
    w = Window.partitionBy("plan_id", "category").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    by_cell = ws.table(by_cell.withColumn("upto", F.sum("n").over(w)).withColumn("room", F.col("take") - (F.col("upto") - F.col("n"))).where("room > 0").drop("take"))
    kept = drawn.select("plan_id", "category", "record_id", "u", "cell").join(by_cell, ["plan_id", "category", "cell"])
    whole = kept.where("n <= room")
    cut = kept.where("n > room").withColumn("k", F.row_number().over(Window.partitionBy("plan_id", "category", "cell").orderBy("u", "record_id"))).where("k <= room")
    return whole.unionByName(cut.drop("k")).select("plan_id", "category", "record_id")


def sample_report(plan: DataFrame, records: DataFrame, seed: int = 0, ws: Workspace | None = None) -> DataFrame:
    """plan_id, category, need, drawn, lacking, wanted_share, drawn_share of every plan row, from the sample drawn.

    need is the larger of the minimum and share times size. A plan row that can't be met lacks the rest; neither its rest
    nor what minima add is taken from other categories, so drawn_share tells how far the sample is from wanted_share.
    """
    ws = ws or Workspace(records.sparkSession)
    goal = _goal(plan, records, ws)
    share = plan.where("category is not null").groupBy("plan_id", "category").agg(F.max(F.coalesce("share", F.lit(0.0))).alias("wanted_share"))
    got = proportional_sample(plan, records, seed, ws, goal).groupBy("plan_id", "category").agg(F.count("*").alias("drawn"))
    rows = goal.join(share, ["plan_id", "category"]).join(got, ["plan_id", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)).cast("long"))
    total = F.sum("drawn").over(Window.partitionBy("plan_id"))
    return rows.select("plan_id", "category", "need", "drawn", (F.col("need") - F.col("drawn")).alias("lacking"), "wanted_share", F.when(total > 0, F.col("drawn") / total).alias("drawn_share"))
