"""Aggregates that judge identities, tracks and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import GAP_BUCKETS


def dominant(df: DataFrame, keys: list[str], ident: str, order: list[str]) -> DataFrame:
    """keys, ident: the most frequent identity that is not null, the first seen on ties."""
    per = df.where(F.col(ident).isNotNull()).groupBy(*keys, ident).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(F.col("_n").desc(), "_first")
    return per.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, ident)


def reentry_scores(events: DataFrame) -> DataFrame:
    """One row over events (before, after): n, correct, undecided, split, accuracy."""
    right = F.coalesce(F.col("before") == F.col("after"), F.lit(False))
    open_ = F.col("after").isNull()
    return events.agg(
        F.count("*").alias("n"), F.count_if(right).alias("correct"), F.count_if(open_).alias("undecided"), F.count_if(~right & ~open_).alias("split"),
        F.round(F.avg(right.cast("double")), 4).alias("accuracy"))


def gap_bucket(gap: Column) -> Column:
    """Name of the bucket of a gap in frames: [0,30) [30,90) [90,300) [300,900) [900,...)."""
    out = F.when(gap < GAP_BUCKETS[1], f"[{GAP_BUCKETS[0]},{GAP_BUCKETS[1]})")
    for lo, hi in zip(GAP_BUCKETS[1:], GAP_BUCKETS[2:]):
        out = out.when(gap < hi, f"[{lo},{hi})")
    return out.otherwise(f"[{GAP_BUCKETS[-1]},inf)")


def retention(events: DataFrame) -> DataFrame:
    """bucket, n, kept: share of events (gap, correct) with the identity kept; empty buckets give no row."""
    return events.groupBy(gap_bucket(F.col("gap")).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 4).alias("kept"))


def shared_identities(df: DataFrame, ident: str, person: str) -> DataFrame:
    """ident, persons: identities that more than one person holds."""
    return df.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.countDistinct(person).alias("persons")).where("persons > 1")


def duplicate_id_frames(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """keys of the frames in which an identity occurs twice."""
    return df.groupBy(*keys).agg(F.count(ident).alias("_n"), F.countDistinct(ident).alias("_d")).where("_n <> _d").select(*keys)


def identities_per_person(df: DataFrame, person: str, ident: str) -> DataFrame:
    return df.groupBy(person).agg(F.countDistinct(ident).alias("identities"))


def mot_counts(gt: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: gt, pred, matched, misses, false_positives, switches, mota.

    ``gt``, ``pred``: frame_id, id. ``matches``: frame_id, gid, cid. A switch is a match of another prediction than the
    last match of the same person, however long ago.
    """
    w = Window.partitionBy("gid").orderBy("frame_id")
    sw = matches.withColumn("_b", F.lag("cid").over(w)).agg(F.count("*").alias("matched"), F.count_if(F.col("_b") != F.col("cid")).alias("switches"))
    n = gt.agg(F.count("*").alias("gt")).crossJoin(pred.agg(F.count("*").alias("pred"))).crossJoin(sw)
    n = n.withColumn("misses", F.col("gt") - F.col("matched")).withColumn("false_positives", F.col("pred") - F.col("matched"))
    return n.withColumn("mota", F.round(1 - (F.col("misses") + F.col("false_positives") + F.col("switches")) / F.greatest(F.col("gt"), F.lit(1)), 4))


def idf1_dominant(gt: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: idtp, idp, idr, idf1, each person's matches counted for its most frequent prediction only."""
    tp = matches.groupBy("gid", "cid").agg(F.count("*").alias("n")).groupBy("gid").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("idtp"))
    j = tp.crossJoin(gt.agg(F.count("*").alias("g"))).crossJoin(pred.agg(F.count("*").alias("p")))
    idp, idr = F.col("idtp") / F.greatest(F.col("p"), F.lit(1)), F.col("idtp") / F.greatest(F.col("g"), F.lit(1))
    return j.select("idtp", F.round(idp, 4).alias("idp"), F.round(idr, 4).alias("idr"), F.round(F.coalesce(F.try_divide(2 * idp * idr, idp + idr), F.lit(0.0)), 4).alias("idf1"))


def coverage(gt: DataFrame, matches: DataFrame, most: float = 0.8, least: float = 0.2) -> DataFrame:
    """id, frames, hits, grade (mostly_tracked, mostly_lost, partly) of each person."""
    hit = matches.groupBy("gid").agg(F.count("*").alias("hits"))
    c = gt.groupBy("id").agg(F.count("*").alias("frames")).join(hit, F.col("id") == F.col("gid"), "left").select("id", "frames", F.coalesce("hits", F.lit(0)).alias("hits"))
    share = F.col("hits") / F.col("frames")
    return c.withColumn("grade", F.when(share >= most, "mostly_tracked").when(share < least, "mostly_lost").otherwise("partly"))


def merges_and_splits(matches: DataFrame) -> DataFrame:
    """One row: predictions that cover several persons, persons covered by several predictions."""
    m = matches.groupBy("cid").agg(F.countDistinct("gid").alias("n")).agg(F.count_if(F.col("n") > 1).alias("false_merges"))
    return m.crossJoin(matches.groupBy("gid").agg(F.countDistinct("cid").alias("n")).agg(F.count_if(F.col("n") > 1).alias("false_splits")))


def mot_reentries(gt: DataFrame, matches: DataFrame, gap: int = 30) -> DataFrame:
    """id, gone, back, before, after: absences of at least ``gap`` frames whose both ends are matched."""
    w = Window.partitionBy("id").orderBy("frame_id")
    g = gt.withColumn("back", F.lead("frame_id").over(w)).where(F.col("back") - F.col("frame_id") >= gap).select("id", F.col("frame_id").alias("gone"), "back")
    a = matches.select(F.col("gid").alias("id"), F.col("frame_id").alias("gone"), F.col("cid").alias("before"))
    b = matches.select(F.col("gid").alias("id"), F.col("frame_id").alias("back"), F.col("cid").alias("after"))
    return g.join(a, ["id", "gone"]).join(b, ["id", "back"]).select("id", "gone", "back", "before", "after")


def retrieval(pairs: DataFrame, top: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row over (q_id, g_id, hit, sim): queries, mean average precision and rank-k rates.

    Queries without any hit are left out. Equal similarities are ordered by the gallery's id.
    """
    w = Window.partitionBy("q_id").orderBy(F.col("sim").desc(), "g_id")
    h = F.col("hit").cast("int")
    r = pairs.withColumn("k", F.row_number().over(w)).withColumn("hits", F.sum(h).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = r.where("hit").groupBy("q_id").agg(F.avg(F.col("hits") / F.col("k")).alias("ap"), F.min("k").alias("first"))
    return per.agg(F.count("*").alias("queries"), F.round(F.avg("ap"), 4).alias("map"), *[F.round(F.avg((F.col("first") <= k).cast("double")), 4).alias(f"rank{k}") for k in top])


def calibrated(intra: DataFrame, hard: DataFrame, inter: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row of thresholds from similarities (sim) of same, hard same and different people and runner-up gaps (gap)."""
    q = lambda df, c, p, name: df.agg(F.percentile(c, p).alias(name))
    j = q(inter, "sim", F.lit(0.99), "i99").crossJoin(q(hard, "sim", F.array(F.lit(0.25), F.lit(0.02), F.lit(0.1)), "h")).crossJoin(q(gaps, "gap", F.lit(0.75), "g75")).crossJoin(q(intra, "sim", F.lit(0.05), "a05"))
    match = F.least("i99", F.col("h")[0])
    return j.select(
        F.round(match, 4).alias("t_match"), F.round(F.least(F.col("h")[1], match - 0.05), 4).alias("t_new"), F.round(F.coalesce("g75", F.lit(0.10)), 4).alias("margin"),
        F.round(F.col("h")[2], 4).alias("veto"), F.round(1 - F.col("a05"), 4).alias("max_distance"))


def rates_by_threshold(scores: DataFrame, steps: int, low: float, high: float) -> DataFrame:
    """threshold, tpr, tnr over (same, sim).

    Scores are first counted per threshold cell and kind, then summed from above, so the scores are read once and not
    once for every threshold.
    """
    width = (high - low) / (steps - 1)
    cell = F.floor((F.col("sim") - low) / F.lit(width) + F.lit(1e-9)).cast("int")
    per = scores.select("same", F.least(F.greatest(cell, F.lit(-1)), F.lit(steps - 1)).alias("cell")).groupBy("cell").agg(F.count_if("same").alias("pos"), F.count_if(~F.col("same")).alias("neg"))
    every = scores.sparkSession.range(-1, steps).select(F.col("id").cast("int").alias("cell"))
    full = every.join(per, "cell", "left").fillna(0, ["pos", "neg"])
    above = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    r = full.select("cell", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n")).where("cell >= 0")
    return r.select(F.round(F.lit(low) + F.col("cell") * F.lit(width), 6).alias("threshold"), F.try_divide("tp", "p").alias("tpr"), (1 - F.try_divide("fp", "n")).alias("tnr"))


def best_balanced(rates: DataFrame) -> DataFrame:
    """threshold, accuracy: the first threshold of the best mean of both rates."""
    return rates.withColumn("accuracy", F.round((F.col("tpr") + F.col("tnr")) / 2, 6)).orderBy(F.col("accuracy").desc(), "threshold").limit(1).select("threshold", "accuracy")


def operating_points(intra: DataFrame, hard: DataFrame, inter: DataFrame, budgets: list[float]) -> DataFrame:
    """budget, threshold, easy_recall, hard_recall: what each share of false merges buys."""
    q = inter.agg(F.percentile("sim", F.array(*[F.lit(1 - b) for b in budgets])).alias("t"))
    t = q.select(F.posexplode("t").alias("i", "threshold")).withColumn("budget", F.element_at(F.array(*[F.lit(b) for b in budgets]), F.col("i") + 1))
    easy, tough = intra.select("sim", F.lit(True).alias("easy")), hard.select("sim", F.lit(False).alias("easy"))
    j = easy.unionByName(tough).crossJoin(F.broadcast(t))
    at = F.avg((F.col("sim") >= F.col("threshold")).cast("double"))
    r = j.groupBy("budget", "threshold").agg(F.avg(F.when(F.col("easy"), (F.col("sim") >= F.col("threshold")).cast("double"))).alias("e"), F.avg(F.when(~F.col("easy"), (F.col("sim") >= F.col("threshold")).cast("double"))).alias("h"), at.alias("_"))
    return r.select("budget", F.round("threshold", 4).alias("threshold"), F.round("e", 4).alias("easy_recall"), F.round("h", 4).alias("hard_recall"))


def separability(scores: DataFrame) -> DataFrame:
    """One row over (same, sim): difference of the means, and the share of different pairs above the 5th percentile of the same."""
    s, d = scores.where("same"), scores.where(~F.col("same"))
    p5 = s.agg(F.percentile("sim", F.lit(0.05)).alias("p5"), F.avg("sim").alias("ms"))
    return d.crossJoin(F.broadcast(p5)).agg(F.round(F.first("ms") - F.avg("sim"), 6).alias("separation"), F.round(F.avg((F.col("sim") >= F.col("p5")).cast("double")), 6).alias("overlap"))


def verdict(separation: Column, accuracy: Column, n_same: Column, n_other: Column) -> Column:
    """Whether a calibration can be trusted."""
    return (
        F.when((n_same < 50) | (n_other < 50), "insufficient").when((separation < 0.25) | (accuracy < 0.85), "weak").when(separation < 0.35, "fair").otherwise("strong"))


def separation_band(separation: Column) -> Column:
    return F.when(separation < 0.15, "poor").when(separation < 0.25, "marginal").when(separation < 0.35, "usable").otherwise("good")


def frame_sweep(frames: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, hits, misses, false_alarms over (positive, conf): frames without a detection have confidence 0."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")
    c = F.coalesce("conf", F.lit(0.0)) >= F.col("threshold")
    return frames.select("positive", "conf", t).groupBy("threshold").agg(
        F.count_if(F.col("positive") & c).alias("hits"), F.count_if(F.col("positive") & ~c).alias("misses"), F.count_if(~F.col("positive") & c).alias("false_alarms"))


def nearest_point(curve: DataFrame, at: float, positives: Column) -> DataFrame:
    """conf, precision, recall, missed of the curve's point nearest to ``at``; missed is rounded half to even."""
    near = curve.orderBy(F.abs(F.col("conf") - at), "conf").limit(1)
    return near.withColumn("missed", F.bround(positives * (1 - F.col("recall"))).cast("long"))


def promoted(models: DataFrame, most_missed: Column, most_fp: Column, least_map: float = 0.57) -> DataFrame:
    """The model of fewest misses among those that pass all limits."""
    return models.where((F.col("missed") < most_missed) & (F.col("fp") <= most_fp) & (F.col("map") >= least_map)).orderBy("missed", "model").limit(1)


def crop_stats(df: DataFrame, height: str, usable: float = 64) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.percentile(height, F.lit(0.5)).alias("median"), F.percentile(height, F.lit(0.1)).alias("p10"), F.round(F.avg((F.col(height) >= usable).cast("double")), 4).alias("usable"))


def runner_up_gap(sims: DataFrame) -> DataFrame:
    """query_id, gap: best minus second best track, for (query_id, track, sim); a single track has no gap."""
    per = sims.groupBy("query_id", "track").agg(F.max("sim").alias("s"))
    w = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "track")
    return per.withColumn("gap", F.col("s") - F.lead("s").over(w)).withColumn("_k", F.row_number().over(w)).where("_k = 1 AND gap is not null").select("query_id", "gap")


def identity_log(visits: DataFrame, ident: str, frame: str, fps: float) -> DataFrame:
    """ident, visits, re_entries, visible_s and segments from rows with a visit number."""
    per = visits.groupBy(ident, "visit").agg(F.min(frame).alias("enter"), F.max(frame).alias("leave"), F.count("*").alias("frames"))
    return per.groupBy(ident).agg(
        F.count("*").alias("visits"), (F.count("*") - 1).alias("re_entries"), F.round(F.sum("frames") / F.lit(fps), 1).alias("visible_s"),
        F.array_sort(F.collect_list(F.struct("enter", "leave", "frames"))).alias("segments"))


def rollup_alert(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, level, labels, confidence: the highest level of a frame with all labels joined."""
    return df.groupBy(*keys).agg(F.max("level").alias("level"), F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"), F.max("conf").alias("confidence"))


def degenerate(norms: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: the median length of the embeddings, and whether they are broken."""
    m = F.percentile("norm", F.lit(0.5))
    return norms.agg(F.round(m, 6).alias("median"), (m < least).alias("broken"))
