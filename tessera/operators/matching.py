"""Joins that match rows within a frame, over time or by likeness.

Every one has an equality key (frame, clip, cell, band), so that it is a hash or merge join with a residual condition and
never a nested loop over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import ASSOCIATION, Association
from tessera.functions.geometry import Box, containment, iou, iou_clamped, landmark
from tessera.operators.gates import WRISTS, near_points
from tessera.operators.ordered import DAY_US, with_previous

BOX = ("x1", "y1", "x2", "y2")


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keep])


def best_overlap(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, above: float = 0.5) -> DataFrame:
    """key, l_<left_id>, r_<right_id>, iou: for each left box the right one of most overlap, if that is above ``above``.

    The first right box, by id, wins ties. Several left boxes may take one right box.
    """
    j = prefixed(left, "l_", [key]).join(prefixed(right, "r_", [key]), key).withColumn("iou", iou(Box.of("l_"), Box.of("r_"))).where(F.col("iou") > above)
    w = Window.partitionBy(key, f"l_{left_id}").orderBy(F.col("iou").desc(), f"r_{right_id}")
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, f"l_{left_id}", f"r_{right_id}", "iou")


def tiered_association(candidates: DataFrame, people: DataFrame, p: Association = ASSOCIATION) -> DataFrame:
    """frame_id, cand_id, person, method, score: the person who holds each candidate; unmatched ones are left out.

    ``candidates``: frame_id, cand_id and a box; ``people``: frame_id, person, pos (order in the frame), kp and a box;
    people without identity (null person) take no part. A candidate near a wrist goes to the first such person. Else the
    score is the contained share where that reaches its threshold, or the overlap where that does, the highest wins, and
    the first person on ties.
    """
    c, q = Box.of("c_"), Box.of("p_")
    # Wrists are taken out of the landmarks before the join, so that pairs carry four numbers and no map.
    wrists = [landmark(F.col("kp"), i)[k].alias(f"{k}{i}") for i in WRISTS for k in ("x", "y")]
    holders = people.where("person is not null").select("frame_id", "person", "pos", *BOX, *wrists)
    j = prefixed(candidates.select("frame_id", "cand_id", *BOX), "c_", ["frame_id"]).join(prefixed(holders, "p_", ["frame_id"]), "frame_id")
    near = near_points(c, [(F.col(f"p_x{i}"), F.col(f"p_y{i}")) for i in WRISTS], p.wrist_radius)
    j = j.withColumn("wrist", near).withColumn("part", containment(c, q)).withColumn("over", iou_clamped(c, q))
    method = F.when(F.col("wrist"), "wrist").when(F.col("part") >= p.containment, "containment").when(F.col("over") >= p.iou, "iou")
    score = F.when(F.col("wrist"), F.lit(1.0)).when(F.col("part") >= p.containment, F.col("part")).when(F.col("over") >= p.iou, F.col("over"))
    j = j.withColumn("method", method).withColumn("score", score).where("method is not null")
    w = Window.partitionBy("frame_id", "c_cand_id").orderBy(F.col("wrist").desc(), F.when(F.col("wrist"), F.lit(0.0)).otherwise(-F.col("score")), "p_pos")
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("frame_id", F.col("c_cand_id").alias("cand_id"), F.col("p_person").alias("person"), "method", "score")


def attached(candidates: DataFrame, people: DataFrame, p: Association = ASSOCIATION) -> DataFrame:
    """The candidates that touch any person of their frame."""
    q = people.select(F.col("frame_id").alias("_f"), *[F.col(c).alias(f"_p_{c}") for c in BOX])
    a, b = Box.of(), Box.of("_p_")
    return candidates.join(q, (F.col("frame_id") == F.col("_f")) & ((iou_clamped(a, b) >= p.iou) | (containment(a, b) >= p.containment)), "left_semi")


def unmatched(rows: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(taken.select(*keys), keys, "left_anti")


def same_frame_negatives(rows: DataFrame, clip: str, frame: str, ident: str) -> DataFrame:
    """a, b: rows of one frame with different identities, smaller first: two people for certain."""
    a = rows.select(clip, frame, F.col(ident).alias("a"), F.col("feat").alias("a_feat"))
    b = rows.select(clip, frame, F.col(ident).alias("b"), F.col("feat").alias("b_feat"))
    return a.join(b, [clip, frame]).where("a < b")


def same_identity_likeness(rows: DataFrame, ident: str, frame: str, long_gap: int = 30) -> DataFrame:
    """ident, is_long, n, total: number and summed likeness of all pairs of one identity, by whether the later frame is
    ``long_gap`` or more behind the earlier one; pairs of one frame don't count.

    The likeness of a vector to all earlier ones is its product with their sum, so running sums per dimension replace
    the pairs: the work is that of the rows, and an identity is spread over its dimensions.
    """
    x = rows.where(F.col(ident).isNotNull() & F.col(frame).isNotNull()).select(F.col(ident).alias("_i"), F.col(frame).cast("long").alias("_f"), F.posexplode(F.col("feat").cast("array<double>")).alias("_d", "_x"))
    w = Window.partitionBy("_i", "_d").orderBy("_f")
    far, all_ = w.rangeBetween(Window.unboundedPreceding, -long_gap), w.rangeBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    x = x.select("_i", "_d", "_x", zero(F.sum("_x").over(far)).alias("far"), zero(F.sum("_x").over(all_)).alias("all"), F.count("*").over(far).alias("nf"), F.count("*").over(all_).alias("na"))
    first = F.col("_d") == 0
    per = x.groupBy("_i").agg(F.sum(F.col("_x") * F.col("far")).alias("tf"), F.sum(F.col("_x") * F.col("all")).alias("ta"), F.sum(F.when(first, F.col("nf")).otherwise(0)).alias("nf"), F.sum(F.when(first, F.col("na")).otherwise(0)).alias("na"))
    both = F.array(F.struct(F.lit(True).alias("is_long"), F.col("nf").alias("n"), F.col("tf").alias("total")), F.struct(F.lit(False).alias("is_long"), (F.col("na") - F.col("nf")).alias("n"), (F.col("ta") - F.col("tf")).alias("total")))
    return per.select(F.col("_i").alias(ident), F.inline(both)).where("n > 0")


def apart_samples(queries: DataFrame, gallery: DataFrame, ident: str, frame: str, gap: int = 30, least: int = 3) -> DataFrame:
    """query_id, n: how many of the identity's gallery samples lie at least ``gap`` frames from the query, where there are ``least``."""
    g = gallery.select(F.col(ident).alias("_i"), F.col(frame).alias("_f"))
    j = queries.join(g, (F.col(ident) == F.col("_i")) & (F.abs(F.col(frame) - F.col("_f")) >= gap))
    return j.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def without_junk(pairs: DataFrame) -> DataFrame:
    """Pairs of query and gallery without distractors and without the query's own person on its own camera."""
    return pairs.where((F.col("g_pid") != -1) & ~((F.col("q_pid") == F.col("g_pid")) & (F.col("q_cam") == F.col("g_cam"))))


def as_of(events: DataFrame, timeline: DataFrame, event_id: str, clip: str, at: str, reach: int, side: str) -> DataFrame:
    """event_id, frame: for each event the nearest frame of the timeline on one side with a decided identity.

    ``side`` is "before" (at most ``reach`` frames back, the event's own included) or "after". Clips are cut into cells
    of ``reach`` frames; within a cell a running extreme over events and frames finds the nearest one, and the next cell
    gives its outermost frame where there is none. So events and frames are sorted together, cell by cell, and never
    joined in pairs; a long clip is spread over its cells.
    """
    back = side == "before"
    t = timeline.where("ident is not null").select(F.col(clip).alias("_c"), F.col("frame_id").alias("_f")).distinct().withColumn("_k", F.floor(F.col("_f") / reach))
    e = events.select(F.col(clip).alias("_c"), F.floor(F.col(at) / reach).alias("_k"), F.col(at).alias("_at"), F.col(event_id).alias("_e"), F.lit(None).cast("long").alias("_f"))
    both = e.unionByName(t.select("_c", "_k", F.col("_f").alias("_at"), F.lit(None).cast(e.schema["_e"].dataType).alias("_e"), "_f"))
    order = [F.col("_at") if back else F.col("_at").desc(), F.col("_f").isNull()]
    w = Window.partitionBy("_c", "_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_own", F.max("_f").over(w) if back else F.min("_f").over(w)).where("_e is not null")
    outer = t.groupBy("_c", (F.col("_k") + (1 if back else -1)).alias("_k")).agg((F.max("_f") if back else F.min("_f")).alias("_outer"))
    near = own.join(outer, ["_c", "_k"], "left").withColumn("frame", F.coalesce("_own", "_outer"))
    return near.where(F.abs(F.col("_at") - F.col("frame")) <= reach).select(F.col("_e").alias(event_id), "frame")


def exit_return_pairs(marks: DataFrame, key: str, order: list[str], cell: int = DAY_US) -> DataFrame:
    """key, exit_at, return_at: each return with the exit right before it.

    A repeated exit replaces the one before, a return ends the search, what stays alone is left out; so a pair is a
    return whose preceding mark is an exit.
    """
    m = with_previous(marks.where("mark is not null"), [key], order, ["mark", order[0]], cell)
    return m.where("mark = 'return' AND prev_mark = 'exit'").select(key, F.col(f"prev_{order[0]}").alias("exit_at"), F.col(order[0]).alias("return_at"))


def last_known(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """``out``: the most recent earlier value that is not null."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def plausible(gap_s: Column, dist: Column, jump: float = 200.0, speed: float = 800.0, check_gap_s: float = 3.0) -> Column:
    """Whether a person can have moved ``dist`` in ``gap_s``; true where nothing is known or the gap is long."""
    return F.coalesce((F.greatest(gap_s, F.lit(0.0)) > check_gap_s) | (dist <= F.lit(jump) + F.lit(speed) * F.greatest(gap_s, F.lit(0.0))), F.lit(True))


def _in_blocks(df: DataFrame, key: str, columns: list[str], block: int, name: str) -> tuple[DataFrame, int]:
    """``df`` in rows of about ``block`` rows each, as parallel arrays, vectors one after the other."""
    rows = df.where(F.col("feat").isNotNull() & F.col(key).isNotNull())
    n = max(1, -(-rows.count() // block))
    got = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(name))
    return got.agg(*[F.collect_list(F.coalesce(c, F.lit(-1).cast("long"))).alias(c) for c in columns], F.flatten(F.collect_list(F.col("feat").cast("array<double>"))).alias(f"{name}_feat")), n


def pair_scores(queries: DataFrame, gallery: DataFrame, block: int = 1024, places: int = 6, best: bool = False) -> DataFrame:
    """q_id, q_pid, q_cam, g_id, g_pid, g_cam, sim of a stated set of queries against all rows of the gallery; with
    ``best`` only the most alike row of each query and g_pid (q_id, q_pid, g_pid, sim), reduced within each block.

    Queries (q_id, q_pid, q_cam, feat) and gallery rows (g_id, g_pid, g_cam, feat) are put into blocks of about
    ``block`` rows by a hash of their id, and every query block meets every gallery block by its number: a row of the
    join holds two bounded blocks and is one matrix product. Rows without id or vector are left out; a null person or
    camera is -1. Only the two numbers of rows come to the driver.
    """
    import numpy as np
    import pyarrow as pa

    q, _ = _in_blocks(queries, "q_id", ["q_id", "q_pid", "q_cam"], block, "q")
    g, n = _in_blocks(gallery, "g_id", ["g_id", "g_pid", "g_cam"], block, "g")
    met = q.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(g, "g").select("q_id", "q_pid", "q_cam", "q_feat", "g_id", "g_pid", "g_cam", "g_feat")
    names = ["q_id", "q_pid", "g_pid", "sim"] if best else ["q_id", "q_pid", "q_cam", "g_id", "g_pid", "g_cam", "sim"]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                x = {name: b.column(c)[k].values.to_numpy() for c, name in enumerate(b.schema.names)}
                a, z = len(x["q_id"]), len(x["g_id"])
                sims = np.round(x["q_feat"].reshape(a, -1) @ x["g_feat"].reshape(z, -1).T, places)
                if best:
                    who, inverse = np.unique(x["g_pid"], return_inverse=True)
                    order = np.argsort(inverse, kind="stable")
                    top = np.maximum.reduceat(sims[:, order], np.flatnonzero(np.diff(inverse[order], prepend=-1)), axis=1)
                    out = [np.repeat(x["q_id"], len(who)), np.repeat(x["q_pid"], len(who)), np.tile(who, a), top.reshape(-1)]
                else:
                    out = [np.repeat(x[c], z) for c in ("q_id", "q_pid", "q_cam")] + [np.tile(x[c], a) for c in ("g_id", "g_pid", "g_cam")] + [sims.reshape(-1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)

    got = met.mapInArrow(run, ", ".join(f"{c} {'double' if c == 'sim' else 'long'}" for c in names))
    return got.groupBy("q_id", "q_pid", "g_pid").agg(F.max("sim").alias("sim")) if best else got


def evicted(df: DataFrame, ident: str, last_seen: str, active: str, capacity: int, cells: int = 1 << 10) -> DataFrame:
    """The identities that leave when only ``capacity`` may stay: absent ones, seen longest ago first, then by identity.

    Of n identities n - ``capacity`` must go, or all absent ones if they are fewer. Absent identities are counted in
    ``cells`` equal stretches of time; cells before the cut leave as a whole, and only the cell in which it falls is
    ranked, so no task sorts them all.
    """
    ends = df.agg(F.count("*").alias("_n"), F.min(last_seen).alias("_a"), F.max(last_seen).alias("_z"))
    step = F.greatest((F.col("_z") - F.col("_a")) / F.lit(cells), F.lit(1.0))
    rows = df.where(~F.col(active)).join(F.broadcast(ends)).withColumn("_cell", F.floor((F.col(last_seen) - F.col("_a")) / step))
    w = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    per = rows.groupBy("_cell").agg(F.count("*").alias("_m"), F.first("_n").alias("_all")).withColumn("_room", F.col("_all") - F.lit(capacity) - F.sum("_m").over(w) + F.col("_m")).where("_room > 0")
    kept = rows.join(F.broadcast(per.select("_cell", "_m", "_room")), "_cell")
    cut = kept.where("_m > _room").withColumn("_r", F.row_number().over(Window.partitionBy("_cell").orderBy(last_seen, ident))).where("_r <= _room")
    return kept.where("_m <= _room").select(*df.columns).unionByName(cut.select(*df.columns))
