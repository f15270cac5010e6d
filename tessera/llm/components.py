"""Problem 5: groups of records that are linked directly or through others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.workspace import Workspace


def star_edges(members: DataFrame, key: str, record: str) -> DataFrame:
    """Edges a, b from the smallest record of each key to its others: n - 1 for n records, never all pairs.

    A key or record that is null ties nothing; repeated members count once. The smallest record comes from a grouped
    minimum with map-side combine, and a key with a third of all rows is split by the skew join.
    """
    m = members.where(F.col(key).isNotNull() & F.col(record).isNotNull()).select(F.col(key).alias("k"), F.col(record).alias("b"))
    least = m.groupBy("k").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("a < z").drop("z")
    return m.join(least, "k").where("a < b").select("a", "b")


def connected(edges: DataFrame, ws: Workspace, max_rounds: int = 64) -> DataFrame:
    """v, head for every vertex of ``edges`` (a, b): head is the smallest id tied to v directly or through others.

    Null ends and self edges tie nothing; repeated edges count once; no edges give no rows.

    Deterministic Borůvka rounds. Every component selects its smallest outgoing edge by (smaller end, larger end), so
    two components select each other only by the same edge, and the smaller is the root of its tree. Trees collapse by
    pointer doubling, edges are relabelled and made distinct, and the rounds end when none remains. Components at least
    halve in each round. All steps are joins and grouped minima over written tables; nothing comes to the driver but
    numbers of rows.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    e = ws.table(edges.where("a is not null and b is not null and a <> b").select(lo.alias("a"), hi.alias("b")).distinct())
    label = None
    for _ in range(max_rounds):
        if not e.count():
            break
        half = e.select(F.col("a").alias("c"), F.col("b").alias("o")).unionAll(e.select("b", "a"))
        # The smallest edge of c by (smaller end, larger end) goes to its smallest neighbour.
        up = ws.table(half.groupBy("c").agg(F.min("o").alias("p")))
        first = True
        while True:
            x, y = up.alias("x"), up.alias("y")
            jump = F.col("y.p")
            if first:
                jump = F.when(F.col("y.p") == F.col("x.c"), F.least("x.c", "x.p")).otherwise(jump)
            nxt = ws.table(x.join(y, F.col("x.p") == F.col("y.c")).select("x.c", jump.alias("p"), (jump != F.col("x.p")).alias("moved")))
            moved = first or nxt.where("moved").limit(1).count() > 0
            ws.drop(up)
            up, first = nxt, False
            if not moved:
                break
        to = up.select("c", "p")
        if label is None:
            new_label = to.select(F.col("c").alias("v"), F.col("p").alias("r"))
        else:
            new_label = label.join(to, F.col("r") == F.col("c"), "left").select("v", F.coalesce("p", "r").alias("r"))
        new_label = ws.table(new_label)
        s, t = to.select(F.col("c").alias("a"), F.col("p").alias("pa")), to.select(F.col("c").alias("b"), F.col("p").alias("pb"))
        moved_e = e.join(s, "a").join(t, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        new_e = ws.table(moved_e)
        ws.drop(e, label, up)
        e, label = new_e, new_label
    else:
        raise RuntimeError(f"edges remain after {max_rounds} rounds")
    if label is None:
        return e.select(F.col("a").alias("v"), F.col("b").alias("head"))
    head = label.groupBy("r").agg(F.min("v").alias("head"))
    return ws.table(label.join(head, "r").select("v", "head"))


def tied_pairs(pairs: DataFrame, left: Column, right: Column, records: DataFrame) -> DataFrame:
    """Edges a, b between the records whose names are ``left`` and ``right``.

    ``records``: name, id. A null end, or one that names no record, ties nothing; a name that several records share
    means the smallest.
    """
    named = records.where("name is not null and id is not null").groupBy("name").agg(F.min("id").alias("id"))
    ends = pairs.select(left.alias("l"), right.alias("r")).where("l is not null and r is not null and l <> r").distinct()
    a, b = named.select(F.col("name").alias("l"), F.col("id").alias("a")), named.select(F.col("name").alias("r"), F.col("id").alias("b"))
    return ends.join(a, "l").join(b, "r").select("a", "b")
