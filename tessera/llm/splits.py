"""Problem 1: splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import connected
from tessera.llm.workspace import Workspace

SPLITS = ("train", "val", "test")
#: Cells of a size class in :func:`fill`.
CELLS = 1 << 10
#: What is persisted from batch to batch.
KEY_TABLE = "key string, unit_id long, split string, state string, n long"


def keys_of(records: DataFrame) -> Column:
    """The keys of a record; one without keys has its own, so that it is a unit by itself."""
    own = F.array(F.concat(F.lit("#"), F.col("record_id").cast("string")))
    keys = F.filter(F.coalesce("keys", F.array().cast("array<string>")), lambda k: k.isNotNull())
    return F.when(F.size(keys) > 0, keys).otherwise(own)


def deliver(spark: SparkSession, units: DataFrame, proportions: dict[str, float] | None, reassign: bool) -> DataFrame:
    """unit_id, n, split, state of units (unit_id, n, splits, quarantined), see :func:`update`."""
    k = F.size("splits")
    clash = F.col("quarantined") | (k > 1)
    state = F.when(clash, "reassigned" if reassign else "quarantined").when(k == 1, F.coalesce("ours", F.lit("kept"))).otherwise("open" if proportions is None else "new")
    u = units.select("unit_id", "n", F.when(~clash & (k == 1), F.col("splits")[0]).alias("split"), state.alias("state"))
    return u if proportions is None else fill(spark, u, proportions)


def fill(spark: SparkSession, units: DataFrame, proportions: dict[str, float]) -> DataFrame:
    """``units`` (unit_id, n, split, state) with a split for those that are new or reassigned.

    Free units are taken from the largest size class (power of two) to the smallest, and within a class in cells of the
    hash of their id; each cell goes as a whole to the split that lacks most, by the sizes of all units that have a split,
    earlier batches included. So one rule places all, a run gives the same splits whatever the order of the rows, and
    every split ends within the largest cell placed last of its share, unless units larger than what it lacks came before.
    Only sums of cells come to the driver, at most 63 classes of ``CELLS`` cells, however many units there are.
    """
    names = [s for s in SPLITS if proportions.get(s, 0) > 0]
    free = F.col("split").isNull() & F.col("state").isin("new", "reassigned")
    u = units.withColumn("free", free).withColumn("size", F.floor(F.log2(F.greatest("n", F.lit(1)))).cast("int")).withColumn("cell", F.pmod(F.xxhash64("unit_id"), F.lit(CELLS)).cast("int"))
    held, cells = dict.fromkeys(names, 0), []
    sums = u.where("free or split is not null").groupBy("split", F.when(F.col("free"), F.col("size")).alias("size"), F.when(F.col("free"), F.col("cell")).alias("cell")).agg(F.sum("n").alias("n"))
    for r in sums.collect():
        if r["split"] is None:
            cells.append((-r["size"], r["cell"], r["n"]))
        elif r["split"] in held:
            held[r["split"]] += r["n"]
    total, whole = sum(held.values()) + sum(n for _, _, n in cells), sum(proportions[s] for s in names)
    lack = {s: proportions[s] / whole * total - held[s] for s in names}
    chosen = []
    for size, cell, n in sorted(cells):
        to = max(names, key=lambda s: (lack[s], -names.index(s)))
        lack[to] -= n
        chosen.append((-size, cell, to))
    to = spark.createDataFrame(chosen, "size int, cell int, to string")
    return u.join(F.broadcast(to), ["size", "cell"], "left").select("unit_id", "n", F.when(F.col("free"), F.col("to")).otherwise(F.col("split")).alias("split"), "state")


def update(
    spark: SparkSession, records: DataFrame, known: DataFrame | None, proportions: dict[str, float] | None, ws: Workspace | None = None, reassign: bool = False, seen: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One batch: (record_id, unit_id, split, state) of its records and the key table (``KEY_TABLE``) to persist for the next.

    ``records``: record_id, keys (array of strings), split. A null record_id is left out, repeated rows of a record count
    once, null keys tie nothing, a record without keys is a unit of its own. ``known``: the key table of the batches
    before, None at first. ``seen``: record_id of earlier batches, whose re-sent records add nothing to the sizes.
    unit_id is the smallest record id of the unit so far, n its size. States:

    - ``kept``: the delivered splits of its records agree; ``new``: it had none and fills the deficit of all batches
      together, or stays ``open`` where ``proportions`` is None; both keep their split in later batches, and a split
      of our own (new, reassigned) is not overruled by what later rows of the unit carry;
    - ``quarantined``: delivered or known splits differ. It has no split, and stays so in later batches with all that is
      merged into it, until a batch with ``reassign`` places it anew as a whole (``reassigned``).

    Method: the graph has one vertex per key of the batch (the key's smallest record) and per known unit, with edges
    between the keys of a record and from a key to its known unit, never pairs of records. Merges are resolved by
    hooking and pointer jumping; keys that the batch does not mention follow their unit. All joins are on record, key or
    unit; a key with a third of all records is combined before its shuffle or split by the skew join.
    """
    ws = ws or Workspace(spark)
    r = records.where("record_id is not null").groupBy("record_id").agg(F.max(F.struct("split", "keys")).alias("r")).select("record_id", "r.split", "r.keys")
    r = r.withColumn("keys", keys_of(r))
    r = r.withColumn("fresh", F.lit(1)) if seen is None else r.join(seen.select("record_id").distinct().withColumn("old", F.lit(1)), "record_id", "left").withColumn("fresh", F.when(F.col("old").isNull(), 1).otherwise(0)).drop("old")
    r = ws.table(r)
    vertex = r.select("record_id", F.explode("keys").alias("key")).groupBy("key").agg(F.min("record_id").alias("vertex"))
    if known is not None:
        vertex = vertex.join(known.select("key", F.col("unit_id").alias("old")), "key", "left")
    vertex = ws.table(vertex)
    ends = r.where(F.size("keys") > 1).select("record_id", F.explode("keys").alias("key")).join(vertex.select("key", "vertex"), "key")
    edges = ends.groupBy("record_id").agg(F.collect_set("vertex").alias("vs")).where(F.size("vs") > 1).select(F.array_min("vs").alias("a"), F.explode("vs").alias("b"))
    if known is not None:
        edges = edges.unionByName(vertex.where("old is not null").select(F.col("vertex").alias("a"), F.col("old").alias("b")))
    tied = connected(edges, ws)
    key_unit = ws.table(vertex.join(tied, vertex["vertex"] == tied["v"], "left").select("key", F.coalesce("head", "vertex").alias("unit_id")))
    members = ws.table(r.select("record_id", "split", "fresh", F.element_at("keys", 1).alias("key")).join(key_unit, "key").select("record_id", "split", "fresh", "unit_id"))
    parts = members.groupBy("unit_id", "split").agg(F.sum("fresh").alias("n")).select("unit_id", "split", "n", F.lit(None).cast("string").alias("was"))
    if known is not None:
        old = known.groupBy("unit_id").agg(F.first("split").alias("split"), F.first("n").alias("n"), F.first("state").alias("was"))
        follow = ws.table(old.join(tied.withColumnRenamed("v", "unit_id"), "unit_id", "left").select(F.col("unit_id").alias("old"), F.coalesce("head", "unit_id").alias("unit_id"), "split", "n", "was"))
        parts = parts.unionByName(follow.drop("old"))
    ours = F.col("was").isin("new", "reassigned")
    units = parts.groupBy("unit_id").agg(
        F.sum("n").alias("n"), F.bool_or(F.coalesce(F.col("was") == "quarantined", F.lit(False))).alias("quarantined"), F.max(F.when(ours, F.col("was"))).alias("ours"),
        F.collect_set("split").alias("all"), F.collect_set(F.when(F.col("was").isNotNull(), F.col("split"))).alias("known"))
    units = units.withColumn("splits", F.array_sort(F.when(F.col("ours").isNotNull(), F.col("known")).otherwise(F.col("all"))))
    done = ws.table(deliver(spark, units, proportions, reassign))
    out = ws.table(members.drop("split", "fresh").join(done.select("unit_id", "split", "state"), "unit_id").select("record_id", "unit_id", "split", "state"))
    keys = key_unit
    if known is not None:
        rest = known.join(key_unit, "key", "left_anti").select("key", F.col("unit_id").alias("old")).join(follow.select("old", "unit_id"), "old")
        keys = keys.unionByName(rest.select("key", "unit_id"))
    table = ws.table(keys.join(done, "unit_id").select("key", "unit_id", "split", "state", "n"))
    ws.drop(r, vertex, key_unit, members, done, *([follow] if known is not None else []))
    return out, table


def assignments(records: DataFrame, known: DataFrame) -> DataFrame:
    """record_id, unit_id, split, state of records by the key table, whatever batch they came in."""
    r = records.where("record_id is not null").groupBy("record_id").agg(F.max("keys").alias("keys"))
    return r.select("record_id", F.element_at(keys_of(r), 1).alias("key")).join(known, "key").select("record_id", "unit_id", "split", "state")


def in_batches(spark: SparkSession, batches: list[DataFrame], proportions: dict[str, float] | None, reassign: bool = False) -> DataFrame:
    """record_id, unit_id, split, state of all records after one :func:`update` per batch, by the key table that is
    written after each and read by the next."""
    ws = Workspace(spark)
    known = seen = None
    for b in batches:
        _, table = update(spark, b, known, proportions, ws, reassign, seen)
        ws.drop(known)
        known = table
        ids = b.select("record_id")
        seen = ids if seen is None else seen.unionByName(ids)
    every = batches[0]
    for b in batches[1:]:
        every = every.unionByName(b)
    return assignments(every, known)
