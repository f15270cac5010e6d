"""Building and checking a picture data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.hamming import near_patterns, nearest_patterns
from tessera.sources.workspace import Workspace

BACKGROUND, DROP = "__background__", "__drop__"


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")


def build_key(source: Column, stem_: Column) -> Column:
    """Name of the original within its source, without the exporter's mark."""
    return F.concat(source, F.lit(":"), F.regexp_replace(stem_, r"\.rf\.[0-9a-f]+$", ""))


def clip_key(stem_: Column, pattern: str) -> Column:
    """The clip a frame was cut from, or null."""
    found = F.regexp_extract(F.lower(F.regexp_replace(stem_, r"_jpg\.rf\.[0-9a-f]+$", "")), pattern, 1)
    return F.when(found != "", found)


def mapped(labels: DataFrame, class_map: DataFrame) -> DataFrame:
    """Labels (source, class, ...) with their target; exact case-sensitive names; unknown ones have target null."""
    return labels.join(class_map.select("source", F.col("src_class").alias("class"), "target"), ["source", "class"], "left")


def unmapped(labels: DataFrame, class_map: DataFrame) -> DataFrame:
    """source, class, n of the labels that the map does not know: an error, not something to skip."""
    return labels.join(class_map.select("source", F.col("src_class").alias("class")), ["source", "class"], "left_anti").groupBy("source", "class").agg(F.count("*").alias("n"))


def require_mapped(labels: DataFrame, class_map: DataFrame, strict: bool = True) -> DataFrame:
    """The mapped labels; with ``strict`` a job that reads an unmapped one fails, else those rows are left out."""
    m = mapped(labels, class_map)
    if not strict:
        return m.where("target is not null")
    return m.withColumn("target", F.when(F.col("target").isNull(), F.raise_error(F.concat(F.lit("unmapped class "), F.col("source"), F.lit("/"), F.col("class")))).otherwise(F.col("target")))


def forbidden(class_map: DataFrame, person_level: list[str], weapon: list[str]) -> DataFrame:
    """Rows that map a class of whole persons to a weapon."""
    return class_map.where(F.col("src_class").isin(person_level) & F.col("target").isin(weapon))


def harmonise(images: DataFrame, labels: DataFrame) -> DataFrame:
    """image_id, verdict: positive, negative, discarded or dropped.

    ``images``: image_id, explicit_empty (an empty label file, which is not the same as none). ``labels``: image_id,
    target. Kept labels decide first, then any to drop, then any background, then the empty file.
    """
    per = labels.groupBy("image_id").agg(
        F.bool_or(~F.col("target").isin(BACKGROUND, DROP)).alias("kept"), F.bool_or(F.col("target") == DROP).alias("drop"), F.bool_or(F.col("target") == BACKGROUND).alias("bg"))
    j = images.join(per, "image_id", "left")
    no = F.lit(False)
    return j.select("image_id", F.when(F.coalesce("kept", no), "positive").when(F.coalesce("drop", no), "discarded").when(F.coalesce("bg", no), "negative")
                    .when(F.coalesce("explicit_empty", no), "negative").otherwise("dropped").alias("verdict"))


def near_pairs(rows: DataFrame, key: str, bits: str, most: int) -> DataFrame:
    """a, b (a < b): edges that tie all rows whose 64-bit patterns differ in at most ``most`` (up to 6) bits.

    A pattern stands for all its rows: equal patterns are tied by a star around their smallest key, near ones by their
    smallest keys, so copies make as many edges as rows and never all pairs. No link between different patterns is lost.
    """
    held = rows.where(F.col(bits).isNotNull()).select(F.col(key).alias("k"), F.col(bits).alias("bits"))
    least = held.groupBy("bits").agg(F.min("k").alias("first"))
    star = held.join(least, "bits").where("k > first").select(F.col("first").alias("a"), F.col("k").alias("b"))
    met = near_patterns(least, least, most).where("left_bits < right_bits")
    x, y = least.select(F.col("bits").alias("left_bits"), F.col("first").alias("x")), least.select(F.col("bits").alias("right_bits"), F.col("first").alias("y"))
    between = met.join(x, "left_bits").join(y, "right_bits").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return star.unionByName(between).distinct()


def group_edges(rows: DataFrame, key: str, bits: str, name: str, most: int) -> DataFrame:
    """Edges a, b between near-duplicates and between rows of one name; a name ties its rows to the smallest."""
    first = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(key).alias("a"))
    named = rows.select(name, F.col(key).alias("b")).join(first, name).where("a < b").select("a", "b")
    return near_pairs(rows, key, bits, most).unionByName(named).distinct()


def components(edges: DataFrame, cut, rounds: int = 50) -> DataFrame:
    """id, root of every vertex: the smallest id that is tied to it.

    Labels start as the smallest neighbour and are replaced by the smallest label around and by the label's own label,
    so that chains shrink by half a round. ``cut`` writes a frame and reads it back, see ``sources.tables``.
    """
    both = cut(edges.select("a", "b").unionAll(edges.select("b", "a")).where("a <> b").distinct())
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")))
    for _ in range(rounds):
        other = label.select(F.col("id").alias("b"), F.col("root").alias("other"))
        around = both.join(other, "b").groupBy("a").agg(F.min("other").alias("low"))
        low = label.join(around, F.col("id") == F.col("a")).select("id", "root", F.least("root", "low").alias("low"))
        jump = label.select(F.col("id").alias("j"), F.col("root").alias("up"))
        nxt = cut(low.join(jump, F.col("low") == F.col("j"), "left").select("id", F.least("low", F.coalesce("up", "low")).alias("root"), (F.least("low", F.coalesce("up", "low")) < F.col("root")).alias("moved")))
        moved = nxt.where("moved").limit(1).count()
        label = nxt.select("id", "root")
        if not moved:
            return label
    raise RuntimeError(f"labels still move after {rounds} rounds")


def group_counts(rows: DataFrame) -> DataFrame:
    """group_id, n, n_sources, background and one row's count per class, from group_id, source, bg, cls (array)."""
    base = rows.groupBy("group_id").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.count_if("bg").alias("background"))
    per = rows.select("group_id", F.explode("cls").alias("c")).groupBy("group_id").agg(*[F.count_if(F.col("c") == i).alias(f"class_{i}") for i in range(3)])
    return base.join(per, "group_id", "left").fillna(0, [f"class_{i}" for i in range(3)])


def choose_holdout(groups: DataFrame, share: float, classes: list[str], seed: int = 0) -> DataFrame:
    """group_id, split: whole groups held out until every class reaches its share.

    In hash order, a group that has any class whose target is reached is skipped. The rule is one ordered fold, as each
    choice depends on all before it; groups enter it as counts, in one task, which holds one row per group.
    """
    totals = groups.agg(*[F.sum(c).alias(c) for c in classes]).first()
    target = {c: round((totals[c] or 0) * share) for c in classes}

    def fold(batches):
        have = dict.fromkeys(classes, 0)
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                done = all(have[c] >= target[c] for c in classes)
                take = not done and not any(have[c] >= target[c] and row[c] > 0 for c in classes)
                if take:
                    for c in classes:
                        have[c] += row[c]
                out.append("val" if take else "train")
            yield b[["group_id"]].assign(split=out)

    order = groups.select("group_id", *classes).withColumn("h", shuffled(F.col("group_id"), seed)).repartition(1).sortWithinPartitions("h", "group_id").drop("h")
    return order.mapInPandas(fold, "group_id long, split string")


def forced_holdout(clips: DataFrame, named: list[str]) -> DataFrame:
    """group_id of the groups that hold one of the named clips."""
    return clips.where(F.col("clip").isin(named)).select("group_id").distinct()


def nearest_across(val: DataFrame, train: DataFrame, key: str, bits: str) -> DataFrame:
    """val_id, best: for each held-out row the least number of differing bits to any training row; none without training rows."""
    v = Workspace(val.sparkSession).table(val.where(F.col(bits).isNotNull()).select(F.col(key).alias("val_id"), F.col(bits).alias("bits")))
    best = nearest_patterns(v, train.select(F.col(bits).alias("bits")))
    return v.join(best, F.col("bits") == F.col("left_bits")).select("val_id", "best")


def leakage_gate(nearest: DataFrame, limits: tuple[int, ...] = (4, 6, 10)) -> DataFrame:
    """max_bits, leaks, failed per limit."""
    limit = F.explode(F.array(*[F.lit(x) for x in limits])).alias("max_bits")
    per = nearest.select(limit, "best").groupBy("max_bits").agg(F.count_if(F.col("best") <= F.col("max_bits")).alias("leaks"))
    every = nearest.sparkSession.createDataFrame([(x,) for x in limits], "max_bits int")
    return every.join(per, "max_bits", "left").select("max_bits", F.coalesce("leaks", F.lit(0)).cast("long").alias("leaks"), (F.coalesce("leaks", F.lit(0)) > 0).alias("failed"))


def split_manifest(rows: DataFrame) -> DataFrame:
    """split, source, n rows and n groups."""
    return rows.groupBy("split", "source").agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("n_groups"))


def shuffled(key: Column, seed: int) -> Column:
    """What rows are ordered by to be in random order: an MD5 sum, so that other engines have the same order."""
    return F.md5(F.concat_ws("/", key.cast("string"), F.lit(str(seed))).cast("binary"))


def keep_random(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same whatever the order of the rows."""
    return df.orderBy(shuffled(F.col(key), seed), key).limit(n)


def last_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
