"""Queries of the nine problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import canonical, components, encode, keys, leak, overlap, quota, runs, spam, splits
from tessera.llm.workspace import Workspace

PROPORTIONS = {"train": 0.8, "val": 0.1, "test": 0.1}
CLASSES = ["guns", "knife", "long_gun"]
NEGATIVE = "__background__"


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _image_units(spark: SparkSession, d: str) -> DataFrame:
    key = keys.source_key(F.col("src"))
    arr = F.when(key.isNotNull(), F.array(key))
    return _read(spark, d, "build_dataset").select(F.col("image_id").alias("record_id"), keys.split_key(F.col("split")).alias("split"), arr.alias("keys"), F.col("ingested_at").alias("at"))


def _group_units(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "resplit_dataset").select(F.col("group_id").alias("record_id"), keys.split_key(F.col("split")).alias("split"), keys.clip_keys(F.col("clips")).alias("keys"), F.col("built_at").alias("at"))


def _in_halves(spark: SparkSession, records: DataFrame, proportions: dict[str, float] | None, reassign: bool = False) -> DataFrame:
    """Units after two batches: what came in the first half of the time, or at no known time, and the rest."""
    records = Workspace(spark).table(records)
    ends = records.agg(F.min("at").alias("a"), F.max("at").alias("z")).first()
    if ends["a"] is None:
        return splits.in_batches(spark, [records.drop("at")], proportions, reassign)
    first = F.coalesce(F.col("at") <= F.lit(ends["a"] + (ends["z"] - ends["a"]) / 2), F.lit(True))
    return splits.in_batches(spark, [records.where(first).drop("at"), records.where(~first).drop("at")], proportions, reassign)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose source or tied set stands in several splits as delivered: the quarantined merges after two batches."""
    out = None
    for kind, records in (("image", _image_units(spark, d)), ("group", _group_units(spark, d))):
        got = _in_halves(spark, records, None).where("state = 'quarantined'").select(F.lit(kind).alias("kind"), "record_id", "unit_id")
        out = got if out is None else out.unionByName(got)
    return out


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every record's split with whole units after two batches; units that were spread are placed anew."""
    out = None
    for kind, records in (("image", _image_units(spark, d)), ("group", _group_units(spark, d))):
        got = _in_halves(spark, records, PROPORTIONS, reassign=True).select(F.lit(kind).alias("kind"), "record_id", "unit_id", "split", "state")
        out = got if out is None else out.unionByName(got)
    return out


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "build_dataset").select(
        F.col("image_id").alias("id"), keys.split_key(F.col("split")).alias("split"), F.when(F.col("hash") != 0, F.col("hash")).alias("bits"),
        keys.source_key(F.col("src")).alias("block"), keys.file_stem(F.col("img")).alias("name"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of train that val or test hold as well, the same or almost the same."""
    got = overlap.cross_split(_pictures(spark, d))
    return got.select(F.least("train_id", "eval_id").alias("image_id_a"), F.greatest("train_id", "eval_id").alias("image_id_b")).distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs and pictures per split and source."""
    return overlap.overlap_report(_pictures(spark, d))


def p2_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Every picture that the other side holds as well, with its class of copies and its number of links."""
    return overlap.linked(_pictures(spark, d)).where("n_links > 0").select(F.col("id").alias("image_id"), "class_id", "n_links")


def p2_names(spark: SparkSession, d: str) -> DataFrame:
    """Nearly equal file names of one source on both sides, at most two edits apart: candidates to look at."""
    return overlap.near_names(_pictures(spark, d), 2).select(F.col("block").alias("source"), "eval_name", "train_name", "edits")


def _alert_runs(spark: SparkSession, d: str) -> DataFrame:
    df = _read(spark, d, "alerts").where("person_id is not null and threat_level is not null")
    same = {"threat_level": F.col("threat_level"), "weapons": keys.label_set(F.col("weapons"))}
    return runs.collapse_runs(df, ["stream_id", "person_id"], "timestamp", "alert_id", same, "received_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs of at least two alerts."""
    return _alert_runs(spark, d).where("n_events >= 2").select(F.col("first_id").alias("first_alert_id"), F.col("last_id").alias("last_alert_id"))


def p3_events(spark: SparkSession, d: str) -> DataFrame:
    """Every run, single alerts included, with its count and duration."""
    return _alert_runs(spark, d).select(
        "stream_id", "person_id", "threat_level", "weapons", F.col("first_id").alias("first_alert_id"), F.col("last_id").alias("last_alert_id"),
        F.col("n_events").alias("n_alerts"), F.round("duration_s", 6).alias("duration_s"))


def _typed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Typed values (entry_id, field, value), references (field, ref_id, name), canonical spellings (field, value)."""
    m, src, cls = _read(spark, d, "class_map"), _read(spark, d, "source_ref"), _read(spark, d, "class_ref")
    typed = None
    for f in ("sources", "classes"):
        one = m.select("entry_id", F.lit(f).alias("field"), F.col(f).alias("value"))
        typed = one if typed is None else typed.unionByName(one)
    slugs = src.select(F.lit("sources").alias("field"), F.col("source_id").alias("ref_id"), F.col("slug").alias("name"))
    names = cls.select(F.lit("classes").alias("field"), F.col("class_id").alias("ref_id"), F.col("class_name").alias("name"))
    aliases = cls.select(F.lit("classes").alias("field"), F.col("class_id").alias("ref_id"), F.explode("aliases").alias("name"))
    exact = slugs.unionByName(names)
    return typed.where(F.trim(F.regexp_replace("value", r"[\s" + chr(0xA0) + "]+", " ")) != "").distinct(), exact.unionByName(aliases), exact.select("field", F.col("name").alias("value")).distinct()


def _mapped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Typed values that are no canonical spelling, and what each of them means."""
    ws = Workspace(spark)
    typed, refs, exact = _typed(spark, d)
    open_ = ws.table(typed.join(exact, ["field", "value"], "left_anti"))
    return open_, canonical.map_values(open_, refs, ws=ws)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each typed value that is no canonical spelling, with the entry meant or -1."""
    open_, meant = _mapped(spark, d)
    return open_.join(meant, ["field", "value"]).select("entry_id", "field", "ref_id").distinct()


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed values without an entry, with the number of entries that hold them."""
    open_, meant = _mapped(spark, d)
    return open_.join(meant.where("ref_id = -1"), ["field", "value"]).groupBy("field", "value").agg(F.count("*").alias("n_entries"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pictures and groups tied to others, with the smallest id of their set."""
    pairs = _read(spark, d, "image_pair").where("is_match")
    named = _read(spark, d, "build_dataset").select(keys.path_key(F.col("img")).alias("name"), F.col("image_id").alias("id"))
    images = components.tied_pairs(pairs, keys.path_key(F.col("left_img")), keys.path_key(F.col("right_img")), named)
    clips = _read(spark, d, "resplit_dataset").select("group_id", F.explode(keys.clip_keys(F.col("clips"))).alias("clip"))
    groups = components.star_edges(clips, "clip", "group_id")
    out = None
    for kind, edges in (("image", images), ("group", groups)):
        got = components.connected(edges, Workspace(spark)).select(F.lit(kind).alias("kind"), F.col("v").alias("record_id"), F.col("head").alias("head_id"))
        out = got if out is None else out.unionByName(got)
    return out


def _plans(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, DataFrame]]:
    plan = _read(spark, d, "sample_plan")
    pictures = _read(spark, d, "build_dataset").where("image_id is not null").select(F.col("image_id").alias("record_id"), quota.category_of_picture("labels", CLASSES, NEGATIVE).alias("category"))
    sizes = [(c, F.col(f"counts.{c}")) for c in CLASSES]
    groups = _read(spark, d, "resplit_dataset").where("group_id is not null").select(F.col("group_id").alias("record_id"), quota.majority(sizes, NEGATIVE).alias("category"))
    ws = Workspace(spark)
    return [(t, plan.where(F.col("over_table") == t), ws.table(r.groupBy("record_id").agg(F.max("category").alias("category")))) for t, r in (("build_dataset", pictures), ("resplit_dataset", groups))]


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """What every plan row needs, what was drawn for it, and its share wanted and drawn."""
    a, b = (quota.sample_report(plan, records) for _, plan, records in _plans(spark, d))
    return a.unionByName(b).withColumn("drawn_share", F.round("drawn_share", 9))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Plan rows for which the sample could not be drawn in full."""
    return p6_report(spark, d).where("lacking > 0").select("plan_id", "category")


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    """The drawn sample of every plan."""
    a, b = (quota.proportional_sample(plan, records).withColumn("over_table", F.lit(t)) for t, plan, records in _plans(spark, d))
    return a.unionByName(b)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode.encode_corpus(_read(spark, d, "documents"), "doc_id", "text").select("doc_id", "ids")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items they give away: longest passage, and the item's words that tiles cover in any order."""
    return leak.leaked(_read(spark, d, "documents"), _read(spark, d, "eval_item"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items of which they hold 25 consecutive words."""
    return p8_leaks(spark, d).where("words > 0").select("doc_id", "item_id")


def p9_pages(spark: SparkSession, d: str) -> DataFrame:
    """Spam pages with language, distance and the share of the text that is spam."""
    got = spam.spam_pages(_read(spark, d, "documents"))
    return got.select("doc_id", "lang", F.round("distance", 3).alias("distance"), F.round("spam_share", 4).alias("spam_share"), F.round("cut", 3).alias("cut"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Spam pages."""
    return p9_pages(spark, d).select("doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_splits": p1_splits, "p2_found": p2_found, "p2_report": p2_report, "p2_pictures": p2_pictures, "p2_names": p2_names, "p3_found": p3_found, "p3_events": p3_events,
    "p4_found": p4_found, "p4_unmatched": p4_unmatched,
    "p5_found": p5_found, "p6_found": p6_found, "p6_sample": p6_sample, "p6_report": p6_report, "p7_ids": p7_ids, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found, "p9_pages": p9_pages,
}
