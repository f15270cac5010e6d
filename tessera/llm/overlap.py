"""Problem 2: the same or nearly the same record in two splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.workspace import Workspace
from tessera.operators.hamming import near_patterns


def _segments(length: Column, k: int) -> Column:
    """Start (from 0) and length of k + 1 nearly equal segments."""
    def cut(i):
        a, z = F.floor(length * i / (k + 1)), F.floor(length * (i + 1) / (k + 1))
        return F.struct(i.alias("i"), a.cast("int").alias("p"), (z - a).cast("int").alias("n"))
    return F.transform(F.sequence(F.lit(0), F.lit(k)), cut)


def segment_join(evaluation: DataFrame, training: DataFrame, k: int) -> DataFrame:
    """Distinct pairs eval_text, train_text, block of one block within edit distance ``k``.

    Both inputs: block, text. Null texts and blocks pair with nothing, repeated rows count once, empty texts pair with
    texts of at most ``k`` characters. Other columns are not read.

    Method: distinct evaluation strings are cut into k + 1 segments, of which k edits leave one untouched, at most k
    places from where it was. So each training string looks up its substrings of the segments' lengths at the allowed
    positions, and what meets is verified by the banded dynamic program of ``levenshtein`` with a bound. With k = 0
    the one segment is the whole string. Substrings are joined by block, evaluation length, segment number and text;
    a crowded substring is split by the skew join.
    """
    e = evaluation.where("block is not null and text is not null").select("block", F.col("text").alias("e")).distinct()
    t = training.where("block is not null and text is not null").select("block", F.col("text").alias("t")).distinct()
    if k == 0:
        return e.join(t.select("block", F.col("t").alias("e"), "t"), ["block", "e"]).select("block", F.col("e").alias("eval_text"), F.col("t").alias("train_text"))
    e = e.withColumn("len", F.length("e")).withColumn("s", F.explode(_segments(F.col("len"), k)))
    e = e.select("block", "len", F.col("s.i").alias("i"), F.substring(F.col("e"), F.col("s.p") + 1, F.col("s.n")).alias("part"), "e")
    t = t.withColumn("len", F.explode(F.sequence(F.greatest(F.lit(0), F.length("t") - k), F.length("t") + k)))
    t = t.withColumn("s", F.explode(_segments(F.col("len"), k)))
    t = t.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("s.p") - k), F.col("s.p") + k)))
    t = t.where(F.col("at") + F.col("s.n") <= F.length("t"))
    t = t.select("block", "len", F.col("s.i").alias("i"), F.substring(F.col("t"), F.col("at") + 1, F.col("s.n")).alias("part"), "t").distinct()
    met = e.join(t, ["block", "len", "i", "part"]).where(F.levenshtein("e", "t", k) >= 0)
    return met.select("block", F.col("e").alias("eval_text"), F.col("t").alias("train_text")).distinct()


def bit_segment_join(evaluation: DataFrame, training: DataFrame, k: int = 6, crowded: int = 4096) -> DataFrame:
    """Distinct pairs eval_bits, train_bits of 64-bit patterns (column bits) that differ in at most ``k`` bits: the
    segment join for substitutions only, where a segment can't move, see :func:`tessera.operators.hamming.near_patterns`."""
    got = near_patterns(evaluation, training, k, crowded)
    return got.select(F.col("left_bits").alias("eval_bits"), F.col("right_bits").alias("train_bits"))


def cross_split(records: DataFrame, max_bits: int = 6, max_edits: int = 0) -> DataFrame:
    """train_id, eval_id of pictures in train and in val or test that are the same or almost the same.

    ``records``: id, split (train, val, test or null), bits (null where unusable), block, name. A pair is reported once
    if its bits differ in at most ``max_bits``, or if the names of one block are within ``max_edits``. Rows without a
    split, and repeated rows, pair with nothing more. Bits and names are made distinct before they are compared, so
    copies meet only in the last join, which writes the pairs out; :func:`linked` tells the same without pairs.
    """
    r = records.where("split is not null and id is not null").select("id", (F.col("split") == "train").alias("train"), "bits", "block", "name").distinct()
    # The names are parsed once, as eight branches read them.
    r = Workspace(records.sparkSession).table(r)
    ev, tr = r.where("not train"), r.where("train")
    bits = bit_segment_join(ev, tr, max_bits)
    by_bits = bits.join(ev.select(F.col("id").alias("eval_id"), F.col("bits").alias("eval_bits")), "eval_bits")
    by_bits = by_bits.join(tr.select(F.col("id").alias("train_id"), F.col("bits").alias("train_bits")), "train_bits")
    en, tn = ev.select("block", F.col("name").alias("text")), tr.select("block", F.col("name").alias("text"))
    names = segment_join(en, tn, max_edits)
    by_name = names.join(ev.select("block", F.col("name").alias("eval_text"), F.col("id").alias("eval_id")), ["block", "eval_text"])
    by_name = by_name.join(tr.select("block", F.col("name").alias("train_text"), F.col("id").alias("train_id")), ["block", "train_text"])
    return by_bits.select("train_id", "eval_id").unionByName(by_name.select("train_id", "eval_id")).distinct()


def near_names(records: DataFrame, max_edits: int) -> DataFrame:
    """block, eval_name, train_name, edits of different names of one block within ``max_edits``, one in val or test and
    one in train: names stand for all their pictures, so copies make no pairs. ``records`` as in :func:`cross_split`."""
    r = records.where("split is not null").select((F.col("split") == "train").alias("train"), "block", F.col("name").alias("text")).distinct()
    got = segment_join(r.where("not train"), r.where("train"), max_edits).where("eval_text <> train_text")
    return got.select("block", F.col("eval_text").alias("eval_name"), F.col("train_text").alias("train_name"), F.levenshtein("eval_text", "train_text").alias("edits"))


def linked(records: DataFrame, max_bits: int = 6) -> DataFrame:
    """id, split, block, class_id, n_links of every picture with a split: how many pictures on the other side (train, or
    val and test) are the same or almost the same, by bits or by the name in its block. ``records`` as in :func:`cross_split`.

    No pairs of pictures are formed. Pictures that agree in side, bits, block and name are one class, whose class_id is
    its smallest id. The links of a class are those by bits, by name, and less those by both, each a sum of counts of
    classes on the other side, so a picture that a third of both sides hold costs no more than any other.
    """
    ws = Workspace(records.sparkSession)
    r = records.where("split is not null and id is not null").select("id", "split", (F.col("split") == "train").alias("train"), "bits", "block", "name").distinct()
    c = ws.table(r.groupBy("train", "bits", "block", "name").agg(F.min("id").alias("class_id"), F.countDistinct("id").alias("n")))
    named = F.col("block").isNotNull() & F.col("name").isNotNull()
    near = bit_segment_join(c.where("not train"), c.where("train"), max_bits)
    both = F.explode(F.array(F.struct(F.lit(False).alias("train"), F.col("eval_bits").alias("bits"), F.col("train_bits").alias("far")), F.struct(F.lit(True).alias("train"), F.col("train_bits").alias("bits"), F.col("eval_bits").alias("far"))))
    near = ws.table(near.select(both.alias("x")).select("x.train", "x.bits", "x.far"))
    held = c.where("bits is not null").groupBy((~F.col("train")).alias("train"), F.col("bits").alias("far")).agg(F.sum("n").alias("k"))
    by_bits = near.join(held, ["train", "far"]).groupBy("train", "bits").agg(F.sum("k").alias("by_bits"))
    by_name = c.where(named).groupBy((~F.col("train")).alias("train"), "block", "name").agg(F.sum("n").alias("by_name"))
    other = c.where(named & F.col("bits").isNotNull()).select((~F.col("train")).alias("train"), F.col("bits").alias("far"), "block", "name", F.col("n").alias("k"))
    by_both = c.where(named & F.col("bits").isNotNull()).select("train", "bits", "block", "name").join(near, ["train", "bits"]).join(other, ["train", "far", "block", "name"])
    by_both = by_both.groupBy("train", "bits", "block", "name").agg(F.sum("k").alias("by_both"))
    c = c.join(by_bits, ["train", "bits"], "left").join(by_name, ["train", "block", "name"], "left").join(by_both, ["train", "bits", "block", "name"], "left")
    zero = F.lit(0).cast("long")
    c = c.select("train", "bits", "block", "name", "class_id", (F.coalesce("by_bits", zero) + F.coalesce("by_name", zero) - F.coalesce("by_both", zero)).alias("n_links"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ("train", "bits", "block", "name")]
    return r.alias("r").join(c.alias("c"), same).select("r.id", "r.split", "r.block", "class_id", "n_links")


def overlap_report(records: DataFrame, max_bits: int = 6) -> DataFrame:
    """split, source, n_pairs, n_records per split and source, from either side of each pair, without forming pairs."""
    per = linked(records, max_bits).where("n_links > 0")
    return per.groupBy("split", F.col("block").alias("source")).agg(F.sum("n_links").alias("n_pairs"), F.count("*").alias("n_records"))
