"""Problem 4: free-entered values mapped to a canonical list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.workspace import Workspace

# Look-alike letters, accented letters, and digits typed for letters.
LOOKALIKES = {
    "a": "аαáàâäãåā", "b": "ƅ", "c": "сçćč", "d": "ԁ", "e": "еεéèêëē", "h": "һ", "i": "іιíìîïī", "j": "ј", "k": "κ", "n": "ñń", "o": "оοóòôöõōø",
    "p": "рρ", "q": "ԛ", "s": "ѕśš", "u": "υúùûüū", "v": "ν", "w": "ԝ", "x": "хχ", "y": "уýÿ", "z": "žźż",
}
DIGIT_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}

LOOKS = "".join(LOOKALIKES.values()), "".join(plain * len(alike) for plain, alike in LOOKALIKES.items())
DIGITS = "".join(DIGIT_LETTERS) + "l", "".join(DIGIT_LETTERS.values()) + "i"


def plain_of(c: Column) -> Column:
    """The letters and digits of a name as plain lower-case letters; l and i are one letter, as 1 stands for both."""
    return F.translate(F.regexp_replace(F.translate(F.lower(c), *LOOKS), "[^a-z0-9]+", ""), *DIGITS)


def grams_of(s: Column, sizes: tuple[int, ...]) -> Column:
    """The distinct n-grams of a text marked at both ends."""
    marked = F.concat(F.lit("^"), s, F.lit("$"))

    def of(n: int) -> Column:
        last = F.length(marked) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(marked, i + 1, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def map_values(
    values: DataFrame, refs: DataFrame, sizes: tuple[int, ...] = (2, 3), least: float = 0.47, margin: float = 0.04, strange: float = 0.3, ws: Workspace | None = None,
) -> DataFrame:
    """field, value, ref_id, score for each distinct value of a field; ref_id is -1 and score null where nothing is meant.

    ``values``: field, value. ``refs``: field, ref_id, name; an entry may have several names. Null and blank values and
    names are left out; a value without letters and digits, or of a field without references, is unmatched. Values that
    differ only in spelling are scored once.

    Method: values are made distinct, normalised (:func:`plain_of`) and written once. Candidates come from an inverted
    index of character n-grams and are scored by cosine, where a gram weighs by its rarity among the names. A gram of no
    name, as in added words, tells no entry and weighs ``strange`` of the rarest. The best entry is accepted if its score
    is at least ``least`` and ``margin`` above that of the next entry; nothing else decides.
    """
    ws = ws or Workspace(values.sparkSession)
    v = values.where("field is not null and value is not null and trim(value) <> ''").select("field", "value").distinct()
    v = ws.table(v.withColumn("s", plain_of(F.col("value"))))
    r = refs.where("field is not null and ref_id is not null and name is not null").select("field", "ref_id", plain_of(F.col("name")).alias("name")).where("name <> ''").distinct()
    rg = r.select("field", "ref_id", "name", F.explode(grams_of(F.col("name"), sizes)).alias("g"))
    n_names = r.groupBy("field").agg(F.count("*").alias("names"))
    rarity = rg.groupBy("field", "g").agg(F.count("*").alias("df")).join(n_names, "field").select("field", "g", F.log1p(F.col("names") / F.col("df")).alias("w"))
    index = ws.table(rg.join(rarity, ["field", "g"]).select("field", "ref_id", "name", "g", "w"))
    r_norm = index.groupBy("field", "ref_id", "name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("rn"))
    weighed = index.select("field", "g", "w").distinct()
    vg = v.where("s <> ''").select("field", "s").distinct().select("field", "s", F.explode(grams_of(F.col("s"), sizes)).alias("g"))
    rarest = F.lit(strange) * F.log1p(F.col("names").cast("double"))
    v_norm = vg.join(n_names, "field").join(weighed, ["field", "g"], "left").withColumn("y", F.coalesce("w", rarest)).groupBy("field", "s").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("vn"))
    dots = vg.join(index, ["field", "g"]).groupBy("field", "s", "ref_id", "name").agg(F.sum(F.col("w") * F.col("w")).alias("dot"))
    scored = dots.join(r_norm, ["field", "ref_id", "name"]).groupBy("field", "s", "ref_id").agg(F.max(F.col("dot") / F.col("rn")).alias("part"))
    w = Window.partitionBy("field", "s").orderBy(F.col("part").desc(), "ref_id")
    two = scored.withColumn("k", F.row_number().over(w)).where("k <= 2")
    ranked = two.groupBy("field", "s").agg(F.max(F.when(F.col("k") == 1, F.struct("ref_id", "part"))).alias("top"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("part"))), F.lit(0.0)).alias("next"))
    best = ranked.join(v_norm, ["field", "s"]).select("field", "s", "top.ref_id", (F.col("top.part") / F.col("vn")).alias("score"), ((F.col("top.part") - F.col("next")) / F.col("vn")).alias("lead"))
    good = best.where((F.col("score") >= least) & (F.col("lead") >= margin)).select("field", "s", "ref_id", "score")
    return v.join(good, ["field", "s"], "left").select("field", "value", F.coalesce("ref_id", F.lit(-1)).cast("long").alias("ref_id"), "score")
