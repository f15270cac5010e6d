"""Files in and out, and tables that cut lineage."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.workspace import Workspace

MOT_SCHEMA = "frame long, id long, x double, y double, w double, h double, conf double, class int, visibility double"
EVENTS_SCHEMA = (
    "clip string, fps double, frames long, scenario string, people map<string,string>, "
    "events array<struct<person: string, exit_frame: long, return_frame: long, note: string>>, raw_marks array<struct<type: string, frame: long>>"
)


def cutter(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a frame to the shared folder and reads it back, so that lineage ends there."""
    return Workspace(spark).table


def first_frames(df: DataFrame, n: int, frame: str = "frame_id") -> DataFrame:
    return df.where(F.col(frame) < n)


def every_nth(df: DataFrame, k: int, frame: str = "frame_id", start: int = 0) -> DataFrame:
    return df.where((F.col(frame) - start) % k == 0)


def mot_boxes(df: DataFrame) -> DataFrame:
    """frame, id, x1, y1, x2, y2, visibility of the rows that count: complete, considered, and persons."""
    ok = F.col("visibility").isNotNull() & (F.col("conf") >= 1) & (F.col("class") == 1)
    return df.where(ok).select("frame", "id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), "visibility")


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth of one or more sequences: headless CSV; rows with missing fields are dropped."""
    return mot_boxes(spark.read.csv(path, schema=MOT_SCHEMA, mode="PERMISSIVE", header=False))


def read_event_truth(spark: SparkSession, path: str) -> DataFrame:
    """One document a file: clip, fps, frames and its events and marks as arrays."""
    return spark.read.json(path, schema=EVENTS_SCHEMA, multiLine=True)


def reentry_events(docs: DataFrame) -> DataFrame:
    return docs.select("clip", "fps", F.inline("events"))


def gallery_key(name: Column) -> tuple[Column, Column]:
    """Person and camera in a file name such as 0002_c1s1_000451_03.jpg; -1 is a distractor."""
    pid, cam = F.regexp_extract(name, r"(-?\d+)_c(\d)", 1), F.regexp_extract(name, r"(-?\d+)_c(\d)", 2)
    return F.when(pid != "", pid).try_cast("long"), F.when(cam != "", cam).try_cast("long")


def list_entry(line: Column) -> tuple[Column, Column, Column]:
    """Path, person and camera of a list line: the person after the last blank, the camera third in the name, from 1."""
    path, pid = F.regexp_extract(line, r"^(.*) (\S+)$", 1), F.regexp_extract(line, r"^(.*) (\S+)$", 2)
    cam = F.get(F.split(F.regexp_extract(path, "([^/]*)$", 1), "_"), F.lit(2))
    return path, pid.try_cast("long"), cam.try_cast("long") - 1


def label_line(line: Column) -> Column:
    """Struct cls, cx, cy, w, h of a label line; null for fewer than five fields or a class that is no number."""
    f = F.split(F.trim(line), r"\s+")
    cls = F.get(f, F.lit(0)).try_cast("int")
    num = lambda i: F.get(f, F.lit(i)).try_cast("double")
    return F.when((F.size(f) >= 5) & cls.isNotNull(), F.struct(cls.alias("cls"), num(1).alias("cx"), num(2).alias("cy"), num(3).alias("w"), num(4).alias("h")))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """file, cls, cx, cy, w, h of label files; empty files give no row, their names come from ``label_files``."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), label_line(F.col("value")).alias("l")).where("l is not null").select("file", "l.*")


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """file, empty: an empty label file says there is nothing; a missing one says nothing.

    Scans leave out empty files, so names and lengths come from the file system's listing, as for Spark's own index.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while files.hasNext():
        f = files.next()
        if f.getPath().getName().endswith(".txt"):
            found.append((f.getPath().toString(), f.getLen() == 0))
    return spark.createDataFrame(found, "file string, empty boolean")


_SCALAR = re.compile(r"""\s*(?:'((?:[^']|'')*)'|"((?:[^"\\]|\\.)*)"|([^,\[\]{}#]*?))\s*(?=[,\]}:]|\s#|$)""")


def _scalars(text: str) -> list[str]:
    """The items of a list or mapping in one line, with quotes, up to its end."""
    out, at = [], 0
    while at < len(text):
        m = _SCALAR.match(text, at)
        if not m:
            break
        item = m[1].replace("''", "'") if m[1] is not None else m[2].replace('\\"', '"') if m[2] is not None else m[3].strip()
        out.append(item)
        at = m.end()
        if at >= len(text) or text[at] in "]}":
            break
        at += 1
    return out


def _scalar(text: str) -> str:
    """One value with quotes or a comment behind it."""
    text = text.strip()
    if text[:1] in "'\"":
        return _scalars(text)[0]
    return re.sub(r"\s+#.*$", "", text)


def class_names(path: str) -> list[str] | None:
    """Ordered class names of a data description: a list, or numbers and names, in one line or in a block. None if there are none.

    The file is small and read on the driver. Of YAML the forms of ``names`` are understood, with quotes and comments;
    anchors and documents within documents are not.
    """
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        lines = f.read().splitlines()
    at = next((k for k, line in enumerate(lines) if re.match(r"names\s*:", line)), None)
    if at is None:
        return None
    rest = lines[at].split(":", 1)[1].strip()
    if rest[:1] in ("[", "{"):
        items = _scalars(rest[1:] + " ".join(line.strip() for line in lines[at + 1 :] if line[:1] in " \t"))
        if rest[0] == "{":
            return [v for _, v in sorted(zip(map(int, items[::2]), items[1::2]))] or None
        return [x for x in items if x] or None
    rows = []
    for line in lines[at + 1 :]:
        if line.strip() and not line.strip().startswith("#"):
            if not re.match(r"\s+|-", line):
                break
            rows.append(line.strip())
    if not rows:
        return None
    if rows[0].startswith("-"):
        return [_scalar(r[1:]) for r in rows]
    return [_scalar(v) for _, v in sorted((int(k), v) for k, v in (r.split(":", 1) for r in rows))]


def person_labels(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """image_id, cls, cx, cy, w, h: boxes of persons that are no crowd, as centre and size in shares of the image.

    ``images``: id, width, height. ``annotations``: image_id, category_id, iscrowd, bbox (x, y, w, h). Images without
    persons give no row.
    """
    a = annotations.where("category_id = 1 AND iscrowd = 0").join(images, annotations["image_id"] == images["id"])
    b = F.col("bbox")
    return a.select(
        "image_id", F.lit(0).alias("cls"), ((b[0] + b[2] / 2) / F.col("width")).alias("cx"), ((b[1] + b[3] / 2) / F.col("height")).alias("cy"), (b[2] / F.col("width")).alias("w"), (b[3] / F.col("height")).alias("h"))


def class_report(labels: DataFrame, names: DataFrame) -> DataFrame:
    """source, cls, name, n, stray: instances per source and class; a class without a name is stray."""
    per = labels.groupBy("source", "cls").agg(F.count("*").alias("n"))
    return per.join(names, "cls", "left").select("source", "cls", "name", "n", F.col("name").isNull().alias("stray"))


#: Options by which CSV keeps texts to the letter; readers need the same.
EXACT_CSV = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def append_alerts(df: DataFrame, path: str) -> None:
    """Nine columns of the alert log, appended as CSV with a header in each part; blanks and quotes stay as they are."""
    cols = ["timestamp", "person_id", "threat_level", "threat_name", "weapons", "confidence", "bbox", "arm_raised", "approaching"]
    df.select(*cols).write.csv(path, mode="append", header=True, **EXACT_CSV)


def write_result(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="overwrite")


def write_dataset(df: DataFrame, path: str) -> None:
    """Rows by split, named by source and stem; pictures are not copied."""
    df.withColumn("name", F.concat_ws("__", "source", "stem")).write.partitionBy("split").parquet(path, mode="overwrite")


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """folder, files, bytes and one digest per file tree folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    one = f.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "path", "length", F.sha2("content", 256).alias("digest"))
    return one.groupBy("folder").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("digest"))
