import json

from tessera.sources import tables


def test_mot_reader_drops_what_does_not_count(spark, tmp_path):
    (tmp_path / "gt.txt").write_text("1,1,10,20,30,40,1,1,0.9\n1,2,0,0,5,5,0,1,1\n1,3,0,0,5,5,1,7,1\n1,4,0,0,5\n")
    assert [tuple(r) for r in tables.read_mot(spark, str(tmp_path / "gt.txt")).collect()] == [(1, 1, 10.0, 20.0, 40.0, 60.0, 0.9)]


def test_event_documents_and_their_pairs(spark, tmp_path):
    from tessera.operators.matching import exit_return_pairs
    from pyspark.sql import functions as F

    marks = [("return", 7), ("exit", 40), ("return", 75), ("exit", 80), ("exit", 95), ("return", 130), ("return", 133), ("exit", 150)]
    doc = {"clip": "c", "fps": 25, "frames": 160, "scenario": "s", "people": {"1": "a"}, "events": [{"person": "1", "exit_frame": 40, "return_frame": 75, "note": ""}], "raw_marks": [{"type": t, "frame": f} for t, f in marks]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    docs = tables.read_event_truth(spark, str(tmp_path))
    assert tables.reentry_events(docs).select("exit_frame", "return_frame").first()[:] == (40, 75)
    m = docs.select("clip", F.inline("raw_marks")).select("clip", F.col("type").alias("mark"), "frame")
    assert sorted(r[1:] for r in exit_return_pairs(m, "clip", ["frame"]).collect()) == [(40, 75), (95, 130)]


def test_labels_and_names(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l/a.txt").write_text("0 0.5 0.5 0.1 0.1\nknife 1 1 1 1\n1 0.2\n")
    (tmp_path / "l/b.txt").write_text("")
    assert tables.read_labels(spark, str(tmp_path / "l")).count() == 1
    assert sorted((r["file"][-5:], r["empty"]) for r in tables.label_files(spark, str(tmp_path / "l")).collect()) == [("a.txt", False), ("b.txt", True)]
    for text, want in (("names: ['a', 'b']\n", ["a", "b"]), ("nc: 2  # two\nnames: ['a, the first', \"b's\", c]  # in order\n", ["a, the first", "b's", "c"]), ("names:\n  10: k\n  2: 'b: x'\n\n  # none\n  0: a\nnc: 3\n", ["a", "b: x", "k"]), ("names: {0: a, 1: 'b, c'}\n", ["a", "b, c"]), ("names:\n- \"a # b\"\n- b # last\n", ["a # b", "b"]), ("names:\n  1: b\n  0: a\n", ["a", "b"]), ("names:\n- a\n- b\n", ["a", "b"]), ("nc: 2\n", None)):
        (tmp_path / "d.yaml").write_text(text)
        assert tables.class_names(str(tmp_path / "d.yaml")) == want
    assert tables.class_names(str(tmp_path / "none.yaml")) is None


def test_sinks_and_manifest(spark, tmp_path):
    row = spark.createDataFrame([("2024-01-01", 1, 2, "HIGH", "knife", 0.5, "[]", True, False)], "timestamp string, person_id long, threat_level int, threat_name string, weapons string, confidence double, bbox string, arm_raised boolean, approaching boolean").coalesce(1)
    tables.append_alerts(row, str(tmp_path / "log"))
    tables.append_alerts(row, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 2
    tables.write_result(row, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    tables.write_dataset(spark.createDataFrame([("s", "a", "val")], "source string, stem string, split string"), str(tmp_path / "ds"))
    assert spark.read.parquet(str(tmp_path / "ds")).where("split = 'val'").first()["name"] == "s__a"
    assert tables.manifest(spark, str(tmp_path / "log"), "*.csv").first()["files"] == 2
