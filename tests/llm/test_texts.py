import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import canonical, encode, leak, spam

encoders = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    t = encoders.Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    e = encode.Encoder(encode.read_ranks(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken"), encode.pattern_of(encode.TOKENIZERS))
    return e, lambda xs: [x.ids for x in t.encode_batch(xs, add_special_tokens=False)]


PIECES = [*"abzAZ019'\"-_.,!? \n\t\r", "'s", "'ll", "  ", "\n\n", " 1", "<|endoftext|>", *map(chr, (0x0B, 0x1C, 0x85, 0xA0, 0x3000, 0xE9, 0xDF, 0x4E2D, 0x301, 0xB2, 0x663, 0x200B, 0x1F600))]


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), min_size=1, max_size=20))
@settings(max_examples=150, deadline=None)
def test_fragments_give_the_ids_of_the_whole(both, texts):
    e, whole = both
    raw = [t.encode() for t in texts]
    flat, at = e.batch(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [flat[a:z].tolist() for a, z in zip(at, at[1:])] == whole(texts)


def test_encoding_of_null_empty_long_and_repeated_texts(spark, both):
    long = "the gate 12,5 " * 40000 + "x" * 50000
    rows = [(1, None), (2, ""), (3, long), (4, "a b"), (4, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("ids", F.lit(2))
    got = sorted((r["doc_id"], list(r["ids"])) for r in encode.encode_corpus(df, "doc_id", "text").collect())
    assert got == [(i, both[1]([t or ""])[0]) for i, t in rows]
    assert encode.encode_corpus(df.where("false"), "doc_id", "text").count() == 0


def naive_passage(doc, item, least, one_in):
    """Longest stretch of the item with at most one edit in ``one_in`` words to some stretch of the document."""
    best = 0
    for a in range(len(item)):
        for z in range(a + least, len(item) + 1):
            row = [0] * (len(doc) + 1)
            for i, x in enumerate(item[a:z], 1):
                before, row[0] = row[0], i
                for j, y in enumerate(doc, 1):
                    before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
            if min(row) * one_in <= z - a:
                best = max(best, z - a)
    return best


def as_array(words):
    return np.array(leak.Words().of(" ".join(words)), np.uint64)


def passage(doc, item):
    return leak.compare(as_array(doc), as_array(item), 25, 8, 10)[0]


@pytest.mark.parametrize("seed", range(12))
def test_passages_are_found_as_by_alignment(seed):
    r = random.Random(seed)
    item = [f"w{r.randrange(60)}" for _ in range(r.randint(26, 40))]
    part = item[r.randint(0, 3) : r.randint(12, len(item))]
    for _ in range(r.randint(0, 4)):
        k = r.randrange(len(part))
        part[k : k + 1] = r.choice([[], ["zz"], [part[k], "zz"]])
    doc = [f"w{r.randrange(60)}" for _ in range(20)] + part + [f"v{r.randrange(9)}" for _ in range(20)]
    got = passage(doc, item)
    want = naive_passage(doc, item, 25, 8)
    # A stretch must begin and end with words that are there, so the aligned one may be longer by edits at its ends.
    clear = naive_passage(doc, item, 29, 9)
    assert bool(got) <= bool(want) and bool(got) >= bool(clear)


def clear_passage(doc, item, least, one_in):
    """As :func:`naive_passage`, of stretches that begin and end with words that are there."""
    best = 0
    for a in range(len(item)):
        for b in [j for j, y in enumerate(doc) if y == item[a]]:
            row = list(range(len(doc) - b + 1))
            for i, x in enumerate(item[a:], 1):
                before, row[0] = row[0], i
                for j, y in enumerate(doc[b:], 1):
                    old = row[j]
                    row[j] = min(row[j] + 1, row[j - 1] + 1, before + (x != y))
                    if x == y and i >= least and before * one_in <= i:
                        best = max(best, i)
                    before = old
    return best


def test_a_quote_nearby_takes_nothing_from_a_passage():
    item = [f"w{i}" for i in range(40)]
    part = [f"x{i}" if i in (4, 9, 20) else w for i, w in enumerate(item[:28])]
    doc = item[:12] + [f"y{i}" for i in range(10)] + part
    assert passage(doc, item) == 28


@pytest.mark.parametrize("seed", range(40))
def test_passage_words_are_those_of_a_full_alignment(seed):
    r = random.Random(seed)
    item = [r.randrange(1, 30) for _ in range(r.randint(26, 44))]
    doc = [r.randrange(1, 30) for _ in range(8)]
    for _ in range(3):
        part = item[r.randint(0, 6) : r.randint(10, len(item))]
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(part))
            part[k : k + 1] = r.choice([[], [99], [part[k], 99]])
        doc += part + [r.randrange(1, 30) for _ in range(r.randint(0, 8))]
    assert leak.longest_passage(doc, item, 20, 8, list(range(-len(item), len(doc)))) == clear_passage(doc, item, 20, 8)


ITEM = "The narrow gate counted forty two late visits behind the pump house because nobody had moved the second camera, and the older note about the quiet corridor never reached our own reviewer before noon."


@pytest.mark.parametrize("change", [
    str.upper, lambda t: t.replace(" ", "\n> "), lambda t: t.replace(" visits", " [12] visits"), lambda t: f"<p><b>{t}</b></p>", lambda t: t.replace("e", chr(0x435)), lambda t: t.replace("the", "the" + chr(0x200B)),
    lambda t: t.replace("reviewer", "revie-\nwer"), lambda t: t.replace("nobody", "*nobody*"), lambda t: t.replace("late ", "").replace("second", "third"),
])
def test_looks_make_no_difference(spark, change):
    docs = spark.createDataFrame([(1, "Before it. " + change(ITEM) + " After it."), (1, "Before it. " + change(ITEM) + " After it."), (2, " ".join(ITEM.split()[:20])), (3, None), (4, "")], "doc_id long, text string").withColumn("item_id", F.lit(9))
    items = spark.createDataFrame([(5, ITEM), (5, ITEM), (6, None), (7, "too short")], "item_id long, text string").withColumn("doc_id", F.lit(9))
    assert [(r["doc_id"], r["item_id"]) for r in leak.leaked(docs, items).collect()] == [(1, 5)]


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_many_items_and_long_documents(spark):
    r = random.Random(4)
    items = [(i, " ".join(f"w{r.randrange(400)}" for _ in range(40))) for i in range(30)] + [(99, " ".join(f"w{r.randrange(400)}" for _ in range(3000)))]
    docs = [(i, f"x y {items[i % 30][1]} z") for i in range(40)]
    docs += [(100 + i, " ".join(f"y{r.randrange(900)}" for _ in range(950 + 20 * i)) + " " + items[i][1]) for i in range(12)] + [(200, "q " + " ".join(items[-1][1].split()[990:1060]))]
    got = {(x["doc_id"], x["item_id"]): (x["words"], x["covered"]) for x in leak.leaked(*frames(spark, docs, items)).collect()}
    assert got == {(i, i % 30): (40, 40) for i in range(40)} | {(100 + i, i): (40, 40) for i in range(12)} | {(200, 99): (70, 0)}
    d, t = frames(spark, docs, items)
    assert leak.leaked(d.where("false"), t).count() == 0 and leak.leaked(d, t.where("false")).count() == 0


def test_moved_parts_are_found_by_coverage(spark):
    item = [f"w{i}" for i in range(60)]
    moved = item[40:] + ["x"] * 30 + item[20:40] + ["y", "z"] + item[:20]
    docs = [(1, " ".join(moved)), (2, " ".join(item[:20] + ["x"] * 9 + item[40:44])), (3, " ".join(item)), (4, " ".join(item[:9] + ["a"] + item[10:19] + ["b"] + item[20:29] + ["c"] + item[30:39]))]
    got = {x["doc_id"]: (x["words"], x["covered"], x["item_words"]) for x in leak.leaked(*frames(spark, docs, [(7, " ".join(item))])).collect()}
    assert got == {1: (0, 60, 60), 3: (60, 60, 60), 4: (39, 0, 60)}


def test_a_standing_phrase_of_all_items_is_no_leak(spark):
    r = random.Random(8)
    phrase = "all identities are opaque numbers and expire after"
    items = [(i, phrase + " " + " ".join(f"w{r.randrange(900)}" for _ in range(40))) for i in range(60)]
    docs = [(i, " ".join(f"v{r.randrange(900)}" for _ in range(40)) + " " + phrase + " the end") for i in range(60)] + [(99, items[5][1])]
    assert [tuple(x)[:2] for x in leak.leaked(*frames(spark, docs, items)).collect()] == [(99, 5)]


def test_repetitive_texts_end(spark):
    docs = [(1, "x " * 5000), (2, "x y " * 3000)]
    got = {(x["doc_id"], x["item_id"]) for x in leak.leaked(*frames(spark, docs, [(7, "x " * 600), (8, "y x " * 40)])).collect()}
    assert got == {(1, 7), (2, 8)}


@pytest.mark.parametrize("seed", range(25))
def test_tiles_are_those_of_a_naive_search(seed):
    r = random.Random(seed)
    a, b = ([r.randrange(r.choice([2, 4, 30])) for _ in range(r.randint(0, 60))] for _ in range(2))
    doc, item = np.array(a, np.uint64), np.array(b, np.uint64)
    t = leak.tiles(doc, item, 3)
    free_d, free_i, lengths = set(range(len(a))), set(range(len(b))), []
    while True:
        best = max(((n, -i, -j) for i in range(len(b)) for j in range(len(a)) for n in [next((k for k in range(61) if i + k not in free_i or j + k not in free_d or a[j + k] != b[i + k]), 0)] if n >= 3), default=None)
        if best is None:
            break
        n, i, j = best[0], -best[1], -best[2]
        lengths.append(n)
        free_i -= set(range(i, i + n))
        free_d -= set(range(j, j + n))
    assert all(b[i : i + n] == a[j : j + n] for i, j, n in t)
    assert [n for _, _, n in t] == lengths and len({i + k for i, _, n in t for k in range(n)}) == sum(lengths) == len({j + k for _, j, n in t for k in range(n)})


REFS = [("s", 1, "blades_chapel"), ("s", 2, "knife_ramp"), ("s", 3, "handheld_ramp"), ("c", 7, "kitchen_knife"), ("c", 7, "cuchillo de cocina"), ("c", 8, "flashlight"), ("c", None, None), ("c", 9, "---")]


@pytest.mark.parametrize("field,value,want", [
    ("s", "Blades Chapel (new)", 1), ("s", "chapel blades", 1), ("s", "blaeds_chapl", 1), ("s", "bl" + chr(0x430) + "des_chap" + chr(0xE9) + "l", 1), ("s", "blades ch.", 1), ("s", "knife_tamp", 2), ("s", "kn1fe_ramp v2", 2), ("s", "  knife\xa0ramp\t", 2), ("s", "ramp", -1),
    ("s", "guns_yard", -1), ("s", "n/a", -1), ("s", "?", -1), ("c", "Cuchillo De Cocian", 7), ("c", "f1ash1ight", 8), ("c", "door", -1), ("c", "knife kitchen bbox", 7), ("other", "blades_chapel", -1),
])
def test_values_are_mapped(spark, field, value, want):
    refs = spark.createDataFrame(REFS, "field string, ref_id long, name string").withColumn("value", F.lit("clash"))
    values = spark.createDataFrame([(field, value), (field, value), (field, None), (None, value), (field, " ")], "field string, value string").withColumn("ref_id", F.lit(1))
    assert [(r["value"], r["ref_id"]) for r in canonical.map_values(values, refs).collect()] == [(value, want)]


def test_threshold_and_margin_decide(spark):
    refs = spark.createDataFrame(REFS, "field string, ref_id long, name string")
    values = spark.createDataFrame([("s", v) for v in ("blaeds_chapl", "ramp", "yard of guns", "knife ramp 2nd upload")], "field string, value string")
    found = lambda **k: {r["value"]: r["ref_id"] for r in canonical.map_values(values, refs, **k).collect()}
    assert found() == {"blaeds_chapl": 1, "ramp": -1, "yard of guns": -1, "knife ramp 2nd upload": 2}
    assert set(found(least=0.95).values()) == {-1} and set(found(margin=0.9).values()) == {-1}
    assert found(least=0.0, margin=0.0)["ramp"] in (2, 3)


def test_no_values_or_no_references(spark):
    refs = spark.createDataFrame(REFS, "field string, ref_id long, name string")
    values = spark.createDataFrame([("s", "blades_chapel")], "field string, value string")
    assert canonical.map_values(values.where("false"), refs).count() == 0
    assert canonical.map_values(values, refs.where("false")).first()["ref_id"] == -1


PROSE = "The gate near the stairs was closed because nobody had moved the camera. One of the late visits came after noon, and the note about it was lost. We saw them again when the lights were on in the hall. "
TERMS = "cheap smart lock, best smart lock, smart lock sale, buy smart lock, smart lock price, smart lock free, new smart lock, smart lock offer, top smart lock, used smart lock, "


CASES = [
    (PROSE, False), (PROSE * 8, False), (TERMS, True), (TERMS * 5, True), (PROSE * 2 + TERMS, False), (PROSE + TERMS * 4, True),
    ("https://a.test/x1\nhttp://b.test/y2\nhttps://c.example/z?r=1\n", True), (PROSE + "\nhttps://a.test/x1", False),
    ("* [top lock](http://a.test/1)\n* [buy lock](http://b.test/2)\n* [new lock](http://c.test/3)\n", True),
    ("\n".join(f"[{i}] {x.strip()} https://a.test/{i}" for i, x in enumerate((PROSE + "It was not far from the old wall of the yard. The guards had left for the day before that. ").split(". ")[:5])), False),
    ("#buylock #bestlock #cheaplock #locksale #lockoffer", True), ("Ost Smart Lock XL906 EUR 702.17 | Wen Smart Lock S12 EUR 11.50 | Tar Smart Lock II44 $90.00 | Hol Smart Lock $8.20 | Lem Door Lock $7.10 | Bra Smart Lock $12.00", True),
    ("Looking for smart lock? Our smart lock is the smart lock you want. " * 6, True), ("".join(f"Round {i}. {PROSE}\n" for i in range(6)), False),
    ("ts,id,level\n" + "".join(f"2024-01-{i:02d}T10:00:00,{i},3,SAFE,\"guns\",0.{i}\n" for i in range(10, 28)), False),
    ("".join(f"def f_{i}(x, limit=5):\n    if len(x) > limit:\n        return x[-{i}:]\n    return None\n\n" for i in range(8)), False),
    ("Class counts: shotgun 51 - machete 19 - laptop 42 - wrench 79 - purse 8 - dagger 6 - crowbar 27", False), ("ok", False),
]


NOUNS = [a + b for a in ("gate", "lamp", "hall", "note", "stair", "track", "crowd", "frame", "bus", "door", "clip", "score", "guard", "wall") for b in ("", "s", "way", "side", "line", "yard", "house", "man")]
LITTLE = "the of a in and to on with was for by at from that it had near under while because not this which our".split()


def _prose(r, n, little=LITTLE):
    """Running text of one to three stretches: some four words in ten are function words."""
    def sentence():
        return " ".join(r.choice(little) if r.random() < 0.42 else r.choice(NOUNS) for _ in range(r.randint(7, 14))).capitalize() + r.choice([". ", ". ", " 12. ", ", 3.4. "])
    return ["".join(sentence() for _ in range(r.randint(5, 12))) for _ in range(n)]


def test_spam_is_what_is_far_off_in_a_spam_direction(spark):
    texts = _prose(random.Random(3), 120) + [t for t, _ in CASES]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {x["doc_id"] - 120 for x in spam.spam_pages(df).collect()}
    wrong = [t[:60] for i, (t, want) in enumerate(CASES) if (i in got) != want]
    assert not wrong and min(got) >= 0


def test_distance_and_direction_decide(spark):
    texts = _prose(random.Random(3), 120) + [t for t, _ in CASES]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    real = spam.spam_pages(df).count()
    assert spam.spam_pages(df, spread=-1e3, least=0.0).count() > real and spam.spam_pages(df, direction=0.0).count() > real


def _stuffed(term):
    return " ".join(f"{term} {x} w{term}{j} {f}" for j in range(10) for x, f in ((f"u{term}{j}", "for"), (f"{term}", "in"))) + ". "


def test_stuffing_counts_whatever_the_length_of_the_page(spark):
    pages = ["".join(_stuffed(f"term{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(n)) for n in (1, 5, 20, 60)]
    texts = _prose(random.Random(3), 400) + pages
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert {x["doc_id"] for x in spam.spam_pages(df).collect()} == {400, 401, 402, 403}


@pytest.mark.parametrize("seed", range(6))
def test_stretches_hold_the_whole_text(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word ", "a", "\n", " ", "x" * 900, "\r\n", chr(0x3000)]) for _ in range(400))
    got = spam.stretches(text)
    assert "".join("".join(x.split()) for x in got) == "".join(text.split())
    assert all(spam.visible(x) <= 3 * spam.STRETCH for x in got) and all(x.strip() for x in got)


@pytest.mark.parametrize("text,want", [
    ("the gate and the stairs", (19, [0.6, 1.0, 0.0, 0, 0, 0, 0])), ("gate gate gate", (12, [0.0, 0.0, 1.0, 0, 0, 0, 0])), ("12 34", (4, [0.0, 1.0, 0.0, 0, 0, 1, 0])),
    ("https://a.museum/x", (18, [0.0, 1.0, 0.0, 1, 0, 0, 0])), ("shop.museum", (11, [0.0, 1.0, 0.0, 1, 0, 0, 0])), ("#one #two", (8, [0.0, 1.0, 0.0, 0, 1, 0, 0])), ("++ --", (4, [0.0, 1.0, 0.0, 0, 0, 0, 1])),
])
def test_features_of_plain_cases(text, want):
    assert spam.features_of(text, "en") == ("en", [want])


def test_spam_pages_of_a_corpus(spark):
    r = random.Random(1)
    rows = [(i, t, r.choice(["en", "EN", None, "xx"])) for i, t in enumerate(_prose(r, 200))]
    rows += [(1000, TERMS * 3, "en"), (1000, TERMS * 3, "en"), (1001, None, "en"), (1002, " \n", "en"), (1003, "", None), (1004, " ".join(_prose(r, 2000)), "en"), (None, TERMS * 3, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("distance", F.lit(1)).withColumn("size", F.lit("clash"))
    assert [x["doc_id"] for x in spam.spam_pages(df).collect()] == [1000]
    assert spam.spam_pages(df.where("false")).count() == 0 and spam.spam_pages(df.where("doc_id = 1003")).count() == 0


@pytest.mark.parametrize("clean,spam_rows", [(130, 70), (60, 140), (3, 40), (0, 40)])
def test_spam_is_found_whatever_its_share_of_a_language(spark, clean, spam_rows):
    r = random.Random(2)
    links = "https://a.test/x1\nhttp://b.test/y2\nhttps://c.example/z?r=1\n"
    for copies in (True, False):
        rows = [(i, t, "en") for i, t in enumerate(_prose(r, clean))]
        rows += [(1000 + i, links if copies else links + f"https://d.test/{i}\n", "en") for i in range(spam_rows)]
        rows += [(5000 + i, t, "es") for i, t in enumerate(_prose(r, 20, "el la de los en y un que no se con por para su".split()))]
        got = {x["doc_id"] for x in spam.spam_pages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
        assert got == set(range(1000, 1000 + spam_rows))


def test_centre_and_distance_are_those_of_numpy(spark):
    r = np.random.default_rng(0)
    x = np.clip(r.normal(size=(400, 2)) @ np.array([[60.0, 30.0], [0.0, 50.0]]) + 500, 0, 1000).round().astype(int)
    df = spark.createDataFrame([("g", int(a), int(b)) for a, b in x], "lang string, a int, b int")
    mean, cov = spam.robust_centres(df, ["a", "b"], {"a": 1e-9, "b": 1e-9}, keep=1e9)["g"]
    assert np.allclose(mean, x.mean(axis=0) / 1000) and np.allclose(cov, np.cov(x.T, bias=True) / 1e6)


@pytest.mark.parametrize("seed", range(5))
def test_cone_part_is_that_of_a_fine_search(seed):
    r = np.random.default_rng(seed)
    axes, y = r.normal(size=(3, 2)), r.normal(size=(20, 3))
    got = spam.spamward_part(y, axes)
    turn = np.linspace(0, np.pi / 2, 20001)
    ways = np.stack([np.cos(turn), np.sin(turn)], axis=1) @ axes.T
    ways /= np.linalg.norm(ways, axis=1)[:, None]
    assert np.allclose(np.maximum(y @ ways.T, 0).max(axis=1) ** 2, got, atol=1e-3)
