"""Problem 9: keyword-stuffed and link-list pages."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.workspace import Workspace

# Function words of the corpus' languages.
FUNCTION_WORDS = {
    "en": "a about above across after against all along also although an and any are as at be because been before behind below beneath beside between beyond both but by can could did do does down during each either else ever every few for from further had has have he her here hers him his how however i if in inside into is it its itself just many may me might more most much must my near neither no nobody none nor not of off on once one only onto opposite or other our ours out outside over own past per rather same shall she should since so some still such than that the their theirs them then there these they this those though through till to too toward under unless until up upon us very was we were what when where whereas whether which while who whom whose why will with within without would yet you your yours",
    "es": "a al algo alguno ante antes aquel aunque así bajo bien cada casi como con contra cual cuando cuanto de del desde después donde dos durante e el ella ellos en entre era eran es esa ese eso esta estaba están estar este esto estos fue fueron ha había hacia han hasta hay junto la las le les lo los luego mas me mi mientras muy más ni no nos nosotros nuestro o os otra otro para pero poco por porque pues que quien qué se sea según ser si sido sin sobre solo son su sus sí sólo también tan tanto te tiene todo todos tras tu un una uno unos u y ya yo",
    "de": "aber alle allem allen aller alles als also am an andere auch auf aus bei beim bin bis bist da damit dann darum das dass dasselbe dein dem den denn der des desselben dessen die dies diese diesem diesen dieser dieses doch dort durch ein eine einem einen einer eines er erst es etwas euch für gegen gewesen hab habe haben hat hatte hatten hier hinter ich ihm ihn ihnen ihr ihre ihrem ihren im in ins ist ja jede jedem jeden jeder jedes kann kein keine können mehr mein mich mir mit muss nach nahe neben nicht nichts noch nun nur ob obwohl oder ohne sehr sein seine seinem seinen seiner seit sich sie sind so solche soll sondern sonst um und uns unser unter vom von vor während war waren was weil weiter welche wenn wer werde werden wie wieder will wir wird wo wurde wurden zu zum zur zwar zwischen über",
    "fr": "a ai après au aucun aussi autre aux avaient avait avant avec avoir bien car ce cela ces cet cette chaque chez comme d dans de depuis des deux devant dont donc du déjà elle elles en encore entre est et étaient était être eu eux fait font hors il ils j je jusque l la le les leur leurs lors lui là m mais me mes moins mon même n ne ni non nos notre nous on ont ou où par pas pendant peu plus pour pourquoi près puis qu quand que quel quelle qui quoi s sa sans se ses si sien son sont sous sur t ta tandis te tes toi ton toujours tous tout toute très trop tu un une vers voici voilà vos votre vous y à ça",
}

FEATURES = ["function", "entropy", "repeated", "links", "marks", "numbers", "symbols"]
#: Spread of a feature below which differences between stretches of some forty words are noise.
FLOOR = {"function": 0.05, "entropy": 0.05, "repeated": 0.1, "links": 0.1, "marks": 0.05, "numbers": 0.03, "symbols": 0.02}
#: Which way each feature goes in spam. Numbers and symbols go their own way, that of logs, tables, settings and code.
SPAMWARD = {"function": -1, "entropy": -1, "repeated": 1, "links": 1, "marks": 1}
#: Visible characters of a stretch.
STRETCH = 240
#: A content word is repeated if it comes again among so many content words.
NEAR = 6
#: A stretch with this share of function words is running text, of which the estimates are made.
RUNNING = 0.2
#: Visible characters by which a short stretch is drawn to the centre.
PRIOR = 48
#: Upper 0.1 % point of chi-square with as many degrees of freedom as there are features.
LEAST_CUT = 24.322
#: Features are kept in thousandths, so that their medians are exact over all stretches and come from small counts.
UNIT = 1000

_BIT = {k: 1 << i for i, k in enumerate(FUNCTION_WORDS)}
_MASK: dict[str, int] = {}
for _k, _v in FUNCTION_WORDS.items():
    for _w in _v.split():
        _MASK[_w] = _MASK.get(_w, 0) | _BIT[_k]
_LINK = re.compile(
    r"<[^<>]*(?:https?://|www\.)[^<>]*>|(?:\]\()?(?:https?://|www\.)[^\s<>\"')\]]+\)?|(?<![\w@./-])[a-z0-9](?:[a-z0-9-]*\.)+[a-z]{2,}(?![\w(=.-])(?:/[^\s<>\"')\]]*)?", re.I)
_MAYBE_LINK = re.compile(r"\.[A-Za-z]{2}|://|www\.", re.I)
_MAYBE_MARK = re.compile(r"[#$\xa3€]|EUR|USD|GBP")
_TAG = re.compile(r"<[^<>]*>")
_MARK = re.compile(r"#[^\W\d_]\w*|(?:EUR|USD|GBP|[$\xa3€])\s?\d[\d.,]*|\d[\d.,]*\s?(?:EUR|USD|GBP|[$\xa3€])")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?\d*|\d[\d.,:/-]*|_+")


def visible(text: str) -> int:
    return sum(map(len, text.split()))


def stretches(text: str, width: int = STRETCH) -> list[str]:
    """The text in stretches of about ``width`` visible characters: whole lines, and long lines cut between words."""
    out: list[str] = []
    now: list[str] = []
    size = 0
    for line in text.splitlines():
        words = line.split()
        n = sum(map(len, words))
        if not n:
            continue
        pieces = [(line, n)]
        if 2 * n > 3 * width:
            goal, pieces, part, m = n / round(n / width), [], [], 0
            for word in words:
                for a in range(0, len(word), 2 * width):
                    part.append(word[a : a + 2 * width])
                    m += len(part[-1])
                    if m >= goal:
                        pieces.append((" ".join(part), m))
                        part, m = [], 0
            if part:
                pieces.append((" ".join(part), m))
        for piece, m in pieces:
            if size and 2 * (size + m) > 3 * width:
                out.append("\n".join(now))
                now, size = [], 0
            now.append(piece)
            size += m
            if size >= width:
                out.append("\n".join(now))
                now, size = [], 0
    if now:
        rest = "\n".join(now)
        if out and 3 * size < width:
            out[-1] += "\n" + rest
        else:
            out.append(rest)
    return out


def language_of(words: Counter, lang: str | None = None) -> tuple[str, int]:
    """The language of which most function words occur, and the mask of all languages used.

    ``lang`` holds unless another language has clearly more, so a text with hardly any function word keeps it.
    """
    hits = dict.fromkeys(_BIT, 0)
    for w, n in words.items():
        of = _MASK.get(w)
        if of:
            for k, bit in _BIT.items():
                if of & bit:
                    hits[k] += n
    best, lang = max(hits.values()), (lang or "").lower()
    own = lang if lang in hits and hits[lang] + 3 >= 0.8 * best else max(hits, key=lambda k: (hits[k], k == "en"))
    return own, _BIT[own] | sum(bit for k, bit in _BIT.items() if hits[k] >= max(3, 0.25 * best))


def shares_of(stretch: str) -> tuple[int, list[str], list[float]]:
    """Visible characters, words, and the shares of links, marks, numbers and symbols in a stretch."""
    links = marks = 0
    bare = stretch
    if _MAYBE_LINK.search(bare):
        links = visible(bare) - visible(bare := _LINK.sub(" ", bare))
    if "<" in bare:
        bare = _TAG.sub(" ", bare)
    n = visible(bare)
    size = max(1, n + links)
    if _MAYBE_MARK.search(bare):
        marks = n - visible(bare := _MARK.sub(" ", bare))
    words, letters, digits = [], 0, 0
    for w in _TOKEN.findall(bare.lower()):
        if w[0].isalpha():
            words.append(w)
            letters += len(w)
        elif w[0] != "_":
            digits += len(w)
    symbols = max(0, size - links - marks - digits - letters)
    return size, words, [links / size, marks / size, digits / size, symbols / size]


def densities_of(words: list[str], mask: int) -> list[float]:
    """Share of function words, entropy of the others (1 where all differ), and share of them that come again within ``NEAR``."""
    content = [w for w in words if not _MASK.get(w, 0) & mask]
    m, at = len(content), {}
    if m < 2:
        return [1 - m / len(words) if words else 0.0, 1.0, 0.0]
    again, repeats = set(), False
    for k, w in enumerate(content):
        j = at.get(w)
        if j is not None:
            repeats = True
            if k - j <= NEAR:
                again.add(j)
                again.add(k)
        at[w] = k
    entropy = -sum(c / m * math.log2(c / m) for c in Counter(content).values()) / math.log2(m) if repeats else 1.0
    return [1 - m / len(words), entropy, len(again) / m]


def features_of(text: str, lang: str | None = None) -> tuple[str, list[tuple[int, list[float]]]]:
    """Language of a text, and visible characters and the plain densities, each from 0 to 1, of each of its stretches."""
    parts = [shares_of(s) for s in stretches(text)]
    own, mask = language_of(Counter(chain.from_iterable(words for _, words, _ in parts)), lang)
    return own, [(size, densities_of(words, mask) + shares) for size, words, shares in parts]


def text_features(docs: DataFrame) -> DataFrame:
    """A row per stretch of each document with visible text: doc_id, text_hash, part, lang, size and the features in thousandths."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "part", "lang", "size", *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, langs, parts, sizes, values = [], [], [], [], []
            for row, (text, lang) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                own, found = features_of(text, lang)
                for k, (size, x) in enumerate(found):
                    of.append(row)
                    parts.append(k)
                    langs.append(own)
                    sizes.append(size)
                    values.append(x)
            x = np.rint(np.array(values or np.zeros((0, len(FEATURES)))) * UNIT).astype(np.int16)
            take = pa.array(of, pa.int64())
            cols = [b.column(0).take(take), b.column(3).take(take), pa.array(parts, pa.int32()), pa.array(langs, pa.string()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(x[:, i]) for i in range(len(FEATURES))], names)

    rows = docs.where("doc_id is not null and text is not null").where(F.col("text").rlike(r"\S"))
    rows = rows.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, part int, lang string, size int, {', '.join(f'{f} short' for f in FEATURES)}")


def middle(counts: dict[int, int]) -> float:
    """Lower median of values by their counts."""
    half, upto = (sum(counts.values()) + 1) // 2, 0
    for v in sorted(counts):
        upto += counts[v]
        if upto >= half:
            return v
    raise ValueError("no values")


def robust_centres(rows: DataFrame, columns: list[str], floor: dict[str, float], group: str = "lang", keep: float = 3.0, unit: int = UNIT) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Centre and covariance of each group of ``rows``, and of all rows together under None.

    Medians and median deviations (at least ``floor``) come first and hold while less than half of the rows are of
    another kind; rows within ``keep`` such spreads in every column then give mean and covariance, whose variances are
    raised to the floors. ``columns`` are whole numbers, ``unit`` to one, so medians are exact and come from one count per group,
    column and value; only counts and sums come to the driver, whose number is bounded by groups and values, not by rows.
    """
    long = rows.select(group, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("int").alias("v")) for i, c in enumerate(columns)])).alias("x"))
    seen: dict[tuple[str | None, int], Counter] = {}
    for r in long.groupBy(group, "x.i", "x.v").agg(F.count("*").alias("n")).collect():
        for g in (r[group], None):
            seen.setdefault((g, r["i"]), Counter())[r["v"]] += r["n"]
    low = np.array([floor[c] for c in columns]) * unit
    near: dict[str | None, list[tuple[float, float]]] = {}
    for g in {g for g, _ in seen}:
        box = []
        for i, least in enumerate(low):
            m = middle(seen[g, i])
            off: Counter = Counter()
            for v, n in seen[g, i].items():
                off[abs(v - m)] += n
            s = keep * max(1.4826 * middle(off), least)
            box.append((m - s, m + s))
        near[g] = box
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    k = len(columns)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    x = [F.col(c) / F.lit(float(unit)) for c in columns]
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(x[a] * x[b]).alias(f"p{a}_{b}") for a, b in pairs]]

    def estimate(r) -> tuple[np.ndarray, np.ndarray]:
        mean = np.array([r[f"s{i}"] for i in range(k)]) / r["n"]
        cov = np.zeros((k, k))
        for a, b in pairs:
            cov[a, b] = cov[b, a] = r[f"p{a}_{b}"] / r["n"] - mean[a] * mean[b]
        return mean, cov + np.diag(np.maximum((low / unit) ** 2 - np.diag(cov), 0.0))

    def inside(box: list[tuple[float, float]]) -> Column:
        ok = F.lit(True)
        for c, (lo, hi) in zip(columns, box):
            ok &= F.col(c).between(lo, hi)
        return ok

    if near:
        own = F.lit(False)
        for g, box in near.items():
            if g is not None:
                own |= (F.col(group) == g) & inside(box)
        for r in rows.where(own).groupBy(group).agg(*sums).collect():
            out[r[group]] = estimate(r)
        out[None] = estimate(rows.where(inside(near[None])).agg(*sums).first())
    return out


def spamward_part(y: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Squared length of the part of each row of ``y`` that lies in the cone of the columns of ``axes``.

    The nearest point of the cone is the projection on some set of axes with no negative share, and the longest such
    projection.
    """
    k = axes.shape[1]
    best = np.zeros(len(y))
    for r in range(1, k + 1):
        for s in combinations(range(k), r):
            a = axes[:, s]
            share = y @ np.linalg.pinv(a).T
            length = ((share @ a.T) ** 2).sum(axis=1)
            best = np.where((share >= 0).all(axis=1) & (length > best), length, best)
    return best


def distances(rows: DataFrame, model: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``rows`` of :func:`text_features` with ``distance``, the squared Mahalanobis distance from the centre of the
    language (of all, where it has none), and ``direction``, the share of it that is spamward.

    A short stretch is drawn to the centre as by ``PRIOR`` characters of ordinary text.
    """
    names = ["doc_id", "text_hash", "part", "lang", "size", "function", "distance", "direction"]
    ready = {}
    for g, (mean, cov) in model.items():
        whiten = np.linalg.inv(np.linalg.cholesky(cov))
        ready[g] = mean, whiten, np.stack([whiten[:, FEATURES.index(f)] * sign for f, sign in SPAMWARD.items()], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(names.index("size") + 1 + i).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))], axis=1) / UNIT
            size, lang = b.column(4).to_numpy(zero_copy_only=False), np.array(b.column(3).to_pylist(), object)
            far, way = np.zeros(len(x)), np.zeros(len(x))
            for g in set(lang.tolist()):
                at = np.flatnonzero(lang == g)
                mean, whiten, axes = ready.get(g, ready[None])
                y = (x[at] - mean) @ whiten.T
                d = (y**2).sum(axis=1)
                far[at] = d * (size[at] / (size[at] + PRIOR)) ** 2
                way[at] = spamward_part(y, axes) / np.maximum(d, 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(6)] + [pa.array(far), pa.array(way)], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select(*names[:5], *FEATURES).mapInArrow(run, f"doc_id {kind}, text_hash long, part int, lang string, size int, function short, distance double, direction double")


def spam_pages(docs: DataFrame, spread: float = 3.0, direction: float = 0.7, least: float = LEAST_CUT, share: float = 0.5) -> DataFrame:
    """doc_id, lang, distance (the largest of a spam stretch), spam_share and cut of the pages that are spam.

    ``docs``: doc_id, text, lang. Null, empty and blank texts are no spam, nor are rows without doc_id; a null or wrong
    lang is replaced by what the text shows; repeated rows count once; of different texts under one doc_id one spam text
    is enough; copies of a text count once in the statistics; an empty table gives no row.

    Method: texts are cut into stretches of about ``STRETCH`` visible characters. Robust centre and covariance of plain
    densities (:func:`features_of`) are estimated per language over the running text of the whole corpus, that is the
    stretches with ``RUNNING`` function words or more, so lists of any number can't become the centre and stuffed
    sentences only if they are half of it. A stretch is spam if its squared Mahalanobis distance lies beyond the cut and
    ``direction`` of it lies in the cone of the spam directions (``SPAMWARD``). The cut is, per language, the
    median of the logarithms of the distances of running text plus ``spread`` median deviations, and ``least`` or more. A page is spam if more than
    ``share`` of its visible characters stand in spam stretches. A corpus without any running text has no centre and
    gives no row.
    """
    ws = Workspace(docs.sparkSession)
    rows = ws.table(text_features(docs))
    once = rows.where(F.col("function") >= RUNNING * UNIT).dropDuplicates(["text_hash", "part"])
    model = robust_centres(once, FEATURES, FLOOR)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not model:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, lang string, distance double, spam_share double, cut double")
    far = ws.table(distances(rows, model))
    # Logarithms in hundredths: their counts are as few as those of the features.
    log = F.round(F.log(F.greatest("distance", F.lit(1e-6))) * 100).cast("int")
    counts: dict[str | None, Counter] = {}
    running = far.where(F.col("function") >= RUNNING * UNIT).select("lang", "text_hash", "part", log.alias("v")).dropDuplicates(["text_hash", "part"])
    for r in running.groupBy("lang", "v").agg(F.count("*").alias("n")).collect():
        for g in (r["lang"], None):
            counts.setdefault(g, Counter())[r["v"]] += r["n"]
    cuts = {}
    for g, c in counts.items():
        m = middle(c)
        off: Counter = Counter()
        for v, n in c.items():
            off[abs(v - m)] += n
        cuts[g] = max(least, math.exp((m + spread * 1.4826 * middle(off)) / 100))
    cut = F.lit(cuts[None])
    for g, v in cuts.items():
        if g is not None:
            cut = F.when(F.col("lang") == g, F.lit(v)).otherwise(cut)
    rows = far.withColumn("cut", cut).withColumn("bad", (F.col("distance") > F.col("cut")) & (F.col("direction") >= direction))
    page = rows.groupBy("doc_id", "text_hash").agg(
        F.first("lang").alias("lang"), F.max(F.when(F.col("bad"), F.col("distance"))).alias("distance"), F.first("cut").alias("cut"),
        (F.sum(F.when(F.col("bad"), F.col("size")).otherwise(0)) / F.sum("size")).alias("spam_share"))
    found = page.where(F.col("spam_share") > share).groupBy("doc_id").agg(F.max(F.struct("spam_share", "distance", "lang", "cut")).alias("p"))
    return found.select("doc_id", "p.lang", "p.distance", "p.spam_share", "p.cut")
