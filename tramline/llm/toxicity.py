"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A window (one word,
punctuation aside, tiled so that a short one still makes a compressed block) that compresses far
better with the toxic dictionary than with the ordinary one speaks for toxicity. How much a pair of
lengths speaks is calibrated: each cell (window length, toxic length, ordinary length) gets the log
ratio of its rates in toxic and in ordinary documents, and a logistic function of the document's
strongest windows gives the score.

The dictionaries' contents are trained by contrast: distinct contexts of each word (so that copies
of one document count once) are counted in toxic and in ordinary documents; the words that a
likelihood-ratio test finds to be commoner in toxic ones form the toxic dictionary, the commonest
others the ordinary one.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import settle, small, table

#: The labelled rows of each class that training reads, about; a hash of doc_id picks them.
SAMPLE_PER_CLASS = 8_000
TOXIC_WORDS, ORDINARY_WORDS = 2_000, 100_000
#: A word joins the toxic dictionary at this likelihood ratio or more (p about 0.005), in 2 contexts or more.
LEAST_RATIO = 8.0
TILES = 4
WINDOW_BYTES = 64
THRESHOLD = 0.7
HELD_OUT = 1
_CACHE = 300_000
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_CELL = (24, 120)


def windows(text: str | None) -> list[bytes]:
    """The windows of a text: lower-cased words without ASCII punctuation, those over 64 bytes in pieces. Null: none."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()
    if all(len(w) <= WINDOW_BYTES for w in words):
        return words
    return [w[i : i + WINDOW_BYTES] for w in words for i in range(0, len(w), WINDOW_BYTES)]


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    cells: tuple[tuple[tuple[int, int, int], float], ...] = ()
    weights: tuple[float, ...] = ()

    @property
    def key(self) -> str:
        return hashlib.sha256(repr((self.toxic, self.ordinary, self.cells, self.weights)).encode()).hexdigest()


class Scorer:
    """A model at work in one process. Lengths and weights of windows are kept for up to _CACHE words."""

    def __init__(self, model: Model):
        self.model, self.cells = model, dict(model.cells)
        self.with_toxic, self.with_ordinary = _compressor(model.toxic), _compressor(model.ordinary)
        self.kept: dict[bytes, float] = {}

    def cell(self, window: bytes) -> tuple[int, int, int]:
        tiled = (b" " + window + b" ") * TILES
        longest, most = _CELL
        return min(len(window), longest), min(most, len(self.with_toxic.compress(tiled))), min(most, len(self.with_ordinary.compress(tiled)))

    def weight(self, window: bytes) -> float:
        found = self.kept.get(window)
        if found is None:
            if len(self.kept) >= _CACHE:
                self.kept.clear()
            found = self.kept[window] = self.cells.get(self.cell(window), 0.0)
        return found

    def features(self, text: str | None) -> list[float]:
        """Strongest and second window, density and numbers of windows that speak for toxicity."""
        every = windows(text)
        get, weight = self.kept.get, self.weight
        strong = sorted((v for w in every if (v := (get(w) if (got := get(w)) is not None else weight(w))) > 0.5), reverse=True)
        n = len(every)
        over = sum(v > 1 for v in strong)
        return [
            strong[0] if strong else 0.0,
            strong[1] if len(strong) > 1 else 0.0,
            50.0 * sum(v for v in strong if v > 1) / (n + 20),
            math.log1p(over),
            math.log1p(sum(v > 2 for v in strong)),
            math.log1p(len(strong)) / math.log(n + 10),
        ]

    def score(self, text: str | None) -> float:
        """0 to 1, rising with toxicity."""
        at = sum(a * b for a, b in zip(self.model.weights, [*self.features(text), 1.0]))
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, at))))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=4, strategy=zstandard.STRATEGY_BTLAZY2)
    # The last bytes of a dictionary are not indexed, so blanks follow the content.
    trained = zstandard.ZstdCompressionDict(b" " + content + b" " * 16, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=how)


_SCORERS: dict[str, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    if (key := model.key) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


# ---- training ----


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(text, toxic, half): about per_class labelled documents of each class outside the held-out fold.

    half 0 trains the dictionaries, half 1 calibrates. An id with several labels is toxic if one
    says so; one with several texts gives one row, the least of them. So the labels' bound holds for
    what the driver reads, too.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    spot = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20))
    rate = F.coalesce(*[F.when(F.col("toxic") == c, F.lit(per_class / n)) for c, n in sizes.items()], F.lit(0.0))
    picked = known.where(spot < rate * (1 << 20)).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    seen = docs.select("doc_id", "text").join(small(settle(picked), 4 * per_class), "doc_id")
    return seen.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("half").alias("half")).select("text", "toxic", "half")


def train_dictionaries(sample: DataFrame) -> Model:
    """The two dictionaries, from the sample's half 0."""

    def contexts(batches):
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = windows(text)
                around = [b"", *words, b""]
                marks = [xxhash.xxh3_64_intdigest(b" ".join(around[i : i + 3])) - (1 << 63) for i in range(len(words))]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(marks, pa.int64()), pa.array([toxic] * len(words), pa.int32())], names=["word", "mark", "toxic"])

    seen = sample.where("half = 0").select("text", F.col("toxic").cast("int")).mapInArrow(contexts, "word binary, mark long, toxic int").distinct()
    counts = settle(seen.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")))
    total = counts.agg(F.sum("a"), F.sum("b")).first()
    toxic_n, ordinary_n = float(total[0] or 0), float(total[1] or 0)
    if not toxic_n or not ordinary_n:
        return Model(b"", b"")
    n = F.col("a") + F.col("b")
    share = toxic_n / (toxic_n + ordinary_n)
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    ratio = 2 * (part(F.col("a"), n * share) + part(F.col("b"), n * (1 - share)))
    leans = (F.col("a") >= 2) & (F.col("a") / toxic_n > 4 * F.col("b") / ordinary_n) & (ratio >= LEAST_RATIO)
    toxic = counts.where(leans).orderBy(ratio.desc(), "word").limit(TOXIC_WORDS).select("word").collect()
    ordinary = counts.where(~leans & (F.col("b") > 0)).orderBy(F.desc("b"), "word").limit(ORDINARY_WORDS).select("word").collect()
    # zstandard reaches the end of a dictionary most cheaply: the strongest words stand last.
    return Model(b" ".join(bytes(r[0]) for r in reversed(toxic)), b" ".join(bytes(r[0]) for r in reversed(ordinary)))


def calibrate(sample: DataFrame, model: Model) -> Model:
    """model with the cells' weights and the logistic function, from the sample's half 1."""
    rest = sample.where("half = 1").select("text", F.col("toxic").cast("int"))

    def count(batches):
        at = _scorer(model)
        for batch in batches:
            sums: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in set(windows(text)):
                    sums[toxic, *at.cell(w)] += 1
            if sums:
                columns = [pa.array(c, pa.int32()) for c in zip(*sums)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sums.values(), pa.int64())], names=["toxic", "x", "y", "z", "n"])

    got = rest.mapInArrow(count, "toxic int, x int, y int, z int, n long").groupBy("toxic", "x", "y", "z").agg(F.sum("n").alias("n")).collect()
    per: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for r in got:
        per[r["toxic"]][r["x"], r["y"], r["z"]] = r["n"]
    toxic_n, ordinary_n = sum(per[1].values()), sum(per[0].values())
    if not toxic_n or not ordinary_n:
        return Model(model.toxic, model.ordinary, (), (0.0,) * 6 + (-5.0,))
    few, share = 2.0, toxic_n / (toxic_n + ordinary_n)
    weigh = lambda k: math.log((per[1][k] + few * share) / (toxic_n + few)) - math.log((per[0][k] + few * (1 - share)) / (ordinary_n + few))
    model = Model(model.toxic, model.ordinary, tuple(sorted((k, weigh(k)) for k in {*per[0], *per[1]})))

    def featured(batches):
        at = _scorer(model)
        for batch in batches:
            rows = [at.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sorted((r["toxic"], tuple(r["x"])) for r in rest.mapInArrow(featured, "toxic int, x array<double>").collect())
    return Model(model.toxic, model.ordinary, model.cells, _logistic(np.array([x for _, x in rows]), np.array([t for t, _ in rows], float)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights (the last one constant) of a ridge logistic regression by Newton's method.

    Features that would count against toxicity are left out, so that a score never falls with a
    stronger window.
    """
    middle, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - middle) / spread, np.ones(len(x))]
    use = np.ones(x.shape[1] + 1, bool)
    while True:
        part, w = z[:, use], np.zeros(use.sum())
        hold = ridge * np.r_[np.ones(use.sum() - 1), 1e-6]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -50, 50)))
            step = np.linalg.solve((part * (p * (1 - p))[:, None]).T @ part + np.diag(hold), part.T @ (y - p) - hold * w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        every = np.zeros(len(use))
        every[use] = w
        if (every[:-1] >= 0).all():
            break
        use[:-1] &= every[:-1] > 0
    slopes = every[:-1] / spread
    return (*map(float, slopes), float(every[-1] - slopes @ middle))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from the labelled documents outside the held-out fold. Without both classes it scores all alike, low."""
    sample = settle(training_sample(docs, labels, per_class))
    return calibrate(sample, train_dictionaries(sample))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row from its whole text, however long. Null and empty texts have the score of no evidence;
    null and repeated ids and repeated rows are rows like any other; other columns are not read; an empty table gives an empty result."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        at = _scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(at.score, batch.column(1).to_pylist()), pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
