"""Quality classification with hierarchical empirical Bayes over sites.

A logistic classifier gives each document evidence from its own text. Hosts and the paths below
them have rates of good documents; each path's rate is shrunk towards its host's, and each host's
towards the global rate, by strengths estimated from the spread between groups (method of moments),
so that sparse sites stay near their prior. A document's posterior adds its own evidence to the
log odds of its path's rate; the document itself is left out of the path, the host and the total.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import let, settle, small, table, text_of, words_of
from tramline.llm.rules import SYMBOLS

#: The labelled rows that the classifier is fitted on, about; a hash of doc_id picks them.
SAMPLE = 20_000
#: A site table up to this many rows is sent to all executors; a larger one is joined by a shuffle.
SMALL_SITES = 10_000
KEEP = 0.5
#: A prior weighs at least so many documents. Sites of one document tell nothing of the spread within sites.
LEAST_PRIOR = 1.0
#: Bounds on a path's rate, so that a site alone never decides.
RATES = (0.05, 0.95)
_WHITE = " \t\n\x0b\f\r"
N_FEATURES = 7


def features(text: Column) -> Column:
    """Shares of symbols, capitals, repeated lines and repeated words, word length, and length in words, as an array."""
    dropped = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    chars = F.greatest(F.lit(1), F.char_length(F.translate(text, _WHITE, "")))
    words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    lines = let(F.split(text, "\n"), lambda x: 1 - F.size(F.array_distinct(x)) / F.size(x))
    return let(
        words,
        lambda w: F.array(
            F.least(F.lit(0.3), dropped(SYMBOLS) / chars),
            dropped("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars,
            lines,
            F.coalesce(1 - w["d"] / F.nullif(w["n"], F.lit(0)), F.lit(0.0)),
            F.greatest(F.lit(0.0), 1 - w["d"] / F.greatest(F.lit(1), w["n"]) - 0.5),
            F.least(F.lit(20.0), chars / F.greatest(F.lit(1), w["n"])),
            F.log1p(w["n"].cast("double")),
        ),
    )


@dataclass(frozen=True)
class Classifier:
    """Logistic weights (the last one constant) and the rate of good rows it was fitted at."""

    weights: tuple[float, ...]
    base: float

    def probability(self, x: Column) -> Column:
        at = F.lit(self.weights[-1])
        for i, w in enumerate(self.weights[:-1]):
            at = at + F.get(x, i) * w
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), at))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """A classifier of labels.quality. Without labels of both kinds it gives the same probability to all.

    An id with several labels counts as good if one is; one with several texts gives one row, the
    least of their features.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < (1 << 20) * sample / max(1, n))
    seen = docs.select("doc_id", "text").join(small(settle(picked), 2 * sample), "doc_id").select("doc_id", "quality", features(text_of()).alias("x"))
    rows = sorted((tuple(r["x"]), r["quality"]) for r in seen.groupBy("doc_id").agg(F.min("x").alias("x"), F.first("quality").alias("quality")).collect())
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Classifier((0.0,) * N_FEATURES + (4.0 if not len(y) or y.min() else -4.0,), 0.5)
    x = np.array([r[0] for r in rows])
    middle, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - middle) / spread, np.ones(len(x))]
    hold, w = np.r_[np.ones(x.shape[1]), 1e-6], np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold), z.T @ (y - p) - hold * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / spread
    return Classifier((*map(float, slopes), float(w[-1] - slopes @ middle)), float(y.mean()))


def _strength(n: float, groups: float, inside: float, between: float, sum_n2: float) -> float:
    """The prior's weight in documents: variance within groups over variance between their true rates."""
    if n <= groups or groups < 2:
        return 1e9
    within = max(1e-9, inside / (n - groups))
    spread = (between - (groups - 1) * within) / max(1e-9, n - sum_n2 / n)
    return max(LEAST_PRIOR, min(1e9, within / spread)) if spread > 0 else 1e9


def sites(scored: DataFrame) -> DataFrame:
    """(host, path, n, s, host_n, host_s, all_n, all_s, host_prior_n, path_prior_n): one row for each path, from columns host, path and p.

    n and s count documents and sum their probabilities, in the path, the host and all; host_prior_n
    is the weight of the rate of all among the host's documents, path_prior_n that of the host's
    rate among the path's. Paths are grouped before hosts, so that no task sees a whole host.
    """
    paths = settle(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    square = lambda s, n: F.sum(F.col(s) * F.col(s) / F.col(n))
    weight = lambda n: F.sum(F.col(n).cast("double") * F.col(n))
    joined = settle(paths.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host"))
    n, s, q, n_paths, path_sq, path_n2 = joined.agg(F.sum("n"), F.sum("s"), F.sum("q"), F.count(F.lit(1)), square("s", "n"), weight("n")).first()
    if not n:
        n, s, k, k2 = 0, 0.0, LEAST_PRIOR, LEAST_PRIOR
    else:
        n_hosts, host_sq, host_n2 = hosts.agg(F.count(F.lit(1)), square("host_s", "host_n"), weight("host_n")).first()
        k = _strength(n, n_hosts, q - host_sq, host_sq - s * s / n, host_n2)
        k2 = _strength(n, n_paths, q - path_sq, path_sq - host_sq, path_n2)
    return joined.select("host", "path", "n", "s", "host_n", "host_s", F.lit(n).cast("long").alias("all_n"), F.lit(float(s)).alias("all_s"), F.lit(float(k)).alias("host_prior_n"), F.lit(float(k2)).alias("path_prior_n"))


def rate_without(p: Column) -> Column:
    """The rate of a document's path without the document, from the columns of sites with _ before their names."""
    c = lambda name: F.col(f"_{name}")
    whole = F.when(c("all_n") > 1, (c("all_s") - p) / (c("all_n") - 1)).otherwise(F.lit(0.5))
    host = (c("host_s") - p + c("host_prior_n") * whole) / (c("host_n") - 1 + c("host_prior_n"))
    return (c("s") - p + c("path_prior_n") * host) / (c("n") - 1 + c("path_prior_n"))


def _judged(docs: DataFrame, labels: DataFrame, carry: list[str], host_col: str = "source", path_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(row, host, path, p, path_rate, posterior, keep) for each row of docs; row is a struct of the columns to carry."""
    model = fit(docs.select("doc_id", F.col(text_col).alias("text")), labels)
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    scored = docs.select(row, F.col(host_col).alias("host"), F.col(path_col).alias("path"), model.probability(features(text_of(text_col))).alias("p"))
    known = settle(sites(scored.select("host", "path", "p")))
    known = small(known, SMALL_SITES).select(*[F.col(c).alias(f"_{c}") for c in known.columns])
    joined = scored.join(known, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    logit = lambda x: F.log(x / (1 - x))
    inside = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    evidence = logit(inside(F.col("p"), 1e-9, 1 - 1e-9)) - math.log(model.base / (1 - model.base))
    out = joined.withColumn("path_rate", inside(rate_without(F.col("p")), *RATES)).withColumn("posterior", 1 / (1 + F.exp(-(evidence + logit(F.col("path_rate"))))))
    return out.withColumn("keep", F.col("posterior") >= KEEP).drop(*known.columns)


def classify(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", text_col: str = "text") -> DataFrame:
    """docs with p (the text's own probability), path_rate, posterior and keep.

    Null and empty texts are judged by their features and site like any other; a null host or path
    is a site of its own. Rows that are repeated are judged alike. Columns of docs with these four
    names are replaced; all others stay. The texts are read whole, however long, and thrice (sample,
    sites, posterior) rather than shuffled. An empty table gives an empty result.
    """
    new = ["p", "path_rate", "posterior", "keep"]
    carry = [c for c in docs.columns if c not in new]
    out = _judged(docs, labels, carry, host_col, path_col, text_col)
    return out.select(*[F.col("row")[c].alias(c) for c in carry], *new)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, host, path, p, path_rate, posterior, keep of every document: hosts are sources, their paths languages."""
    found = _judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("row.doc_id", "host", "path", "p", "path_rate", "posterior", "keep")


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    found = _judged(docs, table(spark, sf_dir, "labels"), docs.columns).where("keep")
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns])
