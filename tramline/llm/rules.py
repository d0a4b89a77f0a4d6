"""Quality rules as weak supervision.

Each rule votes good or bad on a document, or abstains. Expectation-maximisation over the counts of
the vote patterns estimates every rule's accuracy without labels, and the posterior probability of
good quality replaces a filter that all rules must pass. Everything that touches documents is built
from DataFrame functions; the driver sees only the pattern counts, at most 3 to the number of rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import let, settle, table, text_of, words_of

SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\x0b\f\r"
LEAST_WORDS = 50
KEEP = 0.5


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the counts of each whole text; null texts count as empty.

    n_words; word_chars, code points in words; n_symbols; n_lines and n_dup_lines, lines with a
    word, and those of them equal to an earlier line; n_repeat_words, words in windows of three
    words that occur twice or more in the text; n_upper, upper-case A-Z.
    """
    text = F.col("_text")
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _WHITE, "")) > 0)
    dropped = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    found = base.select(
        "doc_id",
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("_w"),
        F.char_length(F.translate(text, _WHITE, "")).cast("long").alias("word_chars"),
        dropped(SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_l"),
        dropped("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
    )
    return found.select("doc_id", "_w.n_words", "word_chars", "n_symbols", F.col("_l.n").alias("n_lines"), F.col("_l.dup").alias("n_dup_lines"), "_w.n_repeat_words", "n_upper")


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of three words that occur twice or more.

    The windows are sorted with their places: equal ones become neighbours. The places of repeated
    windows, in order, each add the words that the one before has not covered.
    """
    windows = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 2)),
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("w"), i.alias("i")),
    )

    def places(s: Column) -> Column:
        same = lambda x, j: F.get(s, j)["w"].eqNullSafe(x["w"])
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(p, zero, step, lambda acc: acc["n"])

    found = let(F.sort_array(windows), lambda s: let(places(s), covered))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(found)


@dataclass(frozen=True)
class Vote:
    """A rule: a SQL expression over the counts that is bad at or above `bad`, good at or below
    `good`, and abstains in between or where it is null. `misfires` is the share of bad votes that
    one expects it to cast on good documents, before any document is seen."""

    name: str
    value: str
    good: float
    bad: float
    misfires: float

    def column(self) -> Column:
        """1 good, -1 bad, 0 no vote."""
        v = F.expr(self.value)
        return F.coalesce(F.when(v >= self.bad, -1).when(v <= self.good, 1), F.lit(0))


VOTES = (
    Vote("symbols", "n_symbols / nullif(word_chars, 0)", 0.02, 0.08, 0.002),
    Vote("upper case", "n_upper / nullif(word_chars, 0)", 0.1, 0.2, 0.002),
    Vote("repeated windows", "n_repeat_words / nullif(n_words, 0)", 0.2, 0.4, 0.002),
    Vote("repeated lines", "n_dup_lines / nullif(n_lines, 0)", 0.2, 0.4, 0.002),
    Vote("word length", "abs(word_chars / nullif(n_words, 0) - 5)", 0.4, 0.7, 0.05),
)
#: What one expects of any rule before any document is seen: its share of bad votes on bad documents.
CATCHES = 0.3
#: Votes that the expectations count as, for each document.
PRIOR_VOTES = 1.0
START_GOOD = 0.8


@dataclass(frozen=True)
class LabelModel:
    """Prior of good, and each rule's share of bad votes among its votes on good and on bad documents."""

    prior: float
    misfires: tuple[float, ...]
    catches: tuple[float, ...]

    def weights(self, nth: int) -> tuple[float, float]:
        """What a good and a bad vote of a rule add to the log odds of good."""
        a, b = self.misfires[nth], self.catches[nth]
        return math.log((1 - a) / (1 - b)), math.log(a / b)

    def log_odds(self, pattern: tuple[int, ...]) -> float:
        at = math.log(self.prior / (1 - self.prior))
        for nth, vote in enumerate(pattern):
            if vote:
                at += self.weights(nth)[vote < 0]
        return at


def fit(patterns: dict[tuple[int, ...], int], misfires: tuple[float, ...], catches: float = CATCHES, prior_votes: float = PRIOR_VOTES, rounds: int = 500) -> LabelModel:
    """Expectation-maximisation of a label model with independent rules.

    A rule sees one kind of fault, and faults seldom meet in a document: the likelihood alone would
    let the hidden class stand for the two faults that meet most. So each rule's rates have a Beta
    prior around what one expects of it, worth `prior_votes` votes a document, whatever the number
    of documents. No rate is clamped, but a rule that would catch less than it misfires is taken as
    without effect, which keeps the classes from changing places. Abstaining says nothing of the
    quality. An empty table leaves the expectations.
    """
    total = sum(patterns.values())
    weight = max(1.0, prior_votes * total)
    model, before = LabelModel(START_GOOD, misfires, (catches,) * len(misfires)), None
    for _ in range(rounds):
        good = {p: n / (1 + math.exp(-max(-50.0, min(50.0, model.log_odds(p))))) for p, n in sorted(patterns.items())}
        mass = sum(good.values())
        low, high = [], []
        for nth, expected in enumerate(misfires):
            cast = lambda of, *votes: sum(of(p) for p in good if p[nth] in votes)  # noqa: B023, E731
            a = (cast(good.get, -1) + weight * expected) / (cast(good.get, -1, 1) + weight)
            bad = lambda p: patterns[p] - good[p]
            b = (cast(bad, -1) + weight * catches) / (cast(bad, -1, 1) + weight)
            low.append(min(a, b))
            high.append(b)
        model = LabelModel((mass + 1) / (total + 2), tuple(low), tuple(high))
        if before is not None and abs(before - mass) < 1e-9 * max(1, total):
            break
        before = mass
    return model


def vote_patterns(counts: DataFrame, votes=VOTES) -> dict[tuple[int, ...], int]:
    """How many documents have each pattern of votes: at most 3 ** len(votes) rows."""
    names = [f"_v{i}" for i in range(len(votes))]
    rows = counts.select(*[v.column().alias(n) for v, n in zip(votes, names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    return {tuple(r[n] for n in names): r["n"] for r in rows}


def posterior(model: LabelModel, votes=VOTES) -> Column:
    """Probability of good quality over the counts."""
    at = F.lit(math.log(model.prior / (1 - model.prior)))
    for nth, vote in enumerate(votes):
        v, (good, bad) = vote.column(), model.weights(nth)
        at = at + F.when(v > 0, good).when(v < 0, bad).otherwise(0.0)
    return 1 / (1 + F.exp(-at))


def judge(docs: DataFrame, votes=VOTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, the counts, base_failed, quality (the posterior) and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated windows. kept: not
    base_failed and a posterior of one half or more. Empty tables give empty results; repeated
    rows are judged alike, whatever their ids; other columns are not read. Texts are read whole,
    however long; null and empty ones have no votes and fail the base.
    """
    counts = settle(stats(docs, id_col, text_col))
    model = fit(vote_patterns(counts, votes), tuple(v.misfires for v in votes))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = counts.withColumns({"base_failed": failed, "quality": posterior(model, votes)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every document."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def _oracle() -> str:
    """The counts, votes and label model in SQL: patterns are counted, and a recursion repeats the rounds on a list of the prior, the misfires and the catches."""
    many = range(len(VOTES))
    values = [v.value.replace("/ nullif", "::DOUBLE / nullif") for v in VOTES]
    votes = ", ".join(f"coalesce(CASE WHEN {x} >= {v.bad} THEN -1 WHEN {x} <= {v.good} THEN 1 END, 0) AS v{i}" for i, (x, v) in enumerate(zip(values, VOTES)))
    low, high = (lambda i: f"s[{i + 2}]"), (lambda i: f"s[{i + 2 + len(VOTES)}]")
    odds = lambda: "ln(s[1] / (1 - s[1])) + " + " + ".join(f"CASE v{i} WHEN -1 THEN ln({low(i)} / {high(i)}) WHEN 1 THEN ln((1 - {low(i)}) / (1 - {high(i)})) ELSE 0 END" for i in many)
    names = ", ".join(f"v{i}" for i in many)
    rate = lambda i, w, expected: f"(sum(CASE WHEN v{i} = -1 THEN {w} ELSE 0 END) + {PRIOR_VOTES} * greatest(1, sum(n)) * {expected}) / (sum(CASE WHEN v{i} <> 0 THEN {w} ELSE 0 END) + {PRIOR_VOTES} * greatest(1, sum(n)))"
    b = [rate(i, "(n - g)", CATCHES) for i in many]
    a = [f"least({rate(i, 'g', VOTES[i].misfires)}, {b[i]})" for i in many]
    start = ", ".join(map(str, [START_GOOD, *(v.misfires for v in VOTES), *([CATCHES] * len(VOTES))]))
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY id),
g3 AS (SELECT id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r3 AS (SELECT id, i FROM g3 QUALIFY count(*) OVER (PARTITION BY id, k) > 1),
r AS (SELECT id, count(DISTINCT j) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS j FROM r3) GROUP BY id),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper
  FROM d LEFT JOIN l ON l.id = d.id LEFT JOIN r ON r.id = d.id),
v AS (SELECT *, {votes} FROM c),
pats AS (SELECT {names}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
em(i, s) AS (
  SELECT 0, [{start}]::DOUBLE[]
  UNION ALL
  SELECT i + 1, (SELECT [(sum(g) + 1) / (sum(n) + 2), {", ".join(a)}, {", ".join(b)}] FROM (SELECT *, n / (1 + exp(-greatest(-50, least(50, {odds()})))) AS g FROM pats)) FROM em WHERE i < 300),
q AS (SELECT v.*, 1 / (1 + exp(-({odds()}))) AS quality, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v, (SELECT s FROM em WHERE i = 300))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND quality >= {KEEP} AS kept, round(quality, 6) AS quality FROM q
"""


ORACLE_OP6 = _oracle()
