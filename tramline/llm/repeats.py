"""Repeated passages by prefix-partitioned suffix trees.

A passage counts from 50 words on. The trees hold only suffixes that can matter:

1. Each window of 50 words chooses its anchor, the run of 8 words with the least hash inside it, so
   equal windows choose equal anchors at equal places. Neighbouring windows mostly share one; about
   one anchor in 22 words remains. An anchor with its windows is a context.
2. Contexts whose anchor stands in one document only are dropped. Equal contexts are aggregated to
   one, which keeps the smallest and the largest of their documents: copies reach no tree twice.
3. The words that all windows of a context share are its prefix, at first the anchor. Prefixes with
   few contexts share a memory-sized group. A prefix with too many for a group is lengthened: its
   windows are split by where the anchor stands in them, in two halves, so that each half shares
   more words; and so on, up to whole windows of 50 words, which are equal and are aggregated.
4. Each group builds the suffix tree of its contexts (suffix array and longest common prefixes). Its
   highest internal nodes of 50 words or more, and its leaves, tell the smallest document in which
   the words below them start; from there removal is read. Overlapping ones join to maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import small, stored, table

WINDOW = 50
ANCHOR = 8
#: A group holds about this many contexts, some 100 words each; prefixes with more are lengthened.
GROUP_CONTEXTS = 2_000
#: Documents that hold contexts for the trees are picked by a broadcast of their ids up to this many, else by a shuffle.
SMALL_IDS = 1_000_000
_MEMO = 500_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Memo(dict):
    """Hashes of words, kept for up to _MEMO of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def split_words(text: str | None) -> list[bytes]:
    """The words of a text, between ASCII white space; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """base ** i and base ** -i modulo 2 ** 64, grown as texts need them."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 1 << 15)
            inverse = pow(self.base, -1, 1 << 64)
            self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, self.base, np.uint64))])
            self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, inverse, np.uint64))])


_POWERS = tuple(map(_Powers, _BASES))


def _span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span of word hashes, equal for equal spans wherever they stand."""
    out = []
    for nth, powers in enumerate(_POWERS):
        powers.upto(len(values))
        v = values if nth == 0 else _mixed(values)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * powers.up[: len(v)])])
        out.append(_mixed((sums[ends] - sums[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64)))
    return out[0], out[1]


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first window, last window) of the contexts of a text of 50 words or more."""
    grams = np.zeros(len(values) - ANCHOR + 1, np.uint64)
    for j in range(ANCHOR):
        grams = grams * np.uint64(_BASES[0]) + values[j : j + len(grams)]
    grams = _mixed(grams)
    spread = WINDOW - ANCHOR + 1
    at = np.empty(len(values) - WINDOW + 1, np.int64)
    for begin in range(0, len(at), 1 << 15):
        part = np.lib.stride_tricks.sliding_window_view(grams[begin : begin + (1 << 15) + spread - 1], spread)[: len(at) - begin]
        at[begin : begin + len(part)] = part.argmin(axis=1) + np.arange(begin, begin + len(part))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return grams[at[first]], at[first], first, last


def contexts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, h, c1, c2, lo, hi, off): each context's document and text, anchor, content, windows,
    and where the anchor stands in the first of them; for texts of 50 words or more."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["th", "h", "c1", "c2", "lo", "hi", "off"]

    def run(batches):
        memo = _Memo()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, cols = [], [[] for _ in names]
                for nth, (th, text) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    words = split_words(text)
                    if len(words) < WINDOW:
                        continue
                    values = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
                    h, place, lo, hi = anchors(values)
                    c1, c2 = _span_hashes(values, lo, hi + WINDOW)
                    c1 = _mixed(c1 + (place - lo).astype(np.uint64))
                    rows.append(np.full(len(h), nth))
                    for col, x in zip(cols, (np.full(len(h), th, np.int64), h.view(np.int64), c1.view(np.int64), c2.view(np.int64), lo, hi, place - lo)):
                        col.append(x)
                if rows:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(rows))), *(pa.array(np.concatenate(c)) for c in cols)], names=["doc_id", *names])

    return _known(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def _known(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, text): rows with an id; th tells apart the texts of an id."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


# ---- the trees ----


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rank of each suffix, ranks of the prefixes of 1, 2, 4... tokens): doubled until all suffixes differ."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    levels = [rank]
    while len(rank) and int(rank.max()) + 1 < len(rank):
        known = 1 << (len(levels) - 1)
        moved = np.concatenate([rank[known:] + 1, np.zeros(min(known, len(rank)), np.int64)])
        rank = np.unique(rank * (len(rank) + 1) + moved, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
    return rank, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Tokens that each suffix of a sorted list shares with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    n = len(levels[0])
    i, j = order[:-1].copy(), order[1:].copy()
    for known in range(len(levels) - 1, -1, -1):
        step = 1 << known
        inside = (i + step <= n) & (j + step <= n)
        same = inside & (levels[known][np.minimum(i, n - 1)] == levels[known][np.minimum(j, n - 1)])
        i[same] += step
        j[same] += step
        out[1:][same] += step
    return out


def deep_nodes(tokens: np.ndarray, starts: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(order of starts, begins): starts in the order of their suffixes, and where in it each of the
    highest nodes of `depth` tokens or more (a leaf, if nothing else shares so many) begins."""
    rank, levels = suffix_array(tokens)
    order = np.argsort(rank[starts])
    shared = common_prefixes(starts[order], levels)
    return order, np.flatnonzero(shared < depth)


def _group_nodes(group: pd.DataFrame) -> pd.DataFrame:
    """(c1, c2, lo, hi, m) of a group of contexts: runs of windows whose words start in document m and in none smaller, where a later document holds the context."""
    ids: dict[str, int] = {}
    tokens, starts, at = [], [], 0
    for nth, (n, text) in enumerate(zip(group["n"], group["words"])):
        words = [ids.setdefault(w, len(ids)) for w in text.split(" ")]
        tokens.append(np.array([*words, -1 - nth], np.int64))  # a mark of its own ends each context
        starts.append(np.arange(at, at + n))
        at += len(words) + 1
    sizes = group["n"].to_numpy(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    starts_ = np.concatenate(starts)
    order, begins = deep_nodes(np.concatenate(tokens), starts_)
    smallest, place = np.unique(group["d"].to_numpy(), return_inverse=True)
    least = np.empty(len(starts_), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(place[row[order]], begins), np.diff([*begins, len(order)]))
    window = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + group["base"].to_numpy(np.int64)[row]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (least[1:] != least[:-1])]))
    last = np.concatenate([new[1:] - 1, [len(row) - 1]])
    m, of = smallest[least[new]], row[new]
    hit = m < group["e"].to_numpy()[of]
    new, last, m, of = new[hit], last[hit], m[hit], of[hit]
    return pd.DataFrame({"c1": group["c1"].to_numpy()[of], "c2": group["c2"].to_numpy()[of], "lo": window[new], "hi": window[last], "m": m})


def _cut_out(batches):
    """The words of contexts."""
    names = ["h", "c1", "c2", "d", "e", "off", "n", "words"]
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            rows, words = [], []
            for text, places in zip(part.column(0).to_pylist(), part.column(1)):
                every = split_words(text)
                words += [b" ".join(every[lo : hi + WINDOW]) for lo, hi in zip(places.values.field("lo").to_pylist(), places.values.field("hi").to_pylist())]
                rows.append(places.values)
            if rows:
                flat = pa.concat_arrays(rows)
                count = pa.array(np.asarray(flat.field("hi")) - np.asarray(flat.field("lo")) + 1)
                yield pa.RecordBatch.from_arrays([*(flat.field(n) for n in names[:6]), count, pa.array([w.decode("utf-8", "replace") for w in words], pa.string())], names=names)


def _halves(rows: DataFrame) -> DataFrame:
    """The contexts of prefixes that are too many, by two longer prefixes: windows in which the anchor stands in the lower or the upper half of [low, high]."""
    every = F.split("words", " ")
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")

    def half(low, high):
        first, last = F.greatest(F.lit(0), F.col("off") - high), F.least(F.col("n") - 1, F.col("off") - low)
        prefix = F.array_join(F.slice(every, (F.col("off") - low + 1).cast("int"), (F.lit(WINDOW) - high + low).cast("int")), " ")
        return F.when(
            first <= last,
            F.struct(
                F.xxhash64(low, high, prefix).alias("key"),
                low.alias("low"),
                high.alias("high"),
                (F.col("off") - first).alias("off"),
                (F.col("base") + first).alias("base"),
                (last - first + 1).alias("n"),
                F.array_join(F.slice(every, (first + 1).cast("int"), (last - first + WINDOW).cast("int")), " ").alias("words"),
            ),
        )

    both = F.array_compact(F.array(half(F.col("low"), middle), half(middle + 1, F.col("high"))))
    return rows.select("c1", "c2", "d", "e", F.explode(both).alias("x")).select("c1", "c2", "d", "e", "x.*").select(rows.columns)


def node_runs(cut: DataFrame, kind: str, most: int) -> DataFrame:
    """(c1, c2, lo, hi, m) of all contexts, each prefix lengthened until at most `most` contexts share it; see _group_nodes."""
    rows = cut.select(F.col("h").alias("key"), "c1", "c2", "d", "e", F.lit(0).alias("low"), F.lit(WINDOW - ANCHOR).alias("high"), "off", F.lit(0).cast("long").alias("base"), "n", "words")
    rows, parts = stored(rows), []
    schema = f"c1 long, c2 long, lo long, hi long, m {kind}"
    while True:
        hot = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("key"))
        crowded = bool(hot.head(1))
        fine = rows.join(hot, "key", "left_anti") if crowded else rows
        groups = max(1, -(-fine.count() // most))
        group = fine.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups))).select("g", "c1", "c2", "d", "e", "base", "n", "words")
        parts.append(group.groupBy("g").applyInPandas(_group_nodes, schema))
        if not crowded:
            break
        rows = rows.join(hot, "key", "left_semi")
        whole = stored(rows.where("low = high").select("c1", "c2", "e", "base", "words", "d"))
        if whole.head(1):  # prefixes of 50 words: all windows of one are equal
            least = stored(whole.groupBy("words").agg(F.min("d").alias("m")))
            parts.append(whole.join(least, "words").where("m < e").select("c1", "c2", F.col("base").alias("lo"), F.col("base").alias("hi"), "m"))
        rows = stored(_halves(rows.where("low < high")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, lo, hi): runs of windows, by first word, that also start in a document with a smaller id.

    Ids are of any type with an order. Rows with equal ids are one document, whether their texts
    (told apart by th, their hash) are equal or not: they take nothing from each other. Runs of a
    text may overlap; together they hold all such windows. Texts under 50 words, null texts and
    rows without an id have none and give none. Texts are read whole, however long, and other
    columns are not read. Contexts are equal if 128 bits of hash are; trees compare words.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    every = stored(contexts(docs, id_col, text_col))
    shared = stored(every.groupBy("h").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 < d1").select("h"))
    kept = stored(every.join(shared, "h", "left_semi"))  # joins of stored tables have plain shuffles on both sides, which are split where a key is hot
    content = stored(kept.groupBy("c1", "c2").agg(F.min("doc_id").alias("d"), F.max("doc_id").alias("e")))
    one = kept.join(content, ["c1", "c2"]).where("d = doc_id").dropDuplicates(["c1", "c2"])
    one = stored(one.select("doc_id", "th", F.struct("h", "c1", "c2", "d", "e", "off", "lo", "hi").alias("place")))
    places = one.groupBy("doc_id", "th").agg(F.collect_list("place").alias("places"))
    texts = _known(docs, id_col, text_col).join(small(one.select("doc_id").distinct(), SMALL_IDS), "doc_id", "left_semi").dropDuplicates(["doc_id", "th"])
    cut = texts.join(places, ["doc_id", "th"]).select("text", "places").mapInArrow(_cut_out, f"h long, c1 long, c2 long, d {kind}, e {kind}, off long, n long, words string")
    runs = stored(node_runs(cut, kind, GROUP_CONTEXTS).select("c1", "c2", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "m"))
    return kept.join(runs, ["c1", "c2"]).where(F.col("m") < F.col("doc_id")).select("doc_id", "th", (F.col("lo") + F.col("_lo")).alias("lo"), (F.col("lo") + F.col("_hi")).alias("hi"))


def maximal(runs: DataFrame) -> DataFrame:
    """(doc_id, th, begin, end, n_words): the maximal repeated passages of each text, from its runs of windows."""
    order = Window.partitionBy("doc_id", "th").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = runs.withColumn("_new", F.coalesce((F.col("lo") > reach + WINDOW).cast("int"), F.lit(0)))
    parted = parted.withColumn("_part", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = parted.groupBy("doc_id", "th", "_part").agg(F.min("lo").alias("begin"), (F.max("hi") + WINDOW).alias("end"))
    return found.select("doc_id", "th", "begin", "end", (F.col("end") - F.col("begin")).alias("n_words"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept (the kept words joined by spaces). See repeats for odd rows."""
    runs = repeats(docs, id_col, text_col).groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    both = texts.join(runs, ["doc_id", "th"], "left").select("doc_id", "text", "runs")
    return both.mapInArrow(_kept, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept string")


def _kept(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for text, runs in zip(part.column(1).to_pylist(), part.column(2)):
                words = split_words(text)
                n, kept = len(words), words
                if runs.is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.asarray(runs.values.field("lo")), 1)
                    np.add.at(edge, np.minimum(n, np.asarray(runs.values.field("hi")) + WINDOW), -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:n] == 0)]
                rows.append((n, n - len(kept), b" ".join(kept).decode("utf-8", "replace")))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "n_words", "n_removed", "kept"])


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
m AS (SELECT k, min(doc_id) AS first FROM p GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM p JOIN m USING (k) WHERE first < doc_id),
e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS kept, count(*) AS n FROM e ANTI JOIN c USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
