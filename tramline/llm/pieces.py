"""SentencePiece encoding and decoding over a relational lattice.

Text becomes words: white space turns into the piece mark, and a word is a run of marks with the
characters after it, or a line feed; no piece crosses these borders. The lattice of a word holds an
edge for each substring that is a piece: substrings of bounded length are exploded, joined by
equality to the piece table and grouped by word. A fold with Spark's higher-order aggregate then
segments the word: Viterbi over the scores for unigram models; for BPE models, whose ids come from
merging the best neighbours first and not from the best sum, the merges over the same edges.

`lattice` has these relations as DataFrames, for a table of words. Documents go the same way inside
their task, where they stay, since a shuffle of their words would move more than their texts: each
task explodes the words that are new to it, probes the broadcast piece table and sends their edges
to the fold; the fold's pieces come back to the task's documents, in the order of the rows. A task
knows a bounded number of words at a time and folds again what it has forgotten.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from array import array
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import let, table, text_of

MODEL_FILE = os.environ.get("TRAMLINE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: Words that a task knows at a time, and words in a row of lattices.
KNOWN_WORDS, ROW_WORDS = 500_000, 1024
#: Longer words are merged by a heap inside the task, as the fold's time grows with the square of their length.
LONG_WORD = 60
MARK = "▁"
_WORD = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
_BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Pieces:
    """A piece table: (piece, id, score), the id of byte 0, and whether ids come from merges (BPE) or the best sum."""

    rows: tuple[tuple[str, int, float], ...]
    byte_base: int
    merges: bool = True

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.rows)

    def ranks(self) -> dict[int, int]:
        """The place of each piece's score among all, the best first, by id; equal scores share theirs."""
        place = {s: k for k, s in enumerate(sorted({s for _, _, s in self.rows}, reverse=True))}
        return {i: place[s] for _, i, s in self.rows}


def load_pieces(model_file: str = MODEL_FILE) -> Pieces:
    """The table of a SentencePiece BPE model with byte fallback. Read on the driver; tasks get the table."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
    rows = tuple((model.id_to_piece(i), i, model.get_score(i)) for i in range(size) if not special(i))
    if any(MARK in p.lstrip(MARK) or (len(p) > 1 and "\n" in p) for p, _, _ in rows):
        raise ValueError("a piece of this model crosses the borders of words")
    return Pieces(rows, next(i for i in range(size) if model.is_byte(i)))


def words(text: str | None) -> list[str]:
    """The words of a text; null and empty texts have none."""
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


# ---- the lattice as relations ----


def lattice(distinct: DataFrame, table_: DataFrame, longest: int) -> DataFrame:
    """(word, edges) of a table with column word: edges is an array of (i, j, score, id, rank), end exclusive.

    table_ has piece, id, score and rank. Words without any edge have an empty array.
    """
    n = F.char_length("word")
    starts = distinct.where(n > 0).select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    spans = starts.select("word", "i", F.explode(F.sequence(F.col("i") + 1, F.least(n, F.col("i") + longest))).alias("j"))
    parts = spans.select("word", "i", "j", F.substring("word", F.col("i") + 1, F.col("j") - F.col("i")).alias("piece"))
    edges = parts.join(F.broadcast(table_), "piece").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("i", "j", "score", "id", "rank"))).alias("edges"))
    none = F.array().cast("array<struct<i:int,j:int,score:double,id:int,rank:int>>")
    return distinct.select("word").join(edges, "word", "left").withColumn("edges", F.coalesce("edges", none))


def marks(edges: Column) -> Column:
    """The edges of a BPE word over two characters or more, the best first and then leftmost, as bits of its borders: ends (lo) and all between (mid)."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    wide = F.transform(F.filter(edges, lambda e: e["j"] - e["i"] > 1), lambda e: F.struct(e["rank"].alias("r"), e["i"].alias("i"), e["j"].alias("j")))
    return F.transform(F.array_sort(wide), lambda e: F.struct((bit(e["i"]) + bit(e["j"])).alias("lo"), (bit(e["j"]) - bit(e["i"] + 1)).alias("mid")))


#: A bit above those of the borders.
_WAITS = 1 << 61


def fold_merges(word: Column, edges: Column) -> Column:
    """Borders of the pieces of a BPE word, as bits, from its marks. Words have at most LONG_WORD characters.

    The rule takes the best edge whose ends are borders with one border between, again and again.
    As borders only go, one pass in the order of the edges does the same, unless an edge meets
    several borders between its ends and might fit later; such a word is folded step by step.
    """
    n = F.char_length(word)
    none = F.lit(0).cast("long")
    start = F.call_function("shiftleft", F.lit(1).cast("long"), n + 1) - 1
    ends = lambda at, e: at.bitwiseAND(e["lo"]) == e["lo"]
    between = lambda at, e: F.bit_count(at.bitwiseAND(e["mid"]))

    def once(at: Column, e: Column) -> Column:
        return F.when(ends(at, e), F.when(between(at, e) == 1, at.bitwiseAND(F.bitwise_not(e["mid"]))).when(between(at, e) > 1, at.bitwiseOR(F.lit(_WAITS))).otherwise(at)).otherwise(at)

    def step(at: Column, _: Column) -> Column:
        gone = F.aggregate(edges, none, lambda acc, e: F.when(acc != 0, acc).when(ends(at, e) & (between(at, e) == 1), e["mid"]).otherwise(none))
        return at.bitwiseAND(F.bitwise_not(gone))

    steps = lambda: F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), start, step)
    return let(F.aggregate(edges, start, once), lambda found: F.when(found < _WAITS, found).otherwise(steps()))


def fold_viterbi(word: Column, edges: Column, unknown: float = -1e4) -> Column:
    """Borders of the best path by the sum of scores; a character without an edge costs `unknown`.

    The state is an array of the best (score, borders) up to each position; ties go to the path
    whose last piece starts first.
    """
    n = F.char_length(word)
    kind = "array<struct<score:double,path:array<int>>>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("path"))).cast(kind)

    def step(best: Column, j: Column) -> Column:
        ends = F.transform(F.filter(edges, lambda e: e["j"] == j), lambda e: F.struct((F.get(best, e["i"])["score"] + e["score"]).alias("score"), (-e["i"]).alias("i")))
        skip = F.struct((F.get(best, j - 1)["score"] + unknown).alias("score"), (1 - j).alias("i"))
        top = F.array_max(F.concat(ends, F.array(skip)))
        new = F.transform(F.array(top), lambda t: F.struct(t["score"].alias("score"), F.concat(F.get(best, -t["i"])["path"], F.array(j)).alias("path")))
        return F.concat(best, new).cast(kind)

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda best: F.get(best, n)["path"])


def fold(word: Column, lattice_: Column, merges: bool) -> Column:
    """Borders of a word's pieces: from the marks of a BPE word, as bits; from the edges of a unigram word, as an array."""
    return fold_merges(word, lattice_) if merges else fold_viterbi(word, lattice_)


def segment(lattices: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of lattices: the pieces between the fold's borders, bytes for characters without a piece."""
    word, edges = F.col("word"), F.col("edges")
    if pieces.merges:
        bits = fold_merges(word, marks(edges))
        borders = let(bits, lambda m: F.filter(F.sequence(F.lit(0), F.char_length(word)), lambda i: m.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0))
    else:
        borders = fold_viterbi(word, edges)
    cut = lattices.withColumn("borders", borders)
    pairs = F.transform(F.slice("borders", 1, F.size("borders") - 1), lambda b, k: F.struct(b.alias("i"), F.get("borders", k + 1).alias("j")))
    hexes = lambda p: F.hex(F.encode(F.substring(word, p["i"] + 1, p["j"] - p["i"]), "UTF-8"))
    fall = lambda p: F.transform(F.regexp_extract_all(hexes(p), F.lit("(..)"), F.lit(1)), lambda h: (F.conv(h, 16, 10).cast("int") + pieces.byte_base))
    one = lambda p: F.transform(F.filter(edges, lambda e: (e["i"] == p["i"]) & (e["j"] == p["j"])), lambda e: e["id"])
    ids = F.flatten(F.transform(pairs, lambda p: F.when(F.size(one(p)) > 0, one(p)).otherwise(fall(p))))
    return cut.select("word", ids.alias("ids"))


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """The piece table as a DataFrame; the model's file bounds it, so that it may be broadcast."""
    ranks = pieces.ranks()
    return spark.createDataFrame([(*r, ranks[r[1]]) for r in pieces.rows], "piece string, id int, score double, rank int")


# ---- documents, inside their tasks ----

#: Lattices of a row: marks of BPE words, edges of unigram words; and what the fold makes of them.
_MARKS = "array<struct<word:string,lattice:array<struct<lo:long,mid:long>>>>"
_EDGES = "array<struct<word:string,lattice:array<struct<i:int,j:int,score:double,id:int,rank:int>>>>"


class Encoder:
    """The piece table at work in one process."""

    def __init__(self, pieces: Pieces):
        self.base, self.merges, self.longest = pieces.byte_base, pieces.merges, pieces.longest
        self.id_of = {p: i for p, i, _ in pieces.rows}
        size = max(self.base + 255, *(i for _, i, _ in pieces.rows)) + 1
        self.scores, self.ranks, self.raw = np.zeros(size), np.zeros(size, np.int32), [b""] * size
        ranks = pieces.ranks()
        for p, i, s in pieces.rows:
            self.raw[i], self.scores[i], self.ranks[i] = p.replace(MARK, " ").encode(), s, ranks[i]
        for b in range(256):
            self.raw[self.base + b] = bytes([b])
        self.spelled = np.zeros((size, self.longest), np.uint32)
        heads: list[dict[int, int]] = [{} for _ in range(self.longest + 1)]
        for p, i, _ in pieces.rows:
            h = 0
            for k, c in enumerate(map(ord, p)):
                self.spelled[i, k] = c
                h = (h * _BASE + c + 1) % (1 << 64)
                heads[k + 1].setdefault(h, -1)
            heads[len(p)][h] = i
        #: By length: hashes of all beginnings of pieces in order, and the ids of those that are pieces.
        self.heads = [(np.array(sorted(d), np.uint64), np.array([d[h] for h in sorted(d)], np.int64)) for d in heads]

    def probes(self, some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, i, j, id) of the substrings of words that are pieces.

        The substrings that begin at each character are lengthened while a piece begins so, and
        joined to the piece table by a hash; equal hashes are verified by their characters.
        """
        codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.fromiter(map(len, some), np.int64, len(some))
        ends = np.cumsum(n)
        word = np.repeat(np.arange(len(some)), n)
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        parts = []
        for k in range(1, self.longest + 1):
            inside = at + k <= ends[word[at]]
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = h * np.uint64(_BASE) + codes[at + k - 1].astype(np.uint64) + np.uint64(1)
            known, ids = self.heads[k]
            spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[spot] == h
            at, h, got = at[hit], h[hit], ids[spot[hit]]
            whole = got >= 0
            begin, ident = at[whole], got[whole]
            same = (codes[begin[:, None] + np.arange(k)] == self.spelled[ident, :k]).all(axis=1)
            parts.append((begin[same], np.full(int(same.sum()), k), ident[same]))
        begin, length, ident = (np.concatenate(c) if parts else np.empty(0, np.int64) for c in (zip(*parts) if parts else ((), (), ())))
        first = (ends - n)[word[begin]]
        return word[begin], begin - first, begin - first + length, ident

    def lattices(self, some: list[str]) -> pa.Array:
        """The lattices of words of at most LONG_WORD characters, as the relations of `lattice` give them: elements of _MARKS or _EDGES."""
        at, i, j, ids = self.probes(some)
        if self.merges:
            wide = j - i > 1
            at, i, j, ids = at[wide], i[wide], j[wide], ids[wide]
            order = np.lexsort((i, self.ranks[ids], at))
            at, i, j = at[order], i[order], j[order]
            one = np.int64(1)
            flat = pa.StructArray.from_arrays([pa.array((one << i) + (one << j)), pa.array((one << j) - (one << (i + 1)))], names=["lo", "mid"])
        else:
            order = np.argsort(at, kind="stable")
            at, i, j, ids = at[order], i[order], j[order], ids[order]
            flat = pa.StructArray.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(self.scores[ids]), pa.array(ids.astype(np.int32)), pa.array(self.ranks[ids])], names=["i", "j", "score", "id", "rank"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(some)))]).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(some, pa.string()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["word", "lattice"])

    def named(self, word: str, borders) -> tuple[int, ...]:
        """The ids of the pieces between a fold's borders; bytes for characters without a piece."""
        if self.merges:
            i, bits, parts = 0, borders >> 1, []
            while bits:
                k = (bits & -bits).bit_length()
                parts.append(word[i : i + k])
                i, bits = i + k, bits >> k
        else:
            parts = [word[a:b] for a, b in zip(borders, borders[1:])]
        try:
            return tuple([self.id_of[p] for p in parts])
        except KeyError:
            return tuple([x for p in parts for x in ((self.id_of[p],) if p in self.id_of else [self.base + b for b in p.encode()])])

    def long(self, word: str) -> tuple[int, ...]:
        """The ids of a word over LONG_WORD characters."""
        borders = self._merged(word) if self.merges else self._best(word)
        return tuple([x for a, b in zip(borders, borders[1:]) for x in ((self.id_of[word[a:b]],) if word[a:b] in self.id_of else [self.base + c for c in word[a:b].encode()])])

    def _merged(self, word: str) -> list[int]:
        """As fold_merges, with a heap of the edges over two neighbours."""
        n = len(word)
        ids = _Costs(self.id_of, self.scores)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(-got, i, i + 2) for i in range(n - 1) if (got := ids.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j = heapq.heappop(heap)
            if not alive[i] or (middle := after[i]) >= n or after[middle] != j:
                continue
            alive[middle], after[i] = False, j
            if j < n:
                before[j] = i
                if (got := ids.get(word[i : after[j]])) is not None:
                    heapq.heappush(heap, (-got, i, after[j]))
            if i > 0:
                left = before[i]
                if (got := ids.get(word[left:j])) is not None:
                    heapq.heappush(heap, (-got, left, j))
        return [i for i in range(n) if alive[i]] + [n]

    def _best(self, word: str, unknown: float = -1e4) -> list[int]:
        """As fold_viterbi."""
        best, last = [0.0], [0]
        for j in range(1, len(word) + 1):
            top = (best[j - 1] + unknown, 1 - j)
            for i in range(max(0, j - self.longest), j):
                if (got := self.id_of.get(word[i:j])) is not None:
                    top = max(top, (best[i] + self.scores[got], -i))
            best.append(top[0])
            last.append(-top[1])
        path = [len(word)]
        while path[-1]:
            path.append(last[path[-1]])
        return path[::-1]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, marks as spaces, without the first one."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class _Costs:
    """Scores by piece."""

    def __init__(self, id_of: dict[str, int], scores: np.ndarray):
        self.id_of, self.scores = id_of, scores

    def get(self, piece: str) -> float | None:
        found = self.id_of.get(piece)
        return None if found is None else float(self.scores[found])


_ENCODERS: dict[str, Encoder] = {}


class Codec:
    """A piece table, sent to the tasks as one broadcast that the model's file bounds."""

    def __init__(self, spark: SparkSession, pieces: Pieces | None = None):
        pieces = pieces or load_pieces()
        self.key, self.merges = os.urandom(8).hex(), pieces.merges
        self.sent = spark.sparkContext.broadcast(pieces)

    def here(self) -> Encoder:
        """The encoder of this process."""
        if self.key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[self.key] = Encoder(self.sent.value)
        return _ENCODERS[self.key]

    def __getstate__(self):
        return {"key": self.key, "merges": self.merges, "sent": self.sent}


def with_lattices(docs: DataFrame, codec: Codec) -> DataFrame:
    """(key, text, fresh, words) from (key, text): each document, and before it rows with the lattices of the
    words that its task doesn't know yet; fresh tells that the task has forgotten all words before."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches):
        encoder, known, fresh = codec.here(), set(), True
        schema = None
        for batch in batches:
            key = batch.schema.field(0).type
            schema = schema or pa.schema([("key", key), ("text", pa.string()), ("fresh", pa.bool_()), ("words", pa.list_(encoder.lattices([]).type))])
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                needed = set().union(*map(words, part.column(1).to_pylist()))
                if len(known) > KNOWN_WORDS:
                    known, fresh = set(), True
                new = sorted(w for w in needed - known if len(w) <= LONG_WORD)
                known |= needed
                for begin in range(0, len(new), ROW_WORDS):
                    edges = encoder.lattices(new[begin : begin + ROW_WORDS])
                    one = pa.ListArray.from_arrays(pa.array([0, len(edges)], pa.int32()), edges)
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, key), pa.nulls(1, pa.string()), pa.array([fresh]), one], schema=schema)
                    fresh = False
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([False] * n), pa.nulls(n, schema.field(3).type)], schema=schema)

    return docs.select("key", "text").mapInArrow(run, f"key {kind}, text string, fresh boolean, words {_MARKS if codec.merges else _EDGES}")


def coded(docs: DataFrame, codec: Codec, id_col: str, text_col: str, what, fields: str) -> DataFrame:
    """(key, *fields) for each row of docs: what(encoder, ids) gives the values from the ids of the whole text.

    The rows of a partition keep their order from the lattices through the fold, so that the fold
    of each word is there before the documents that need it.
    """
    keyed = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = keyed.schema["key"].dataType.simpleString()
    folds = F.transform("words", lambda w: F.struct(w["word"].alias("word"), fold(w["word"], w["lattice"], codec.merges).alias("borders")))
    folded = with_lattices(keyed, codec).select("key", "text", "fresh", folds.alias("words"))
    out = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[f.split()[1]]) for f in fields.split(", ")])

    def run(batches):
        encoder, known = codec.here(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, keys = [], []
                for nth, (text, fresh, new) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3))):
                    if new.is_valid:
                        if fresh:
                            known = {}
                        flat = new.values
                        some, borders = flat.field("word").to_pylist(), flat.field("borders").to_pylist()
                        known.update(zip(some, map(encoder.named, some, borders)))
                        continue
                    every = words(text)
                    try:
                        ids = list(chain.from_iterable(map(known.__getitem__, every)))
                    except KeyError:
                        ids = list(chain.from_iterable([encoder.long(w) if len(w) > LONG_WORD else known[w] for w in every]))
                    keys.append(nth)
                    rows.append(what(encoder, ids))
                if rows:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), out)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keys)), *columns], names=["key", *out.names])

    return folded.mapInArrow(run, f"key {kind}, {fields}")


def encode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row: the piece ids of the whole text.

    Null and empty texts have none; null and repeated ids and repeated rows are rows like any
    other; other columns are not read; an empty table gives an empty result.
    """
    found = coded(docs, codec, id_col, text_col, lambda _, ids: (ids,), "ids array<int>")
    return found.withColumnRenamed("key", id_col)


def decode(encoded: DataFrame, codec: Codec, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of (id, ids); null and empty ids give the empty text. See encode for odd rows."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = codec.here()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([encoder.decode(i or []) for i in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as 32-bit numbers), decoded_sha256, decoded_chars of every document."""

    def digest(encoder, ids):
        back = encoder.decode(ids)
        return len(ids), hashlib.sha256(array("i", ids).tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), len(back)

    found = coded(table(spark, sf_dir, "documents"), Codec(spark), "doc_id", "text", digest, "n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long")
    return found.withColumnRenamed("key", "doc_id")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and decoded_sha256 (of the text decoded from the ids) of the documents. See encode for odd rows."""
    keyed = docs.select(F.struct("doc_id", "source").alias("key"), "text")
    told = lambda encoder, ids: (ids, hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
    found = coded(keyed, Codec(spark), "key", "text", told, "ids array<int>, decoded_sha256 string")
    return found.select("key.doc_id", "key.source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


def unigram_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, pieces: the best path of each distinct word of at most LONG_WORD characters of benchmark, over the relations
    and a unigram table: single letters and the two- and three-letter substrings of region and nation names, by how often they stand there."""
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("w")).union(table(spark, sf_dir, "region").select(F.lower("r_name").alias("w")))
    start = names.select("w", F.explode(F.sequence(F.lit(1), F.char_length("w"))).alias("i"))
    parts = start.select(F.explode(F.array(*[F.when(F.col("i") + k - 1 <= F.char_length("w"), F.substring("w", F.col("i"), F.lit(k))) for k in (1, 2, 3)])).alias("piece")).where("piece is not null")
    counted = parts.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    pieces_ = counted.select("piece", F.lit(0).alias("id"), F.round(F.log(F.col("n") / 1000.0), 6).alias("score"), F.lit(0).alias("rank"))
    every = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower(text_of()), "[^a-z]+")).alias("word")).where(F.char_length("word").between(1, LONG_WORD)).distinct()
    cut = lattice(every, pieces_, 3).select("word", fold_viterbi(F.col("word"), F.col("edges")).alias("b"))
    told = F.array_join(F.transform(F.slice("b", 1, F.size("b") - 1), lambda i, k: F.substring(F.col("word"), i + 1, F.get("b", k + 1) - i)), " ")
    return cut.select("word", told.alias("pieces"))
