"""SimHash near-duplicates found through deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Fingerprints that differ in at most three
bits differ in at most one bit of at least one segment. Every segment is indexed whole and with
each single bit deleted; two segments that differ in exactly bit b share exactly the variant with
b deleted, one with the bit set and one with it clear. An equality join of the clear with the set
variants, and of equal whole segments, therefore meets every pair that can link, and the
full distance is verified in the join. Only distinct fingerprints are indexed: copies share one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import components, let, settle, small, stored, table

SEGMENT_BITS = 32
MAX_DISTANCE = 3
SHINGLE_WORDS = 3
HASH_SEED = 42
#: The pipeline's stage: near copies share this much of their shingles of so many words.
STAGE_WORDS = 5
STAGE_SIMILARITY = 0.8
#: Grams found so often among about so many sampled rows come last in prefixes, the commonest at the end. They set an order, no result.
ORDER_SAMPLE = 20_000
ORDER_COMMON = 2
ORDER_MOST = 250_000
#: Grams of their prefixes that similar sets share at least.
SHARED = 4
#: Rows of a gram that all meet; in larger ones they meet the pivots of so many drawn orders and one more.
MEET_ALL = 16
DRAWN_ORDERS = 6
#: Members of a gram that one task holds against as many others.
BLOCK = 512
#: Up to so many keys are sent to the grams, rather than the grams shuffled to them.
HELD_KEYS = 500_000
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the word shingles of a text in order, repeated ones too.

    A-Z are lower-cased. A null text counts as empty and has none; fewer words than a shingle give
    the hash of the whole sequence.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    last = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]) - 1
    digest = xxhash.xxh64_intdigest
    out = np.empty(n, np.uint64)
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        pairs = zip(starts[at:to].tolist(), last[at:to].tolist())
        out[at:to] = np.fromiter((digest(line[i:j], HASH_SEED) for i, j in pairs), np.uint64, to - at)
    return out


def simhash(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes as a signed 64-bit number, 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles of a text (see shingle_hashes); no word gives 0."""
    return simhash(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row of docs, fp as a signed 64-bit number."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at most max_distance (3 or less) bits apart.

    fps has one row for each distinct fingerprint in column fp.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("two segments guarantee distances up to 3")
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    high = F.shiftrightunsigned("fp", SEGMENT_BITS)
    entries = []
    for segment, value in enumerate((low, high)):
        entries.append((segment * (SEGMENT_BITS + 1) + SEGMENT_BITS, value, None))
        for bit in range(SEGMENT_BITS):
            entries.append((segment * (SEGMENT_BITS + 1) + bit, value, bit))

    def side(which: int, name: str) -> DataFrame:
        keys = []
        for tag, value, bit in entries:
            key = (value if bit is None else value.bitwiseAND(F.lit(~(1 << bit) & 0xFFFFFFFF))).bitwiseOR(F.lit(tag << SEGMENT_BITS))
            keys.append(key if bit is None else F.when(F.shiftrightunsigned(value, bit).bitwiseAND(F.lit(1)) == which, key))
        return fps.select(F.col("fp").alias(name), F.explode(F.array(*keys)).alias("key")).where(F.col("key").isNotNull())

    whole = F.pmod(F.shiftrightunsigned("key", SEGMENT_BITS), F.lit(SEGMENT_BITS + 1)) == SEGMENT_BITS
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    left, right = side(0, "a"), side(1, "b")
    # Spark sizes an exploded array as one entry: a side of 35 rows for each fingerprint would be broadcast as if it had one.
    return left.join(right.hint("merge"), "key").where(near & (~whole | (F.col("a") < F.col("b")))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row for each row of docs: id, fp, component_id.

    component_id is the smallest id (nulls aside) of the documents reachable over links. Rows
    with equal texts, null and empty texts included, share a fingerprint and so a component.
    An empty table gives an empty result; other columns are ignored.
    """
    each = settle(fingerprints(docs, id_col, text_col))
    distinct = settle(each.groupBy("fp").agg(F.min(id_col).alias("first")))
    parts = components(links(distinct.select("fp"), max_distance)).withColumnRenamed("node", "fp")
    rooted = distinct.join(parts, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return each.join(classes, "fp").select(id_col, "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sets(docs: DataFrame, names: list[str], kinds: str, row, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, *names) for each row of docs; row gives the values from a text's shingle hashes and their distinct values in ascending order."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    types = [fields[k] for k in kinds.split()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for text in part.column(1).to_pylist():
                    hashes = shingle_hashes(text, shingle)
                    rows.append(row(hashes, np.unique(hashes.view(np.int64))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), types))], names=[id_col, *names])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{n} {k}" for n, k in zip(names, kinds.split()))]))


def _key(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.astype("<i8").tobytes(), HASH_SEED) - (1 << 63)


def prefix(grams: np.ndarray, common: np.ndarray, often: np.ndarray, threshold: float) -> np.ndarray:
    """The first n - ceil(threshold n) + SHARED of n grams, common ones last in the order of their counts (often); both are in ascending order.

    Two sets with a Jaccard similarity of threshold or more share at least SHARED grams of their
    prefixes (or all that they must share, if that is fewer) in any order that is the same for all
    sets, so `common` changes no result, only the number of pairs.
    """
    count = np.zeros(len(grams), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        count = np.where(common[at] == grams, often[at], 0)
    return grams[np.argsort(count, kind="stable")[: len(grams) - _least(len(grams), threshold) + SHARED]]


def _least(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def common_grams(docs: DataFrame, rows: int, id_col: str, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams found ORDER_COMMON times or more in a sample of about ORDER_SAMPLE rows, in ascending order, and their counts.

    Only those from the least count on at which they are ORDER_MOST or fewer.
    """
    picked = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("order")), F.lit(max(1, rows // ORDER_SAMPLE))) == 0)
    grams = _sets(picked, ["grams"], "array<long>", lambda _, each: (each,), id_col, text_col, shingle).select(F.explode("grams").alias("gram"))
    found = stored(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") >= ORDER_COMMON))
    total, least = 0, None
    for often, some in sorted(map(tuple, found.groupBy("often").count().collect()), reverse=True):
        if (total := total + some) > ORDER_MOST:
            break
        least = often
    held = found.where(F.lit(False) if least is None else F.col("often") >= least).toArrow()
    common, often = held.column("gram").to_numpy(), held.column("often").to_numpy()
    order = np.argsort(common)
    return common[order], np.minimum(often[order], 65535).astype(np.uint16)


def similar(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, threshold: float, repeated: bool, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """The pairs (a, b) of keys whose sets have a Jaccard similarity of threshold or more.

    Sets are computed anew, and only for the first document of each key of a pair. They are
    deduplicated only where ids repeat.
    """
    needed = settle(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(firsts, "key").select("key", "first"))
    texts = docs.join(small(needed.select(F.col("first").alias("_first")).distinct(), HELD_KEYS), F.col(id_col).eqNullSafe(F.col("_first")), "left_semi")
    sets = _sets(texts, ["key", "grams"], "long array<long>", lambda _, each: (_key(each), each), id_col, text_col, shingle).select("key", "grams")
    held = sets.join(small(needed.select("key"), HELD_KEYS), "key", "left_semi")
    held = held.dropDuplicates(["key"]) if repeated else held
    both = small(pairs, HELD_KEYS).join(held.select(F.col("key").alias("a"), F.col("grams").alias("_a")), "a").join(held.select(F.col("key").alias("b"), F.col("grams").alias("_b")), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.withColumn("_s", shared).where(F.col("_s") >= threshold * (F.size("_a") + F.size("_b") - F.col("_s")) - 1e-9).select("a", "b")


def _apart(heads: DataFrame, parts: DataFrame) -> DataFrame:
    """(gram, key, n, part, _size) of the grams whose keys are in several components; a key without one is its own."""
    own = stored(heads.join(parts, "key", "left").select("gram", "key", "n", F.coalesce("component", "key").alias("part")).distinct())
    several = own.groupBy("gram").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi"), F.count(F.lit(1)).alias("_size")).where("_lo < _hi").select("gram", "_size")
    return stored(own.join(stored(several), "gram"))


def _meetings(own: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of keys of different parts, from (gram, key, n, part, _size).

    All members of a gram of up to MEET_ALL rows meet; those that share two such grams are a pair.
    The members of a larger one are given its pivots: the member that shares most with others, and
    the first of some drawn orders of all keys. A key makes a pair with each pivot that two of its
    larger grams have; so it makes one row for each, however many grams they share.
    """
    few, many = own.where(F.col("_size") <= MEET_ALL), own.where(F.col("_size") > MEET_ALL)
    other = few.select("gram", F.col("key").alias("b"), F.col("part").alias("_part"))
    met = few.join(other, "gram").where((F.col("key") < F.col("b")) & (F.col("part") != F.col("_part"))).select(F.col("key").alias("a"), "b")
    scored = many.withColumn("_score", F.sum("_size").over(Window.partitionBy("key")))
    drawn = [F.min_by("key", F.xxhash64("key", F.lit(i))).alias(f"_p{i}") for i in range(DRAWN_ORDERS)]
    pivots = stored(scored.groupBy("gram").agg(F.max_by("key", "_score").alias("_top"), *drawn))
    some = F.array_distinct(F.array("_top", *[f"_p{i}" for i in range(DRAWN_ORDERS)]))
    given = many.select("gram", "key").join(pivots.select("gram", some.alias("_some")), "gram").groupBy("key").agg(F.flatten(F.collect_list("_some")).alias("_all"))
    twice = let(F.array_sort("_all"), lambda each: F.array_distinct(F.filter(each, lambda x, i: F.get(each, i + 1) == x)))
    starred = given.select("key", F.explode(twice).alias("b")).where("key <> b")
    often = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_c")).where("_c >= 2").select("a", "b")
    return often.union(starred.select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b"))).distinct()


def _rest(own: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: all pairs of keys of different parts that may be similar and that _meetings
    need not have proposed, from (gram, key, n, part, _size).

    Such a pair shares SHARED grams of its prefixes, but at most one of up to MEET_ALL rows: so it
    shares SHARED - 1 larger ones, and still one if each key leaves out its SHARED - 2 largest. All
    members of those meet, in blocks, so that no task holds a whole gram. Of two sets the one whose
    prefix ends first has all its shared grams in both prefixes, or after its own: the pairs with
    too few for the threshold never leave the task. A pair leaves at the least of the grams at which
    it meets, so it is one row however many they are.
    """
    held = own.groupBy("key", "n", "part").agg(F.array_sort(F.collect_list(F.struct((-F.col("_size")).alias("less"), "gram"))).alias("_g"))
    large = F.slice(F.filter("_g", lambda g: g["less"] < -MEET_ALL), SHARED - 1, 1 << 30)
    held = held.withColumn("_large", large).where(F.size("_large") > 0)
    grams = F.concat(F.col("_large.gram"), F.array_except(F.col("_g.gram"), F.col("_large.gram")))

    def tasks(g):
        """(gram, block, lo, hi) of each block that a key's block meets."""
        blocks = F.ceil(-g["less"] / BLOCK).cast("int")
        block = F.pmod(F.xxhash64("key", F.lit("block")), blocks.cast("long")).cast("int")
        return F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(g["gram"].alias("gram"), block.alias("block"), F.least(block, o).alias("lo"), F.greatest(block, o).alias("hi")))

    dealt = held.select("key", "n", "part", grams.alias("grams"), F.size("_large").alias("m"), F.explode(F.flatten(F.transform("_large", tasks))).alias("_t")).select("key", "n", "part", "grams", "m", "_t.*")

    def alike(one, two, row, gram, rows: int) -> np.ndarray:
        """How many grams of (row, gram) the rows one and two share."""
        shared = np.zeros((len(one), len(two)), np.float32)
        order = np.argsort(gram, kind="stable")
        row, gram = row[order], gram[order]
        for start in range(0, int(gram.max(initial=-1)) + 1, 2048):
            lo, hi = np.searchsorted(gram, (start, start + 2048))
            has = np.zeros((rows, 2048), np.float32)
            has[row[lo:hi], gram[lo:hi] - start] = 1
            shared += has[one] @ has[two].T
        return shared

    def meet(t: pa.Table) -> pa.Table:
        key, n, part, at, m = (t.column(c).to_numpy() for c in ("key", "n", "part", "block", "m"))
        grams = t.column("grams").combine_chunks()
        ends = grams.offsets.to_numpy()
        row, each = np.repeat(np.arange(len(key)), np.diff(ends)), grams.flatten().to_numpy()
        before = (np.arange(len(each)) - (ends[:-1] - ends[0])[row] < m[row]) & (each < t.column("gram")[0].as_py())
        _, gram, often = np.unique(each, return_inverse=True, return_counts=True)
        row, gram, before = row[often[gram] > 1], gram[often[gram] > 1], before[often[gram] > 1]
        _, gram = np.unique(gram, return_inverse=True)
        one, two = np.flatnonzero(at == at.min()), np.flatnonzero(at == at.max())
        x, y = n[one].astype(np.float64)[:, None], n[two].astype(np.float64)[None, :]
        fit = (np.minimum(x, y) >= threshold * np.maximum(x, y) - 1e-9) & (part[one][:, None] != part[two][None, :])
        if one[0] == two[0]:
            fit &= one[:, None] < two[None, :]
        left = np.maximum(0, np.ceil(threshold * np.maximum(x, y) - 1e-9) - SHARED)
        fit &= alike(one, two, row, gram, len(key)) >= np.maximum(1, np.ceil(threshold / (1 + threshold) * (x + y) - 1e-9) - left)
        fit &= alike(one, two, row[before], gram[before], len(key)) == 0
        i, j = np.nonzero(fit)
        a, b = key[one][i], key[two][j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("gram", "lo", "hi").applyInArrow(meet, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = STAGE_SIMILARITY, shingle: int = STAGE_WORDS) -> DataFrame:
    """One row for each row of docs: id and component_id, over pairs of a Jaccard similarity of
    threshold or more between their sets of word shingles.

    A similarity of 0.8 leaves some 10 of 64 fingerprint bits different, for which segments would
    be too short to tell documents apart. So SimHash links only propose the closest pairs;
    the others are proposed by shared grams of their prefixes, first with the least key of each gram,
    then, between components so found, as _meetings has it, and at last, between those that are
    still apart, as _rest has it. Every pair is verified by its grams. No similar
    pair is missed at thresholds of 0.8 or more (lower ones let sets of a few grams share fewer than SHARED); the work for a gram in many rows that stay apart grows with their square. Rows
    without words form one component. component_id is the smallest id, nulls aside. Sets are known
    by a 64-bit hash (key); they are computed anew for each use rather than stored, since they take
    more room than the texts. Repeated rows and ids are rows like any other; other columns are not
    read; texts are read whole; an empty table gives an empty result.
    """
    told = [id_col, text_col, shingle]
    each = stored(_sets(docs, ["key", "fp", "n"], "long long int", lambda hashes, grams: (_key(grams), simhash(hashes), len(grams)), *told))
    firsts = settle(each.groupBy("key").agg(F.min(id_col).alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n")))
    common, often = common_grams(docs, each.count(), *told)
    parts_of = _sets(docs, ["key", "n", "prefix"], "long int array<long>", lambda _, grams: (_key(grams), len(grams), prefix(grams, common, often, threshold)), *told)
    heads = parts_of.select("key", "n", F.explode("prefix").alias("gram"))
    met = heads.groupBy("gram").agg(F.min("key").alias("pivot"), F.max("key").alias("_last")).where("pivot < _last").select("gram", "pivot")
    # Copies have one key: their rows of a gram are one.
    heads = stored(heads.join(stored(met), "gram").dropDuplicates(["gram", "key"]))

    fps = settle(firsts.groupBy("fp").agg(F.min("key").alias("least")))
    alike = firsts.select("key", "fp").join(fps, "fp").where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    name = lambda c: fps.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}"))
    linked = links(fps.select("fp")).join(name("a"), "a").join(name("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    fit = lambda n, m: (F.col(n) >= threshold * F.col(m) - 1e-9) & (F.col(m) >= threshold * F.col(n) - 1e-9)
    enough = lambda n, m: F.col("_c") >= F.least(F.lit(SHARED), F.ceil(threshold / (1 + threshold) * (F.col(n) + F.col(m)) - 1e-9))
    stars = heads.where("key <> pivot").groupBy(F.col("pivot").alias("a"), F.col("key").alias("b")).agg(F.count(F.lit(1)).alias("_c"))
    others = alike.union(linked).withColumn("_c", F.lit(SHARED).cast("long"))
    pairs = others.union(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "_c").groupBy("a", "b").agg(F.max("_c").alias("_c"))
    long_as = lambda c, n: firsts.select(F.col("key").alias(c), F.col("n").alias(n))
    pairs = settle(pairs.join(long_as("a", "_n"), "a").join(long_as("b", "_m"), "b").where(fit("_n", "_m") & enough("_n", "_m")).select("a", "b"))
    repeated = bool(each.groupBy(id_col).count().where("count > 1").head(1))
    verified = lambda some: similar(some, docs, firsts, threshold, repeated, *told)
    found = settle(verified(pairs))

    parts = components(found).select(F.col("node").alias("key"), "component")
    own = _apart(heads, parts)
    across = settle(_meetings(own).join(pairs, ["a", "b"], "left_anti").join(long_as("a", "_n"), "a").join(long_as("b", "_m"), "b").where(fit("_n", "_m")).select("a", "b"))
    # The next components start from the stars of these, which are few rounds from their end.
    found = settle(parts.select(F.col("key").alias("a"), F.col("component").alias("b")).union(verified(across)))

    if own.where(F.col("_size") > MEET_ALL).head(1):
        parts = components(found).select(F.col("node").alias("key"), "component")
        own = _apart(own, parts)
        if own.where(F.col("_size") > MEET_ALL).head(1):
            rest = settle(_rest(own, threshold).join(pairs.union(across), ["a", "b"], "left_anti"))
            found = parts.select(F.col("key").alias("a"), F.col("component").alias("b")).union(verified(rest))

    parts = components(found).withColumnRenamed("node", "key")
    rooted = firsts.join(parts, "key", "left").select("key", "first", F.coalesce("component", "key").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return each.select(id_col, "key").join(rooted.join(smallest, "root").select("key", "component_id"), "key").select(id_col, "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, of each component of near copies only the one with the smallest doc_id.

    Repeated rows with that doc_id stay; a component whose ids are all null keeps them.
    """
    found = near_copies(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return docs.join(found.select(F.col("doc_id").alias("_kept")).distinct(), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
