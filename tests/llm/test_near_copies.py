"""Near copies whose shared grams are all in many documents that are no copies of each other."""

import itertools
import random

import pytest

from tramline.llm import simhash


def sets(text):
    w = text.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def least_of_components(texts):
    each, root = [sets(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if 5 * len(each[a] & each[b]) >= 4 * len(each[a] | each[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [40, 512])
def test_similar_pairs_in_large_grams(spark, monkeypatch, block):
    """Runs of passages from a small pool: each gram is in dozens of documents, few of which are similar."""
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    random.seed(11)
    pool = [" ".join(f"w{p}x{i}" for i in range(12)) for p in range(14)]
    texts = []
    for _ in range(600):
        chosen = [pool[p] for p in sorted(random.sample(range(14), 7))]
        texts.append(" ".join(chosen))
        if random.random() < 0.2:
            w = texts[-1].split()
            texts.append(" ".join(w[random.randrange(0, 6) : len(w) - random.randrange(0, 6)]))
    random.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    want = least_of_components(texts)
    assert len(set(want)) > 400 and [got[i] for i in range(len(texts))] == want


def test_each_pair_of_large_grams_is_proposed_once(spark, monkeypatch):
    """Sets that share many large grams are one row, not one for each gram, and none is missed."""
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rows = [(g, key, 40, key, 30) for key in range(30) for g in range(20)] + [(100 + key, key, 40, key, 1) for key in range(30)]
    own = spark.createDataFrame(rows, "gram long, key long, n int, part long, _size long")
    proposed = simhash._rest(own, 0.8)
    assert sorted(map(tuple, proposed.collect())) == list(itertools.combinations(range(30), 2))
    plan = proposed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("FlatMapGroupsInArrow") and "Join" not in plan


def generated(plan):
    """Rows that the Generate nodes of an executed plan made."""
    name, kin = plan.nodeName(), plan.children()
    within = plan.finalPhysicalPlan() if name.startswith("AdaptiveSparkPlan") else plan.plan() if "QueryStage" in name else None
    own = plan.metrics().get("numOutputRows").get().value() if name == "Generate" else 0
    return own + (generated(within) if within is not None else 0) + sum(generated(kin.apply(i)) for i in range(kin.size()))


def test_members_of_large_grams_make_a_row_for_each_pivot(spark):
    """However many grams they share: one row for each pivot that shares two, none for a single gram."""
    rows = [(g, key, 40, key, 50) for key in range(50) for g in range(20)] + [(99, key, 40, key, 40) for key in range(100, 140)]
    met = simhash._meetings(spark.createDataFrame(rows, "gram long, key long, n int, part long, _size long"))
    pairs = {tuple(r) for r in met.collect()}
    pivots = {x for x in range(50) if sum(x in p for p in pairs) == 49}
    assert 1 <= len(pivots) <= 7 and pairs == {(min(p, k), max(p, k)) for p in pivots for k in range(50) if k != p}
    other = met.groupBy().count()
    other.collect()
    assert generated(other._jdf.queryExecution().executedPlan()) <= 50 * 7


def test_commonest_grams_come_last(spark):
    """In samples of any size a gram found more often comes after one found less often."""
    texts = ["a b c d e f"] * 9 + ["b c d e f g"] * 4 + ["one two three four five six seven"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    common, often = simhash.common_grams(docs, len(texts), "doc_id", "text", 5)
    assert sorted(often.tolist()) == [4, 9, 13] and sorted(common.tolist()) == common.tolist()
    rare = simhash.shingle_hashes(texts[-1], 5).view("int64")
    every = sorted([*common.tolist(), *rare.tolist()])
    first = simhash.prefix(simhash.np.array(every), common, often, 0.2).tolist()
    assert first == [*sorted(rare.tolist()), *(g for _, g in sorted(zip(often.tolist(), common.tolist())))]


def test_exploded_keys_are_not_broadcast(spark):
    """Spark sizes an exploded array as one entry, so that some 35 rows for each of 300,000 fingerprints seem to fit a broadcast."""
    fps = spark.range(300_000).selectExpr("xxhash64(id) AS fp")
    assert "Broadcast" not in simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    pairs = simhash.links(spark.createDataFrame([(0,), (7,), (-1,), (1 << 40,), (15,)], "fp long"))
    assert {tuple(sorted(r)) for r in pairs.collect()} == {(0, 7), (0, 1 << 40), (7, 15)}
