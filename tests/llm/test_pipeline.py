"""The pipeline's stages in order, each on what the one before kept, against plain Python."""

import collections
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tramline.llm import mixing, pieces, quality, registry, secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4) if w else 0))


def kept_of_copies(docs):
    """The smallest id of each component of texts with a similarity of 0.8 or more."""
    sets, root = [grams(r["text"]) for r in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, r in enumerate(docs):
        least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return sorted(least.values())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    steps, before = [docs.collect()], docs
    for nth, stage in enumerate(stages.values()):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(nth)))
        docs = spark.read.parquet(str(tmp_path / str(nth)))
        steps.append(docs.collect())
        if nth < len(stages) - 1:
            assert docs.columns == columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    # Quality: the classifier's own verdicts, and nearly all good documents stay.
    verdicts = {r["doc_id"]: r["keep"] for r in quality.classify(before, labels).collect()}
    assert sorted(r["doc_id"] for r in steps[1]) == sorted(i for i, k in verdicts.items() if k)
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good - {r["doc_id"] for r in steps[1]}) <= 0.02 * len(good) and len(steps[1]) < len(steps[0])
    # Near copies: one of each component.
    assert sorted(r["doc_id"] for r in steps[2]) == kept_of_copies(steps[1])
    # Secrets: no pattern is left where one was found, other texts stay.
    old = {r["doc_id"]: r["text"] for r in steps[2]}
    named = "|".join(re.escape(f"[{r.kind}]") for r in secrets.RULES)
    for r in steps[3]:
        assert r["n_chars"] == len(r["text"]) or r["text"] == old[r["doc_id"]]
        assert not re.search("AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", r["text"])
        parts = re.split(named, r["text"])
        assert r["text"] == old[r["doc_id"]] if len(parts) == 1 else all(p in old[r["doc_id"]] for p in parts)
    # Mix: whole documents, as often as most of them is taken.
    third = spark.read.parquet(str(tmp_path / "2"))
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.taken(*mixing.plan(third)).collect()}
    times = collections.Counter(r["doc_id"] for r in steps[4])
    assert times == {i: n for i, (t, s) in taken.items() if (n := int(t / s + 0.5) if s else 1)}
    # Ids: the public library's.
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    text = {r["doc_id"]: r["text"] for r in steps[3]}
    assert len(steps[5]) == len(steps[4])
    assert all(r["ids"] == lib.encode(text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in steps[5])


def test_run_leaves_only_its_rows(spark):
    from tramline.llm.common import scratch_dir

    out = corpus_pipeline.run(spark, SF)
    folder = Path(scratch_dir(spark).removeprefix("file:"))
    assert out.count() and not list(folder.glob("scratch-*"))
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_every_operator_is_registered():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), db.sql(registry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    shown = lambda df: sorted(tuple("null" if v is None or v != v else f"{v:.12g}" if isinstance(v, (float, int)) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))
    assert shown(got) == shown(want)
