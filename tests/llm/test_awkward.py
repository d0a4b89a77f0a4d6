"""Every operator and stage on null, empty, very long and repeated rows, ties, clashing columns and empty tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from test_operators import WORD, brute_fingerprint, brute_spans, brute_stats
from tramline.llm import matroska, mixing, pieces, quality, repeats, rules, secrets, simhash, toxicity, urls

NAMES = ("found", "blob", "key", "fp", "words", "runs", "_row", "_n", "_id", "h", "th", "p", "keep", "kept", "score", "size", "sid", "ids", "feature", "payload")


@pytest.fixture(scope="module")
def odd(spark):
    """(rows, table): a text of 120,000 words twice, one word 3,000 times, a long unbroken run, nulls, empties, repeated rows; all clashing columns."""
    rnd = random.Random(11)
    long = " ".join(rnd.choice(("alpha", "beta", "gamma", "d")) + str(rnd.randrange(4000)) for _ in range(120_000)) + " password = Aa1Bb2Cc3Dd4Ee5"
    rows = [(1, long, "en", "s1"), (2, long, "en", "s1"), (3, "same " * 3000, "en", None), (4, "x" * 20_000 + " deadbeef0123456789", None, "s2"), (5, None, "en", "s2"), (6, "", "en", "s2"), (None, "no id here", "fr", None)]
    rows += [(7, "twice the same row", "en", "s1")] * 2 + [(8, " \t\n\x0b ", None, None), (8, "another text of the same id", "en", "s1")]
    return rows, spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit(n) for n in NAMES}).repartition(3)


def pairs(df, *cols):
    return sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))


def listed(rows, f):
    return sorted(map(repr, (f(*r) for r in rows)))


def test_media(odd):
    rows, docs = odd
    got = pairs(matroska.digests(matroska.store_texts(docs)), "doc_id", "payload_sha256")
    assert got == listed(rows, lambda i, t, *_: (i, hashlib.sha256(matroska.padded((t or "").encode())).hexdigest()))


def test_repeats(odd):
    rows, docs = odd
    got = pairs(repeats.remove_repeats(docs), "doc_id", "n_words", "n_removed")
    n = lambda t: len(WORD.findall(t or ""))
    assert got == listed(rows, lambda i, t, *_: (i, n(t), n(t) if i == 2 else 0))


def test_fingerprints(odd):
    rows, docs = odd
    got = {(r["doc_id"], r["fp"] & (1 << 64) - 1) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(i, brute_fingerprint(t)) for i, t, *_ in rows}


def test_statistics(odd):
    rows, docs = odd
    got = pairs(rules.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == listed(rows, lambda i, t, *_: (i, *brute_stats(t)))


def test_encoding(odd):
    import sentencepiece

    rows, docs = odd
    try:
        codec = pieces.Codec(docs.sparkSession)
    except OSError:
        pytest.skip("no piece model here")
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    got = pairs(pieces.encode(docs.withColumnRenamed("ids", "x"), codec), "doc_id", "ids")
    assert got == listed(rows, lambda i, t, *_: (i, lib.encode(t or "")))
    back = pieces.decode(pieces.encode(docs, codec), codec)
    assert pairs(back, "doc_id", "text") == listed(rows, lambda i, t, *_: (i, t or ""))


def test_findings(odd):
    rows, docs = odd
    got = pairs(secrets.findings(docs).select("doc_id", F.transform("found", lambda s: F.struct(s["start"], s["nth"], s["end"])).alias("f")), "doc_id", "f")
    assert [re.sub(r"Row\(\w+=(\d+), nth=(\d+), \w+=(\d+)\)", r"(\1, \2, \3)", g) for g in got] == listed(rows, lambda i, t, *_: (i, brute_spans(t)))


def test_sizes(odd):
    rows, docs = odd
    got = pairs(mixing.taken(*mixing.plan(docs)), "doc_id", "size")
    assert got == listed(rows, lambda i, t, *_: (i, len(WORD.findall(t or ""))))


def test_scores(spark, odd):
    rows, docs = odd
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, 0, 1), (6, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs.drop("score"), model)
    plain = toxicity.Scorer(model)
    assert {(r["doc_id"], round(r["score"], 9)) for r in got.collect()} == {(i, round(plain.score(t), 9)) for i, t, *_ in rows}
    out = quality.classify(docs, labels)
    assert out.count() == len(rows) and all(0 <= r["posterior"] <= 1 and r["keep"] == (r["posterior"] >= 0.5) for r in out.collect())


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/" + "x" * 50_000, "<p>" * 50_000), (2, None, None), (2, "", ""), (None, "http://a.net/es/1", "<link rel=canonical href=>")], "page_id long, url string, html string").withColumns({n: F.lit(n) for n in (*NAMES, "_url", "_at", "a", "b")})
    got = urls.judge(pages)
    assert sorted(map(str, (r["verdict"] for r in got.collect()))) == ["allow", "allow", "block", "block"]
    assert all(r["_url"] == "_url" and r["found"] == "found" for r in got.collect())


def test_stages(spark, odd, tmp_path):
    _, docs = odd
    spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for stage in (quality.reject_poor, simhash.keep_one, secrets.redact, mixing.mix):
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, str(tmp_path))
            assert out.columns == docs.columns
            got = out.collect()
            assert all(r[n] == n for r in got for n in NAMES)
            assert bool(got) == (some is docs)
    assert pieces.tokens(spark, docs, "").count() == docs.count()
