"""Secret scans over an incremental blob ledger.

Every version of every text is addressed by the SHA-256 of its content. The ledger records which
(blob, rule, rule version) triples have been scanned and what was found. A run reads one copy of
each blob, applies only the rules that the ledger lacks for it, and joins all findings back to all
rows that carry the blob. Everything is built from DataFrame functions.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import exists, scratch_dir, settle, table, text_of

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what its pattern finds, leftmost and non-overlapping, of at least
    `least` characters in `group`. `hint`, if given, is a string that every match contains."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1
    hint: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The order of the rules breaks ties among spans with the same start. `hex` and `access` state
#: their least length in the pattern: a run of their characters is matched whole or not at all.
BASE_RULES = (
    Rule("assign", _ASSIGN, 12, 2),
    Rule("access", "AKIA[A-Z0-9]{14,}", hint="AKIA"),
    Rule("hex", "[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", hint="eyJ"),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY"),
)
RULES = BASE_RULES + MORE_RULES
_SPANS = "array<struct<start:bigint,end:bigint>>"


def spans(text: Column, rule: Rule) -> Column:
    """The rule's matches in a text that is not null, as (start, end) in code points, end exclusive.

    The pieces between the matches, from a split by the same pattern, give the positions.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast(_SPANS).alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.char_length(pair["gap"])
        end = begin + F.char_length(pair["match"])
        value = pair["match"] if not rule.group else F.regexp_extract(pair["match"], rule.pattern, rule.group)
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        kept = F.concat(F.coalesce(acc["found"], F.lit(None).cast(_SPANS), F.array().cast(_SPANS)), one)
        return F.struct(end.alias("at"), F.when(F.char_length(value) >= rule.least, kept).otherwise(acc["found"]).alias("found"))

    # The gap after the last match has no match beside it and is left out.
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), lambda p: p["match"].isNotNull())
    found = F.aggregate(pairs, start, step, lambda acc: F.coalesce(acc["found"], F.array().cast(_SPANS)))
    may = F.contains(text, F.lit(rule.hint)) if rule.hint else F.regexp_like(text, pattern)
    return F.when(may, found).otherwise(F.array().cast(_SPANS))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """New ledger rows (blob, rule, spans), rule as kind@version, for the pairs that the ledger lacks.

    A blob is the SHA-256 of a text (null as empty); one copy of each is read, whole. A pair that
    finds nothing is recorded with an empty array, so that it is not scanned again.
    """
    text = text_of(text_col)
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("_text")).groupBy("blob").agg(F.first("_text").alias("_text"))
    done = F.array().cast("array<string>")
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("_done"))
        blobs = blobs.join(seen, "blob", "left").where(F.col("_done").isNull() | (F.size(F.array_except(F.array(*[F.lit(r.key) for r in rules]), "_done")) > 0))
        done = F.coalesce("_done", done)
    found = [F.when(~F.array_contains(done, r.key), F.struct(F.lit(r.key).alias("rule"), spans(F.col("_text"), r).alias("spans"))) for r in rules]
    return blobs.select("blob", F.explode(F.array_compact(F.array(*found))).alias("_f")).select("blob", "_f.rule", "_f.spans")


def read_ledger(spark: SparkSession, at: str) -> DataFrame | None:
    """The ledger stored at a folder, None if there is none yet."""
    return spark.read.parquet(at) if exists(spark, at) else None


def update_ledger(versions: DataFrame, at: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The ledger stored at a folder, after the pairs that it lacked have been scanned and appended.

    A run that failed appends nothing; the next one scans its pairs.
    """
    scan(versions, read_ledger(versions.sparkSession, at), rules, text_col).write.mode("append").parquet(at)
    return read_ledger(versions.sparkSession, at)


def _found(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...], text_col: str) -> DataFrame:
    """(row, found) for each row of versions, from a ledger that has all its blobs."""
    place = F.coalesce(*[F.when(F.col("rule") == r.key, F.lit(i)) for i, r in enumerate(rules)])
    hits = ledger.where(F.size("spans") > 0).withColumn("_nth", place).where(F.col("_nth").isNotNull())
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("_nth").alias("nth"), s["end"].alias("end")))
    # Settled, so that the join below shuffles both sides plainly and a blob with many copies is split.
    per_blob = settle(hits.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(each))).alias("found")))
    none = F.array().cast("array<struct<start:bigint,nth:int,end:bigint>>")
    rows = versions.select(F.struct(*[F.col(f"`{c}`") for c in versions.columns]).alias("row"), F.sha2(text_of(text_col), 256).alias("blob"))
    return rows.join(per_blob, "blob", "left").select("row", F.coalesce("found", none).alias("found"))


def findings(versions: DataFrame, at: str | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """versions with found: all spans (start, nth, end) of the rules, by start, then by the rule's place.

    at is the folder of the ledger, which is read and appended to; None takes a new one in the
    shared folder. Null and empty texts have no spans. Repeated rows and copies, whatever their
    ids, each get the findings of their blob. Texts are read whole, however long. A column named
    found is replaced; all others stay. An empty table gives an empty result.
    """
    at = at or f"{scratch_dir(versions.sparkSession)}/ledger-{uuid.uuid4().hex}"
    both = _found(versions, update_ledger(versions, at, rules, text_col), rules, text_col)
    return both.select(*[F.col("row")[c].alias(c) for c in versions.columns if c != "found"], "found")


def _told(found: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    told = lambda s: F.concat_ws(":", F.element_at(kinds, s["nth"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, told), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = findings(docs).select("doc_id", "found")
    base = F.filter("found", lambda s: s["nth"] < len(BASE_RULES))
    count = lambda i: F.size(F.filter("found", lambda s: s["nth"] == i)).cast("long").alias(f"n_{BASE_RULES[i].kind}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(_told(base, RULES), 256).alias("base_sha256"), _told(F.col("found"), RULES).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str, at: str | None = None) -> DataFrame:
    """The documents with every found span replaced by [kind]; n_chars is counted anew where the text changed.

    Overlapping spans are replaced as one, under the name of the first. All columns stay, null and
    empty texts as they are. at is the folder of the ledger, as in findings.
    """
    kinds = F.array(*[F.lit(f"[{r.kind}]") for r in RULES])
    at = at or f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"
    found = _found(docs, update_ledger(docs, at), RULES, "text")
    old = F.col("row")["text"]
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(old, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(kinds, s["nth"] + 1))
        return F.struct(F.when(fresh, piece).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(old, acc["at"] + 1, F.char_length(old)))
    hit = F.size("found") > 0
    out = found.select("row", "found", F.when(hit, F.aggregate("found", start, step, rest)).otherwise(old).alias("text"))
    columns = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(hit, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*[v.alias(c) for c, v in columns.items()])


def secret_ledger_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, pairs: how many (blob, rule version) pairs of documents are scanned at first, again, and after one rule's new version."""
    docs = table(spark, sf_dir, "documents").select("text")
    at = f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"
    raised = (replace(RULES[0], version=RULES[0].version + 1), *RULES[1:])
    runs = []
    for nth, rules in enumerate((RULES, RULES, raised), 1):
        before = read_ledger(spark, at)
        held = before.count() if before is not None else 0
        runs.append((nth, update_ledger(docs, at, rules).count() - held))
    return spark.createDataFrame(runs, "run int, pairs long")


ORACLE_LEDGER_RUNS = f"""
WITH b AS (SELECT count(DISTINCT coalesce(text, '')) AS n FROM documents)
SELECT 1::INTEGER AS run, n * {len(RULES)} AS pairs FROM b UNION ALL SELECT 2, 0 UNION ALL SELECT 3, n FROM b
"""

_JOINED = "array_to_string(list_transform(list_sort(list_transform({0}, lambda x: {{'s': x.s, 'n': x.n, 'e': x.e}})), lambda x: ['assign','access','hex','jwt','forge','pem'][x.n + 1] || ':' || x.s || ':' || x.e), ',')"


def _oracle() -> str:
    patterns = [(r.pattern, r.least, r.group) for r in RULES]
    parts, lists = [], []
    for n, (pattern, least, group) in enumerate(patterns):
        p = pattern.replace("'", "''")
        value = f"regexp_extract(m, '{p}', {group})" if group else "m"
        parts.append(
            f"""f{n} AS (SELECT t, list({{'s': s, 'n': {n}, 'e': s + length(m)}}) FILTER (length({value}) >= {least}) AS f FROM (
  SELECT t, m, (sum(length(g) + length(m)) OVER (PARTITION BY t ORDER BY i) - length(m))::BIGINT AS s
  FROM (SELECT t, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i
        FROM (SELECT t, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gs FROM b) WHERE len(ms) > 0)) GROUP BY t)"""
        )
        lists.append(f"coalesce(f{n}.f, [])")
    joins = " ".join(f"LEFT JOIN f{n} ON f{n}.t = b.t" for n in range(len(patterns)))
    every, base = " || ".join(lists), " || ".join(lists[:3])
    return f"""WITH b AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
{', '.join(parts)},
r AS (SELECT b.t, {every} AS f, {base} AS base, len({lists[0]}) AS a, len({lists[1]}) AS k, len({lists[2]}) AS h FROM b {joins})
SELECT doc_id, a::BIGINT AS n_assign, k::BIGINT AS n_access, h::BIGINT AS n_hex,
       sha256(coalesce({_JOINED.format('base')}, '')) AS base_sha256, coalesce({_JOINED.format('f')}, '') AS spans
FROM documents JOIN r ON r.t = coalesce(text, '')"""


ORACLE_OP9 = _oracle()
