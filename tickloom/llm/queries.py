"""The digest queries over the test tables; each gets its rows through its operator."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import ann, bpe, decontam, infill, periodic, pii, prefix_hash, secrets, simhash, substring, token_counts, token_store, toxicity
from tickloom.llm.common import read, scratch

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Tokens above which a document is over the limit of op7.
TOKEN_LIMIT = 2048
#: Score from which a document counts as toxic.
TOXIC = 0.7


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents to a store, look every key up and read the files back."""
    docs = read(spark, sf_dir, "documents")
    path = scratch(spark, "token-store")
    token_store.write(docs, path, WORD_BPE, end_id=1)
    found = token_store.lookup(docs, path).select("shard", "segment", "place", "copies")
    held = token_store.contents(spark, path).join(found, ["shard", "segment", "place"], "left")
    return held.select(F.col("key").alias("doc_id"), "start", F.col("n_ids").cast("long").alias("n_tokens"), "ids_crc32", F.col("copies").cast("long").alias("indexed_copies"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(read(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3)
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(read(spark, sf_dir, "documents"), window=50).drop("kept_text")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(list(pii.BASE)), 256).alias("base_sha256"), pii.listed(pii.KINDS).alias("spans"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, n=10)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.prefix_counts(read(spark, sf_dir, "documents"), WORD_BPE, every="char")
    return counted.select("doc_id", "n_bytes", token_counts.n_tokens().alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("secrets", lambda x: F.concat_ws(":", x["s"], x["e"])), ",")
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), listed.alias("spans"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=13, one_in=20).withColumn("n_items", F.size("items").cast("long")).drop("items")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(read(spark, sf_dir, "documents"), seed="1")
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """In every tenth document by a hash of its id, words from one place on repeat the first ones there."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    a = (F.col("g") % F.col("n")).cast("int")
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("int")
    chosen = docs.where(h % 10 == 0).select("doc_id", words.alias("words"), F.floor(h / 10).alias("g")).withColumn("n", F.size("words"))
    made = chosen.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", p)
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    line = F.array_join(F.transform("words", lambda w, i: F.get("words", at(i))), " ")
    return docs.where(h.isNull() | (h % 10 != 0)).select("doc_id", "text").unionByName(made.select("doc_id", line.alias("text")))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse(_with_planted_runs(read(spark, sf_dir, "documents")), power=4, least=6)
    # the run of most periods, told by whole numbers; runs are in order of start, then period
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise("")
    return (
        found.withColumn("best", best)
        .select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")], F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
        .withColumn("exponent_milli", F.expr("1000 * length div period"))
    )


def _last_third(own: str, after: str) -> str:
    """A text whose last third gives way to the beginning of the one that follows."""
    cut = len(own) // 3
    return own[: len(own) - cut] + after[:cut]


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prefix_hash.compared(read(spark, sf_dir, "documents"), _last_third)
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_bytes")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_store, op2_byte_bpe, op3_simhash, op4_substring, op5_pii, op6_ann, op7_token_counts, op8_secrets, op9_decontamination, op10_toxicity, op11_infill, op12_periodic, op13_fingerprints]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_OP4 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(ws) - 48)) AS t(i)),
lo AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN lo USING (h) WHERE low < doc_id),
each AS (SELECT doc_id, k, ws[k] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(k)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS line FROM each ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS line FROM b, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS line FROM d, sizes, unnest(range(1, len(ws) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.line = dw.line),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
h AS (SELECT *, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(digest, 9, 8) AS BIGINT) % (n + 1) AS y, CAST('0x' || substr(digest, 17, 8) AS BIGINT) % 100 AS z, CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 100 AS u FROM d),
f AS (SELECT *, least(x, y) AS c1, greatest(x, y) AS c2, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR z >= 90 THEN 'plain' WHEN u < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, c1) AS pre, substr(text, c1 + 1, c2 - c1) AS mid, substr(text, c2 + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN c1 END AS prefix_chars, CASE WHEN form <> 'plain' THEN c2 - c1 END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the other queries have brute-force tests."""
    return {"op4_substring": _OP4, "op9_decontamination": _OP9, "op11_infill": _OP11} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
