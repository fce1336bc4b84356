"""The registered query of each operator, over whole tables, and its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import chat, conversation_repair, decontaminate, jaccard_join, kdtree_search, license_scan, lm_score, pii, quality, sentencepiece_bpe, substring_dedup, token_alignment, url_filter
from tracelake.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def held_out(k: int):
    """Rows kept from training: crc32 of the id mod k is 1; a null id is never held out and never trained on."""
    return F.coalesce(fold(F.col("doc_id"), k) == 1, F.lit(False))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def sha256(text) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_bpe.round_trip(table(spark, sf_dir, "documents"), piece_model(), ["doc_id"])
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256(joined).alias("ids_sha256"), sha256(F.col("decoded")).alias("decoded_sha256"))


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kdtree_search.clean(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64.0)
    found = kdtree_search.top_k(rows, rows.where("id % 20 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))


SQL["op3_exact_top_k"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64.0 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.x, c.x) DESC, c.vec_id)::INT AS rank,
  c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 20 = 0
QUALIFY rank <= 20
"""


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), ~held_out(3), ["doc_id"])
    return judged.select("doc_id", held_out(3).alias("held_out"), "score", "predicted")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    plain = F.filter("spans", lambda s: s["plain"])

    def count(kind: str) -> Column:
        return F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, sha256(span_text(plain)).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"))


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm_score.judge(docs, F.col("doc_id").isNotNull() & ~held_out(5))
    return scored.select("doc_id", held_out(5).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = sha256(F.array_join("items", ",")).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids, "contaminated")


SQL["op8_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, least(10, len(w)) AS n, array_to_string(w[s + 1 : s + least(10, len(w))], ' ') AS g
  FROM i, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS u(s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, text, s, n, array_to_string(w[s + 1 : s + n], ' ') AS g FROM (SELECT doc_id, text, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, text, item_id, s, n FROM dw JOIN iw USING (n, g)),
h AS (SELECT doc_id, text, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, text, unnest(range(s, s + n)) AS p FROM m) GROUP BY ALL),
f AS (SELECT doc_id, text, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, text, item_id::VARCHAR AS k FROM m) GROUP BY ALL)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id IS NOT DISTINCT FROM h.doc_id AND d.text IS NOT DISTINCT FROM h.text
LEFT JOIN f ON d.doc_id IS NOT DISTINCT FROM f.doc_id AND d.text IS NOT DISTINCT FROM f.text
"""


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


@query
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


SQL["op10_chat_formatting"] = r"""
WITH t AS (SELECT DISTINCT coalesce(conv_id, -9223372036854775808) AS conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
g AS (SELECT conv_id, turn, count(*) AS k, string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY role, text) AS s FROM t GROUP BY ALL),
p AS (SELECT conv_id, turn, sum(k) OVER w AS n, string_agg(turn || '#' || s, '') OVER w AS s, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
kept AS (SELECT n, s, min(conv_id) AS conv_id FROM p WHERE is_last GROUP BY ALL),
best AS (SELECT conv_id FROM kept WHERE (n, s) NOT IN (SELECT n, s FROM p WHERE NOT is_last))
SELECT nullif(conv_id, -9223372036854775808) AS conv_id, floor(turn / 1024.0)::BIGINT AS part, count(*)::BIGINT AS n_turns,
  string_agg('<|' || replace(role, '|', '') || '|>' || chr(10) || replace(replace(text, '<|', '< |'), '|>', '| >') || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS text
FROM t JOIN best USING (conv_id) GROUP BY conv_id, floor(turn / 1024.0)
"""


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.linked(table(spark, sf_dir, "documents"), byte_model(), piece_model(), ["doc_id"])


@query
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicate(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", sha256(F.col("kept")).alias("kept_sha256"))


SQL["op12_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + 19], ' ') ORDER BY doc_id, s) AS k
  FROM d, unnest(range(1, len(w) - 18)) AS u(s) WHERE len(w) >= 20),
r AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM g WHERE k > 1) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(table(spark, sf_dir, "conversations"))
