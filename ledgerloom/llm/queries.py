"""Named queries of the training-data operators, with DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.embedding_dedup import vector_groups
from ledgerloom.llm.exact_dedup import exact_groups
from ledgerloom.llm.html_text import main_texts
from ledgerloom.llm.language import identify, learn_profiles
from ledgerloom.llm.language_model import score_texts
from ledgerloom.llm.merkle import merkle_manifest
from ledgerloom.llm.mixing import mix_order
from ledgerloom.llm.near_dedup import near_groups
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.quality import fit_quality, held_out, score_quality
from ledgerloom.llm.suffix_dedup import remove_repeats
from ledgerloom.llm.token_files import read_token_files, write_token_files
from ledgerloom.llm.whitening import fit_whitening, whiten
from ledgerloom.session import Scratch

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    "op1_exact_dedup",
    r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""",
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


@_query("op2_minhash_near_dedup")
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


@_query("op3_mix_sources")
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_order(_table(spark, sf_dir, "documents"))


@_query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


@_query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels").filter(~held_out()))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@_query("op9_embedding_near_dedup")
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(_table(spark, sf_dir, "embeddings"))


@_query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    shards = write_token_files(_table(spark, sf_dir, "documents"), scratch.path("ids"), scratch=scratch)
    return read_token_files(spark, shards)


@_query("op8_language_profiles")
def op8_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.filter(~held_out()))
    return identify(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@_query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


@_query("op10_lm_scores")
def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"), ~held_out(parts=7, part=2))


@_query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(fit_whitening(_table(spark, sf_dir, "embeddings")))


def _sql_leaf(n_chars: str) -> str:
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    text = [f"CAST({f} AS VARCHAR)" for f in fields]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in text) + "))"


#: crc32 of a decimal number's digits, bit by bit.
_SQL_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
        lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

_MERKLE_SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, lang, leaf, version, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS id,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf,
               CASE WHEN {_SQL_CRC32} % 7 = 0 THEN {_sql_leaf("n_chars + 1")} END AS version FROM documents)
),
tree AS (
  SELECT 0 AS level, lang, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, lang, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY level, lang, pos // 2, n
),
subroots AS MATERIALIZED (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
),
top AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n
),
way AS (
  SELECT id, lang, 0 AS level, pos, n, coalesce(version, leaf) AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT w.id, w.lang, w.level + 1, w.pos // 2, (w.n + 1) // 2,
         sha256(CASE WHEN w.pos % 2 = 1 THEN t.h || w.h ELSE w.h || coalesce(t.h, '') END), w.proof || coalesce(t.h, '')
  FROM way w LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level AND t.pos = xor(w.pos, 1)
  WHERE w.n > 1
),
last AS (
  SELECT w.id, s.subroot, 0 AS level, s.pos, s.n, w.h, w.proof
  FROM way w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT w.id, w.subroot, w.level + 1, w.pos // 2, (w.n + 1) // 2,
         sha256(CASE WHEN w.pos % 2 = 1 THEN t.h || w.h ELSE w.h || coalesce(t.h, '') END), w.proof || coalesce(t.h, '')
  FROM last w LEFT JOIN top t ON t.level = w.level AND t.pos = xor(w.pos, 1)
  WHERE w.n > 1
)
SELECT l.doc_id, l.leaf, f.subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaves l JOIN last f ON f.id = l.id AND f.n = 1 CROSS JOIN (SELECT h FROM top WHERE n = 1) r
"""


@_query("op12_merkle_manifest", _MERKLE_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(_table(spark, sf_dir, "documents"))


@_query("op13_html_extraction")
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(_table(spark, sf_dir, "pages"))
