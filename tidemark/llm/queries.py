"""The registered queries of the corpus operators: thin, they apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ball_tree, cdc, chat, collocations, decontam, html_tree, identifiers, packing, qda, ring, rules, simhash, token_output
from tidemark.llm.common import materialize, small_batches, work_path
from tidemark.llm.tokens import vocabulary_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    token_output.write_tokens(_table(spark, sf_dir, "documents"), path, vocabulary_path("word_bpe_49k.json"), end_id=2)
    return token_output.read_tokens(spark, path)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = vocabulary_path("byte_bpe_50k.json")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(materialize(chat.format_chats(turns, tokenizer), "chats"), tokenizer)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.repeated_passages(_table(spark, sf_dir, "documents")).drop("key")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words_in=3)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_policy(rules.ledger(_table(spark, sf_dir, "documents")), rules.POLICIES["v1"])
    base = F.col("failed").bitwiseAND(F.lit(rules.POLICIES["base"])) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", F.col("failed").alias("failed_rules"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op8_hash_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.assign_shards(_table(spark, sf_dir, "documents"), n_shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(_table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op13_contextual_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.identifiers(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_hash_ring_shards": op8_hash_ring_shards,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_html_extraction": op10_html_extraction,
    "op11_ranked_search": op11_ranked_search,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_contextual_identifiers": op13_contextual_identifiers,
}

#: DuckDB SQL of those that SQL can express.
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES: dict[str, str] = {
    "op11_ranked_search": f"""WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents), l AS (SELECT doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0), c AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM l),
 tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY 1, 2), q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
 w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term, big_n),
 s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN l USING (doc_id), c GROUP BY 1, 2),
 r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0) SELECT * FROM r WHERE rank <= 10""",
    "op12_phrase_collocations": r"""WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(x) AS piece, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS x FROM documents)),
 w AS (SELECT doc_id, lang, i, unnest(x) AS w1, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, lang, i, regexp_extract_all(piece, '[^\x20\x09]+') AS x FROM p)),
 g AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id, lang, i ORDER BY k)), n AS (SELECT lang, count(*)::BIGINT AS n FROM w GROUP BY 1),
 f1 AS (SELECT lang, w1, count(*)::HUGEINT AS f FROM g GROUP BY 1, 2), f2 AS (SELECT lang, w1, w2, count(*)::HUGEINT AS f FROM g WHERE w2 IS NOT NULL GROUP BY 1, 2, 3), f3 AS (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS f FROM g WHERE w3 IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
 x AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY 1, 2, 3),
 c AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, p.f AS l, q.f AS r, 1 AS k FROM f2 JOIN f1 p ON p.lang = f2.lang AND p.w1 = f2.w1 JOIN f1 q ON q.lang = f2.lang AND q.w1 = f2.w2 LEFT JOIN x ON x.lang = f2.lang AND x.w1 = f2.w1 AND x.w2 = f2.w2 WHERE f2.f >= 10 AND (x.f IS NULL OR 100 * x.f < 50 * f2.f)
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, p.f, q.f, 1 FROM f3 t JOIN f1 p ON p.lang = t.lang AND p.w1 = t.w1 JOIN f2 q ON q.lang = t.lang AND q.w1 = t.w2 AND q.w2 = t.w3
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, p.f, q.f, 2 FROM f3 t JOIN f2 p ON p.lang = t.lang AND p.w1 = t.w1 AND p.w2 = t.w2 JOIN f1 q ON q.lang = t.lang AND q.w1 = t.w3),
 s AS (SELECT *, (1000000 * a * a) // (l * r) AS score FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE cut = 1)
 SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000""",
}
