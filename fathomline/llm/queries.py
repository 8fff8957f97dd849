"""Registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .common import crc_remainder, let, words
from .content_dedup import exact_dedup
from .host_quality import host_quality
from .lm_score import score_documents
from .mixing import mix_sources
from .near_dup import near_duplicates
from .packing import pack_documents
from .phrases import mine_phrases
from .pieces import encode_pieces
from .runs import periodic_runs
from .sharding import shard_documents
from .token_store import token_round_trip
from .toxicity import score_toxicity
from .url_rules import judge_urls

#: Bytes of text in a shard of op4.
SHARD_BYTES = 4 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op4_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), SHARD_BYTES).select("doc_id", "shard", "shard_depth", "shard_bytes", "shard_docs")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))


RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return judge_urls(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "selected", "copies")


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Texts of identifiers whose crc32 ends in 0 go on with a stretch of their words from some place on."""
    h = crc_remainder(F.col("doc_id"), 1 << 32)
    g = F.expr("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) div 10")

    def repeated(w):
        n = F.greatest(F.size(w), F.lit(1)).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.array_join(F.transform(w, lambda x, i: F.when(i < s["a"], x).otherwise(F.get(w, (s["a"] + (i - s["a"]) % s["p"]).cast("int")))), " "))

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.when(h % 10 == 0, let(words(text), repeated)).otherwise(text).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_token_store, op3_lm_scores, op4_extendible_shards, op5_near_duplicates, op6_host_quality, op7_url_rules, op8_exact_dedup, op9_toxicity, op10_source_mixing, op11_sentence_pieces, op12_phrases, op13_periodic_runs)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS b, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS bits FROM documents
), leaf AS (
  SELECT 0 AS depth, doc_id, b, bits, sum(b) OVER () AS s, count(*) OVER () AS n FROM d
  UNION ALL
  SELECT depth + 1, doc_id, b, bits, sum(b) OVER (PARTITION BY bits >> (51 - depth)), count(*) OVER (PARTITION BY bits >> (51 - depth))
  FROM leaf WHERE s > {SHARD_BYTES} AND n > 1 AND depth < 52
)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(bits >> (52 - depth)), 52, '0'), 53 - depth) END AS shard, depth::INTEGER AS shard_depth, s::BIGINT AS shard_bytes, n::BIGINT AS shard_docs
FROM leaf WHERE s <= {SHARD_BYTES} OR n = 1 OR depth = 52
"""

OP6_SQL = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w, row_number() OVER () AS r FROM documents
), tri AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3
), grams AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM tri
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM grams, (VALUES (0), (1), (2)) AS s(k) WHERE c >= 2 GROUP BY r
), line AS (
  SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(line.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN line USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), g AS (
  SELECT *, base_failed OR 100 * n_symbols > 30 * word_chars OR 100 * n_dup_lines > 50 * n_words AS any_failed FROM f
), h AS (
  SELECT source AS host, count(*)::DOUBLE AS n, sum(any_failed::INTEGER)::DOUBLE AS x FROM g GROUP BY source
), p AS (
  SELECT sum(x) / sum(n) AS mean, greatest(sum(x * x / n) / sum(n) - (sum(x) / sum(n)) * (sum(x) / sum(n)), 0) AS v FROM h
), k AS (
  SELECT mean, CASE WHEN v < 1e-12 THEN 1e4 ELSE least(greatest(mean * (1 - mean) / v - 1, 1), 1e4) END AS strength FROM p
), v AS (
  SELECT host, (x + mean * strength) / (n + strength) AS rate FROM h, k
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed) AND rate <= 0.5 AS kept, round(rate, 9) AS host_rate
FROM g JOIN v ON g.source IS NOT DISTINCT FROM v.host
"""

OP7_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.v, 'allow') AS verdict
FROM s LEFT JOIN LATERAL (
  SELECT h || p AS rule, v FROM rules WHERE (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, p) ORDER BY length(h) + length(p) DESC, length(h) DESC, v DESC LIMIT 1
) r ON TRUE
"""

OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), cut AS (
  SELECT c.*, s.b, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM c JOIN (VALUES (1), (2)) AS s(b) ON s.b < c.k
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:s.b], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[s.b + 1:], ' ')
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, b) = 1
), inside AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM c WHERE k = 3
), m AS (
  SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN m USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_extendible_shards": OP4_SQL, "op6_host_quality": OP6_SQL, "op7_url_rules": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op12_phrases": OP12_SQL}
