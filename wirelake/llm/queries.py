"""The registered queries of the operators, thin over their general interfaces, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wirelake.llm import alignment, decontamination, fim, langid, mixing, packing, quality, sharding, simhash, tokenfile, topk, toxicity, wordpiece
from wirelake.llm.common import bucket_of, table


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of near equal size. No row is dropped; equal texts are not held together."""
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    assigned = sharding.assign_shards(docs).drop("text")
    return sharding.with_slots(assigned, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "home_shard")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    lexicon = toxicity.learn(docs, labels, among=bucket_of("doc_id", 3) != 1)
    return toxicity.score(docs.select("doc_id", "text"), lexicon).select(
        "doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").cast("int").alias("predicted"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), text_col="text")
    return rows.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.learn(docs, among=bucket_of("doc_id", 5) != 0)
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_rejected")


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy longest-match token counts of every document over the byte-level vocabulary of 50,257 tokens."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return wordpiece.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_words", "n_tokens", "n_unknown")


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return tokenfile.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.ledger(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~quality.passes(quality.BASE)).alias("base_failed"), quality.passes(quality.POLICY).alias("kept"), "failed_rules")


def op9_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    index = decontamination.build(table(spark, folder, "documents"))
    return decontamination.summary(decontamination.matches(index, table(spark, folder, "benchmark")))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fim.transform(table(spark, folder, "documents").select("doc_id", "text"), with_text=False, digests=True)


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    made = alignment.align(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return made.documents().drop("groups")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_sharding, op2_toxicity, op3_simhash, op4_language_id, op5_mixing, op6_token_counts, op7_token_files, op8_quality_rules,
    op9_exact_top_k, op10_packing, op11_decontamination, op12_fill_in_middle, op13_alignment, pipeline)}

_LETTERS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = "[^\\x20\\x09-\\x0D]+"

ORACLES = {
    "op8_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws, string_split(text, chr(10)) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (
    SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY r),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT r, unnest(ls) AS l FROM w)
    WHERE regexp_matches(l, '{_WORD}') GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
    FROM w LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END)::BIGINT
    AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_rules & 3 <> 0 AS base_failed,
    failed_rules = 0 AS kept, failed_rules FROM f""",
    "op11_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '{_LETTERS}') AS ws FROM documents),
i AS (SELECT item_id, ws, least(len(ws), 10) AS k FROM (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_LETTERS}') AS ws FROM benchmark)
    WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS p FROM i)),
grams AS (SELECT r, k, p, array_to_string(ws[p:p + k - 1], ' ') AS g FROM (
    SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k)),
occ AS (SELECT r, p, k, item_id FROM grams JOIN win USING (k, g)),
hit AS (SELECT r, count(DISTINCT p + o) AS n_hit FROM (SELECT r, p, unnest(range(0, k)) AS o FROM occ) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (
    SELECT r, item_id, any_value(coalesce(item_id::VARCHAR, '')) AS id FROM occ GROUP BY r, item_id) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
    "op12_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS us,
    ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(us)::BIGINT AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b FROM u),
f AS (SELECT doc_id, text, n, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:], '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
    AS output_sha256, sha256(text) AS restored_sha256 FROM f""",
    "op9_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
}
