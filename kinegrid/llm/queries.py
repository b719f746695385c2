"""The registered queries of this subpackage: thin applications with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrid.llm.common import cut_lineage, residue, table

SHARDS = 24
#: Words that may stand between those of a benchmark window in a proximity match.
SLOP = 3
#: Fixed values of the contract: the judged rules.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinegrid.llm.neardup import near_duplicates

    classed, _ = near_duplicates(table(spark, sf_dir, "documents"))
    return classed.select("doc_id", "class_id", "class_size")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinegrid.llm.rules import quality_votes

    judged = quality_votes(table(spark, sf_dir, "documents"), settle=cut_lineage)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good")
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinegrid.llm.chat import digests, format_conversations

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    return digests(format_conversations(turns.union(extra)))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinegrid.llm.pages import extract_text

    pages = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinegrid.llm.mixing import language_model_scores

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return language_model_scores(docs, learnt=lambda k: residue(k, 7) != 2, tuning=lambda k: residue(k, 7) == 3)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinegrid.llm.segment import NBEST, Vocabulary, encode

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = encode(docs, Vocabulary.load(), nbest=NBEST, decoded="decoded")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.round("score", 6).alias("score"),
        F.transform("nbest", lambda x: F.round(x["score"], 6)).alias("nbest_scores"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinegrid.llm.ranking import THRESHOLD, held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), train_only=lambda k: ~held_out(k))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinegrid.llm.urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinegrid.llm.shards import interleaved_shards

    placed = interleaved_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _contamination(spark: SparkSession, sf_dir: str, slop: int, *more: Column) -> DataFrame:
    from kinegrid.llm.contamination import build_index, contaminated, search, stored

    docs = table(spark, sf_dir, "documents")
    found = search(stored(build_index(docs)), table(spark, sf_dir, "benchmark"), slop=slop)
    return found.select(
        F.col("key").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        *more,
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contamination(spark, sf_dir, 0)


def op9_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of op9, and the items with a window whose words stand in order within SLOP more words (exact matches are among them)."""
    return _contamination(spark, sf_dir, SLOP, F.size("near").cast("long").alias("n_near"), F.sha2(F.array_join("near", ","), 256).alias("near_sha256"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinegrid.llm.resampling import importance_resample

    drawn = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinegrid.llm.lexical import build_index, search

    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinegrid.llm.ranking import held_out
    from kinegrid.llm.toxicity import THRESHOLD, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels"), train_only=lambda k: ~held_out(k)))
    n = lambda which: F.size(which).cast("long")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        n(F.col("hits")).alias("n_hits"),
        n(F.filter("hits", lambda h: h["quoted"])).alias("n_quoted"),
        n(F.filter("hits", lambda h: h["errors"] > 0)).alias("n_misspelled"),
    )


QUERIES = (
    op1_minhash_neardup,
    op2_quality_rules,
    op3_chat_formatting,
    op4_html_extraction,
    op5_lm_scoring,
    op6_sentencepiece,
    op7_url_filters,
    op8_sharding,
    op9_decontamination,
    op9_proximity,
    op10_quality_classifier,
    op11_importance_resampling,
    op12_ranked_search,
    op13_toxicity,
)


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = r"""WITH t AS (SELECT conv_id, turn, role AS r, text AS x, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '', 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '', 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS et, replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c'), chr(10), '\n') AS er FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length(er) + length(et) + 14) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

OP9_SQL = (
    "WITH d AS (SELECT doc_id, row_number() OVER () AS rid, " + _WORDS.format("text") + " AS w FROM documents), "
    "i AS (SELECT CAST(item_id AS VARCHAR) AS item, " + _WORDS.format("text") + """ AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS s, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
sz AS (SELECT DISTINCT s FROM iw), dp AS (SELECT rid, w, s, unnest(range(1, len(w) - s + 2)) AS p FROM d, sz WHERE len(w) >= s),
m AS (SELECT rid, dw.s, p, item FROM (SELECT rid, s, p, array_to_string(w[p:p + s - 1], ' ') AS k FROM dp) dw JOIN iw ON iw.s = dw.s AND iw.k = dw.k),
h AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, q FROM (SELECT rid, unnest(range(p, p + s)) AS q FROM m)) GROUP BY 1),
n AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN n USING (rid)"""
)


OP11_SQL = (
    r"""WITH z AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS z),
d AS (SELECT doc_id, row_number() OVER () AS rid, """
    + _WORDS.format("text")
    + " AS w FROM documents), b AS (SELECT "
    + _WORDS.format("text")
    + """ AS w FROM benchmark),
x AS (SELECT DISTINCT f FROM (SELECT unnest(w) AS f FROM d UNION ALL SELECT unnest(w) FROM b)),
c AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))), lambda a, y: xor(a >> 8, z[xor(a & 255, y) + 1])), 4294967295) % 10000 AS k FROM x, z),
s AS (SELECT k, count(*) AS s FROM (SELECT unnest(w) AS f FROM d) JOIN c USING (f) GROUP BY k), t AS (SELECT k, count(*) AS t FROM (SELECT unnest(w) AS f FROM b) JOIN c USING (f) GROUP BY k),
g AS (SELECT k, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT sum(len(w)) FROM d) + 10000) / (CAST(s + 1 AS DOUBLE) * ((SELECT coalesce(sum(len(w)), 0) FROM b) + 10000)))) AS g FROM s LEFT JOIN t USING (k)),
e AS (SELECT rid, CAST(floor(sum(CAST(g AS BIGINT)) / count(*)) AS BIGINT) AS weight FROM (SELECT rid, unnest(w) AS f FROM d) JOIN c USING (f) JOIN g USING (k) GROUP BY rid),
h AS (SELECT rid, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN e USING (rid)),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS r, count(*) OVER () AS n FROM h WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM h LEFT JOIN r USING (rid)"""
)


OP12_SQL = (
    "WITH d AS (SELECT doc_id, row_number() OVER () AS rid, "
    + _WORDS.format("text")
    + " AS w FROM documents), i AS (SELECT item_id, row_number() OVER () AS iid, "
    + _WORDS.format("text")
    + """ AS w FROM benchmark),
c AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0), q AS (SELECT iid, t, count(*) AS times FROM (SELECT iid, unnest(w) AS t FROM i) GROUP BY ALL), u AS (SELECT DISTINCT t FROM q),
p AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) SEMI JOIN u USING (t) GROUP BY ALL),
g AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
m AS (SELECT rid, CAST(100 - 25 + (25 * len(w) * n) // l AS BIGINT) AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT iid, rid, CAST(sum(times * weight * (1000000000 * tf // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN g USING (t) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT iid, rid, score, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS FIRST) AS INT) AS rank FROM s JOIN d USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN d USING (rid) JOIN i USING (iid) WHERE rank <= 20"""
)


def oracle_sql() -> dict:
    """The other queries are no SQL: they fit models, walk graphs or lattices, or order by Spark's hashes. Their tests are brute force."""
    return {"op3_chat_formatting": OP3_SQL, "op9_decontamination": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op12_ranked_search": OP12_SQL}
