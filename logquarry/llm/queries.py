"""The registered queries of this subpackage, and what SQL can say of them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import (
    alignment, bpe, chat, decontaminate, langid, licenses, linededup, negatives, quality_model, quality_rules, shards, simhash, superminhash,
)
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's notices; see ``licenses.scan_licenses``."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


PROBE = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that holds control strings, formatted and read back; see ``chat``."""
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_conversations(turns))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document held against the benchmark; see ``decontaminate.decontaminate``."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), "contaminated")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards; see ``shards.assign_shards``."""
    return shards.assign_shards(table(spark, sf_dir, "documents"), 40)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document measured and judged; see ``quality_rules.judge``."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return quality_rules.judge(table(spark, sf_dir, "documents"), path).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "band_group", "chars_per_token", "byte_share", "entropy",
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; see ``simhash.near_duplicates``."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    decoded = bpe.decode(bpe.encode(docs, path), path)
    return decoded.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; see ``bpe``."""
    return token_digests(table(spark, sf_dir, "documents"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from the labels of two thirds of them; see ``quality_model``."""
    docs = table(spark, sf_dir, "documents")
    held_out = langid.held_out(F.col("doc_id"), 3, 1)
    labels = table(spark, sf_dir, "labels").where(~held_out)
    scored = quality_model.score(docs, quality_model.learn(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that is not empty with its class; see ``linededup.classify_lines``."""
    return linededup.classify_lines(table(spark, sf_dir, "documents")).drop("text_hash")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from four fifths of them; see ``langid``."""
    docs = table(spark, sf_dir, "documents")
    held_out = langid.held_out(F.col("doc_id"), 5, 0)
    model = langid.learn(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_words")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every 50th vector; see ``negatives.hard_negatives``."""
    rows = table(spark, sf_dir, "embeddings")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    used = rows.where(finite).select("vec_id", moved.alias("label"), whole.alias("vector"))
    return negatives.hard_negatives(used, F.col("vec_id") % 50 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two vocabularies aligned; see ``alignment.align_corpus``."""
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align_corpus(table(spark, sf_dir, "documents"), *paths)


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near documents; see ``superminhash.near_duplicates``."""
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), 2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_license_scan, op2_chat_format, op3_decontaminate, op4_shards, op5_quality_rules, op6_simhash, op7_bpe,
        op8_quality_model, op9_line_dedup, op10_language, op11_hard_negatives, op12_alignment,
        op13_superminhash,
    )}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op2_sql() -> str:
    marked = "|".join(re.escape(c) for c in ["\\", *chat.CONTROL])
    fixed = len(chat.TURN) + len(chat.NEXT) + len(chat.END)
    return f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', {_text(PROBE)} UNION ALL SELECT -1, 1, 'assistant', {_text(PROBE)}
        ), sized AS (
            SELECT *, {fixed} + length(role) + length(text)
                + length(regexp_extract_all(text, {_text(marked)}))
                + length(regexp_extract_all(role, {_text(marked + "|" + chr(92) + "n")})) AS chars
            FROM turns
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
                AS loss_sha256,
            sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id"""


def _words_sql(text: str) -> str:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z lower-cased, as a list."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{lower}'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"


def _op3_sql() -> str:
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql("text")} AS w FROM documents),
        b AS (SELECT item_id, {_words_sql("text")} AS w FROM benchmark),
        cut AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
        windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
            FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM cut)
        ),
        sizes AS (SELECT DISTINCT n FROM cut),
        grams AS (
            SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
        ),
        found AS (SELECT r, item_id, i, n FROM grams JOIN windows USING (n, win)),
        hits AS (
            SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r
        ),
        listed AS (
            SELECT r, count(DISTINCT item_id) AS n_items,
                array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids
            FROM found GROUP BY r
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hits USING (r) LEFT JOIN listed USING (r)"""


def _op11_sql() -> str:
    return """
        WITH v AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same,
                list_inner_product(a.vector, v.vector)::BIGINT AS score
            FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0
        ),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
            row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3"""


def _op13_sql() -> str:
    return """
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ),
        g AS (
            SELECT DISTINCT r, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS gram
            FROM (SELECT r, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)
        ),
        n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
        shared AS (SELECT a.r AS a, b.r AS b, count(*) AS m FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.r <> b.r GROUP BY 1, 2),
        links AS (
            SELECT a, b FROM shared JOIN n AS x ON x.r = a JOIN n AS y ON y.r = b WHERE 100 * m >= 80 * (x.n + y.n - m)
        ),
        reach AS (SELECT r, r AS other FROM n UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other),
        least AS (SELECT reach.r, min(d.doc_id) AS component FROM reach JOIN d ON d.r = reach.other GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n > 0 THEN component ELSE doc_id END AS component_id,
            doc_id IS NOT DISTINCT FROM CASE WHEN n > 0 THEN component ELSE doc_id END AS kept
        FROM d LEFT JOIN n USING (r) LEFT JOIN least USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": _op2_sql(), "op3_decontaminate": _op3_sql(), "op11_hard_negatives": _op11_sql(),
        "op13_superminhash": _op13_sql(),
    }
