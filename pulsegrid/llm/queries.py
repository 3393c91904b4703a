"""The operators of this folder applied to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import fingerprints, mixing, mpeg, order_minhash, pieces, quality, separators, suffix_tree, topk, warc


def tokenizer_file(name: str) -> str:
    """Where the public tokenizers are installed; operators take the path itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scored(table(spark, sf_dir, "documents"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_classes(table(spark, sf_dir, "documents"))


def op4_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.deduplicated(table(spark, sf_dir, "documents"))


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.round_trip(table(spark, sf_dir, "documents"))


def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("segments")


def op7_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), end=2)


def op10_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_threshold_topk": op1_threshold_topk,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_order_minhash": op3_order_minhash,
    "op4_fingerprint_index": op4_fingerprint_index,
    "op5_mpeg_audio": op5_mpeg_audio,
    "op6_warc_segments": op6_warc_segments,
    "op7_quadratic_discriminant": op7_quadratic_discriminant,
    "op8_distinct_chunks": op8_distinct_chunks,
    "op9_separator_scan": op9_separator_scan,
    "op10_pivotal_mix": op10_pivotal_mix,
}

ORACLE_SQL: dict[str, str] = {
    "op1_threshold_topk": """
        WITH v AS (
            SELECT vec_id AS id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
            FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 20 = 0
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op4_fingerprint_index": """
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
        ), each AS (
            SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos, len(words) AS n FROM w
        ), spans AS (
            SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS span FROM each
        ), ranked AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY span ORDER BY doc_id, pos) AS nth FROM spans WHERE pos <= n - 19
        ), removed AS (
            SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM ranked WHERE nth > 1
        ), kept AS (
            SELECT doc_id, count(r.pos) AS lost, string_agg(word, ' ' ORDER BY pos) FILTER (r.pos IS NULL) AS words
            FROM each LEFT JOIN removed r USING (doc_id, pos) GROUP BY doc_id
        )
        SELECT doc_id, len(w.words)::BIGINT AS n_words, coalesce(lost, 0)::BIGINT AS n_removed, sha256(coalesce(kept.words, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op6_warc_segments": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
        ), groups AS (
            SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS last FROM p
        )
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (((('0x' || substr(hex, (i // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> ((3 - i % 4) * 5)::INTEGER) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
            CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> last THEN last END AS refers_to
        FROM groups
    """,
}
