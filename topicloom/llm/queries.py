"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc32, table


#: Most bytes of text in a shard.
SHARD_BYTES = 1 << 20


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out: rows whose crc32(doc_id) mod 5 is 0; a row without id is never learned from."""
    from .quality import assess, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = id_crc32("doc_id") % 5
    model = train(docs, table(spark, sf_dir, "labels").filter(fold != 0).select("doc_id", "quality"))
    scored = assess(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_dedup

    return near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    found = shards(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)
    return found.select("row.doc_id", "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes")


def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sampling import sampled
    from .tokens import vocabulary

    return sampled(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"), with_ids=False)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    from .tokens import vocabulary

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"), 2048)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import new_folder
    from .tokenfiles import read_token_files, write_token_files
    from .tokens import vocabulary

    path = new_folder(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), path, vocabulary("byte_bpe_50k.json"))
    return read_token_files(spark, path)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out: rows whose crc32(doc_id) mod 4 is 2; a row without id is never learned from."""
    from .language import identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = id_crc32("doc_id") % 4
    model = train(docs, fold != 2)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")


def op11_sale_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .enrichment import enrich

    return enrich(table(spark, sf_dir, "sales"), table(spark, sf_dir, "client_changes"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out: rows whose crc32(doc_id) mod 3 is 1; a row without id is never learned from."""
    from .toxicity import assess, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = id_crc32("doc_id") % 3
    model = train(docs, table(spark, sf_dir, "labels").filter(fold != 1).select("doc_id", "toxic"))
    scored = assess(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.7, 1).otherwise(0).alias("predicted"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_sharding": op3_sharding,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_piece_sampling": op5_piece_sampling,
    "op6_license_scan": op6_license_scan,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_token_files": op8_token_files,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_sale_enrichment": op11_sale_enrichment,
    "op12_toxicity": op12_toxicity,
    "op13_importance_resampling": op13_importance_resampling,
}

#: crc32 in SQL: its remainders of one byte by their rule, then one step for each byte of ``crc_of``'s text.
CRC_TABLE_SQL = """tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i))"""


def crc_of(text: str) -> str:
    """SQL of the crc32 of a text's UTF-8 bytes; ``tab`` has to be joined."""
    return f"xor(list_reduce(list_transform(range(1, length(hex({text})), 2), lambda p: ('0x' || substr(hex({text}), p, 2))::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op3_sharding": f"""
        WITH r AS (
            SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
                   (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT << 30)
                   | (('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT >> 2) AS h
            FROM documents
        ), d AS (SELECT unnest(range(0, 63))::INTEGER AS depth),
        c AS (SELECT depth, h >> (62 - depth) AS p, sum(n_bytes) AS b, count(*) AS n FROM r, d GROUP BY ALL),
        f AS (
            SELECT doc_id, r.h, n_bytes, min(c.depth) AS depth FROM r, c
            WHERE c.p = r.h >> (62 - c.depth) AND (c.b <= {SHARD_BYTES} OR c.n = 1) GROUP BY ALL
        )
        SELECT f.doc_id, f.n_bytes::BIGINT AS n_bytes, f.depth || ':' || c.p AS shard, f.depth, c.b::BIGINT AS shard_bytes
        FROM f JOIN c ON c.depth = f.depth AND c.p = f.h >> (62 - f.depth)
    """,
    "op2_embedding_near_dedup": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            AND list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION
            SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM component LEFT JOIN counted USING (vec_id)
    """,
    "op11_sale_enrichment": f"""
        WITH {CRC_TABLE_SQL},
        s AS (
            SELECT row_number() OVER () AS pos, sale_id, client_id, sold_at,
                   greatest(0, least(9, floor((date_diff('day', DATE '1970-01-01', arrived_at::DATE) - 19723) * 10 / 152)))::BIGINT AS b
            FROM sales
        ),
        c AS (
            SELECT *, greatest(0, least(9, floor((date_diff('day', DATE '1970-01-01', valid_at::DATE)
                   + coalesce({crc_of("change_id::VARCHAR")}, 0) % 4 - 19723) * 10 / 152)))::BIGINT AS b
            FROM (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL), tab
        ),
        m AS (
            SELECT p, (SELECT max(sold_at) FROM s WHERE b < p) - INTERVAL 36 HOUR AS sm, (SELECT max(valid_at) FROM c WHERE b < p) - INTERVAL 36 HOUR AS cm
            FROM range(10) r(p)
        ),
        h AS (SELECT p, cm, CASE WHEN sm IS NOT NULL AND cm IS NOT NULL THEN least(sm, cm) END AS h FROM m),
        v AS (
            SELECT client_id, valid_at, change_id, op, b, floor(100 * balance + 0.5)::BIGINT AS cents,
                   row_number() OVER (ORDER BY valid_at, seq NULLS FIRST, change_id NULLS FIRST, floor(100 * balance + 0.5) NULLS FIRST, coalesce(op, '')) AS o
            FROM c JOIN h ON c.b = h.p WHERE cm IS NULL OR valid_at >= cm
        ),
        gone AS (SELECT client_id, p, max(o) AS o FROM v JOIN h ON b <= p AND valid_at <= h GROUP BY client_id, p),
        e AS (
            SELECT pos, sale_id, client_id, sold_at, coalesce(min(p), 10) AS e
            FROM s LEFT JOIN h ON p >= b AND (sold_at IS NULL OR sold_at < h) GROUP BY ALL
        ),
        met AS (
            SELECT pos, count(*) AS n_held, max(v.o) FILTER (valid_at <= sold_at) AS o
            FROM e JOIN v ON v.client_id = e.client_id AND v.b <= e
            LEFT JOIN gone ON gone.client_id = e.client_id AND gone.p = e - 1
            WHERE v.b = e OR v.o >= coalesce(gone.o, 0) GROUP BY pos
        )
        SELECT 'sale' AS rec, sale_id AS id, e AS batch, coalesce(n_held, 0) AS n_held, change_id, cents AS balance_cents, op
        FROM e LEFT JOIN met USING (pos) LEFT JOIN v ON v.o = met.o
        UNION ALL
        SELECT 'late', change_id, b, NULL, NULL, NULL, NULL FROM c JOIN h ON c.b = h.p WHERE valid_at < cm
    """,
    "op13_importance_resampling": rf"""
        WITH {CRC_TABLE_SQL},
        d AS (SELECT doc_id, row_number() OVER () AS pos, text FROM documents),
        w AS (SELECT pos, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM d),
        b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
        v AS (SELECT word, {crc_of("word")} % 10000 AS bucket FROM (SELECT word FROM w UNION SELECT word FROM b), tab),
        s AS (SELECT bucket, count(*) AS s FROM w JOIN v USING (word) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (word) GROUP BY bucket),
        g AS (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
                   / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
            FROM s FULL JOIN t USING (bucket)
        ),
        f AS (SELECT pos, count(*) AS n, sum(gain)::BIGINT AS weight FROM w JOIN v USING (word) JOIN g USING (bucket) GROUP BY pos),
        r AS (
            SELECT doc_id, pos, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                   coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM d LEFT JOIN f USING (pos)
        ),
        k AS (SELECT pos, row_number() OVER (ORDER BY score DESC, doc_id, pos) AS rank FROM r WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM k) * 10 // 100 THEN rank END AS rank
        FROM r LEFT JOIN k USING (pos)
    """,
    "op9_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY k) AS group_size,
               row_number() OVER w = 1 AS kept,
               sha256(k) AS text_sha256
        FROM n
        WINDOW w AS (PARTITION BY k ORDER BY length(t) DESC, doc_id)
    """,
}
