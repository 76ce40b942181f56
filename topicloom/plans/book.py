"""What the catalogue's modules share: the article view in both engines, and a register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators import articles as ops

#: The day that the catalogue's queries are run for.
TARGET = "2024-01-01"

#: Raw label of a source by the last digit of its number; the others have none.
RAW_LABELS = {0: "far-left", 1: "left", 2: "lean-left", 3: "center", 4: "right", 5: "lean right", 6: "far-right", 8: "Unknown", 9: "nonsense"}

ARTICLES_SQL = f"""
articles AS (
    SELECT d.doc_id AS ord, left(split_part(d.text, chr(10), 1), 120) AS title, left(d.text, 400) AS description,
           p.url AS url, d.source AS source, d.lang AS lang,
           strftime(e.ts, '%Y-%m-%dT%H:%M:%SZ') AS published_at, strftime(e.ts, '%Y-%m-%d') AS published_date,
           v.label AS cluster_id, v.embedding AS embedding,
           CASE CAST(substr(d.source, 4) AS INTEGER) % 10 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in RAW_LABELS.items())} END AS bias
    FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id
    LEFT JOIN embeddings v ON v.vec_id = d.doc_id
),
grouped AS (SELECT * FROM articles WHERE cluster_id IS NOT NULL)
"""

#: Canonical label of the raw ones above, in title case.
LABEL_SQL = "CASE {c} WHEN 'far-left' THEN 'Far Left' WHEN 'left' THEN 'Left' WHEN 'lean-left' THEN 'Left' WHEN 'center' THEN 'Center' WHEN 'right' THEN 'Right' WHEN 'lean right' THEN 'Right' WHEN 'far-right' THEN 'Far Right' WHEN 'nonsense' THEN 'Nonsense' ELSE 'Unknown' END"
TITLE_SQL = "CASE {c} WHEN 'far-left' THEN 'Far Left' WHEN 'left' THEN 'Left' WHEN 'lean-left' THEN 'Lean Left' WHEN 'center' THEN 'Center' WHEN 'right' THEN 'Right' WHEN 'lean right' THEN 'Lean Right' WHEN 'far-right' THEN 'Far Right' WHEN 'nonsense' THEN 'Nonsense' ELSE 'Unknown' END"

HOST_SQL = r"regexp_replace(lower(regexp_extract(coalesce({c}, ''), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?', 1)), '^www\.', '')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles, with a page's URL, an event's time and a vector's cluster where there are such rows.

    The title is the whole first line and the description the whole text; ARTICLES_SQL still cuts both.
    """
    d = table(spark, sf_dir, "documents")
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding")
    met = d.join(p, "doc_id", "left").join(e, "doc_id", "left").join(v, "doc_id", "left")
    raw = F.create_map(*[F.lit(x) for kv in RAW_LABELS.items() for x in kv])
    at = F.when(F.col("ts").isNotNull(), ops.iso_timestamp(F.col("ts")))
    return met.select(
        F.col("doc_id").alias("ord"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("description"),
        "url",
        "source",
        "lang",
        at.alias("published_at"),
        F.left(at, F.lit(10)).alias("published_date"),
        F.col("label").alias("cluster_id"),
        "embedding",
        F.try_element_at(raw, F.substr("source", F.lit(4)).cast("int") % 10).alias("bias"),
    )


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).filter("cluster_id is not null")


class Book:
    """Queries by name, and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        """Registers a function (spark, sf_dir) -> DataFrame under its own name."""

        def put(f: Callable[[SparkSession, str], DataFrame]):
            key = name or f.__name__
            self.queries[key] = f
            if sql:
                self.sql[key] = sql.replace("{ARTICLES}", ARTICLES_SQL)
            return f

        return put
