"""Queries on clusters: spread, labels, freshness, ranking, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import stats, text, url
from topicloom.operators import articles as ops
from topicloom.operators import clusters

from .book import HOST_SQL, LABEL_SQL, TARGET, TITLE_SQL, Book, articles, grouped

BOOK = Book()
query = BOOK.add

_HOSTS = f"hosts AS (SELECT *, {HOST_SQL.format(c='url')} AS host FROM grouped)"
_DIVERSITY = rf"""{_HOSTS},
hc AS (SELECT cluster_id, host, count(*) AS n, min(ord) AS first_ord FROM hosts WHERE host <> '' GROUP BY 1, 2),
div AS (SELECT cluster_id, count(*) AS unique_domains, sum(n)::BIGINT AS total_with_domain,
        first(host ORDER BY n DESC, first_ord) AS top_domain, round(max(n)::DOUBLE / sum(n), 3) AS top_share,
        round(-sum((n / t) * log2(n / t)), 3) AS entropy
    FROM (SELECT *, sum(n) OVER (PARTITION BY cluster_id)::DOUBLE AS t FROM hc) GROUP BY 1),
ids AS (SELECT DISTINCT cluster_id FROM grouped),
diversity AS (SELECT cluster_id, coalesce(unique_domains, 0) AS unique_domains, coalesce(total_with_domain, 0) AS total_with_domain,
        coalesce(top_domain, '') AS top_domain, coalesce(top_share, 0.0) AS top_share, coalesce(entropy, 0.0) AS entropy FROM ids LEFT JOIN div USING (cluster_id))
"""
_CONC = "conc AS (SELECT cluster_id, round(max(n)::DOUBLE / sum(n), 3) AS source_concentration FROM (SELECT cluster_id, source, count(*) AS n FROM grouped GROUP BY 1, 2) GROUP BY 1)"
_FRESH = f"fresh AS (SELECT cluster_id, CASE WHEN count(published_date) = 0 THEN 1.0 ELSE count(*) FILTER (published_date::DATE BETWEEN DATE '{TARGET}' - 1 AND DATE '{TARGET}' + 1)::DOUBLE / count(published_date) END AS today_ratio FROM grouped GROUP BY 1)"
_METRICS = f"""{_DIVERSITY}, {_CONC}, {_FRESH},
metrics AS (SELECT cluster_id, count(*) AS size, min(ord) AS cluster_ord, count(DISTINCT bias) AS labels FROM grouped GROUP BY 1),
scored AS (SELECT m.*, d.entropy, d.unique_domains, c.source_concentration, round(f.today_ratio, 3) AS today_ratio,
    CASE WHEN round(f.today_ratio, 3) = 0 THEN 1.0 ELSE round(f.today_ratio, 3) END AS tr
    FROM metrics m JOIN diversity d USING (cluster_id) JOIN conc c USING (cluster_id) JOIN fresh f USING (cluster_id)),
ranked AS (SELECT *, size + entropy * 0.8 + unique_domains * 0.12 + labels * 0.15 + (tr - 0.5) * least(12.0, size * 0.4)
    - CASE WHEN size >= 12 AND tr < 0.25 THEN 3.0 ELSE 0.0 END - CASE WHEN size >= 12 AND source_concentration >= 0.45 THEN 2.5 ELSE 0.0 END AS matter_score FROM scored)
"""


@query(f"WITH {{ARTICLES}}, {_DIVERSITY} SELECT * FROM diversity")
def source_diversity(spark, sf_dir):
    return clusters.diversity(grouped(spark, sf_dir))


@query(f"WITH {{ARTICLES}}, {_CONC} SELECT * FROM conc")
def source_concentration(spark, sf_dir):
    return clusters.concentration(grouped(spark, sf_dir))


@query(f"""WITH {{ARTICLES}}, {_DIVERSITY} SELECT cluster_id, round(coalesce(-sum((n / t) * log2(n / t)), 0.0), 6) AS domain_entropy
    FROM ids LEFT JOIN (SELECT *, sum(n) OVER (PARTITION BY cluster_id)::DOUBLE AS t FROM hc) USING (cluster_id) GROUP BY 1""")
def domain_entropy(spark, sf_dir):
    rows = grouped(spark, sf_dir).withColumn("url_normalized", url.normalise(F.col("url")))
    return clusters.domain_entropy(rows).select("cluster_id", F.round("domain_entropy", 6).alias("domain_entropy"))


@query(f"WITH {{ARTICLES}}, {_FRESH} SELECT cluster_id, round(today_ratio, 6) AS today_ratio FROM fresh")
def today_ratio(spark, sf_dir):
    return clusters.freshness(grouped(spark, sf_dir), TARGET).select("cluster_id", F.round("today_ratio", 6).alias("today_ratio"))


@query(f"""WITH {{ARTICLES}}, l AS (SELECT cluster_id, {TITLE_SQL.format(c="bias")} AS label FROM grouped),
    n AS (SELECT cluster_id, label, count(*) AS n FROM l WHERE label <> 'Unknown' GROUP BY 1, 2)
    SELECT cluster_id, label, round_even((n::DOUBLE / sum(n) OVER (PARTITION BY cluster_id)) * 100, 0)::INTEGER AS pct FROM n""")
def bias_pct_half_even(spark, sf_dir):
    return clusters.label_percent(grouped(spark, sf_dir), F.col("bias"))


_SHARES = f"""sl AS (SELECT cluster_id, CASE WHEN {TITLE_SQL.format(c="bias")} IN ('Far Left', 'Left', 'Center', 'Right', 'Far Right', 'Unknown') AND coalesce(bias, '') <> '' THEN {TITLE_SQL.format(c="bias")} ELSE 'Center' END AS label FROM grouped),
sn AS (SELECT cluster_id, label, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY cluster_id) AS exact FROM sl GROUP BY 1, 2),
sf AS (SELECT *, floor(exact) AS low, list_position(['Far Left', 'Left', 'Center', 'Right', 'Far Right', 'Unknown'], label) AS rnk FROM sn),
st AS (SELECT *, 100 - sum(low) OVER (PARTITION BY cluster_id) AS spare, row_number() OVER (PARTITION BY cluster_id ORDER BY exact - low DESC, rnk) AS turn FROM sf),
shares AS (SELECT cluster_id, label, (low + CASE WHEN turn <= spare THEN 1 ELSE 0 END)::INTEGER AS pct FROM st WHERE low + CASE WHEN turn <= spare THEN 1 ELSE 0 END > 0)"""


@query(f"WITH {{ARTICLES}}, {_SHARES} SELECT * FROM shares")
def bias_pct_largest_remainder(spark, sf_dir):
    return clusters.label_shares(grouped(spark, sf_dir), F.col("bias"))


@query("""WITH {ARTICLES}, n AS (SELECT cluster_id, coalesce(nullif(bias, ''), 'Center') AS label, count(*) AS n FROM grouped GROUP BY 1, 2)
    SELECT cluster_id, label, round(n * 100 / sum(n) OVER (PARTITION BY cluster_id)::DOUBLE, 1) AS pct FROM n""")
def bias_pct_1dp(spark, sf_dir):
    return clusters.label_percent_1dp(grouped(spark, sf_dir), F.col("bias"))


@query("""WITH {ARTICLES}, n AS (SELECT cluster_id, coalesce(bias, 'unknown') AS label, count(*) AS n, min(ord) AS f FROM grouped GROUP BY 1, 2)
    SELECT cluster_id, first(label ORDER BY n DESC, f) AS majority, round_even(max(n)::DOUBLE / sum(n) * 100, 0)::INTEGER || '%' AS share FROM n GROUP BY 1""")
def majority_label(spark, sf_dir):
    return clusters.majority_label(grouped(spark, sf_dir), F.col("bias"))


@query(f"""WITH {{ARTICLES}}, {_METRICS} SELECT cluster_id, size, unique_domains, labels, entropy, source_concentration, today_ratio, round(matter_score, 6) AS matter_score
    FROM ranked ORDER BY matter_score DESC, cluster_ord LIMIT 10""")
def matter_score_topk(spark, sf_dir):
    """Flagship: articles to ranked topics."""
    top = clusters.ranked(clusters.measured(grouped(spark, sf_dir), TARGET, F.col("bias")), "matter_score", "cluster_ord", 10)
    return top.select("cluster_id", "size", "unique_domains", "labels", "entropy", "source_concentration", "today_ratio", F.round("matter_score", 6).alias("matter_score"))


@query("""WITH {ARTICLES} SELECT cluster_id, count(*) AS n, min(ord) AS cluster_ord FROM grouped GROUP BY 1 HAVING count(*) >= 6 ORDER BY n DESC, cluster_ord LIMIT 10""")
def size_ranked_top10(spark, sf_dir):
    rows = grouped(spark, sf_dir).groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("ord").alias("cluster_ord")).filter("n >= 6")
    return clusters.ranked(rows, "n", "cluster_ord", 10)


@query("""WITH {ARTICLES}, h AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ord) AS r FROM grouped)
    SELECT cluster_id, string_agg(title || '. ' || description, chr(10) ORDER BY ord) AS text FROM h WHERE r <= 10 GROUP BY 1""")
def cluster_texts(spark, sf_dir):
    return clusters.joined_text(grouped(spark, sf_dir), F.concat("title", F.lit(". "), "description"), "\n", 10)


@query(r"""WITH {ARTICLES}, t AS (SELECT cluster_id, ord, regexp_replace(title, '^\s+|\s+$', '', 'g') AS t FROM grouped)
    SELECT cluster_id, string_agg(t, ' ' ORDER BY ord) AS text FROM t WHERE t <> '' GROUP BY 1""")
def title_texts(spark, sf_dir):
    return clusters.title_text(grouped(spark, sf_dir))


@query(r"""WITH {ARTICLES} SELECT cluster_id, array_to_string(list_sort(list_distinct(list(replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'www.', '')) FILTER (url IS NOT NULL))), ',') AS domains FROM grouped GROUP BY 1""")
def domain_lists(spark, sf_dir):
    return clusters.domain_list(grouped(spark, sf_dir)).select("cluster_id", F.nullif(F.array_join("domains", ","), F.lit("")).alias("domains"))


_CANON = rf"""canon AS (SELECT g.*, {HOST_SQL.format(c="url")} || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')
    || CASE WHEN regexp_extract(url, '\?([^#]*)', 1) LIKE 'page=%' THEN '?' || split_part(regexp_extract(url, '\?([^#]*)', 1), '&', 1) ELSE '' END AS cu FROM grouped g)"""


@query(f"WITH {{ARTICLES}}, {_CANON} SELECT cluster_id, left(coalesce(string_agg(cu, '|' ORDER BY cu) FILTER (url IS NOT NULL), ''), 8000) AS signature FROM canon GROUP BY 1")
def url_signatures(spark, sf_dir):
    return clusters.url_signature(grouped(spark, sf_dir))


@query(f"""WITH {{ARTICLES}}, {_CANON}, {_DIVERSITY},
    s AS (SELECT cluster_id, coalesce(list_sort(list_distinct(list(cu) FILTER (url IS NOT NULL))), []) AS urls, count(*) AS size, min(ord) AS co FROM canon GROUP BY 1)
    SELECT cluster_id, size, entropy, place FROM (SELECT s.*, d.entropy, row_number() OVER (PARTITION BY urls ORDER BY size DESC, d.entropy DESC, co) AS r, min(co) OVER (PARTITION BY urls) AS place FROM s JOIN diversity d USING (cluster_id)) WHERE r = 1""")
def signature_collapse(spark, sf_dir):
    return clusters.signature_collapse(grouped(spark, sf_dir))


@query(r"""WITH {ARTICLES}, h AS (SELECT *, lower(replace(regexp_extract(coalesce(url, ''), '^[a-z]+://([^/?#]*)', 1), 'www.', '')) AS host, row_number() OVER (PARTITION BY cluster_id ORDER BY ord) AS r FROM grouped),
    c AS (SELECT cluster_id, host, count(*) AS n, min(ord) AS f FROM h WHERE host <> '' GROUP BY 1, 2),
    d AS (SELECT cluster_id, count(*) AS unique_domains, first(host ORDER BY n DESC, f) AS top_domain, max(n)::DOUBLE / sum(n) AS top FROM c GROUP BY 1)
    SELECT g.cluster_id, g.num_articles, coalesce(unique_domains, 0) AS unique_domains, coalesce(top_domain, '') AS top_domain, round(coalesce(top, 0.0), 1) AS top_share, g.titles AS example_titles
    FROM (SELECT cluster_id, count(*) AS num_articles, string_agg(left(title, 140), ' / ' ORDER BY ord) FILTER (r <= 5) AS titles FROM h GROUP BY 1) g LEFT JOIN d USING (cluster_id)""")
def trust_log(spark, sf_dir):
    return clusters.trust_log(grouped(spark, sf_dir)).withColumn("example_titles", F.array_join("example_titles", " / "))


@query("""WITH {ARTICLES}, r AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS rnk, ord % 7 = 0 AS suspicious, CASE ord % 11 WHEN 0 THEN 'SINGLE_EVENT' WHEN 1 THEN 'MIXED' END AS cached FROM articles),
    u AS (SELECT *, rnk < 60 AS forced, sum(CASE WHEN (rnk < 60 OR suspicious) AND cached IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY rnk) AS used FROM r)
    SELECT ord, CASE WHEN NOT (forced OR suspicious) THEN 'pass' WHEN cached IS NOT NULL THEN CASE WHEN cached IN ('THEMATIC_BUCKET', 'MIXED') THEN 'drop' ELSE 'keep' END
        WHEN used <= 24 THEN 'judge' WHEN forced THEN 'drop' ELSE 'pass' END AS decision FROM u""")
def budget_gate(spark, sf_dir):
    """Document ids are 0 and up without gaps, so the id is the rank."""
    rows = articles(spark, sf_dir).select("ord", F.col("ord").alias("rank"), (F.col("ord") % 7 == 0).alias("suspicious"), F.when(F.col("ord") % 11 == 0, "SINGLE_EVENT").when(F.col("ord") % 11 == 1, "MIXED").alias("cached")).withColumn("forced", F.col("rank") < 60)
    return clusters.budget_gate(rows).select("ord", "decision")


@query("""SELECT strftime(max(ts), '%Y-%m-%d') AS newest, count(*) FILTER (ts::DATE = (SELECT max(ts)::DATE FROM events)) AS rows_of_newest FROM events""")
def latest_partition(spark, sf_dir):
    from topicloom.operators.serving import latest

    from .book import table

    rows = table(spark, sf_dir, "events").withColumn("dt", F.to_date("ts"))
    return latest(rows).agg(F.date_format(F.max("dt"), "yyyy-MM-dd").alias("newest"), F.count("*").alias("rows_of_newest"))


@query(f"""WITH {{ARTICLES}} SELECT cluster_id, string_agg(label, ',' ORDER BY n DESC, label) AS labels FROM (SELECT cluster_id, {LABEL_SQL.format(c="bias")} AS label, count(*) AS n FROM grouped GROUP BY 1, 2) GROUP BY 1""")
def labels_by_cluster(spark, sf_dir):
    n = grouped(spark, sf_dir).groupBy("cluster_id", text.canonical_label(F.col("bias")).alias("label")).agg(F.count("*").alias("n"))
    return n.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "label"))), lambda p: p["label"]), ",").alias("labels"))


@query(f"""WITH {{ARTICLES}}, {_METRICS} SELECT cluster_id, (size >= 12 AND (size / 1000.0 < 0.10 OR entropy / 10 < 0.42 OR (entropy / 10 < 0.50 AND source_concentration > 0.14) OR (size >= 25 AND size / 1000.0 < 0.16) OR (size >= 15 AND tr < 0.25))) AS suspicious,
    CASE WHEN size < 4 THEN TRUE WHEN size > 12 THEN FALSE ELSE entropy / 10 < 0.40 AND source_concentration > 0.18 END AS incoherent FROM ranked""")
def review_flags(spark, sf_dir):
    """The two cluster predicates on measured columns that stand in for similarity."""
    m = clusters.measured(grouped(spark, sf_dir), TARGET, F.col("bias"))
    flagged = stats.suspicious(F.col("size"), F.col("size") / 1000.0, F.col("entropy") / 10, F.col("source_concentration"), F.col("today_ratio"))
    return m.select("cluster_id", flagged.alias("suspicious"), stats.incoherent(F.col("size"), F.lit(18), F.col("entropy") / 10, F.col("source_concentration")).alias("incoherent"))


@query("""WITH {ARTICLES} SELECT cluster_id, count(*) AS n FROM (SELECT * FROM grouped WHERE title <> '' OR coalesce(url, '') <> '') GROUP BY 1 HAVING count(*) >= 2""")
def drop_empty_articles(spark, sf_dir):
    rows = grouped(spark, sf_dir).select("cluster_id", "ord", "title", "url")
    return ops.sizeable(rows, 2, ops.titled_or_linked(F.col("title"), F.col("url"))).groupBy("cluster_id").agg(F.count("*").alias("n"))
