"""Queries on article rows: URLs, texts, filters, keep-first, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom import dims
from topicloom.functions import text, url
from topicloom.operators import articles as ops

from .book import HOST_SQL, LABEL_SQL, TARGET, Book, articles, table

BOOK = Book()
query = BOOK.add

_SPLIT = r"""
u AS (
    SELECT page_id, url, regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', ['scheme', 'host', 'path', 'query']) AS p
    FROM pages
)
"""


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(rf"""WITH {_SPLIT},
    k AS (SELECT *, list_filter(string_split(p.query, '&'), lambda x: x <> '' AND NOT list_contains({_quoted(dims.NORMALISE_DROPS)}, split_part(x, '=', 1))) AS kept FROM u)
    SELECT page_id, lower(p.scheme) || '://' || regexp_replace(lower(p.host), '^m\.', '')
        || CASE WHEN regexp_replace(p.path, '/+$', '') = '' THEN '/' ELSE regexp_replace(p.path, '/+$', '') END
        || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_normalized FROM k""")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url.normalise(F.col("url")).alias("url_normalized"))


@query(rf"""WITH {_SPLIT},
    k AS (SELECT *, list_sort(list_filter(string_split(p.query, '&'), lambda x: x <> '' AND NOT list_contains({_quoted(dims.CANONICAL_DROPS)}, lower(split_part(x, '=', 1))))) AS kept FROM u)
    SELECT page_id, regexp_replace(lower(p.host), '^www\.', '') || regexp_replace(p.path, '/+$', '')
        || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_canonical FROM k""")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url.canonical(F.col("url")).alias("url_canonical"))


@query(rf"""WITH {_SPLIT}
    SELECT page_id, regexp_replace(regexp_replace(lower(p.host), '^www\.', '') || p.path, '/+$', '') AS host_path,
           regexp_replace(lower(p.host), '^www\.', '') AS domain, lower(replace(p.host, 'www.', '')) AS domain_plain FROM u""")
def url_parts(spark, sf_dir):
    c = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", url.host_and_path(c).alias("host_path"), url.domain(c).alias("domain"), url.domain_without_any_www(c).alias("domain_plain"))


@query(rf"""WITH {{ARTICLES}}
    SELECT ord, CASE WHEN regexp_replace(split_part(coalesce(url, ''), '?', 1), '/+$', '') <> ''
        THEN regexp_replace(split_part(url, '?', 1), '/+$', '') ELSE lower(title || source) END AS merge_key FROM articles""")
def merge_keys(spark, sf_dir):
    return articles(spark, sf_dir).select("ord", url.merge_key(F.lit(None).cast("string"), F.col("url"), F.col("title"), F.col("source")).alias("merge_key"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS spaced,
        trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS fused FROM pages""")
def clean_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.untagged(F.col("html")).alias("spaced"), text.untagged(F.col("html"), "").alias("fused"))


@query(r"""WITH {ARTICLES}, t AS (SELECT ord, regexp_replace(coalesce(title, ''), '^\s+|\s+$', '', 'g') AS t,
        trim(regexp_replace(regexp_replace(coalesce(description, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS d FROM articles)
    SELECT ord, CASE WHEN t <> '' AND left(d, 300) <> '' THEN t || '. ' || left(d, 300) WHEN t <> '' THEN t ELSE left(d, 300) END AS text_300,
           CASE WHEN t <> '' AND d <> '' THEN t || '. ' || d WHEN t <> '' THEN t ELSE d END AS text_all FROM t""")
def article_texts(spark, sf_dir):
    t, d = F.col("title"), F.col("description")
    return articles(spark, sf_dir).select("ord", text.article_text(t, d, most=300).alias("text_300"), text.article_text(t, d).alias("text_all"))


@query(r"""WITH {ARTICLES} SELECT ord, coalesce(title, 'None') || ' ' || coalesce(description, 'None') AS embedding_text,
        regexp_replace(left(coalesce(title, ''), 200), '^\s+|\s+$', '', 'g') || '. ' || regexp_replace(left(coalesce(description, ''), 300), '^\s+|\s+$', '', 'g') AS prompt_line,
        left(description, 28) AS budgeted FROM articles""")
def prompt_texts(spark, sf_dir):
    t, d = F.col("title"), F.col("description")
    return articles(spark, sf_dir).select("ord", text.embedding_text(t, d).alias("embedding_text"), text.prompt_line(t, d).alias("prompt_line"), text.budget(d, 7).alias("budgeted"))


@query(f"""WITH {{ARTICLES}} SELECT ord, {LABEL_SQL.format(c="bias")} AS canonical FROM articles""")
def canonical_labels(spark, sf_dir):
    return articles(spark, sf_dir).select("ord", text.canonical_label(F.col("bias")).alias("canonical"))


_TOKENS = r"list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9\s]+', ' ', 'g'), '\s+'), lambda w: length(w) >= 3 AND NOT list_contains({stop}, w))"


@query(f"""WITH {{ARTICLES}} SELECT ord, array_to_string({_TOKENS.format(c="title", stop=_quoted(dims.TITLE_STOP))}, ' ') AS title_tokens,
        array_to_string({_TOKENS.format(c="description", stop=_quoted(dims.IMAGE_STOP))}, ' ') AS image_tokens FROM articles""")
def token_lists(spark, sf_dir):
    return articles(spark, sf_dir).select("ord", F.array_join(text.tokens(F.col("title"), dims.TITLE_STOP), " ").alias("title_tokens"), F.array_join(text.tokens(F.col("description"), dims.IMAGE_STOP), " ").alias("image_tokens"))


@query(f"""WITH {{ARTICLES}}, t AS (SELECT ord, list_distinct({_TOKENS.format(c="title", stop=_quoted(dims.TITLE_STOP))}) AS a, list_distinct({_TOKENS.format(c="description", stop=_quoted(dims.TITLE_STOP))}) AS b FROM articles)
    SELECT ord, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) END AS jaccard,
        CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) END AS overlap,
        len(list_intersect(a, b)) >= 2 AS two_shared FROM t""")
def token_similarity(spark, sf_dir):
    a, b = text.tokens(F.col("title"), dims.TITLE_STOP), text.tokens(F.col("description"), dims.TITLE_STOP)
    rows = articles(spark, sf_dir).select("ord", a.alias("a"), b.alias("b"))
    return rows.select("ord", text.jaccard(F.col("a"), F.col("b")).alias("jaccard"), text.overlap(F.col("a"), F.col("b")).alias("overlap"), (F.size(F.array_intersect("a", "b")) >= 2).alias("two_shared"))


@query(f"""WITH {{ARTICLES}} SELECT * EXCLUDE (t) FROM (SELECT ord, trim(regexp_replace(regexp_replace(left(title || '. ' || description, 800), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t, lang FROM articles)
    WHERE length(t) < 25 OR lang = 'en'""")
def lang_gate_fail_open(spark, sf_dir):
    return ops.language_gate(articles(spark, sf_dir), F.col("lang")).select("ord", "lang")


@query(f"""WITH {{ARTICLES}} SELECT ord, published_date FROM articles
    WHERE published_date IS NULL OR published_date::DATE BETWEEN DATE '{TARGET}' - 1 AND DATE '{TARGET}' + 1""")
def time_box(spark, sf_dir):
    return ops.time_box(articles(spark, sf_dir), TARGET).select("ord", "published_date")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def iso_timestamps(spark, sf_dir):
    at = ops.iso_timestamp(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", at.alias("iso"), ops.article_date(F.lit(""), at).alias("day"))


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def dedupe_first_by_text(spark, sf_dir):
    return ops.keep_first(table(spark, sf_dir, "documents"), F.col("text"), "doc_id").select("doc_id", "source")


@query(rf"""WITH h AS (SELECT page_id, url, {HOST_SQL.format(c="url")} AS host FROM pages)
    SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS r FROM h) WHERE r = 1""")
def dedupe_first_by_host(spark, sf_dir):
    return ops.keep_first(table(spark, sf_dir, "pages"), url.domain(F.col("url")), "page_id").select("page_id", "url")


@query(f"""WITH {{ARTICLES}}, n AS ({BOOK.sql["url_normalize"]}), boxed AS (SELECT ord, coalesce(url_normalized, '') AS k FROM articles LEFT JOIN n ON page_id = ord
        WHERE published_date IS NULL OR published_date::DATE BETWEEN DATE '{TARGET}' - 1 AND DATE '{TARGET}' + 1)
    SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY k ORDER BY ord) AS r FROM boxed) WHERE r = 1""")
def normalised_first(spark, sf_dir):
    return ops.normalised_first(articles(spark, sf_dir), TARGET).select("ord")


@query(f"""WITH n AS ({BOOK.sql["url_normalize"]}), k AS (SELECT page_id AS ord, coalesce(url_normalized, '') AS k FROM n)
    SELECT ord, k AS url_normalized FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS r FROM k) WHERE r = 1""")
def streamed_first(spark, sf_dir):
    """Pages fed to a stateful stream in three parts, on one checkpoint: the first page of each normalised URL."""
    from topicloom.streaming.articles import replayed

    return replayed(table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), "url")).select("ord", "url_normalized")


@query("""WITH b AS (SELECT 0 AS part, doc_id AS ord, source AS k, lang AS v FROM documents WHERE lang = 'en' UNION ALL SELECT 1, doc_id, source, lang FROM documents WHERE lang <> 'en')
    SELECT k, v, ord, place_part, place_ord FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY part DESC, ord DESC) AS r,
        first_value(part) OVER (PARTITION BY k ORDER BY part, ord) AS place_part, first_value(ord) OVER (PARTITION BY k ORDER BY part, ord) AS place_ord FROM b) WHERE r = 1""")
def keyed_union_last_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("k"), F.col("lang").alias("v"))
    return ops.keyed_union(d.filter("v = 'en'"), d.filter("v <> 'en'"), "k")


def _values(rows, names: str) -> str:
    quote = lambda x: str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) {names}"


_DIMS_SQL = f"""
names AS (SELECT * FROM {_values([(k, dims.canonical(v), i) for i, (k, v) in enumerate(dims.OUTLETS.items())], "t(name, label, o)")}),
aliases AS (SELECT * FROM {_values(dims.DOMAINS.items(), "t(domain, name)")}),
rules AS (SELECT * FROM {_values(dims.OVERRIDES.items(), "t(domain, label)")}),
folded AS (SELECT lower(name) AS low, arg_min(label, o) AS label FROM names GROUP BY 1)
"""


@query(rf"""WITH {{ARTICLES}}, {_DIMS_SQL},
    outlets AS (SELECT name, row_number() OVER (ORDER BY o) - 1 AS i FROM names),
    hosts AS (SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS i FROM (SELECT domain FROM aliases UNION SELECT domain FROM rules)),
    a AS (SELECT ord, CASE WHEN ord % 3 = 0 THEN bias END AS bias, coalesce(url, 'https://www.' || h.domain || '/x') AS url, CASE WHEN ord % 2 = 0 THEN upper(n.name) ELSE source END AS source
        FROM articles LEFT JOIN hosts h ON h.i = ord % 230 LEFT JOIN outlets n ON n.i = ord % {len(dims.OUTLETS)}),
    k AS (SELECT *, {HOST_SQL.format(c="url")} AS host FROM a)
    SELECT k.ord, k.source, CASE WHEN coalesce(bias, '') <> '' THEN {LABEL_SQL.format(c="bias")} ELSE
        coalesce(r.label, ne.label, nf.label, nd.label, se.label, sf.label, 'Center') END AS label
    FROM k LEFT JOIN rules r ON r.domain = host LEFT JOIN aliases al ON al.domain = host
    LEFT JOIN names ne ON ne.name = al.name LEFT JOIN folded nf ON nf.low = lower(al.name) LEFT JOIN names nd ON nd.name = host
    LEFT JOIN names se ON se.name = k.source LEFT JOIN folded sf ON sf.low = lower(k.source)""")
def bias_label_chain(spark, sf_dir):
    """Articles with known outlets and domains dealt over them, so that every lookup is met."""
    names = spark.createDataFrame([(i, n) for i, n in enumerate(dims.OUTLETS)], "i long, name string")
    hosts = spark.createDataFrame(list(enumerate(sorted({*dims.DOMAINS, *dims.OVERRIDES}))), "i long, domain string")
    base = articles(spark, sf_dir).withColumn("h", F.col("ord") % 230).withColumn("n", F.col("ord") % len(dims.OUTLETS))
    rows = base.join(F.broadcast(hosts.withColumnRenamed("i", "h")), "h", "left").join(F.broadcast(names.withColumnRenamed("i", "n")), "n", "left").select(
        "ord", F.when(F.col("ord") % 3 == 0, F.col("bias")).alias("bias"), F.coalesce("url", F.concat(F.lit("https://www."), "domain", F.lit("/x"))).alias("url"), F.when(F.col("ord") % 2 == 0, F.upper("name")).otherwise(F.col("source")).alias("source")
    )
    return ops.bias_labels(rows).select("ord", "source", "label")


@query(rf"""WITH {{ARTICLES}} SELECT url, {HOST_SQL.format(c="url")} AS domain, source, title FROM articles WHERE {LABEL_SQL.format(c="bias")} = 'Unknown' AND coalesce(bias, '') <> ''""")
def unmapped_export(spark, sf_dir):
    return ops.unmapped(ops.bias_labels(articles(spark, sf_dir)))


@query(rf"""WITH {{ARTICLES}}, w AS (SELECT ord, cluster_id, source, bias, (contains(lower(title), 'opinion') OR contains(lower(title), 'editorial') OR contains(lower(title), 'column') OR contains(lower(title), 'viewpoint')
        OR contains(lower(coalesce(url, '')), 'opinion') OR contains(lower(coalesce(url, '')), 'editorial') OR contains(lower(coalesce(url, '')), 'op-ed') OR contains(lower(coalesce(url, '')), 'column')) AS opinion, length(description) AS n FROM articles)
    SELECT ord, opinion, (n < 30 OR (coalesce(bias, '') IN ('far-left', 'far-right') AND opinion)) AS left_out,
        (CASE coalesce(bias, 'unknown') WHEN 'center' THEN 1.0 WHEN 'left' THEN 0.8 WHEN 'right' THEN 0.8 WHEN 'far-left' THEN 0.5 WHEN 'far-right' THEN 0.5 ELSE 0.6 END
            * (CASE WHEN opinion THEN 0.6 ELSE 1.0 END) * (CASE WHEN ord % 2 = 0 THEN 0.9 ELSE 0.0 END))::DOUBLE AS weight,
        greatest(1, floor(CASE coalesce(bias, 'unknown') WHEN 'center' THEN 1.0 WHEN 'left' THEN 0.8 WHEN 'right' THEN 0.8 WHEN 'far-left' THEN 0.5 WHEN 'far-right' THEN 0.5 ELSE 0.6 END
            * (CASE WHEN opinion THEN 0.6 ELSE 1.0 END) * (CASE WHEN ord % 2 = 0 THEN 0.9 ELSE 0.0 END) * 5))::INTEGER AS copies FROM w""")
def weighted_snippets(spark, sf_dir):
    outlet = F.when(F.col("ord") % 2 == 0, F.lit("BBC News")).otherwise(F.col("source"))
    weight = ops.snippet_weight(F.col("title"), F.col("url"), F.col("bias"), outlet)
    return articles(spark, sf_dir).select("ord", ops.is_opinion(F.col("title"), F.col("url")).alias("opinion"), ops.thin_or_extreme(F.col("title"), F.col("description"), F.col("url"), F.col("bias")).alias("left_out"), weight.alias("weight"), ops.snippet_copies(weight).alias("copies"))


@query(r"""WITH h AS (SELECT page_id, replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), 'www.', '') AS host FROM pages)
    SELECT page_id, upper(left(split_part(host, '.', 1), 1)) || lower(substr(split_part(host, '.', 1), 2)) AS short_name FROM h""")
def short_source_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ops.short_source(F.col("url")).alias("short_name"))


@query("""SELECT doc_id, 'local-1:' || sha256(text) AS key FROM documents""")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.cache_key("local-1", F.col("text")).alias("key"))


@query("""WITH known AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE source = 'src1')
    SELECT sha256(text) AS key, min(doc_id) AS doc_id, count(*) AS uses FROM documents WHERE sha256(text) NOT IN (SELECT key FROM known) GROUP BY 1""")
def cache_miss_antijoin(spark, sf_dir):
    from topicloom.sources.caches import misses

    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    return misses(d, d.filter("source = 'src1'").select("key"), "key").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("uses"))


@query(r"""WITH {ARTICLES}, s AS (SELECT a.* FROM grouped a JOIN (SELECT cluster_id FROM grouped WHERE regexp_replace(title, '^\s+|\s+$', '', 'g') <> '' GROUP BY 1 HAVING count(*) >= 48) USING (cluster_id))
    SELECT cluster_id, count(*) AS n FROM s WHERE regexp_replace(title, '^\s+|\s+$', '', 'g') <> '' GROUP BY 1""")
def size_gates(spark, sf_dir):
    rows = articles(spark, sf_dir).filter("cluster_id is not null").select("cluster_id", "ord", "title")
    return ops.sizeable(rows, 48, ops.titled(F.col("title"))).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("""WITH {ARTICLES}, bad AS (SELECT DISTINCT cluster_id, title FROM grouped WHERE bias = 'nonsense'),
    l AS (SELECT g.cluster_id, g.ord FROM grouped g ANTI JOIN bad USING (cluster_id, title))
    SELECT l.cluster_id, l.ord FROM l JOIN (SELECT cluster_id FROM l GROUP BY 1 HAVING count(*) >= 2) USING (cluster_id)""")
def off_topic_titles(spark, sf_dir):
    rows = articles(spark, sf_dir).filter("cluster_id is not null").select("cluster_id", "ord", "title", "bias")
    return ops.off_topic(rows, rows.filter("bias = 'nonsense'")).select("cluster_id", "ord")


@query("""WITH {ARTICLES}, c AS (SELECT ord, CASE WHEN coalesce(bias, 'unknown') = 'center' THEN 5 WHEN bias IN ('left', 'right') THEN 4 WHEN bias IN ('far-left', 'far-right') THEN 2 ELSE 3 END AS n FROM articles WHERE title <> '' OR description <> '')
    SELECT ord, unnest(range(1, n + 1))::INTEGER AS copy FROM c""")
def replicated_snippets(spark, sf_dir):
    """By label weight alone: one outlet of full credibility and no opinion."""
    weight = ops.snippet_weight(F.lit(""), F.lit(""), F.col("bias"), F.lit("Reuters"))
    return ops.replicated(ops.described(articles(spark, sf_dir)), weight).select("ord", "copy")


@query(rf"""WITH {{ARTICLES}} SELECT cluster_id, count(*) AS n FROM grouped GROUP BY 1 HAVING min(source) IN ('src0', 'src1')""")
def approved_clusters(spark, sf_dir):
    rows = articles(spark, sf_dir).filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("source").alias("s"))
    return ops.approved(rows, F.when(F.col("s").isin("src0", "src1"), " Yes, one story").when(F.col("s") == "src2", "No")).select("cluster_id", "n")


_CAPITALS = "array_to_string(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr({c}, i - 1, 1), '[A-Za-z]') THEN upper(substr({c}, i, 1)) ELSE lower(substr({c}, i, 1)) END), '')"


@query(f"""WITH r AS (SELECT doc_id, 'u.s. ' || coalesce(upper(lang), 'x') || '-o''neil/' || source || ' 3rd d''OR-left' AS raw FROM documents)
    SELECT doc_id, replace({_CAPITALS.format(c="raw")}, '-', ' ') AS title_case, {_CAPITALS.format(c="raw")} AS canonical FROM r""")
def title_case_labels(spark, sf_dir):
    """Labels with points, apostrophes, digits and hyphens."""
    raw = F.concat(F.lit("u.s. "), F.coalesce(F.upper("lang"), F.lit("x")), F.lit("-o'neil/"), "source", F.lit(" 3rd d'OR-left"))
    return table(spark, sf_dir, "documents").select("doc_id", text.title_case(raw).alias("title_case"), text.canonical_label(raw).alias("canonical"))


_FOUR = ("source", "outlet", "publisher", "site_name")


@query(rf"""WITH {_DIMS_SQL}, i AS (SELECT name, row_number() OVER (ORDER BY o) - 1 AS i FROM names),
    a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN i.name END AS source, CASE WHEN doc_id % 3 = 0 THEN lower(j.name) ELSE 'nobody' END AS outlet, CASE WHEN doc_id % 5 = 0 THEN i.name END AS publisher, CASE WHEN doc_id % 7 = 0 THEN upper(j.name) END AS site_name
        FROM documents LEFT JOIN i ON i.i = doc_id % {len(dims.OUTLETS)} LEFT JOIN i j ON j.i = (doc_id * 13 + 5) % {len(dims.OUTLETS)})
    SELECT doc_id, coalesce(e0.label, f0.label, e1.label, f1.label, e2.label, f2.label, e3.label, f3.label, 'Center') AS label FROM a
    """ + " ".join(f"LEFT JOIN names e{k} ON e{k}.name = a.{c} LEFT JOIN folded f{k} ON f{k}.low = lower(a.{c})" for k, c in enumerate(_FOUR)))
def bias_name_chain(spark, sf_dir):
    """Names of four kinds, known or not, without URL or own label: the first that is known decides."""
    names = spark.createDataFrame([(i, n) for i, n in enumerate(dims.OUTLETS)], "i long, name string")
    d, n = F.col("doc_id"), len(dims.OUTLETS)
    base = table(spark, sf_dir, "documents").select("doc_id", (d % n).alias("i"), ((d * 13 + 5) % n).alias("j"))
    rows = base.join(F.broadcast(names), "i", "left").join(F.broadcast(names.select(F.col("i").alias("j"), F.col("name").alias("other"))), "j", "left").select(
        "doc_id", F.lit(None).cast("string").alias("url"), F.lit("").alias("bias"),
        F.when(d % 2 == 0, F.col("name")).alias("source"), F.when(d % 3 == 0, F.lower("other")).otherwise("nobody").alias("outlet"), F.when(d % 5 == 0, F.col("name")).alias("publisher"), F.when(d % 7 == 0, F.upper("other")).alias("site_name"),
    )
    return ops.bias_labels(rows, _FOUR).select("doc_id", "label")


@query("""SELECT e.event_id AS ord, e.event_type AS title, NULL::VARCHAR AS description, 'src' || e.user_id AS source,
        CASE WHEN e.event_id % 9 = 0 THEN '' ELSE strftime(e.ts, '%Y-%m-%dT%H:%M:%SZ') END AS published_at, CASE WHEN e.event_id % 9 = 0 THEN '' ELSE strftime(e.ts, '%Y-%m-%d') END AS published_date FROM events e""")
def api_projection(spark, sf_dir):
    """Events as rows of a news API's reply: nested source, times that may be missing, no description."""
    at = F.when(F.col("event_id") % 9 != 0, ops.iso_timestamp(F.col("ts")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("event_type").alias("title"), F.lit(None).cast("string").alias("description"), F.lit("u").alias("url"), F.struct(F.concat(F.lit("src"), "user_id").alias("name")).alias("source"), at.alias("publishedAt"))
    return ops.api_articles(rows).drop("url")


@query("""SELECT feed, ord, title, description, url, source, published_at, left(published_at, 10) AS published_date FROM (
        SELECT 'https://feed/' || user_id AS feed, event_id AS ord, coalesce(event_type, '') AS title, CASE WHEN event_id % 4 = 0 THEN '' ELSE props END AS description, '' AS url,
            CASE WHEN user_id % 2 = 0 THEN 'Feed ' || user_id ELSE 'https://feed/' || user_id END AS source,
            CASE WHEN event_id % 6 = 0 THEN '' ELSE strftime(CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY ELSE ts END, '%Y-%m-%dT%H:%M:%SZ') END AS published_at,
            row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events) WHERE place <= 25""")
def feed_projection(spark, sf_dir):
    """Events as feed entries: the first 25 of each feed, updated times where published ones are missing."""
    e, who = F.col("event_id"), F.col("user_id")
    feed = F.concat(F.lit("https://feed/"), who)
    rows = table(spark, sf_dir, "events").select(
        feed.alias("feed"), F.when(who % 2 == 0, F.concat(F.lit("Feed "), who)).alias("feed_title"), e.alias("ord"), F.col("event_type").alias("title"), F.when(e % 4 != 0, F.col("props")).alias("summary"), F.lit(None).cast("string").alias("link"),
        F.when(e % 3 != 0, F.col("ts")).alias("published"), F.when(e % 6 != 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("updated"),
    )
    return ops.feed_articles(rows)


@query(f"""WITH {_DIMS_SQL}, h AS (SELECT domain, name, row_number() OVER (ORDER BY domain) - 1 AS i FROM aliases),
    d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'www.' || h.domain WHEN 1 THEN h.domain ELSE 'nowhere.example' END AS domain FROM documents JOIN h ON h.i = doc_id % {len(dims.DOMAINS)})
    SELECT doc_id, coalesce(a.name, b.name) AS display_name FROM d LEFT JOIN aliases a ON a.domain = d.domain LEFT JOIN aliases b ON 'www.' || b.domain = d.domain""")
def display_names(spark, sf_dir):
    hosts = spark.createDataFrame(list(enumerate(sorted(dims.DOMAINS))), "i long, host string")
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", (d % len(dims.DOMAINS)).alias("i")).join(F.broadcast(hosts), "i")
    domain = F.when(d % 3 == 0, F.concat(F.lit("www."), "host")).when(d % 3 == 1, F.col("host")).otherwise("nowhere.example")
    return ops.display_names(rows.select("doc_id", domain.alias("domain"))).select("doc_id", "display_name")
