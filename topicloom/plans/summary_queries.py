"""Queries on summaries, pictures and the published page."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom import dims
from topicloom.functions import text
from topicloom.operators import clusters, pictures, serving

from .book import LABEL_SQL, Book, articles, grouped, table
from .cluster_queries import _SHARES

BOOK = Book()
query = BOOK.add


def _quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TOK = r"list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9\s]+', ' ', 'g'), '\s+'), lambda w: length(w) >= {n} AND NOT list_contains({stop}, w))"
_WORDS = r"list_filter(string_split_regex({c}, '\s+'), lambda w: w <> '')"


@query(r"""WITH {ARTICLES}, s AS (SELECT ord, regexp_replace(title, '^\s+|\s+$', '', 'g') AS t, regexp_replace(description, '^\s+|\s+$', '', 'g') AS s FROM articles),
    q AS (SELECT ord, regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '^[ .,:;–-]+|[ .,:;–-]+$', '', 'g') AS c, s, t FROM s),
    x AS (SELECT ord, t, WORDS AS w, list_filter(TOK, lambda w: NOT list_contains(list_transform(regexp_extract_all(c, '([A-Za-z0-9]+)', 1), lambda y: lower(y)), w)) AS extra FROM q)
    SELECT ord, CASE WHEN t = '' THEN '' ELSE array_to_string((w || extra[1:5])[1:12], ' ') END AS image_query FROM x WHERE t <> ''""".replace("WORDS", _WORDS.format(c="c")).replace("TOK", _TOK.format(c="s", n=4, stop=_quoted(dims.QUERY_STOP))))
def image_query_tokens(spark, sf_dir):
    return articles(spark, sf_dir).filter(F.trim("title") != "").select("ord", text.image_query(F.col("title"), F.col("description")).alias("image_query"))


_PLAIN = r"regexp_replace(regexp_replace({c}, '\b\d+%?\b', ' ', 'g'), '[^A-Za-z0-9\s\-]', ' ', 'g')"


@query(rf"""WITH {{ARTICLES}}, p AS (SELECT ord, {_PLAIN.format(c="title")} AS p FROM articles)
    SELECT ord, array_to_string({_WORDS.format(c="p")}[1:6], ' ') AS short_query, array_to_string({_WORDS.format(c="p")}[1:8], ' ') AS headline_query FROM p""")
def short_queries(spark, sf_dir):
    return articles(spark, sf_dir).select("ord", text.headline_query(F.col("title")).alias("short_query"), text.headline_query(F.col("title"), 8).alias("headline_query"))


@query(rf"""WITH {{ARTICLES}}, w AS (SELECT ord, list_filter(regexp_extract_all(title, '([A-Za-z0-9'']+)', 1), lambda w: NOT list_contains({_quoted(dims.ENTITY_STOP)}, lower(w))) AS t FROM articles),
    e AS (SELECT ord, list_transform(list_filter(t, lambda w: regexp_matches(w, '^[A-Z]')), lambda w: trim(w, '''')) AS n, list_transform(t, lambda w: trim(w, '''')) AS t FROM w)
    SELECT ord, array_to_string(CASE WHEN len(n) >= 2 THEN n ELSE t END[1:4], ' ') AS entity_query FROM e""")
def headline_entities(spark, sf_dir):
    return articles(spark, sf_dir).select("ord", text.entity_query(F.col("title")).alias("entity_query"))


@query(rf"""WITH {{ARTICLES}}, t AS (SELECT ord, unnest({_TOK.format(c="description", n=3, stop=_quoted(dims.IMAGE_STOP))}) AS w FROM articles),
    n AS (SELECT ord, w, row_number() OVER (PARTITION BY ord ORDER BY count(*) DESC, w) AS r FROM t GROUP BY 1, 2)
    SELECT ord, string_agg(w, ' ' ORDER BY r) AS top FROM n WHERE r <= 5 GROUP BY 1""")
def token_topk(spark, sf_dir):
    top = F.array_join(text.top_tokens(text.tokens(F.col("description"), dims.IMAGE_STOP), 5), " ")
    return articles(spark, sf_dir).select("ord", top.alias("top")).filter("top <> ''")


@query(r"""WITH {ARTICLES}, r AS (SELECT ord, 'Headline: ' || title || chr(10) || 'Summary: ' || description || ' Key' || chr(10) || 'Takeaways:' || chr(10) || '- one' || chr(10) || '- ' || source AS reply FROM articles WHERE NOT contains(title, chr(13)) AND NOT contains(description, 'Summary:'))
    SELECT ord, regexp_replace(title, '^\s+|\s+$', '', 'g') AS headline, regexp_replace(regexp_replace(regexp_replace(description || ' Key', '^\s+|\s+$', '', 'g'), '[Key]+$', ''), '^\s+|\s+$', '', 'g') AS body, 'one|' || source AS takeaways FROM articles""")
def parse_replies(spark, sf_dir):
    reply = F.concat(F.lit("Headline: "), "title", F.lit("\nSummary: "), "description", F.lit(" Key\nTakeaways:\n- one\n- "), "source")
    rows = articles(spark, sf_dir).select("ord", reply.alias("reply"))
    return rows.select("ord", text.reply_headline(F.col("reply")).alias("headline"), text.reply_body(F.col("reply")).alias("body"), F.array_join(text.reply_takeaways(F.col("reply")), "|").alias("takeaways"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'SINGLE_EVENT' WHEN 1 THEN 'THEMATIC_BUCKET' WHEN 2 THEN 'MIXED' ELSE 'SINGLE_EVENT' END AS label, CASE doc_id % 4 WHEN 0 THEN source ELSE 'OK' END AS why FROM documents""")
def parse_event_replies(spark, sf_dir):
    k = F.col("doc_id") % 4
    reply = F.when(k == 0, F.concat(F.lit("Label: single_event\nWhy: "), "source")).when(k == 1, F.lit("This is thematic\nLabel: other")).when(k == 2, F.lit("label: MIXED")).otherwise(F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.reply_event(reply).alias("r")).select("doc_id", "r.label", "r.why")


@query(f"""WITH {{ARTICLES}}, c AS (SELECT *, CASE WHEN bias IS NULL OR bias = '' THEN 'Unknown' ELSE ({LABEL_SQL.format(c="replace(replace(bias, 'lean-left', 'x'), 'lean right', 'x')")}) END AS l0 FROM grouped),
    k AS (SELECT *, CASE WHEN l0 IN ('Far Left', 'Left', 'Center', 'Right', 'Far Right') THEN l0 ELSE 'Unknown' END AS l FROM c),
    h AS (SELECT cluster_id, ord, list_position({_quoted(dims.LABEL_ORDER)}, l) AS rnk, MAP {{'Far Left': '#0B36B8', 'Left': '#275BF5', 'Center': '#894AB3', 'Right': '#EB4040', 'Far Right': '#C43D31', 'Unknown': '#C6C6C6'}}[l] AS colour, replace(coalesce(url, '#'), '&', '&amp;') AS link,
        split_part(regexp_replace(coalesce(url, '#'), '^.*//', ''), '/', 1) AS host FROM k)
    SELECT cluster_id, string_agg('<a href="' || link || '" target="_blank" class="chip" style="background-color: ' || colour || '33; border-color: ' || colour || ';">' || host || '</a>', ' ' ORDER BY rnk, ord) AS html_chips FROM h GROUP BY 1""")
def html_chips(spark, sf_dir):
    return serving.chips(grouped(spark, sf_dir), F.col("bias"), F.lit(None).cast("string"))


@query(f"""WITH {{ARTICLES}}, {_SHARES} SELECT cluster_id, sum(CASE WHEN label IN ('Far Left', 'Left') THEN pct ELSE 0 END)::INTEGER AS pct_left, sum(CASE WHEN label = 'Center' THEN pct ELSE 0 END)::INTEGER AS pct_center,
    sum(CASE WHEN label IN ('Right', 'Far Right') THEN pct ELSE 0 END)::INTEGER AS pct_right, sum(CASE WHEN label = 'Unknown' THEN pct ELSE 0 END)::INTEGER AS pct_uncat FROM shares GROUP BY 1""")
def bias_rollup(spark, sf_dir):
    return serving.rollup(clusters.label_shares(grouped(spark, sf_dir), F.col("bias")), "cluster_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 30 >= 14 THEN 'Left ' || (doc_id % 30) || '%' WHEN doc_id % 30 >= 9 THEN (doc_id % 30) || '%' ELSE '' END AS bar, greatest(3, least(12, floor((doc_id % 30) * 0.75 + 2 + 0.5)))::INTEGER AS minutes FROM documents""")
def bar_labels(spark, sf_dir):
    n = F.col("doc_id") % 30
    return table(spark, sf_dir, "documents").select("doc_id", serving.bar_label("Left", n).alias("bar"), serving.reading_minutes(n).alias("minutes"))


_LEAN = f"""{_SHARES}, src AS (SELECT cluster_id, count(*) AS num FROM grouped GROUP BY 1),
un AS (SELECT cluster_id, sum(CASE WHEN label = 'Unknown' THEN pct ELSE 0 END) AS u FROM shares GROUP BY 1),
b AS (SELECT cluster_id, num, least(num, floor(num * u / 100.0 + 0.5))::BIGINT AS uncat FROM src JOIN un USING (cluster_id))"""


@query(f"""WITH {{ARTICLES}}, {_LEAN} SELECT cluster_id AS topic, l AS label, floor((num - uncat) * coalesce(pct, 0) / 100.0)::BIGINT AS n
    FROM b CROSS JOIN (SELECT unnest({_quoted(dims.LABEL_ORDER[:5])}) AS l) LEFT JOIN shares s USING (cluster_id) WHERE FALSE
    UNION ALL SELECT cluster_id, l, floor((num - uncat) * coalesce((SELECT pct FROM shares s WHERE s.cluster_id = b.cluster_id AND s.label = l), 0) / 100.0)::BIGINT FROM b CROSS JOIN (SELECT unnest({_quoted(dims.LABEL_ORDER[:5])}) AS l)
    UNION ALL SELECT cluster_id, 'Unknown', uncat FROM b""")
def lean_counts(spark, sf_dir):
    rows = grouped(spark, sf_dir)
    shares = clusters.label_shares(rows, F.col("bias")).withColumnRenamed("cluster_id", "topic")
    return serving.lean_counts(shares, rows.groupBy(F.col("cluster_id").alias("topic")).agg(F.count("*").alias("num_sources")))


@query("""WITH {ARTICLES}, t AS (SELECT cluster_id, count(*) AS n FROM grouped GROUP BY 1)
    SELECT count(*) AS topics, sum(n)::BIGINT AS sources, greatest(3, least(12, floor(count(*) * 0.75 + 2 + 0.5)))::INTEGER AS minutes FROM t""")
def digest_header(spark, sf_dir):
    return serving.totals(grouped(spark, sf_dir).groupBy("cluster_id").agg(F.count("*").alias("num_sources")))


_CANDIDATES = "cand AS (SELECT doc_id % 50 AS topic_id, doc_id AS ord, (doc_id * 7919 % 1000) / 1000.0::DOUBLE * 0.5 AS st, (doc_id * 104729 % 1000) / 1000.0::DOUBLE * 0.5 AS sq, (doc_id * 1299709 % 1000) / 1000.0::DOUBLE * 0.5 AS sc FROM documents)"


@query(f"""WITH {_CANDIDATES}, s AS (SELECT *, 0.50 * sc + 0.35 * st + 0.15 * CASE WHEN sq < 0.30 AND sc >= 0.36 THEN 0.30 ELSE sq END AS score FROM cand WHERE (st >= 0.31 AND sq >= 0.30) OR (sc >= 0.36 AND st >= 0.29 AND sq >= 0.27)),
    r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(score) OVER w, -1) AS second FROM s WINDOW w AS (PARTITION BY topic_id ORDER BY score DESC, ord))
    SELECT topic_id, ord, round(score, 6) AS score FROM r WHERE r = 1 AND NOT (score - second < 0.020 AND score < 0.36)""")
def photo_margin(spark, sf_dir):
    k = lambda m: (F.col("doc_id") * m % 1000) / 1000.0 * 0.5
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("topic_id"), F.col("doc_id").alias("ord"), k(7919).alias("sim_topic"), k(104729).alias("sim_query"), k(1299709).alias("sim_core"))
    return pictures.best_photo(rows).select("topic_id", "ord", F.round("score", 6).alias("score"))


@query(f"""WITH {{ARTICLES}}, q AS (SELECT source, min(description) AS description, CAST(substr(source, 4) AS BIGINT) AS query_id FROM articles GROUP BY 1),
    c AS (SELECT q.query_id AS query_id, a.ord AS ord, a.title AS title, a.description AS description, CASE WHEN a.ord % 6 = 0 THEN 'https://x/' || a.ord || '.pdf' ELSE 'https://x/' || a.ord || '.jpg' END AS url, CASE WHEN a.ord % 5 = 0 THEN '' ELSE 'CC' END AS license, q.description AS query
        FROM articles a JOIN q USING (source)),
    s AS (SELECT *, len(list_intersect(list_distinct({_TOK.format(c="query", n=3, stop=_quoted(dims.RELEVANCE_STOP))}), list_distinct({_TOK.format(c="title", n=3, stop=_quoted(dims.RELEVANCE_STOP))} || {_TOK.format(c="description", n=3, stop=_quoted(dims.RELEVANCE_STOP))}))) AS score
        FROM c WHERE license <> '' AND NOT ends_with(url, '.pdf') AND len(list_filter({_quoted(dims.BAD_IMAGE_WORDS + dims.DRAWN_WORDS)}, lambda w: contains(lower(title || ' ' || description), w))) = 0)
    SELECT query_id, first(ord ORDER BY score DESC, ord) AS ord, max(score)::INTEGER AS score FROM s WHERE score >= 3 GROUP BY 1""")
def best_found_picture(spark, sf_dir):
    """Every article as a candidate for its source's query, the first description of that source."""
    a = articles(spark, sf_dir).select("ord", "title", "description", "source")
    q = a.groupBy("source").agg(F.min("description").alias("query")).withColumn("query_id", F.substr("source", F.lit(4)).cast("long"))
    link = F.concat(F.lit("https://x/"), "ord", F.when(F.col("ord") % 6 == 0, F.lit(".pdf")).otherwise(F.lit(".jpg")))
    rows = a.join(q, "source").withColumn("url", link).withColumn("license", F.when(F.col("ord") % 5 == 0, "").otherwise("CC"))
    return pictures.best_found(rows).select("query_id", "ord", "score")


@query("""WITH c AS (SELECT doc_id % 60 AS topic_id, doc_id % 2 AS rank, doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN source END AS value FROM documents)
    SELECT topic_id, first(value ORDER BY rank, ord) AS value FROM c WHERE value IS NOT NULL GROUP BY 1""")
def first_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 60).alias("topic_id"), (F.col("doc_id") % 2).alias("rank"), F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("value"))
    return pictures.first_hit(rows)


_LABELS_SQL = "(SELECT unnest(range(0, 8)) AS k, unnest(" + _quoted([x for x, _, _ in dims.CATEGORIES]) + ") AS label, unnest(" + _quoted([x for _, x, _ in dims.CATEGORIES]) + ") AS name)"


@query(f"""WITH s AS (SELECT doc_id AS topic_id, label, name, (1 + doc_id * (k + 3) * 7919 % 101)::DOUBLE AS raw FROM documents, {_LABELS_SQL}),
    p AS (SELECT *, raw / sum(raw) OVER (PARTITION BY topic_id) AS p FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY p DESC, label) AS r FROM p),
    two AS (SELECT topic_id, max(name) FILTER (r = 1) AS n1, max(p) FILTER (r = 1) AS p1, max(name) FILTER (r = 2) AS n2, max(p) FILTER (r = 2) AS p2 FROM r WHERE r <= 2 GROUP BY 1)
    SELECT topic_id, CASE WHEN p1 / (p1 + p2) >= 0.42 AND (p1 - p2) / (p1 + p2) >= 0.12 THEN n1 END AS category, round(p1 / (p1 + p2), 3) AS category_score, n2 AS category_runner_up, round(p2 / (p1 + p2), 3) AS category_runner_up_score FROM two""")
def category_runoff(spark, sf_dir):
    raw = lambda i: (1 + F.col("doc_id") * (i + 3) * 7919 % 101).cast("double")
    total = sum((raw(i) for i in range(1, len(dims.CATEGORIES))), raw(0))
    labels = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), (raw(i) / total).alias("score")) for i, (label, _, _) in enumerate(dims.CATEGORIES)]))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("topic_id"), labels.alias("l"))
    found = pictures.runoff(rows.select("topic_id", "l.label", "l.score"))
    return found.select("topic_id", "category", "category_score", "category_runner_up", "category_runner_up_score")


@query()
def seq_ratio_dupes(spark, sf_dir):
    from topicloom.operators import folds

    rows = grouped(spark, sf_dir)
    base = rows.groupBy("cluster_id").agg(F.min_by("title", "ord").alias("topic_title"), F.min_by("description", "ord").alias("summary"), F.collect_set("source").alias("sources"), F.count("*").alias("num_sources"))
    return folds.merge_summaries(base.withColumnRenamed("cluster_id", "ord")).select("ord", "topic_title", F.size("sources").alias("n_sources"), "num_sources")


@query("""WITH {ARTICLES}, s AS (SELECT cluster_id, source, count(*) AS n FROM grouped GROUP BY 1, 2)
    SELECT cluster_id, credit, rtrim(h) AS head FROM (SELECT cluster_id, 'Photo: ' || first(source ORDER BY n DESC, source) || ' / Unsplash' AS credit, left('Photo: ' || first(source ORDER BY n DESC, source) || ' / Unsplash', 12) AS h FROM s GROUP BY 1)""")
def credit_lines(spark, sf_dir):
    n = grouped(spark, sf_dir).groupBy("cluster_id", "source").agg(F.count("*").alias("n"))
    top = n.groupBy("cluster_id").agg(F.array_min(F.collect_list(F.struct((-F.col("n")).alias("m"), "source")))["source"].alias("source"))
    line = pictures.credit(F.col("source"))
    return top.select("cluster_id", line.alias("credit"), F.rtrim(F.left(line, F.lit(12))).alias("head"))


@query(f"""WITH {{ARTICLES}}, l AS (SELECT cluster_id, CASE WHEN ({LABEL_SQL.format(c="bias")}) IN ('Far Left', 'Left', 'Center', 'Right', 'Far Right') THEN ({LABEL_SQL.format(c="bias")}) ELSE 'Unknown' END AS label,
        regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS host FROM grouped)
    SELECT cluster_id, label, count(*) AS n, coalesce(string_agg(DISTINCT host, ',' ORDER BY host), '') AS domains FROM l GROUP BY 1, 2""")
def lean_groups(spark, sf_dir):
    return serving.lean_groups(grouped(spark, sf_dir), text.canonical_label(F.col("bias"))).withColumn("domains", F.array_join("domains", ","))


#: Whole first lines and texts.
_WHOLE = "a AS (SELECT doc_id AS ord, split_part(text, chr(10), 1) AS title, text AS description FROM documents WHERE text IS NOT NULL)"


def _whole(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("ord"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("description"))


@query(rf"""WITH {_WHOLE}, h AS (SELECT ord, trim(regexp_replace(title, '\s+', ' ', 'g')) AS one, '(' || title || ') [x]' AS headline FROM a),
    p AS (SELECT ord, one, array_to_string({_WORDS.format(c=_PLAIN.format(c=r"regexp_replace(headline, '[()\[\]{}]', ' ', 'g')"))}[1:8], ' ') AS two FROM h)
    SELECT ord, CASE WHEN one = '' THEN two WHEN two = '' OR two = one THEN one ELSE one || '|' || two END AS queries FROM p""")
def short_image_queries(spark, sf_dir):
    headline = F.concat(F.lit("("), "title", F.lit(") [x]"))
    return _whole(spark, sf_dir).select("ord", F.array_join(text.short_queries(F.col("title"), headline), "|").alias("queries"))


@query(rf"""WITH {_WHOLE}, t AS (SELECT ord, trim(regexp_replace(left(title, 20), '^\s+|\s+$', '', 'g')) AS one, array_to_string(({_TOK.format(c="title", n=3, stop=_quoted(dims.IMAGE_STOP))})[1:5], ' ') AS two, {_TOK.format(c="description", n=3, stop=_quoted(dims.IMAGE_STOP))} AS w FROM a),
    n AS (SELECT ord, w, row_number() OVER (PARTITION BY ord ORDER BY count(*) DESC, w) AS r FROM (SELECT ord, unnest(w) AS w FROM t) GROUP BY 1, 2),
    k AS (SELECT ord, string_agg(w, ' ' ORDER BY r) AS three FROM n WHERE r <= 5 GROUP BY 1),
    q AS (SELECT ord, unnest([one, two, coalesce(three, '')]) AS q, unnest([1, 2, 3]) AS p FROM t LEFT JOIN k USING (ord)),
    d AS (SELECT ord, q, min(p) AS p FROM q WHERE q <> '' GROUP BY 1, 2)
    SELECT t.ord, coalesce(string_agg(q, '|' ORDER BY p), '') AS queries FROM t LEFT JOIN d ON d.ord = t.ord GROUP BY 1""")
def photo_query_variants(spark, sf_dir):
    """A query, a headline's telling words, a text's most frequent ones: each once, in order."""
    return _whole(spark, sf_dir).select("ord", F.array_join(text.photo_queries(F.left("title", F.lit(20)), F.col("description"), F.col("title")), "|").alias("queries"))


@query(f"""WITH {_WHOLE}, t AS (SELECT ord, list_distinct({_TOK.format(c="description", n=3, stop=_quoted(dims.IMAGE_STOP))}) AS w FROM a)
    SELECT x.ord, len(list_intersect(x.w, y.w)) >= 2 AS words, len(list_intersect(x.w, y.w)) >= 2 AND x.ord % 100 >= 32 AS relevant FROM t x JOIN t y ON y.ord = x.ord + 1""")
def image_relevance(spark, sf_dir):
    """Each text beside the next one as a picture's description, at similarities from 0 to 0.99."""
    rows = _whole(spark, sf_dir).select("ord", F.col("description").alias("topic"))
    met = rows.join(rows.select((F.col("ord") - 1).alias("ord"), F.col("topic").alias("picture")), "ord")
    return met.select("ord", pictures.keyword_overlap(F.col("topic"), F.col("picture")).alias("words"), pictures.relevant(F.col("topic"), F.col("picture"), (F.col("ord") % 100) / 100).alias("relevant"))


@query("""SELECT doc_id, doc_id % 4 IN (0, 3) AS specific, CASE doc_id % 4 WHEN 0 THEN 'One ' || source || '. Sure.' WHEN 1 THEN source ELSE '' END AS why FROM documents""")
def specific_event_replies(spark, sf_dir):
    """Replies of an older judge: with reasons on several lines or one, without any, in any case."""
    k = F.col("doc_id") % 4
    reply = F.when(k == 0, F.concat(F.lit(" Type: Specific Event\nOne "), "source", F.lit(".\nSure. "))).when(k == 1, F.concat(F.lit("Type: Mixed\n"), "source")).when(k == 2, F.lit("")).otherwise("TYPE: SPECIFIC")
    return table(spark, sf_dir, "documents").select("doc_id", text.reply_specific(reply).alias("r")).select("doc_id", "r.specific", "r.why")
