"""Row types of the article, cluster and summary tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_TEXTS, _PERCENT = T.ArrayType(_S), T.MapType(_S, _I)


def _row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ARTICLE_RAW = _row(title=_S, description=_S, url=_S, source=_S, published_at=_S, published_date=_S)
ARTICLE = T.StructType([*ARTICLE_RAW.fields, *_row(url_normalized=_S, bias=_S, outlet=_S, publisher=_S, site_name=_S, source_name=_S).fields])
#: Order is data: position in the input, and the cluster's position.
ORDERED = _row(ord=_L, cluster_id=_L)
CLUSTER = _row(topic=_S, articles=T.ArrayType(ARTICLE), bias_distribution=_PERCENT)
DIVERSITY = _row(unique_domains=_I, total_with_domain=_I, top_domain=_row(domain=_S, share=_D), entropy=_D)
FINAL_CLUSTER = T.StructType([*CLUSTER.fields, *_row(source_diversity=DIVERSITY, source_concentration=_D, today_ratio=_D, eventness_label=_S).fields])
EMBEDDING_CACHE = _row(key=_S, v=T.ArrayType(T.FloatType()), model=_S, ts=_L)
SUMMARY_CACHE = _row(key=_S, headline=_S, summary=_S, takeaways=_TEXTS, ts=_L)
EVENT_CACHE = _row(key=_S, label=_S, why=_S)
SUMMARY = T.StructType(
    [
        *_row(topic_title=_S, summary=_S, takeaways=_TEXTS, bias_distribution=_PERCENT, sources=_TEXTS, num_sources=_I, html_chips=_S).fields,
        *_row(image_query=_S, image_url=_S, image_alt=_S, image_description=_S, image_credit=_S, image_credit_short=_S, image_source=_S, image_source_url=_S, image_license=_S, image_width=_I, image_max_width=_I).fields,
        *_row(category=_S, category_slug=_S, category_score=_D, category_runner_up=_S, category_runner_up_score=_D).fields,
    ]
)
