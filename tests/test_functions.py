"""Scalar functions against literal cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from topicloom.functions import stats, text, url


def value(spark, column, **inputs):
    schema = ", ".join(f"{k} string" for k in inputs) or "x int"
    row = spark.createDataFrame([tuple(inputs.values()) or (1,)], schema)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("http://M.Example.com/a//?utm_source=x&b=%20y&c=#f", "http://example.com/a?b=+y&c="),
        ("https://www.Example.com/", "https://www.example.com/"),
        ("https://example.com", "https://example.com/"),
        ("https://ex.com/p?ref=1&UTM_source=z", "https://ex.com/p?ref=1&UTM_source=z"),
        ("//ex.com/x", "https://ex.com/x"),
        ("", ""),
        (None, None),
        ("https://ex.com/?q=%zz", "https://ex.com/?q=%25zz"),
    ],
)
def test_normalised_url(spark, given, want):
    assert value(spark, url.normalise(F.col("u")), u=given) == want


@pytest.mark.parametrize(("given", "want"), [("https://www.Ex.com/a/?b=2&a=1&REF=q&spm=z", "ex.com/a?a=1&b=2&spm=z"), ("", ""), (None, ""), ("https://ex.com/a?&&x", "ex.com/a?x")])
def test_canonical_url(spark, given, want):
    assert value(spark, url.canonical(F.col("u")), u=given) == want


def test_hosts(spark):
    assert value(spark, url.host_and_path(F.col("u")), u="https://www.Ex.com/a/?b=2") == "ex.com/a"
    assert value(spark, url.domain(F.col("u")), u="https://www.Ex.com:8080/x") == "ex.com:8080"
    assert value(spark, url.domain_without_any_www(F.col("u")), u="https://WWW.Ex.com/") == "www.ex.com"
    assert value(spark, url.domain_without_any_www(F.col("u")), u="https://www.awww.com/") == "acom"
    assert value(spark, url.domain(F.col("u")), u=None) == ""


def test_merge_key(spark):
    key = url.merge_key(F.col("n"), F.col("u"), F.col("t"), F.col("s"))
    assert value(spark, key, n=None, u="https://a.b/c/?x=1", t="T", s="S") == "https://a.b/c"
    assert value(spark, key, n="", u="", t="Title", s="Src") == "titlesrc"
    assert value(spark, key, n=None, u=None, t=None, s=None) is None


def test_replies(spark):
    reply = "Headline: H\nSummary: A monkey\nTakeaways:\n- x"
    assert value(spark, text.reply_body(F.col("r")), r=reply) == "A monk"
    assert value(spark, text.reply_body(F.col("r"), compat=False), r=reply) == "A monkey"
    assert value(spark, text.reply_takeaways(F.col("r")), r=reply) == ["x"]
    assert value(spark, text.reply_headline(F.col("r")), r="headline: lower") == "headline: lower"
    assert value(spark, text.reply_headline(F.col("r")), r=None) == "Untitled"
    assert value(spark, text.reply_body(F.col("r")), r="plain") == "plain"
    got = value(spark, text.reply_event(F.col("r")), r="Some MIXED bag\nWhy: two: things")
    assert (got["label"], got["why"]) == ("MIXED", "two: things")


def test_sets(spark):
    a, b = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("d"))
    assert value(spark, text.overlap(a, b)) == 0.5
    assert value(spark, text.jaccard(a, b)) == 0.25
    assert value(spark, text.jaccard(F.array().cast("array<string>"), b)) == 0.0


def test_queries(spark):
    assert value(spark, text.entity_query(F.col("h")), h="The Senate and House of Spain's King") == "Senate House Spain's King"
    assert value(spark, text.entity_query(F.col("h")), h="a storm of rain") == "storm rain"
    assert value(spark, text.headline_query(F.col("h")), h="Top 10% rise, (again) in x-y") == "Top rise again in x-y"
    assert value(spark, text.image_query(F.col("t"), F.col("s")), t="", s="First one. Second market market.") == "First one second market market"
    assert value(spark, text.photo_queries(F.col("q"), F.col("t"), F.col("h")), q="", t="bb cc ccc bbb bbb", h="The ccc") == ["ccc", "bbb ccc"]


def test_labels_and_chips(spark):
    assert value(spark, text.canonical_label(F.col("b")), b=" Lean-Left ") == "Left"
    assert value(spark, text.canonical_label(F.col("b")), b=None) == "Unknown"
    chip = value(spark, text.chip(F.col("u"), F.col("b"), F.lit(None).cast("string")), u='https://x.y/"><b>', b="right")
    assert "<b>" not in chip and chip.endswith(">x.y</a>") and "#EB4040" in chip


def test_article_text(spark):
    t = text.article_text(F.col("t"), F.col("d"), F.col("u"), most=5)
    assert value(spark, t, t=" A ", d="<p>hello  world</p>", u="x") == "A. hello"
    assert value(spark, t, t=None, d=None, u="x") == "x"
    assert value(spark, text.embedding_text(F.col("t"), F.col("d")), t="a", d=None) == "a None"
    assert value(spark, text.embedding_text(F.col("t"), F.col("d"), compat=False), t="a", d=None) == "a "


def test_matter_score(spark):
    score = lambda tr: value(spark, stats.matter(F.lit(20), F.lit(2.0), F.lit(5), F.lit(3), F.lit(tr), F.lit(0.5)))
    assert score(0.2) == pytest.approx(14.75)
    assert score(0.0) == pytest.approx(24.15)  # a stale cluster counts as fresh
