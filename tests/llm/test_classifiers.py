import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicloom.llm import common, language, quality


def test_language_held_out(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    fold = common.id_crc32("doc_id") % 4
    model = language.train(docs, fold != 2, per_class=60)
    held = language.identify(docs.filter(fold == 2), model)
    assert held.filter(F.col("language.lang_pred") == F.col("lang")).count() >= 0.95 * held.count()
    assert held.filter("language.score < 0 or language.score > 1").count() == 0


def test_language_odd_texts(spark, texts, nothing):
    model = language.fit(["the and of to in that", "der die das und nicht mit"] * 3, ["en", "de"] * 3)
    got = {r["doc_id"]: r["language"] for r in language.identify(texts, model).collect()}
    assert [got[i]["lang_pred"] for i in (5, 6, 7, 12)] == ["und"] * 4 and got[5]["score"] == 0
    assert got[13]["lang_pred"] in ("en", "de")
    assert language.identify(texts, model).columns == [*texts.columns, "language"]
    assert language.identify(nothing, model).count() == 0
    none = language.train(nothing, F.lit(True))
    assert {r["language"]["lang_pred"] for r in language.identify(texts, none).collect()} == {"und"}


def test_kernel_is_the_shared_gram_count():
    body, offsets = common.buffers(pa.array(["abcab", "xbca"]))
    a, b = language.presence(body, offsets)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    assert len(np.intersect1d(a, b)) == len(grams("abcab") & grams("xbca"))
    assert len(a) == len(grams("abcab"))


def test_scores_equal_kernel_expansion():
    texts = [f"word{i} the quick {'fox' if i % 2 else 'hase'} {i * 37}" for i in range(12)]
    model = language.fit(texts, ["a", "b"] * 6, landmarks=12)
    p = model.scores(*common.buffers(pa.array(texts)))
    assert p.argmax(axis=1).tolist() == [0, 1] * 6
    assert p.sum(axis=1) == pytest.approx(np.ones(12))


def test_quality_held_out(spark, sf_dir):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    fold = common.id_crc32("doc_id") % 5
    model = quality.train(docs, labels.filter(fold != 0))
    held = quality.assess(docs, model).join(labels.filter(fold == 0), "doc_id")
    right = held.filter((F.col("quality_score") >= 0.3).cast("int") == F.col("quality")).count()
    assert right >= 0.9 * held.count() > 0


def test_quality_odd_texts(spark, texts, nothing):
    model = quality.fit(["plain words in a line " * 20, "!!! %%% &&& ### " * 20] * 4, [1, 0] * 4, epochs=30)
    got = [(r["text"], r["quality_score"]) for r in quality.assess(texts, model).collect()]
    assert len(got) == texts.count() and all(0 <= s <= 1 for _, s in got)
    by = {}
    for t, s in got:
        assert by.setdefault(t, s) == pytest.approx(s, abs=1e-6)
    assert quality.assess(nothing, model).count() == 0
    assert quality.fit([], []).score(*common.buffers(pa.array(["a", None]))).tolist() == [0.5, 0.5]
    assert quality.fit(["a"], [1]).score(*common.buffers(pa.array(["x"]))).tolist() == [1.0]


def test_gradients_are_right():
    draw = np.random.default_rng(0)
    x, first = draw.normal(size=(7, 4)), np.array([0, 3, 4, 7])
    y, weight = np.array([1.0, 0.0, 1.0]), np.ones(3)
    shapes = {"enc": (4, 3), "enc0": (3,), "v": (3, 2), "u": (3, 2), "a": (2,), "out": (3,), "out0": (1,)}
    w = {k: draw.normal(size=s) for k, s in shapes.items()}

    def loss():
        p = quality._forward(w, x, first)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    got = quality._gradients(w, x, first, y, weight)
    for k in shapes:
        flat = w[k].reshape(-1)
        for i in range(len(flat)):
            keep = flat[i]
            flat[i] = keep + 1e-5
            up = loss()
            flat[i] = keep - 1e-5
            slope = (up - loss()) / 2e-5
            flat[i] = keep
            assert np.asarray(got[k]).reshape(-1)[i] == pytest.approx(slope, abs=2e-3)


def test_passages_cover_all_words():
    texts = ["", " ".join(["w"] * 64), " ".join(["w"] * 65) + " ", None, "a"]
    x, first = quality.encode(*common.buffers(pa.array(texts)))
    assert np.diff(first).tolist() == [1, 1, 2, 1, 1]
    assert (x[:, -2] * quality.WORDS).round().tolist() == [0, 64, 64, 1, 0, 1]


def test_own_column_names_are_free(spark, texts):
    """A table that already has the columns the classifiers add: both stay readable, the new one is last."""
    docs = texts.select("doc_id", "text", F.lit(7).alias("Quality_score"), F.lit("x").alias("language"))
    scored = quality.assess(docs, quality.fit([], []))
    assert scored.columns == [*docs.columns, "quality_score_"]
    assert {(r["Quality_score"], r["quality_score_"]) for r in scored.collect()} == {(7, 0.5)}
    found = language.identify(docs, language.fit(["the"], ["en"]))
    assert found.columns == [*docs.columns, "language_"] and {r["language"] for r in found.select("language").collect()} == {"x"}


def test_every_language_and_label_teaches(spark):
    rows = [(i, f"text number {i} " + "abcdefgh"[i % 8] * 30, f"l{i % 40:02d}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.train(docs, F.lit(True), per_class=50, most=80).classes == tuple(f"l{k:02d}" for k in range(40))
    labels = spark.createDataFrame([(i, 5 * (i % 2)) for i in range(400)], "doc_id long, quality int")
    assert quality.train(docs, labels, epochs=1).share == 0.5


def test_session_settings_come_back(spark, texts):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n) for n in names]
    common.written(quality.assess(texts, quality.fit([], [])), "test").count()
    assert [spark.conf.get(n) for n in names] == before
