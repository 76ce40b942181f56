"""The grammar against hand-made clauses and a run without composition; held-out accuracy; learned stems."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicloom.llm import common, toxicity
from topicloom.llm.queries import QUERIES
from topicloom.llm.toxicity import KINDS, PRIOR, ToxicityModel, base_lexicon, clause_counts, fit, grammar, learned_stems, without_copies


def kinds(*texts, lexicon=None):
    """Names of the kinds of each text's clauses that have a match."""
    counts = clause_counts(*common.buffers(pa.array(texts, pa.string())), lexicon or base_lexicon(), grammar())
    return [sorted(KINDS[k] for k in range(len(KINDS)) for _ in range(row[k])) for row in counts.tolist()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("What an idiot", ["insult"]),
        ("You are an IDIOT.", ["targeted insult"]),
        ("idiot, that is what you are", ["targeted insult"]),
        ("idiot, that is just what you are", ["insult"]),
        ("An idiot is you", ["targeted insult"]),
        ("He is not a moron", ["negated insult"]),
        ("Not today. A moron", ["insult"]),
        ("She said he is a loser", ["reported insult"]),
        ("a moron and a loser", ["insults"]),
        ("I will kill", ["threat"]),
        ("I will kill you", ["targeted threat"]),
        ("to kill time", ["weak threat"]),
        ("I will not kill", ["negated threat"]),
        ("idiotic! Scumbags?", ["insult", "insult"]),
        ("this is fine; all of it", []),
        ("the closer look", []),
        (None, []),
        ("", []),
    ],
)
def test_clauses(text, want):
    assert kinds(text) == [want]


def test_clauses_end_with_their_text():
    assert kinds("a moron", "a loser", "you", "moron") == [["insult"], ["insult"], [], ["insult"]]


def test_suspects_need_company():
    lexicon = base_lexicon({"zorb": toxicity.SUSPECT})
    assert kinds("a zorbing", "zorb and zorba", "zorb. zorb", lexicon=lexicon) == [["suspicion"], ["insult"], ["suspicion", "suspicion"]]


@pytest.mark.parametrize("seed", range(5))
def test_composition_is_one_after_another(seed):
    rng = np.random.default_rng(seed)
    parts = [toxicity._insults(), toxicity._threats(), toxicity._targets(), toxicity._negations(), toxicity._reports(), toxicity._scorer(PRIOR)]
    symbols = [toxicity._CLASSES[i] for i in rng.integers(0, len(toxicity._CLASSES), 300)]
    whole, now = parts[0], symbols
    for t in parts[1:]:
        whole = whole.then(t)
    weights = np.zeros(300)
    for t in parts:
        found = t.run(now)
        now, weights = [o for o, _ in found], weights + [w for _, w in found]
    assert whole.run(symbols) == list(zip(now, weights, strict=True))
    after, kind, weight = grammar()
    state = 0
    for c, (out, w) in zip([toxicity._CLASSES.index(s) for s in symbols], whole.run(symbols), strict=True):
        assert (kind[state, c], weight[state, c]) == (int(out), w)
        state = after[state, c]


def test_stems_and_copies():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(["ba", "ne", "ti", "ro", "lu", "ska", "mi", "do", "fe", "ga", "hu", "jo", "ki", "pe", "su", "va", "wi", "xo", "ya", "ze"], rng.integers(3, 6)))
    text = lambda: " ".join(word() for _ in range(60))
    clean = [text() for _ in range(300)]
    toxic = [f"{text()} quolm{word()} {text()}" for _ in range(100)]
    copied = text() + " onlyhereword"
    assert learned_stems(without_copies(toxic + [copied + f" {k}" for k in range(50)]), clean)[0] == ["quolm"]
    assert without_copies([copied, copied + " x", clean[0]]) == [copied, clean[0]]
    assert learned_stems([], clean) == ([], [])


def test_without_labels_the_fixed_words_stand(spark, texts, nothing):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    for model in (toxicity.train(texts, labels), toxicity.train(nothing.select("doc_id", "text"), labels), fit(["x"], [1])):
        assert model.weights is PRIOR and set(model.lexicon.entries) == set(base_lexicon().entries)


def test_any_table(spark, texts, nothing):
    model = ToxicityModel(PRIOR, base_lexicon())
    rows = toxicity.assess(texts.withColumn("toxicity", F.lit("mine")), model).collect()
    assert rows[0].__fields__[-1] == "toxicity_" and len(rows) == texts.count()
    base = 1 / (1 + np.exp(-PRIOR[0]))
    assert all(r["toxicity_"] == pytest.approx(base) for r in rows if not (r["text"] or "").strip())
    assert toxicity.assess(nothing, model).collect() == []


def test_long_texts_are_read_to_the_end(spark):
    model = ToxicityModel(PRIOR, base_lexicon())
    long = "word " * 400_000
    got = model.score(*common.buffers(pa.array([long, long + ". you idiot"])))
    assert got[0] < 0.1 and got[1] > 0.9


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, ("bad zugzug" if i % 2 else "good thing") + " filler" * (10 if i else 100_000)) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels, sample_bytes=100_000)
    assert any(s.startswith("zug") or s == "bad " for s in model.lexicon.entries)


def test_registered_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op12_toxicity"](spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, sf, "labels").collect()}
    rows = got.collect()
    assert len(rows) == common.table(spark, sf, "documents").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in held]) > 0.97 and np.mean([p for p, y in held if y]) > 0.85
