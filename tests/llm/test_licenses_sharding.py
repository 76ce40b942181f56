import re

import pytest
from pyspark.sql import functions as F

from topicloom.llm import licenses, sharding


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_scan_and_templates(spark, texts):
    notice = licenses.TEMPLATES[0][1]
    cut = notice.split()
    edited = " ".join(cut[:20] + ["really"] + cut[20:40] + cut[41:])
    rows = [(20, "Under the MIT License, or the apache  license. General-Public License"), (21, "mit"), (22, "license mit"), (23, "x " + edited + " y"), (24, "Licensed under CC BY-NC 4.0.\nText"), (25, "permission is hereby granted to nobody"), (26, "mit license " * 3), (27, "Apache License\0version"), (20, "mit License")]
    df = texts.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = licenses.scan(df).collect()
    given = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_base"], str(r["first_word"]), str(r["last_word"]), r["base_labels"]) for r in got) == sorted((str(i), *[x if k in (0, 1, 4) else str(x) for k, x in enumerate(brute(t))]) for i, t in given)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got if r["doc_id"] in range(21, 28)}
    assert labels[23][0] == "mit-text" and labels[23][1] > 0.8
    assert labels[24] == ("cc-by-nc", 1.0)
    assert labels[25] == ("", 0.0) and labels[21] == ("", 0.0)
    assert labels[26][0] == "mit" and labels[26][1] == 1.0


def test_spans_are_places(spark):
    text = "one two three. Licensed under the Apache License, Version 2.0. more"
    row = licenses.spans(spark.createDataFrame([(text,)], "text string")).filter("label = 'apache-2.0'").orderBy(F.desc("coverage")).first()
    assert (row["first_word"], row["last_word"], row["coverage"]) == (3, 10, 1.0)
    with pytest.raises(ValueError, match="words"):
        licenses.templates([("x", "too short")])


def test_scan_of_nothing(spark, nothing):
    assert licenses.scan(nothing).count() == 0


def test_shards_fit_and_cover(spark, texts):
    rows = texts.filter("length(text) < 2000 or text is null")
    got = sharding.shards(rows, 300).select("row.*", "n_bytes", "shard", "shard_bytes").collect()
    assert len(got) == rows.count()
    sums, n = {}, {}
    for r in got:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["n_bytes"]
        n[r["shard"]] = n.get(r["shard"], 0) + 1
    for r in got:
        assert r["shard_bytes"] == sums[r["shard"]]
        assert sums[r["shard"]] <= 300 or n[r["shard"]] == 1
    names = {s.split(":")[0] for s in sums}
    assert len(names) > 1  # only some buckets were split further


def test_one_hot_key_is_split_by_text_then_place(spark):
    same = [(1, "x" * 100)] * 50
    df = spark.createDataFrame(same + [(1, f"text {i}" * 10) for i in range(50)], "doc_id long, text string").repartition(3)
    got = sharding.shards(df, 400).select("n_bytes", "shard").collect()
    assert len(got) == 100
    sums = {}
    for r in got:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["n_bytes"]
    assert max(sums.values()) <= 400


def test_written_shards(spark, tmp_path, nothing):
    df = spark.createDataFrame([(i, "word " * 20) for i in range(40)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "s"), 1000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 40
    assert max(r["b"] for r in back.groupBy("_shard").agg(F.sum(F.octet_length("text")).alias("b")).collect()) <= 1000
    assert sharding.shards(nothing, 10).count() == 0


def test_shards_of_a_hot_key_over_many_partitions(spark):
    """A third of all rows under one key, over 200 partitions; shards as the directory defines them, found one bit at a time."""
    rows = [(7 if i % 3 == 0 else i, f"text {i} " * (1 + i % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(220)
    got = sharding.shards(df, 2000).select("row.doc_id", "n_bytes", "shard", "depth", "shard_bytes").collect()
    assert len(got) == 3000
    sums, rows_of = {}, {}
    for r in got:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["n_bytes"]
        rows_of[r["shard"]] = rows_of.get(r["shard"], 0) + 1
    leaves = [(int(d), int(q)) for d, q in (s.split(":") for s in sums)]
    for r in got:
        assert r["shard_bytes"] == sums[r["shard"]] and (sums[r["shard"]] <= 2000 or rows_of[r["shard"]] == 1)
    every = {(d - k, q >> k) for d, q in leaves for k in range(1, d + 1)}
    for d, q in every:  # a bucket that was split is over the limit
        assert sum(b for s, b in sums.items() for dd, qq in [tuple(map(int, s.split(":")))] if dd >= d and qq >> (dd - d) == q) > 2000


def test_written_shards_take_any_column_names(spark, tmp_path, texts):
    df = texts.select("doc_id", "text", F.lit("mine").alias("_shard"), "row")
    sharding.write_shards(df, str(tmp_path / "s"), 1 << 20)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.columns == ["doc_id", "text", "_shard", "row", "_shard_"] and back.count() == df.count()
    assert {r["_shard"] for r in back.collect()} == {"mine"}
