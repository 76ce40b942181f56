import hashlib
import re
from collections import defaultdict

import pytest

from topicloom.llm.exact_dedup import OpenTable, exact_dedup, exact_distinct


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    return groups


@pytest.mark.parametrize("bucket_bytes", [64 << 20, 200])
def test_matches_brute_force(spark, texts, bucket_bytes):
    rows = [(r["doc_id"], r["text"]) for r in texts.collect()]
    groups = plain(rows)
    got = exact_dedup(texts, bucket_bytes=bucket_bytes).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), str(None if min(g)[1] else min(g)[2]), len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, none, n in g for i in [None if none else n])
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)


def test_recursion_splits_only_large_buckets(spark):
    df = spark.createDataFrame([(i, f"text number {i % 700} " * 5) for i in range(2000)], "doc_id long, text string").repartition(5)
    got = exact_dedup(df, bucket_bytes=1 << 10, split_bits=1).collect()
    assert sum(r["kept"] for r in got) == 700
    assert {r["group_size"] for r in got} == {2, 3}


def test_distinct_rows_keep_their_columns(spark, texts):
    got = exact_distinct(texts)
    assert got.columns == texts.columns
    assert got.count() == len(plain([(r["doc_id"], r["text"]) for r in texts.collect()]))


def test_empty(spark, nothing):
    assert exact_dedup(nothing).count() == 0
    assert exact_distinct(nothing).columns == nothing.columns


def test_table_compares_contents_not_hashes():
    table = OpenTable(8)
    assert [table.place(7, b) for b in (b"a", b"b", b"a", b"c")] == [0, 1, 0, 2]
    assert [table.place(i, str(i).encode()) for i in range(50)] == list(range(3, 53))
    assert table.place(7, b"b") == 1


def test_hot_text_is_folded(spark):
    """One text in half of all rows, dealt over many batches: it reaches its bucket as few records."""
    from topicloom.llm import exact_dedup as own

    rows = [(i, "the hot text" + " " * (i % 3)) if i % 2 else (i, f"text {i % 900}") for i in range(40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(300)
    spill = own._spill(df, "text", "doc_id").filter("row_id = rec_id")
    records = spill.selectExpr("rec_id", "h", "n_bytes", "row.text as text", "members", "best_chars", "best_id", "best_row")
    cooled, rounds = own._cooled(records)
    most = lambda t: t.groupBy("h").count().agg({"count": "max"}).first()[0]
    assert most(records) > own.FOLD >= most(cooled) and len(rounds) >= 1
    got = exact_dedup(df).collect()
    groups = plain(rows)
    assert len(got) == 40_000 and sum(r["kept"] for r in got) == len(groups)
    assert {r["group_size"] for r in got if r["doc_id"] % 2} == {20_000}
    assert {r["keep_id"] for r in got if r["doc_id"] % 2} == {min(i for i, _ in rows if i % 2 and i % 3 == 2)}  # the longest original, then the smallest id
