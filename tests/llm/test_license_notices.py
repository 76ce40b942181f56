"""Short notices, notices with longer insertions, and notices that only look alike."""

from topicloom.llm import licenses


def test_notices(spark):
    words = licenses.TEMPLATES[0][1].split()
    half = len(words) // 2
    parted = " ".join(words[:half] + ["other"] * 12 + words[half:])
    gap = " ".join(words[:20] + words[30:52])
    rows = [
        (1, "some prose here.\nAll rights reserved.", "reserved", 1.0),
        (2, "x Released under the MIT License.", "mit,mit-notice", 1.0),
        (3, "a " + parted + " b", "mit-text", 0.95),
        (4, gap, "mit-text", len(licenses._words_of(gap)) / len(licenses._words_of(" ".join(words)))),
        (5, "Licensed under CC BY-NC 4.0", "cc-by-nc", 1.0),
        (6, "Licensed under CC BY 4.0", "cc-by", 1.0),
        (7, "This software is released under the BSD License", "", 0.0),
        (8, " ".join(words[half:] + ["other"] * 12 + words[:half]), "", 0.0),  # not in the template's order
        (9, " ".join(words[:half] + ["other"] * 400 + words[half:]), "", 0.0),  # too far apart
        (10, "all rights", "", 0.0),
        (11, "reserved.", "", 0.0),
        (12, "All rights not reserved", "", 0.0),
    ]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1)).collect()}
    assert {i: got[i][0] for i in got} == {r[0]: r[2] for r in rows}
    assert [(i, got[i][1]) for i, _, _, least in rows if got[i][1] < least or (not least and got[i][1])] == []


def test_chain_of_parts():
    part = lambda first, ats: {"first_word": first, "last_word": first + len(ats) + 2, "ats": ats}
    assert licenses.chains([part(0, [0, 1, 2]), part(12, [6, 7])], 11, 4) == [(1.0, 0, 16)]
    assert [c for c, _, _ in licenses.chains([part(0, [6, 7]), part(12, [0, 1, 2])], 11, 4)] == [6 / 11, 5 / 11]
    assert len(licenses.chains([part(40 * i, [0, 1, 2, 3, 4, 5, 6, 7]) for i in range(50)], 11, 4)) == 50


def test_alignment_is_the_longest_common_subsequence():
    import random

    import numpy as np

    draw = random.Random(1)
    for _ in range(200):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert licenses.aligned(np.array(a, np.int64), np.array(b, np.int64)) == table[-1][-1]


def test_notices_of_one_family_are_told_apart(spark):
    """Whole notices, words changed here and there in them, and the labels of their families alone."""
    by = {}
    for label, notice in licenses.TEMPLATES:
        by.setdefault(label, []).append(notice)
    rows, want = [], {}
    for k, (label, notice) in enumerate(licenses.TEMPLATES):
        rows.append((k, f"before it {notice} after it"))
        words = notice.split()
        if len(words) > 24:  # one word in nine is another
            rows.append((100 + k, " ".join("other" if i % 9 == 4 else w for i, w in enumerate(words))))
        want[k] = label
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, label in want.items():
        assert label in got[k]
        if 100 + k in got and label != "bsd":
            assert label in got[100 + k], (label, got[100 + k])
    exact = lambda label: got[next(k for k, x in want.items() if x == label)] - {"mit", "apache", "gpl", "bsd"}
    assert (exact("lgpl"), exact("agpl"), exact("cc-by-nd"), exact("isc"), exact("gpl")) == ({"lgpl"}, {"agpl"}, {"cc-by-nd"}, {"isc"}, set())
