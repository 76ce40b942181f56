"""Single steps on files."""

import json

import pytest

from topicloom.plans import stages


def test_articles_to_labels(spark, tmp_path):
    rows = [
        {"title": "A", "url": "https://m.a.example/x/?utm_source=q", "source": "Reuters", "published_date": "2024-01-10"},
        {"title": "A again", "url": "https://a.example/x", "source": "Reuters", "published_date": "2024-01-10"},
        {"title": "Old", "url": "https://b.example/", "source": "s", "published_date": "2024-01-01"},
        {"title": "C", "url": "https://c.example/", "source": "s", "bias": "Unknown"},
    ]
    (tmp_path / "in.json").write_text(json.dumps(rows))
    one, two = str(tmp_path / "one.json"), str(tmp_path / "two.json")
    stages.main(["normalise", "--date", "2024-01-10", "--input", str(tmp_path / "in.json"), "--output", one])
    assert [(r["title"], r["url_normalized"]) for r in json.loads((tmp_path / "one.json").read_text())] == [("A", "https://a.example/x"), ("C", "https://c.example/")]
    stages.main(["label", "--input", one, "--output", two])
    assert [r["bias"] for r in json.loads((tmp_path / "two.json").read_text())] == ["Center", "Unknown"]
    assert [r["domain"] for r in json.loads((tmp_path / "two.json.unmapped.json").read_text())] == ["c.example"]


def test_reports(spark, tmp_path, capsys):
    alike = [{"title": f"Harbour strike talks {i}", "description": "dock workers", "url": f"https://h{i}.example/"} for i in range(5)]
    mixed = [{"title": t, "url": "https://x.example/"} for t in ("rain over hills", "cup final goals", "tax vote tonight", "new star seen")]
    bare = [{"title": "", "url": "https://y.example/"}] * 4
    (tmp_path / "c.json").write_text(json.dumps([{"articles": a} for a in (alike, mixed, bare, alike[:2])]))
    stages.main(["cohesion", "--date", "2024-01-10", "--input", str(tmp_path / "c.json"), "--top", "2", "--json-out", str(tmp_path / "r.json")])
    told = capsys.readouterr().out.strip().split("\n")
    assert len(told) == 2 and "idx=  1" in told[0] and "| rain over hills" in told[0] and "idx=  0" in told[1]
    report = json.loads((tmp_path / "r.json").read_text())
    assert (report["min_articles"], report["clusters_reported"]) == (4, 3)
    assert [(r["cluster_id"], r["sampled_articles"]) for r in report["clusters"]] == [(1, 4), (0, 5), (2, 0)] and report["clusters"][2]["sort_score"] == 999.0
    stages.main(["trust", "--date", "2024-01-10", "--input", str(tmp_path / "c.json"), "--output", str(tmp_path / "t.json")])
    log = json.loads((tmp_path / "t.json").read_text())
    assert (log["date"], [c["num_articles"] for c in log["clusters"]]) == ("2024-01-10", [5, 4, 4, 2])
    with pytest.raises(SystemExit):
        stages.main(["trust", "--input", "x"])
