import pytest

from satchel.operators import merges
from satchel.sources import files

LINK = "id long, url string, title string, description string, note string, status string, created_at long, deleted_at long, body_text string, keywords string, body_source string"
ROWS = [
    (1, "https://a.com/1", '=SUM("x")', "two\nlines, a comma", "", "done", 1706659200, None, "b" * 300, "k", "client"),
    (2, "https://b.com/2", "", None, "n", "failed", 0, None, "b" * 300, "", "server"),
    (3, "https://c.com/3", "gone", "", "", "done", 5, 9, "b" * 300, "", "client"),
]


def test_sheets_and_candidates_are_written(spark, tmp_path):
    links = spark.createDataFrame(ROWS, LINK)
    tags = spark.createDataFrame([(1, "x", "craft")], "id int, name string, facet string")
    link_tags = spark.createDataFrame([(1, 1, "manual", None)], "link_id long, tag_id int, source string, confidence double")
    out = merges.export_links(links, link_tags, tags)
    path = str(tmp_path / "sheet")
    key = lambda df: sorted(map(str, df.collect()))
    for _ in range(2):  # overwritten, not added to
        files.write_links_sheet(out.coalesce(1), path, rows_per_file=1)
        assert key(files.read_links_sheet(spark, path)) == key(out.fillna("").select("id", "saved", "url", "domain", "title", "description", "tags", "note", "status"))
    assert len(list((tmp_path / "sheet").glob("*.csv"))) == 2
    assert "2024-01-31 00:00:00" in "".join(p.read_text() for p in (tmp_path / "sheet").glob("*.csv"))
    candidates = merges.label_candidates(links, link_tags, tags)
    files.write_label_candidates(candidates, str(tmp_path / "labels"))
    got = spark.read.schema(candidates.schema).json(str(tmp_path / "labels"))
    assert key(got) == key(candidates) and got.count() == 1


def test_timing_log_gates(spark, tmp_path):
    lines = ['{"outcome": "saved", "ms": 100}', '{"outcome": "duplicate", "ms": 300.5}', '{"outcome": "failed", "ms": 9000}', '{"outcome": "saved", "ms": "fast"}', "not json", '{"outcome": "saved"}']
    (tmp_path / "log").write_text("\n".join(lines))
    report, broken = files.read_timing_log(spark, str(tmp_path / "log"))
    assert broken.first()[0] == 3 and {r["class"]: (r.n, r.max, r.over_budget) for r in report.collect()} == {"saved": (2, 300.5, 0), "failed": (1, 9000.0, 1)}
    files.timing_gate(report)
    with pytest.raises(RuntimeError, match="1 of 2"):
        files.timing_gate(files.read_timing_log(spark, str(tmp_path / "log"), budget_ms=200)[0])
    (tmp_path / "bad").write_text(lines[2])
    with pytest.raises(RuntimeError, match="no save"):
        files.timing_gate(files.read_timing_log(spark, str(tmp_path / "bad"))[0])
