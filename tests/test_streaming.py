import json

from roadweave.streaming.status import apply_reports, follow, read_reports


def test_reports_mark_sections(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"section_id": i, "collected_at": f"2024-01-0{i}T00:00:00Z"} for i in (1, 2)]
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in [*rows, rows[0], {"section_id": None, "collected_at": None}]))
    seen = []
    follow(read_reports(spark, str(folder)), str(tmp_path / "ck"), lambda df: seen.extend(r["section_id"] for r in df.collect())).awaitTermination()
    assert sorted(x for x in seen if x is not None) == [1, 2]
    sections = spark.createDataFrame([(1, False), (2, True), (3, False)], "section_id long, collected boolean")
    reports = spark.createDataFrame([(i, None) for i in [*seen, 9]], "section_id long, collected_at timestamp")
    assert [tuple(r) for r in apply_reports(sections, reports).orderBy("section_id").collect()] == [(1, True), (2, True), (3, False)]
