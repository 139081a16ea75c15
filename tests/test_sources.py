"""Readers, the page parser and journals as streams."""

import pytest

from lexmill.sources import html, readers
from lexmill.streaming import journal
from tests.conftest import SF


def test_json_lines_modes(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    path = f"file://{tmp_path}/x.jsonl"
    assert readers.json_lines(spark, f"file://{tmp_path}/none", "a int").count() == 0
    assert sorted(r.a for r in readers.json_lines(spark, path, "a int", "skip").collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed|bad|parse"):
        readers.json_lines(spark, path, "a int", "strict").collect()


def test_page_blocks_links_and_paths(spark):
    page = "<title>T</title><nav><p>no</p></nav><h1>A</h1><p>x <a href='u.pdf'>doc</a></p><h2>B</h2><ul><li>i</li></ul><table><tr><td>1</td><td>2</td></tr></table><h1>C</h1>end"
    r = html.parse_pages(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).collect()
    assert [(b.kind, b.text, b.path) for b in r[0].blocks] == [("h1", "A", ""), ("p", "x doc", "A"), ("h2", "B", "A"), ("li", "i", "A > B"), ("tr", "1 | 2", "A > B"), ("h1", "C", ""), ("p", "end", "C")]
    assert (r[0].title, r[0].links[0].href, r[0].links[0].anchor) == ("T", "u.pdf", "doc") and r[1].blocks == []


def test_journal_stream_drops_repeats(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").limit(200)
    e.unionByName(e).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = journal.deduplicated(stream).writeStream.format("memory").queryName("journal_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("journal_out").count() == 200
