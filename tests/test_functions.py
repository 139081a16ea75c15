"""Text functions, readers, small operators and the adaptive loop, one case each at least."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import chunking, controller, tables
from lexmill.sources import html, readers
from lexmill.streaming import journal
from tests.conftest import SF


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "column, want",
    [
        (lambda: T.repair(F.lit("a wrapped,\nline  of\ttext\n\n\n\nNext")), "a wrapped, line of text\n\nNext"),
        (lambda: T.citation_key(F.lit("Section 12(3), Schedule 4.")), "s 12 3 sch 4"),
        (lambda: T.locators(F.lit("see Section 5(2) and regulation 7A, section 5(2)")), ["regulation 7a", "section 5(2)"]),
        (lambda: T.ancestors(F.lit("a-b-c")), ["a-b", "a"]),
        (lambda: T.ancestors(F.lit("a")), []),
        (lambda: T.safe_id(F.lit(" a/b c.pdf ")), "a_b_c.pdf"),
        (lambda: T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))), 1 / 3),
        (lambda: T.regime(F.lit("PA2023 text")), "PA2023"),
        (lambda: T.embedding_text(F.lit("s 1"), F.lit("A > B"), F.lit("T"), F.lit("x [[LINK_0001]] y")), "s 1\nA > B\nT\n\nx y"),
        (lambda: T.instrument_url(F.lit("https://www.legislation.gov.uk/ukpga/2023/54/contents#x")), "legislation.gov.uk/ukpga/2023/54"),
        (lambda: html.structured_text(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("level"), F.lit(t).alias("text")) for k, v, t in (("h2", 2, "H"), ("li", 0, "i"), ("blockquote", 0, "q"), ("p", 0, "p"))))), "## H\n- i\n> q\np"),
    ],
)
def test_text_functions(spark, column, want):
    got = value(spark, column())
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_updates_of_a_page(spark):
    got = value(spark, html.updates(F.lit("Updates\n3 March 2024: Added a form.\n12 June 2025 - Closed.")))
    assert [(u.date_text, u.note) for u in got] == [("3 March 2024", "Added a form."), ("12 June 2025", "Closed.")]


def test_placeholders_in_blocks_and_sections(spark):
    page = "<h1>A</h1><p>see <a href='u.pdf'>this</a> now</p><h2>B</h2><p>b</p><h1>C</h1><p>c</p>"
    d = html.parse_pages(spark.createDataFrame([(1, page)], "page_id long, html string"), marked=True)
    b = d.select("page_id", F.posexplode("blocks").alias("pos", "b")).select("page_id", "pos", "b.*")
    assert [r.text for r in b.orderBy("pos").collect()] == ["A", "see this [[LINK_0001]] now", "B", "b", "C", "c"]
    assert [r.text for r in html.section_of(b, "page_id", "pos", "A").orderBy("pos").collect()] == ["A", "see this [[LINK_0001]] now", "B", "b"]


def test_readers(spark, tmp_path):
    kind = readers.source_kind(spark.createDataFrame([("a", "x.xml"), ("b", "p.pdf"), ("b", "i.html"), ("c", "n.txt")], "folder string, name string"))
    assert {(r.folder, r.kind) for r in kind.collect()} == {("a", "LEGISLATION"), ("b", "HTML"), ("c", "NONE")}
    s = spark.sql("select array(named_struct('id', 'g', 'sources', array('u', 'v'))) as groups")
    assert [(r.group_id, r.source) for r in readers.seeds(s).collect()] == [("g", "u"), ("g", "v")]
    assert readers.canonical_json(spark.createDataFrame([(2, "x")], "b int, a string")).first().value == '{"a":"x","b":2}'
    readers.write_qrels(spark.createDataFrame([("q", "d", 3)], "query string, id string, grade int"), f"file://{tmp_path}/qrels")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/qrels").collect()] == ["q 0 d 3"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x.txt").write_text("abc")
    m = readers.manifest(spark, f"file://{tmp_path}/f").first()
    assert (m.bytes, m.sha256) == (3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")


def test_upsert_takes_the_last(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, n int, v string")
    assert {(r.k, r.v) for r in tables.upsert(d, ["k"], "n").collect()} == {(1, "b"), (2, "c")}


def test_windowed_counts_of_a_stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = journal.per_window(stream, late="0 seconds").writeStream.format("memory").queryName("windows_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.start, r.event_type): r.n for r in journal.per_window(e).collect()}
    got = {(r.start, r.event_type): r.n for r in spark.table("windows_out").collect()}
    assert got and got.items() <= want.items()


def test_provision_windows(spark):
    text = "".join(f"{i} Of things\n" + "word " * (20 + 5 * i) + "\n\n" for i in range(1, 12)) + "x" * 900
    d = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc long, text string")
    rows = chunking.provision_windows(d, "doc", target=200, most=400).orderBy("window").collect()
    assert "".join(r.text for r in rows) == text and max(len(r.text) for r in rows) <= 400 and {r.doc for r in rows} == {1}
    assert sum(r.text.lstrip()[:1].isdigit() for r in rows) >= 8


def item(i, **more):
    return {"chunk_id": i, "text": f"text of {i}", **more}


def test_adaptive_loop():
    found = {"why": [item("a", canonical_ids=["n1"])], "more": [item("b"), item("b")], "other": [item("a")], "third": [item("b")]}
    backend = controller.replay(found, {"n1": [item("c")]})
    run = lambda said, plan=lambda q: [], n=3, b=backend: controller.adaptive("why", [], b, plan, said, n)
    act = lambda **x: {"issues": {"I1": "PARTIAL"}, "next_action": x}
    assert run(lambda s: {"issues": {"I1": "FULL"}}).stop == "ESTIMATED_COVERAGE_COMPLETE"
    assert run(lambda s: act(type="STOP")).stop == "CONTROLLER_STOP"
    assert run(lambda s: act(type="SEARCH", query="why", graph=True)).stop == "REPEATED_ACTION"
    assert run(lambda s: act(type="SEARCH", query="unknown")).stop == "INVALID_ACTION_OR_TOOL_ERROR"
    assert run(lambda s: act(type="EXPAND", query="x", target_anchor="n9")).stop == "INVALID_ACTION_OR_TOOL_ERROR"
    steps = iter([act(type="EXPAND", query="x", target_anchor="n1"), act(type="SEARCH", query="more"), act(type="STOP")])
    out = run(lambda s: next(steps))
    assert (out.stop, [e["chunk_id"] for e in out.bundle], [o["new"] for o in out.operations]) == ("BUDGET_EXHAUSTED", ["a", "c", "b"], [1, 1, 1])
    steps = iter([act(type="SEARCH", query="more"), act(type="SEARCH", query="other"), act(type="SEARCH", query="third"), act(type="STOP")])
    assert run(lambda s: next(steps), n=5).stop == "NO_NEW_EVIDENCE"
    out = run(lambda s: 1 / 0, lambda q: ["more"])
    assert (out.stop, len(out.errors), [e["chunk_id"] for e in out.acquired]) == ("CONTROLLER_STOP", 2, ["a", "b"])
    out = run(lambda s: act(type="STOP"), lambda q: 1 / 0)
    assert out.errors and out.acquired and run(lambda s: act(type="EXPAND", query="x", target_anchor="n1"), b=controller.replay(found)).stop == "INVALID_ACTION_OR_TOOL_ERROR"
    with pytest.raises(ValueError):
        run(lambda s: {}, n=9)
