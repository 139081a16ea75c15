"""Gold citations, coherence, grouped intervals, prefixes, remaining text and nested documents at their edges."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import coherence, evaluate, gold, graph
from lexmill.plans.checkpoint import Workspace
from lexmill.sources import nested


def test_citations(spark):
    chunks = [(3, "Procurement Act 2023, s 45(2)", "about frameworks"), (1, "Procurement Act 2023 s 45", "maximum term"), (2, "Guidance: Frameworks", "open frameworks and dynamic markets"), (4, None, "no citation but markets"), (5, "Procurement Act 2023 s 7", "x"), (6, "", "")]
    asked = [("a", "Procurement Act 2023, Section 45"), ("b", "dynamic markets guide"), ("c", "zzzz yyyy"), ("d", None), ("e", "; ."), ("f", "ACT 202"), ("g", "Procurement Act 2023 s 45 and more that nobody has"), ("a", "Procurement Act 2023, Section 45")]
    got = {r.key: (r.status, r.id, r.n_candidates) for r in gold.resolve(spark.createDataFrame(asked, "key string, citation string"), spark.createDataFrame(chunks, "id long, citation string, text string")).collect()}
    assert got == {"a": ("MATCHED", 1, 2), "b": ("FUZZY_MATCHED", 2, None), "c": ("UNRESOLVED", None, None), "d": ("UNRESOLVED", None, None), "e": ("UNRESOLVED", None, None), "f": ("MATCHED", 1, 3), "g": ("MATCHED", 1, 2)}
    none = spark.createDataFrame([], "key string, citation string")
    assert gold.resolve(none, spark.createDataFrame(chunks, "id long, citation string, text string")).count() == 0


def test_random_pairs_are_even_and_different(spark):
    nodes = spark.range(20)
    got = coherence.random_pairs(nodes, 4000, "x", Workspace(spark, "draws")).collect()
    assert len(got) > 3990 and all(r.a != r.b for r in got)
    for side in "ab":
        n = np.bincount([r[side] for r in got], minlength=20)
        assert n.min() > 140 and n.max() < 265  # 200 each
    assert coherence.random_pairs(nodes.where("id = 1"), 10, "x", Workspace(spark, "draws")).count() == 0


def test_components_against_all_pairs(spark):
    rnd = random.Random(1)
    topics = [(i, rnd.sample("abcdef", rnd.randint(0, 4))) for i in range(150)]
    members = [(c, i) for i in range(150) for c in [("big" if i < 60 else f"c{i % 40}")]]
    t = dict(topics)
    got = {r.component: (r["size"], r.pairs, r["mean"]) for r in coherence.of_components(spark.createDataFrame(members, "component string, node long"), spark.createDataFrame(topics, "id long, topics array<string>"), pairs=100).collect()}
    want = {}
    for c in {c for c, _ in members}:
        own = [i for x, i in members if x == c]
        some = [set(t[i]) for i in own if t[i]]
        p = [len(a & b) / len(a | b) for k, a in enumerate(some) for b in some[k + 1 :]][:100]
        if len(own) >= 3 and p:
            want[c] = (len(own), len(p), round(sum(p) / len(p), 6))
    assert got.keys() == want.keys() and all(got[c][:2] == want[c][:2] and abs(got[c][2] - want[c][2]) < 2e-6 for c in want)


def test_grouped_bootstrap_is_near_the_drawn_one(spark):
    rnd = np.random.default_rng(0)
    groups = {g: list(rnd.normal(0.3, 1, rnd.integers(1, 4))) for g in range(80)}
    d = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [(999, None)], "`group` long, delta double")
    got = evaluate.grouped_bootstrap(d, 2000).first()
    means = np.array([np.mean(x) for x in groups.values()])
    low, high = np.quantile(rnd.choice(means, (4000, 80)).mean(1), [0.025, 0.975])
    assert got.n_groups == 80 and abs(got.delta - means.mean()) < 1e-6 and abs(got.low - low) < 0.05 and abs(got.high - high) < 0.05
    assert (got.wins, got.losses, got.ties) == ((means > 0).sum(), (means < 0).sum(), 0)
    none = evaluate.grouped_bootstrap(d.where("false"), 50).first()
    assert (none.n_groups, none.delta, none.low, none.wins, none.ties, none.p) == (0, None, None, 0, 0, 1.0)
    same = evaluate.grouped_bootstrap(d.where("delta is not null").withColumn("delta", F.lit(0.0)), 50).first()
    assert (same.low, same.high, same.ties, same.p) == (0.0, 0.0, 80, 1.0)


def test_longest_start(spark):
    held = spark.createDataFrame([("http://a/",), ("http://a/b",), ("",), (None,), ("http://a/b",), ("x",)], "p string")
    keys = spark.createDataFrame([("http://a/bc", 1), ("http://a/", 2), ("http://", 3), (None, 4), ("x", 5), ("", 6)], "k string, n int")
    assert {r.n: r.found for r in graph.longest_start(keys, "k", held, "p").collect()} == {1: "http://a/b", 2: "http://a/", 3: None, 4: None, 5: "x", 6: None}
    assert {r.found for r in graph.longest_start(keys, "k", held.where("false"), "p").collect()} == {None}


def test_exclusive_text(spark):
    rows = [("a  b c b", ["b"], "a c b"), ("a b", [], "a b"), ("a b", None, "a b"), ("a b", ["x"], ""), ("one two three", ["two", "one", "two"], "three"), (None, ["x"], ""), ("a", ["", None], ""), ("a", ["a"], " ")]
    got = [r[0] for r in spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(rows)], "i int, t string, c array<string>").orderBy("i").select(T.exclusive_text(F.col("t"), F.col("c"))).collect()]
    assert got == [w.strip() for _, _, w in rows]


def test_nested_text(spark):
    deep = "leaf"
    for i in range(7):
        deep = {"k": [deep, i]} if i % 2 else [deep, None, True]
    rows = [(1, json.dumps({"b": ["x", {"image": "no", "Image_URL": ["no"], "z": "y"}], "a": 3, "api_url": {"t": "no"}, "c": deep})), (2, '"only"'), (3, "[]"), (4, None), (5, "not json"), (6, "[]"), (6, '["twice"]')]
    d = spark.createDataFrame(rows, "id long, j string").where("id < 6")
    assert {r.id: r.text for r in nested.strings(d, "id", F.col("j")).collect()} == {1: "x y leaf", 2: "only", 3: "", 4: "", 5: ""}
    assert nested.strings(d.where("false"), "id", F.col("j")).count() == 0


def test_killed_stream_appends_once(spark, tmp_path, monkeypatch):
    """A run that ends between writing and publishing, and one that ends after publishing, leave each row once when they are started again."""
    from lexmill.sources import store

    source, table, schema = tmp_path / "in", str(tmp_path / "table"), "i long"
    for k in range(4):
        spark.range(10 * k, 10 * k + 10).select(F.col("id").alias("i")).coalesce(1).write.mode("append").parquet(str(source))
    publish, append, calls = store.publish, store.append, []

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = store.sink(stream, table, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:
            return False
        return True

    def lost(*a):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost before publishing")
        return publish(*a)

    monkeypatch.setattr(store, "publish", lost)
    assert not run() and store.read(spark, table, schema).count() == 10
    monkeypatch.setattr(store, "publish", publish)

    def late(df, path, name):
        append(df, path, name)
        if name == "batch-2":
            raise RuntimeError("lost after publishing")

    monkeypatch.setattr(store, "append", late)
    assert not run() and store.read(spark, table, schema).count() == 30
    monkeypatch.setattr(store, "append", append)
    assert run() and sorted(r.i for r in store.read(spark, table, schema).collect()) == list(range(40))


def test_reload_is_seen_whole(spark, tmp_path):
    from lexmill.sources import store

    path = str(tmp_path / "t")
    assert store.read(spark, path, "id long").count() == 0
    store.replace(spark.range(5), path)
    old = store.read(spark, path, "id long")
    store.replace(spark.range(7), path)
    assert (old.count(), store.read(spark, path, "id long").count()) == (5, 7)
    n, folders = store.current(spark, path)
    (tmp_path / "t" / "_manifest" / str(n + 1)).write_text("half")  # a writer that was lost
    assert store.current(spark, path) == (n, folders)
    assert store.append(spark.range(2), path, "more") and not store.append(spark.range(2), path, "more") and store.read(spark, path, "id long").count() == 9
    try:
        store.publish(spark, path, n, [])
        raise AssertionError("two writers")
    except store.ChangedMeanwhile:
        pass


def test_statute_records(spark):
    from lexmill.sources import statute_records

    clml = """<Legislation xmlns="http://x"><Part><Number>Part 1</Number><Title>T</Title><P1 id="section-1"><Pnumber>1</Pnumber><P1para>see <Citation URI="http://law/id/2#a">Act 2</Citation><P2><Pnumber>(2)</Pnumber>b <Citation URI="../y">y</Citation></P2><P2>c</P2></P1para></P1>
    <P1><Pnumber>1</Pnumber>again</P1></Part><Commentary id="c1">amended</Commentary><UnknownEffects/><Effect Type="repealed" Year="2020"/></Legislation>"""
    d = spark.createDataFrame([("d", clml, "http://base/z/"), ("e", "<a>", None), ("f", None, None), ("g", "<html/>", None), ("h", "<act><section/></act>", None)], "id string, xml string, url string")
    p = statute_records.parse(d, "id", "xml", "url")
    assert sorted(r.id for r in p.where("nodes is null").collect()) == ["e", "f", "g"]
    n = [(r.node_id, r.parent_id, r.node_type, list(r.path), r.sibling, r.depth) for r in statute_records.records_of(p.where("id = 'd'"), "id", "nodes").orderBy("place").collect()]
    assert n == [
        ("d__part__Part_1", None, "part", [1], 1, 0), ("d__section-1", "d__part__Part_1", "section", [1, 1], 1, 1), ("d__subsection__2", "d__section-1", "subsection", [1, 1, 1], 1, 2),
        ("d__subsection__1_1_2", "d__section-1", "subsection", [1, 1, 2], 2, 2), ("d__section__1", "d__part__Part_1", "section", [1, 2], 2, 1),
    ]
    refs = [(r.reference_id, r.anchor, r.page, r.fragment) for r in statute_records.records_of(p, "id", "refs").collect()]
    assert refs == [
        ("d__part__Part_1__REF_0001", "Act 2", "http://law/id/2", "a"), ("d__section-1__REF_0001", "Act 2", "http://law/id/2", "a"),
        ("d__part__Part_1__REF_0002", "y", "http://base/y", None), ("d__section-1__REF_0002", "y", "http://base/y", None), ("d__subsection__2__REF_0001", "y", "http://base/y", None),
    ]
    assert [(r.element, r.eid, r.text) for r in statute_records.records_of(p, "id", "annotations").collect()] == [("commentary", "c1", "amended")]
    assert [(r.element, dict(r.attributes), r.text) for r in statute_records.records_of(p, "id", "effects").collect()] == [("effect", {"type": "repealed", "year": "2020"}, None)]


def test_assessment_of_chunks(spark):
    from lexmill.operators import quality

    long = "word " * 90
    rows = [
        (1, None, "x", "t", "s", ["a"], ["b"], 1, "EMPTY_TEXT", ""),
        (2, long + "ends", "goes on", "t", "word ends", ["a"], ["b"], 1, "SEVERED_SENTENCE", "BELOW_PREFERRED_BAND"),
        (3, long + "ends", "(a) item", "t", "other", [], None, 1, "", "UNTERMINATED_TAIL+BELOW_PREFERRED_BAND+NO_TOPICS+NO_LEGAL_CONCEPTS+SUMMARY_LOW_GROUNDING"),
        (4, long + "in section 5, or", None, "", None, ["a"], ["b"], 1, "SEVERED_ENUMERATION+NO_TITLE+NO_SUMMARY", "UNTERMINATED_TAIL+BELOW_PREFERRED_BAND"),
        (5, "(b) " + long + "these:", "A", "t", "word", ["a"], ["b"], 2, "SEVERED_LIST_STEM+ORPHAN_LIST_ITEM", "UNTERMINATED_TAIL+BELOW_PREFERRED_BAND"),
        (6, "Short.", None, "t", "short", ["a"], ["b"], None, "TOO_SMALL_TO_RETRIEVE", ""),
        (7, "word " * 1000 + "end.", None, "t", "word", ["a"], ["b"], 1, "", "ABOVE_PREFERRED_BAND"),
    ]
    d = quality.assess(spark.createDataFrame([r[:8] for r in rows], "id int, text string, after string, title string, summary string, topics array<string>, concepts array<string>, ordinal int"))
    got = {r.id: ("+".join(r.defects), "+".join(r.advisories)) for r in d.collect()}
    assert got == {r[0]: r[8:] for r in rows}
    t = quality.table(d.withColumn("m", F.when(F.col("id") > 3, "a")), "m").collect()
    assert {r.m: (r.chunks, r.clean, r.defects) for r in t} == {"UNKNOWN": (3, 1, 2), "a": (4, 1, 6)}


def test_static_metrics(spark):
    from lexmill.operators import benchmark_metrics, filters

    runs = spark.createDataFrame([("a", 1, 10, 1), ("a", 1, 11, 2), ("a", 1, 12, 3), ("b", 1, 13, 1), ("a", 3, 10, 1)], "config string, query int, id int, rank int")
    qrels = spark.createDataFrame([(1, 10, 1, ["x"], False, True), (1, 11, 3, ["x"], True, False), (1, 12, None, ["y"], None, None)], "query int, id int, grade int, supports array<string>, binding boolean, applicable boolean")
    needs = spark.createDataFrame([(1, "x", 3, "binding_rule"), (1, "y", 2, "guidance"), (2, "x", 3, "guidance")], "query int, requirement string, threshold int, role string")
    got = {(r.config, r["query"]): r for r in benchmark_metrics.per_scenario(runs, qrels, needs).collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}  # query 3 is no scenario
    r, dcg = got["a", 1], 1 + 7 / np.log2(3)
    assert abs(r.ndcg10 - dcg / (7 + 1 / np.log2(3))) < 1e-4 and (r.results, r.unjudged, r.hit10, r.mrr, r.coverage5, r.complete10, r.authority_first, r.regime_error) == (3, 1, 1, 0.5, 0.5, 0, 0, 1)
    r = got["b", 1]
    assert (r.ndcg10, r.unjudged, r.hit10, r.mrr, r.authority_first, r.regime_error) == (0.0, 1, 0, 0.0, None, 0)
    r = got["a", 2]
    assert (r.results, r.ndcg10, r.coverage10, r.authority_first) == (0, None, 0.0, None)
    d = spark.createDataFrame([(1, None), (2, "EU"), (3, "UK")], "i int, j string")
    assert [r.i for r in d.where(filters.allowed(F.col("j"), "EU")).collect()] == [1, 3] and d.where(filters.allowed(F.col("j"))).count() == 3
