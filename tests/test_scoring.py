"""Metrics, audits, answers and links at their edges."""

import pytest
from pyspark.errors import PySparkException

from lexmill.operators import linking, retrieve, scoring, search

RANKED = "query string, id string, rank int, authority string, sha string"
QRELS = "query string, id string, grade int, applicability string, status string, sha string"
SUPPORTS = "query string, id string, requirement string, support string"
SPEC = "query string, requirement string, policy string, mandatory boolean, allow_conditional boolean"
WANTED = [("s", "R1", "BINDING_REQUIRED", True, False), ("s", "R2", "OFFICIAL_ALLOWED", True, False)]


def score(spark, ranked, qrels, supports, k=10, spec=WANTED):
    frames = (spark.createDataFrame(r, t) for r, t in ((ranked, RANKED), (qrels, QRELS), (supports, SUPPORTS), (spec, SPEC)))
    return scoring.evaluate_ranking(*frames, k=k).first()


def row(i, rank, authority="PRIMARY_LEGISLATION", sha="h"):
    return ("s", i, rank, authority, sha)


def label(i, grade, applicability="APPLICABLE", status="TEST_FIXTURE", sha="h"):
    return ("s", i, grade, applicability, status, sha)


def test_coverage_by_support_role_and_parts(spark):
    x = score(spark, [row("a", 1)], [label("a", 2)], [("s", "a", "R1", "PARTIAL")], 1)
    assert (x.requirement_coverage, x.hit_ge2, x.scenario_complete) == (0, 1, 0)
    x = score(spark, [row("a", 1, "OFFICIAL_GOVERNMENT_GUIDANCE")], [label("a", 3)], [("s", "a", "R2", "FULL")])
    assert (x.requirement_coverage, x.official_requirement_coverage, x.binding_requirement_coverage) == (0.5, 1, 0)
    x = score(spark, [row("a", 1, "OFFICIAL_GOVERNMENT_GUIDANCE")], [label("a", 3)], [("s", "a", "R1", "FULL")])
    assert (x.content_coverage, x.requirement_coverage) == (0.5, 0)
    x = score(spark, [row("a", 1), row("b", 2)], [label("a", 3), label("b", 3)], [("s", "a", "R1", "FULL"), ("s", "b", "R2", "FULL")])
    assert (x.scenario_complete, x.mrr_first_sufficient) == (1, 1)


def test_grades_and_applicability(spark):
    x = score(spark, [row("a", 1)], [label("a", 1), label("b", 3)], [("s", "a", "R1", "NONE")], 1)
    assert x.pooled_ndcg == pytest.approx(1 / 7, abs=1e-6)
    x = score(spark, [row("a", 1)], [label("a", 0, "INAPPLICABLE")], [("s", "a", "R1", "FULL")])
    assert (x.pooled_ndcg, x.inapplicable_fraction_returned, x.content_coverage) == (None, 1, 0)
    x = score(spark, [], [label("a", 3)], [("s", "a", "R1", "FULL")])
    assert (x.returned, x.requirement_coverage, x.inapplicable_fraction_returned) == (0, 0, None)
    x = score(spark, [row("a", 1)], [label("a", 3, "CONDITIONAL")], [("s", "a", "R1", "FULL")], spec=[("s", "R1", "BINDING_REQUIRED", True, True)])
    assert x.requirement_coverage == 1


@pytest.mark.parametrize(
    "ranked, qrels, fault",
    [
        ([row("a", 1)], [label("b", 1)], "UNJUDGED"),
        ([row("a", 1)], [label("a", 1, status="PENDING")], "UNJUDGED"),
        ([row("a", 1)], [label("a", 1, sha="old")], "STALE_TEXT"),
        ([row("a", 1), row("a", 2)], [label("a", 1)], "DUPLICATE_ID"),
        ([row("a", 1)], [label("a", 1), label("a", 1)], "DUPLICATE_LABEL"),
        ([row("a", 1)], [label("a", 9)], "INVALID_GRADE"),
    ],
)
def test_faulty_rankings_are_errors(spark, ranked, qrels, fault):
    with pytest.raises(PySparkException, match=fault):
        score(spark, ranked, qrels, [("s", "a", "R1", "FULL")])


def test_pool_refuses_two_texts_of_one_id(spark):
    runs = [("q", "static", "a", 1, "h"), ("q", "adaptive", "a", 1, "h"), ("q", "adaptive", "b", 2, "i")]
    kind = "query string, system string, id string, rank int, sha string"
    assert {(r.id, r.systems) for r in scoring.pool(spark.createDataFrame(runs, kind)).collect()} == {("a", "adaptive+static"), ("b", "adaptive")}
    with pytest.raises(PySparkException, match="two texts"):
        scoring.pool(spark.createDataFrame([*runs, ("q", "static", "b", 3, "other")], kind)).collect()


def test_answers(spark):
    e = spark.createDataFrame([("x", "E1", "The contracting authority must publish a notice."), ("x", "E2", "Other words entirely here.")], "answer string, id string, text string")
    good = "The authority must publish a notice [E1]. It says \"must publish a notice\" [E1] in plain words [E1]."
    texts = [("x", good), ("x", "No citation stands in this long sentence at all."), ("x", "An item that is not there is cited here [E9]."), ("x", "It says \"entirely invented wording\" [E1] as it seems [E1].")]
    got = [tuple(r)[1:] for t in texts for r in scoring.verify(spark.createDataFrame([t], "answer string, text string"), e).collect()]
    assert got[0][-2:] == (True, True) and got[1][-2:] == (False, False) and got[2][-2:] == (True, False) and got[3][-3:] == (1, True, False)


def test_rollup_cases(spark):
    node = lambda *xs: spark.createDataFrame([(x,) for x in xs], "node string")
    edges = spark.createDataFrame([("d-1", "d-2"), ("d-1", "d-2-3"), ("d-2-1", "d-2-9"), ("d-1", "x-1")], "source string, target string")
    got = {(r.source, r.target): (r["to"], r.resolution, r.start) for r in linking.densify(edges, node("d-1", "d-2"), node(), node()).collect()}
    assert got == {("d-1", "d-2"): ("d-2", "DIRECT", "d-1"), ("d-1", "d-2-3"): ("d-2", "NEAREST_ANCESTOR_ROLLUP", "d-1"), ("d-2-1", "d-2-9"): (None, "SELF_LOOP", "d-2"), ("d-1", "x-1"): (None, "UNRESOLVABLE", "d-1")}


def test_rows_without_effect_take_their_places(spark):
    hits = spark.createDataFrame([("q", i, i) for i in range(1, 5)], "query string, id long, rank long")
    live = spark.createDataFrame([(2, "OTHER", None, None), (4, "PRIMARY_LEGISLATION", None, None)], "id long, authority string, regime string, jurisdiction string")
    got, trace = search.search({"lexical": hits}, live)
    assert [(r.id, r["rank"]) for r in got.orderBy("rank").collect()] == [(2, 1), (4, 2)]
    assert {(r.stage, r.n) for r in trace.collect()} == {("lexical", 4), ("fused", 4), ("live", 2)}


def test_repeated_keys_are_errors(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    assert scoring.unique_index(d, ["k", "v"]).count() == 2
    with pytest.raises(PySparkException, match="repeated key"):
        scoring.unique_index(d, ["k"]).collect()


def test_unions_of_the_search_claim_no_partitioning(spark):
    def unions(plan):
        own = [plan.outputPartitioning().getClass().getSimpleName()] if plan.nodeName() == "Union" else []
        return own + [x for i in range(plan.children().size()) for x in unions(plan.children().apply(i))]

    spark.conf.unset("spark.sql.unionOutputPartitioning")
    hits = spark.range(40).selectExpr("id % 4 AS query", "id", "CAST(id AS double) AS score")
    live = spark.range(40).selectExpr("id", "'OTHER' AS authority", "CAST(null AS string) AS regime", "CAST(null AS string) AS jurisdiction")
    edges = spark.range(40).selectExpr("id AS source", "(id + 1) % 40 AS target", "0.5D AS confidence")
    _, trace = search.search({"a": retrieve.ranked(hits, "score"), "b": retrieve.ranked(hits.where("id < 20"), "score")}, live, edges)
    found = unions(trace._jdf.queryExecution().sparkPlan())
    planned = unions(trace._jdf.queryExecution().executedPlan().initialPlan())
    assert planned and set(found + planned) == {"UnknownPartitioning"}


def test_search_trace_agrees_each_time(spark):
    import duckdb

    from lexmill.catalog import ORACLES, QUERIES

    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    want = sorted(con.execute(ORACLES["search_trace"]).fetchall())
    for _ in range(5):
        assert sorted((r.query, r.stage, r.n) for r in QUERIES["search_trace"](spark, sf).collect()) == want
