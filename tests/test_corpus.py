"""Bundles against brute force, the search loop, XML and paged text."""

import random
from itertools import combinations

import pytest

from lexmill.operators import bundles, controller
from lexmill.sources import paged, statutes


def greedy(items, k, budget):
    taken, covered, used = [], set(), 0
    for quota in (True, False):
        while len(taken) < k:
            fits = [x for x in items if x not in taken and used + x[2] <= budget and (not quota or sum(t[1] == x[1] for t in taken) < ((k + 1) // 2 if x[1] == bundles.LAW else k // 2))]
            if not fits:
                break
            best = max(fits, key=lambda x: (len(set(x[3]) - covered), -x[0]))
            taken.append(best)
            covered, used = covered | set(best[3]), used + best[2]
    return [x[0] for x in taken if x[1] == bundles.LAW] + [x[0] for x in taken if x[1] != bundles.LAW]


def made(seed):
    r = random.Random(seed)
    return [(i, r.choice([bundles.LAW, bundles.OTHER]), r.randint(0, 90), [f"R{x}" for x in r.sample(range(5), r.randint(0, 3))]) for i in range(r.randint(1, 9))]


def test_assemble_takes_the_greedy_choice(spark):
    sets = {q: made(q) for q in range(12)}
    df = spark.createDataFrame([(q, *x) for q, xs in sets.items() for x in xs], "query int, rank long, lane string, chars long, supports array<string>")
    got = {}
    for r in bundles.assemble(df, 4, 150).orderBy("query", "place").collect():
        got.setdefault(r.query, []).append(r.rank)
    assert got == {q: want for q, xs in sets.items() if (want := greedy(xs, 4, 150))}
    with pytest.raises(ValueError):
        bundles.assemble(df, 0)


def test_coverage_bound_is_the_best_subset(spark):
    sets = {q: made(q) for q in range(12)}
    df = spark.createDataFrame([(q, *x) for q, xs in sets.items() for x in xs], "query int, id long, lane string, chars long, supports array<string>")
    wanted = spark.createDataFrame([(q, f"R{i}") for q in range(13) for i in range(4)], "query int, requirement string")
    got = {r.query: (-r.covered, r["items"], r.chars) for r in bundles.coverage_bound(df, wanted, 2, 120).collect()}
    for q in range(13):
        subsets = (s for n in range(3) for s in combinations(sets.get(q, []), n) if sum(x[2] for x in s) <= 120)
        assert got[q] == min((-len({n for x in s for n in x[3]} - {"R4"}), len(s), sum(x[2] for x in s)) for s in subsets)


def test_search_loop_stops():
    hit = [{"chunk_id": "a", "text": "section 4 applies"}]
    run = lambda said, plan=lambda q: ["first"], n=3: controller.investigate("why", lambda q: hit, plan, said, n)
    assert run(lambda q, e: {"sufficient": True}).stop == "SUFFICIENT"
    assert run(lambda q, e: {}).stop == "NO_ACTION"
    assert run(lambda q, e: {"next_query": "First!"}).stop == "REPEATED_QUERY"
    assert run(lambda q, e: {"next_query": "what of section 9"}).stop == "INVALID_QUERY"
    assert run(lambda q, e: {}, lambda q: 1 / 0).stop == "PLAN_FAILED"
    names = iter(["section 4", "other", "more", "last"])
    out = run(lambda q, e: {"next_query": next(names)})
    assert (out.stop, out.queries, len(out.evidence)) == ("OPERATION_LIMIT", ["first", "section 4", "other"], 1)


def test_statutes():
    rows = statutes.nodes("d", "<Legislation><Part><Number>Part I</Number><Title>T</Title><P1group><Title>H</Title><P1><Pnumber>1</Pnumber><P1para>a <P2><Pnumber>(2)</Pnumber>b</P2> c</P1para></P1></P1group></Part></Legislation>")
    assert [r[1:] for r in rows] == [("CLML", 1, "d__part-Part I", None, 0, "part", "Part I", "T", "a b c"), ("CLML", 2, "d__section-1", "d__part-Part I", 1, "section", "1", "H", "a b c"), ("CLML", 3, "d__subsection-2", "d__section-1", 2, "subsection", "2", None, "b")]
    assert statutes.nodes("d", "<a>") == statutes.nodes("d", None) == statutes.nodes("d", "<html/>") == []


def test_paragraphs_cross_pages(spark):
    pages = spark.createDataFrame([(1, 1, "Head 1\nOne two\nthree-\n"), (1, 2, "Head 2\nfour ends.\nNext"), (1, 3, "Head 3\nlast."), (2, 1, None)], "doc int, page int, text string")
    lines = paged.page_lines(pages, "doc", "page")
    heads = paged.furniture(lines, pages, "doc")
    assert [tuple(r) for r in heads.collect()] == [(1, "Head #", 3)]
    got = [tuple(r) for r in paged.paragraphs(lines, heads, "doc", "page").orderBy("paragraph").collect()]
    assert got == [(1, 1, 1, 2, "One two threefour ends."), (1, 2, 2, 3, "Next last.")]


def test_locator_parts_keep_their_digits(spark):
    from pyspark.sql import functions as F

    from lexmill.functions.text import locator_parts

    df = spark.createDataFrame([("7(0)(1)( 2 )(x)",), ("83B(5)(b)(i)",), ("",)], "s string")
    assert [r[0] for r in df.select(locator_parts(F.col("s"))).collect()] == [["7", "0", "1", "2", "x"], ["83B", "5", "b", "i"], []]
