"""Source divergence, centroid clustering and the set join against brute force, and at the edges."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import centroids, divergence, setjoin
from tests.llm.test_llm import CLASH, EDGE, SCHEMA, sets

# --- divergence


def audited(rows, least, top):
    """All of the audit from dictionaries and whole numbers; rows are (lang, source, text)."""
    rows = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for a, b, t in rows]
    docs, total, own, groups = Counter(), Counter(), defaultdict(Counter), {(a, b) for a, b, _ in rows}
    for a, b, w in rows:
        docs.update((a, x) for x in set(w))
        own[a, b].update(w)
    out = set()
    for lang in {a for a, _ in groups}:
        kept = sorted((x for (a, x), n in docs.items() if a == lang and n >= least), key=lambda x: x.encode())
        sources = sorted(b for a, b in groups if a == lang)
        total = {x: sum(own[lang, b][x] for b in sources) for x in kept}
        prob = lambda n, size: 1 + (10**9 * (n + 5)) // (size + 5 * len(kept))  # noqa: B023, E731
        p = {b: {x: prob(own[lang, b][x], sum(own[lang, b][y] for y in kept)) for x in kept} for b in sources}
        q = {x: prob(total[x], sum(total.values())) for x in kept}
        for b in sources:
            pairs = sorted(((-sum(abs(p[b][x] - p[o][x]) for x in kept), o) for o in sources if o != b), key=lambda y: (y[0], y[1].encode()))
            terms = sorted(((q[x] - p[b][x], x) for x in kept if own[lang, b][x] and p[b][x] > q[x]), key=lambda y: (y[0], y[1].encode()))[:top]
            for part, items in (("pair", pairs), ("term", terms)):
                out |= {(lang, b, part, x, -v, i + 1) for i, (v, x) in enumerate(items)}
    return out


def audit_rows(n=300):
    rnd = random.Random(11)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Été", "ÉTÉ", "Word", "word", "x1y", "l'eau", "日本"]
    rows = []
    for i in range(n):
        lang, source = rnd.choice(["en", "en", "en", "de", None]), rnd.choice(["a", "a", "a", "b", "é", "Z", None, ""])
        skew = vocabulary[len(str(source)) + ord(str(source or 'n')[0]) % 5 :: 3]
        rows.append((lang, source, " ".join(rnd.choice(skew if rnd.random() < 0.4 else vocabulary) for _ in range(rnd.randint(0, 60)))))
    return [*rows, ("fr", "only", "nothing here is kept"), ("fr", "other", None), ("it", "alone", ""), ("en", "empty", None)]


@pytest.mark.parametrize("least, top", [(3, 50), (3, 2), (1, 1), (40, 5), (10**6, 5)])
def test_audit_against_brute_force(spark, least, top):
    rows = audit_rows()
    got = divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"), least_docs=least, top=top).collect()
    assert {tuple(r) for r in got} == audited(rows, least, top) and len(got) == len({tuple(r) for r in got})


def test_terms_whose_bound_is_below_the_kth_are_not_evaluated(spark):
    """Of a thousand buckets only those that hold the first terms, or whose bound reaches the kth value, are read."""
    rows = [("en", "a", f"t{i}", i, 1000 + i, 10) for i in range(2, 1002)]
    posted = spark.createDataFrame(rows, "lang string, source string, term string, n long, p long, q long")
    got = divergence.overused(posted, 3)
    assert [(r["item"], r.value) for r in got.orderBy("rank").collect()] == [("t1001", 1991), ("t1000", 1990), ("t999", 1989)]
    tied = posted.withColumn("q", F.lit(0)).withColumn("p", F.lit(7)).withColumn("n", F.lit(1))
    assert [r["item"] for r in divergence.overused(tied, 3).orderBy("rank").collect()] == sorted(f"t{i}" for i in range(2, 1002))[:3]


def test_probabilities_of_large_counts(spark):
    for n, total, terms in ((10**15, 10**17, 10**9), (0, 0, 3), (3, 10, 0)):
        got = spark.range(1).select(divergence.probability(F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(terms).cast("long"))).first()[0]
        assert got == (1 + 10**9 * (n + 5) // (total + 5 * terms) if terms else 0)


def test_audit_edges(spark):
    d = spark.createDataFrame(EDGE, SCHEMA).withColumns({c: F.lit(c) for c in (*CLASH, "term", "p", "q", "docs", "value", "item")})
    assert {tuple(r) for r in divergence.audit(d, least_docs=2).collect()} == audited([(r[2], r[3], r[1]) for r in EDGE], 2, 50)
    assert divergence.audit(d.where("false")).count() == 0


# --- centroids


def lloyd(rows, dims, k, rounds):
    """The same with Python's whole numbers; rows are (id, integers)."""
    rows = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in rows[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), i) for i, m in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in rows:
            own[near(v)[1]].append(v)
        c = [[sum(x) // len(own[i]) for x in zip(*own[i], strict=True)] if own[i] else m for i, m in enumerate(c)]
    found = [(i, *near(v)[::-1]) for i, v in rows]
    inertia = Counter()
    for _, i, d in found:
        inertia[i] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found), key=str)


@pytest.mark.parametrize("spread", [1, 4, 1000])
def test_clusters_against_whole_numbers(spark, spread):
    rnd = random.Random(spread)
    rows = [(i, [rnd.randint(-spread, spread) for _ in range(4)]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (None, [0, 0, 0, 0])]
    d = spark.createDataFrame([(i, [(x + 0.5) / 256 for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(5)
    got = centroids.cluster(d, dims=4, clusters=9, rounds=4).collect()
    assert sorted(map(tuple, got), key=str) == lloyd(rows, 4, 9, 4)


def test_intervals_hold_and_ties_are_exact():
    rnd = np.random.default_rng(2)
    c = rnd.integers(-(1 << 26), 1 << 26, (40, 64))
    x = np.concatenate([c[rnd.integers(0, 40, 500)] + rnd.integers(-2, 3, (500, 64)), rnd.integers(-(1 << 27), 1 << 27, (500, 64)), np.repeat((c[:1] + c[1:2]) // 2, 9, 0)])
    low, high = centroids.intervals(x, c)
    exact = [[sum(int(q) * int(q) for q in m) - 2 * sum(int(p) * int(q) for p, q in zip(v, m, strict=True)) for m in c] for v in x[::25]]
    assert (low[::25].astype(object) <= exact).all() and (high[::25].astype(object) >= exact).all()
    twice = np.concatenate([c, c[::-1], c + (np.arange(64) == 5)])
    best, distance, extra = centroids.assign(x, twice)
    every = [[sum((int(p) - int(q)) ** 2 for p, q in zip(v, m, strict=True)) for m in twice] for v in x[::25]]
    assert best[::25].tolist() == [r.index(min(r)) for r in every] and distance[::25].tolist() == [min(r) for r in every]
    assert extra > len(x)  # pairs that floats can't tell apart


def test_most_pairs_are_settled_by_floats():
    rnd = np.random.default_rng(3)
    _, _, extra = centroids.assign(rnd.integers(-256, 256, (20000, 64)), rnd.integers(-256, 256, (40, 64)))
    assert extra < 0.01 * 20000 * 40


def test_vectors_that_do_not_count(spark):
    good = [0.25] * 64
    rows = [(1, good), (2, None), (3, []), (4, good[:-1]), (5, [*good, 1.0]), (6, [None, *good[1:]]), (7, [math.nan, *good[1:]]), (8, [math.inf, *good[1:]]), (9, [1e30, *good[1:]]), (1, good), (None, [-0.001] * 64)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in (*CLASH, "v", "cluster", "distance", "rows")})
    got = sorted((tuple(r) for r in centroids.cluster(d).select("vec_id", "cluster", "distance").collect()), key=str)
    # both rows of vector 1 are first centroids, equally near to it: the smaller number has them
    zero, one = hashlib.sha256(b"2:").hexdigest(), hashlib.sha256(b"2:1").hexdigest()
    assert got == sorted([(1, 0 if one < zero else 1, 0)] * 2 + [(None, 2 if one < zero else 0, 0)], key=str)
    assert centroids.cluster(d.where("false")).count() == 0 and centroids.cluster(d.where("vec_id between 2 and 9")).count() == 0


# --- set join


def linked(rows, width, percent):
    own = {i: sets(t, width) for i, t in rows}
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(own)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(own[i]), find(i)) for i in ids}


def family_rows(n=260):
    """Chains of edits, so that families have members far from their leaders, short texts, and a passage that many share."""
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(12)]
    rows, live = [], [[f"v{rnd.randint(0, 400)}" for _ in range(rnd.choice([3, 4, 5, 6, 8, 15, 40, 150, 300]))] for _ in range(14)]
    for i in range(n):
        w = list(rnd.choice(live))
        for _ in range(rnd.choice([0, 1, 1, 2, 5])):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 10**6)}"
        if rnd.random() < 0.5:
            live[rnd.randrange(len(live))] = w
        if rnd.random() < 0.2:
            w = w + passage
        rows.append((i, " ".join(w)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "ONE"), (n + 4, "a a a a"), (n + 5, "A a a a a"), (n + 6, "a b a b a"), (n + 7, "a b a b a b"), (n + 8, "a b a b a b a")]


@pytest.mark.parametrize("options", [{"bound": 256}, {"bound": 6, "list_block": 5, "family_block": 300}, {"bound": 0, "list_block": 40, "family_block": 900}])
def test_join_against_all_pairs(spark, options):
    rows = family_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.similar_sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=4, percent=85, **options).collect()}
    assert got == linked(rows, 4, 85)


def test_join_at_other_thresholds(spark):
    rows = family_rows(140)
    for width, percent in ((5, 80), (1, 60)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()}
        assert got == linked(rows, width, percent)


def test_prefixes_lose_no_link():
    """Any two sets that are similar enough share as many tokens of their prefixes as both require."""
    rnd = random.Random(9)
    for _ in range(3000):
        percent = rnd.choice([60, 80, 85, 95, 100])
        a = set(rnd.sample(range(200), rnd.randint(1, 60)))
        b = set(a)
        for _ in range(rnd.randint(0, 6)):
            (b.discard(rnd.choice(sorted(a))) if rnd.random() < 0.5 and len(b) > 1 else b.add(rnd.randint(200, 400)))
        if 100 * len(a & b) >= percent * len(a | b):
            heads = [set(sorted(x)[: int(setjoin.prefix(len(x), percent))]) for x in (a, b)]
            need = [int(setjoin.required(setjoin.overlap(len(x), percent), percent)) for x in (a, b)]
            assert len(heads[0] & heads[1]) >= max(need)


def test_pivots_cover_all_pairs_but_those_of_one_tree():
    rnd = np.random.default_rng(4)
    for n in (1, 2, 13, 60):
        for density in (0.0, 0.02, 0.3, 1.0):
            link = np.triu(rnd.random((n, n)) < density, 1)
            link |= link.T
            root, want = np.arange(n), np.arange(n)
            for i, js in setjoin.pivots(root):
                for j in js[link[i, js]]:
                    root[root == root[j]] = root[i]
            for _ in range(n):
                want = np.minimum(want, np.where(link, want[None, :], n).min(1, initial=n))
            assert [np.flatnonzero(root == r)[0] for r in root] == want.tolist()


def test_the_boundary_goes_with_the_cost(spark):
    few = spark.createDataFrame([(bytes([i]), 20, [1, 2, 3]) for i in range(200)], "k binary, n long, r array<long>")
    assert setjoin.boundary(few) > 0  # three subsets each are cheaper than lists of two hundred
    many = spark.createDataFrame([(bytes([i]), 4000, list(range(i, i + 250))) for i in range(2)], "k binary, n long, r array<long>")
    assert setjoin.boundary(many) < 256  # thirty thousand subsets each for lists of two
    assert setjoin.boundary(few.where("false")) == 0


def test_a_large_family_is_linear_in_blocks(spark):
    """Members that are joined through a leader don't meet other blocks."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:-1] + [f"e{i}"])) for i in range(400)]
    from lexmill.plans.checkpoint import Workspace

    ws = Workspace(spark, "family")
    out = setjoin.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=85, family_block=1000, ws=ws)
    assert {r.component_id for r in out.collect()} == {0}
    sums = spark.read.parquet(ws.path("sums")).collect()
    assert [s.blocks for s in sums] == [39]  # 400 * 97 shingles
    assert spark.read.parquet(ws.path("main")).count() == 0  # nobody is left for a second comparison


def test_join_edges(spark):
    d = spark.createDataFrame(EDGE, SCHEMA).withColumns({c: F.lit(c) for c in (*CLASH, "token", "f", "tokens", "bits", "joined", "rows", "least")})
    got = setjoin.similar_sets(d, width=4, percent=85).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in EDGE), key=str)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1} and {r.doc_id: r.n_shingles for r in got}[4] == 0
    assert setjoin.similar_sets(d.where("false")).count() == 0
