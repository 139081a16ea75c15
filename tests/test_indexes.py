"""Stored indexes of vectors and words against the same searches without them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import stem
from lexmill.functions import text as T
from lexmill.operators import lexical, retrieve, vectors
from lexmill.plans.checkpoint import Workspace

STEMS = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform
radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr goodness good revival reviv allowance allow inference infer
airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ
angulariti angular effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll syzygy syzygi by by été été x1s x1s dying dy generalizations gener oscillators oscil""".split()


def test_stems_of_known_words(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    got = stem.with_stem(spark.createDataFrame([(w, 1) for w, _ in pairs] + [(None, 2)], "term string, n int"), "term").collect()
    assert [(r.term, r.stem) for r in got] == [*pairs, (None, None)]


def points(n=1200, dims=16):
    rnd = np.random.default_rng(1)
    middle = rnd.normal(size=(30, dims))
    return [(i, [float(x) for x in middle[i % 30] + 0.3 * rnd.normal(size=dims)]) for i in range(n)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_index(spark, tmp_path, monkeypatch, kind):
    """All cells give the exact neighbours, the stored number of cells 0.9 of them, and one cell is dealt to several parts."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "BLOCKS", 2)
    rows = [*points(), (5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (None, [1.0] * 16), *[(6000 + i, [1.0, *[0.0] * 15]) for i in range(400)]]
    v = spark.createDataFrame(rows, f"id long, vector array<{kind}>").repartition(3)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query"), "vector")
    vectors.write_index(v, str(tmp_path), cells=20)
    cells = spark.read.parquet(f"{tmp_path}/cells")
    assert cells.agg(F.sum("rows"), F.max("parts")).first()[:] == (1600, cells.agg(F.ceil(F.max("rows") / 32)).first()[0])
    exact = {tuple(r) for r in retrieve.nearest(asked, vectors.usable(v, "id"), 10).select("query", "id", "score", "rank").collect()}
    assert {tuple(r) for r in vectors.search_index(asked, str(tmp_path), 10, probes=0).select("query", "id", "score", "rank").collect()} == exact
    distinct = asked.where("query < 5000")  # the others have four hundred equal neighbours
    found = vectors.search_index(distinct, str(tmp_path), 10)
    each = vectors.recall(found, retrieve.nearest(distinct, vectors.usable(v, "id"), 10))
    assert each.agg(F.avg("recall")).first()[0] >= 0.9
    few = vectors.recall(vectors.search_index(distinct, str(tmp_path), 10, probes=1), retrieve.nearest(distinct, vectors.usable(v, "id"), 10)).agg(F.avg("recall")).first()[0]
    assert few <= 1.0 and found.count() == 10 * distinct.count()


def test_empty_vector_index(spark, tmp_path):
    v = spark.createDataFrame([], "id long, vector array<float>")
    vectors.write_index(v, str(tmp_path))
    assert vectors.search_index(v.select(F.col("id").alias("query"), "vector"), str(tmp_path), 3).count() == 0


def corpus(n=400):
    rnd = random.Random(2)
    common = [f"common{i}" for i in range(6)]
    rows = []
    for i in range(n):
        w = [rnd.choice(common) for _ in range(rnd.randint(0, 60))] + [f"rare{rnd.randint(0, 30)}" for _ in range(rnd.choice([0, 0, 0, 1, 3]))] + rnd.choice([[], ["hopes"], ["hoping", "Hoped"]])
        rnd.shuffle(w)
        rows.append((i, " ".join(w)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, rows[3][1]), (n + 3, rows[3][1])]


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_blocks_give_the_rows_of_all_postings(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(lexical, "BLOCK", 8)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "rare1 rare2 common0 common1"), (2, "common1 common2"), (3, "hoped rare7"), (4, "nobody has this"), (5, ""), (6, "rare3 rare3 rare4 common5")], "item_id long, text string")
    lexical.write_index(docs, "doc_id", {"text": 1.0}, str(tmp_path), stemmed=False)
    want = retrieve.bm25(asked, docs, "item_id", T.words(F.col("text")), "doc_id", {"text": 1.0}, k).select("query", "id", "score", "rank").collect()
    ws = Workspace(spark, "blocks")
    got = lexical.search(asked, str(tmp_path), "item_id", T.words(F.col("text")), k).select("query", "id", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    read = {r["query"]: (r.postings, r["read"]) for r in lexical.postings_read(asked, str(tmp_path), "item_id", T.words(F.col("text")), k, ws).collect()}
    assert all(b <= a for a, b in read.values())
    if k == 1:
        assert read[1][1] < 0.5 * read[1][0]  # the common words' postings are read for candidates alone


def test_stemmed_blocks(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "hope"), (2, "HOPES hoping")], "item_id long, text string")
    lexical.write_index(docs, "doc_id", {"text": 1.0}, str(tmp_path))
    got = lexical.search(asked, str(tmp_path), "item_id", T.words(F.col("text")), 1000).collect()
    want = {i for i, t in corpus() if t and {"hopes", "hoping", "hoped"} & set(t.lower().split())}
    assert {r.id for r in got if r["query"] == 1} == {r.id for r in got if r["query"] == 2} == want


def test_unions_that_are_grouped_afterwards_exchange_their_rows(spark):
    """Without a setting of the session: inputs that share a partitioning are exchanged again above their union."""
    from lexmill.operators import scoring, search

    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "true"
    parts = [spark.range(2000).select((F.col("id") % 50).alias("query"), (F.col("id") % 70).alias("id")).distinct().withColumn("rank", F.lit(i)).repartition(4, "query", "id") for i in (1, 2)]
    fused = retrieve.fuse({"a": parts[0], "b": parts[1]})
    assert fused.count() == 350 and {r.channels for r in fused.collect()} == {"a+b"}
    runs = parts[0].withColumn("system", F.lit("a")).unionByName(parts[1].withColumn("system", F.lit("b"))).withColumn("sha", F.lit("x"))
    assert {r.systems for r in scoring.pool(runs).collect()} == {"a+b"}
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(100)], "source long, target long, confidence double")
    hits = spark.createDataFrame([(1, 5, 1), (2, 50, 1)], "query long, id long, rank int")
    got = search.graph_channel(hits, edges, hops=3)
    assert sorted((r["query"], r.id, r["rank"]) for r in got.collect()) == [(1, 6, 1), (1, 7, 2), (1, 8, 3), (2, 51, 1), (2, 52, 2), (2, 53, 3)]
    for df in (retrieve.fuse({"a": parts[0], "b": parts[1]}), scoring.pool(parts[0].withColumn("system", F.lit("a")).withColumn("sha", F.lit("x")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(query" in plan[: plan.index("Union")]
