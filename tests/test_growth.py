"""What larger tables and odd rows showed: results, and plans that don't grow with the rows."""

import datetime
import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.catalog import QUERIES
from lexmill.functions.batches import pieces
from lexmill.functions.text import words
from lexmill.operators import benchmark_metrics, evaluate, retrieve


def test_runs_of_rounded_seconds(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    micros = [400_000, 3600_600_000, 7200_500_000]  # seconds 0, 3601 and 7200 (a half goes to the even one)
    rows = [(i, at + datetime.timedelta(microseconds=m), 1, "a") for i, m in enumerate(micros)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["journal_runs"](spark, str(tmp_path)).collect()] == [(1, "a", 3, 2)]


def test_bootstrap_draws_rows_and_no_list(spark):
    n, replicates = 700, 20
    deltas = [(None if i == n - 1 else i * 3, float(i * i % 101)) for i in range(n)]  # a null comes last
    got = evaluate.bootstrap(spark.createDataFrame(deltas[::-1], "i long, delta double"), replicates, "s")
    draw = lambda r, t: int(hashlib.sha256(f"s|{r}|{t}".encode()).hexdigest()[:8], 16) % n
    means = [np.mean([deltas[draw(r, t)][1] for t in range(n)]) for r in range(replicates)]
    row = got.first()
    assert (row.n, row.mean) == (n, round(np.mean([d for _, d in deltas]), 6))
    assert (row.low, row.high) == pytest.approx((np.quantile(means, 0.025), np.quantile(means, 0.975)), abs=1e-6)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower() and "Window" not in plan  # no list of places, no numbering in one task


def test_scores_of_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "DOCS", 7, raising=False)
    monkeypatch.setattr(retrieve, "QUERIES", 2, raising=False)
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{i}" for i in rng.zipf(1.5, n) % 30)
    docs = [(i, text(int(rng.integers(0, 20))), f"w{i % 4}") for i in range(60)] + [(i, "w1 w2 w3 w3", None) for i in range(60, 90)] + [(90, None, None), (91, "", "")]
    asked = [(f"q{i}", text(6) + " nobody") for i in range(9)]
    d, q = spark.createDataFrame(docs, "id long, text string, source string"), spark.createDataFrame(asked, "key string, text string")
    found = retrieve.bm25(q, d, "key", words(F.col("text")), "id", {"text": 1.0, "source": 2.0}, 5)
    tf = {i: Counter((t or "").split()) + Counter({w: 2 * n for w, n in Counter((s or "").split()).items()}) for i, t, s in docs}
    dl = {i: sum(c.values()) for i, c in tf.items()}
    avgdl, df = np.mean([x for x in dl.values() if x > 0]), Counter(w for c in tf.values() for w in c)
    idf = {w: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    want = []
    for key, t in asked:
        score = {i: round(sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * dl[i] / avgdl)) for w in set(t.split()) if c[w]), 6) for i, c in tf.items() if set(t.split()) & set(c)}
        want += [(key, i, s, n + 1) for n, (s, i) in enumerate((-s, i) for s, i in sorted((-s, i) for i, s in score.items())[:5])]
    assert sorted((r.query, r.id, r.score, r.rank) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query#" not in plan  # pairs of queries and documents aren't grouped, so they aren't shuffled


def test_batches_in_pieces():
    batch = pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": ["x" * (i % 50 * 100) for i in range(1000)]})
    parts = list(pieces(batch, 20_000))
    assert max(p.nbytes for p in parts) <= 20_000 and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert [p.num_rows for p in pieces(batch.slice(49, 1), 10)] == [1]


def test_nearest_meets_some_queries_at_once(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "QUERIES", 3)
    rng = np.random.default_rng(3)
    m = rng.integers(-3, 4, (50, 5)).astype(float)
    m[40:] = m[7]  # copies tie, so ids decide
    m[3] = 0
    v = spark.createDataFrame([(int(i), [float(x) for x in m[i]]) for i in rng.permutation(50)] + [(99, None)], "id long, vector array<double>")
    got = retrieve.nearest(v.where("id % 5 = 2").withColumnRenamed("id", "query"), v, 4)
    unit = {i: m[i] / np.linalg.norm(m[i]) for i in range(50) if m[i].any()}
    want = [(q, i, r + 1) for q in unit if q % 5 == 2 for r, (_, i) in enumerate(sorted((-round(float(unit[q] @ x), 5), i) for i, x in unit.items() if i != q)[:4])]
    assert sorted((r.query, r.id, r["rank"]) for r in got.collect()) == sorted(want)


def test_means_from_exact_sums(spark):
    names = [m for m in benchmark_metrics.MEANS if m != "ndcg10"]
    rows = spark.createDataFrame([("a", v, *[0.0] * len(names)) for v in [0.6627, 0.8418, 0.5634, 0.9467]], f"config string, ndcg10 double, {', '.join(f'{n} double' for n in names)}").coalesce(1)
    assert benchmark_metrics.by_configuration(rows).first().ndcg10 == 0.7537  # the mean is 0.75365


def test_stored_index_has_a_row_for_a_term_and_block(spark, tmp_path):
    d = spark.createDataFrame([(i, f"alpha beta w{i}") for i in range(50)], "id long, text string").coalesce(1)
    retrieve.write_index(d, "id", {"text": 1.0}, f"{tmp_path}/index")
    stored = spark.read.parquet(f"{tmp_path}/index")
    assert stored.where("term = 'alpha'").count() == stored.where("term is null").count() < 50
    q = spark.createDataFrame([(1, "alpha w7"), (2, "nobody")], "item_id long, text string")
    assert [(r.query, r.id, r["rank"]) for r in retrieve.search_index(q, f"{tmp_path}/index", "item_id", words(F.col("text")), 2).orderBy("rank").collect()] == [(1, 7, 1), (1, 0, 2)]
