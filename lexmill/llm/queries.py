"""Queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.llm import centroids, divergence, exact, langid, licenses, media, minhash, mixing, packing, pii, setjoin, suffix, warc

QUERIES = {}
ORACLES = {}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS x FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY x ORDER BY length(t) DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY x) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY x ORDER BY length(t) DESC, doc_id) AS kept, sha256(x) AS text_sha256
FROM n"""
)
def op4_exact_dedup(spark, sf_dir):
    """The row that stays of every group of equal texts."""
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


@query(
    r"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
d AS (SELECT documents.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, quality FROM documents LEFT JOIN q ON q.doc_id = documents.doc_id),
k AS (SELECT *, -ln((('0x' || substr(sha256('mix|' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
  / CASE quality WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(cap, coalesce((SELECT arg_min(rate, cap / weight) FROM r WHERE rate * weight <= cap) * weight, cap)) END AS target FROM r),
o AS (SELECT k.doc_id, k.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken FROM o"""
)
def op8_source_mix(spark, sf_dir):
    """Words that the mix takes of every document; quality by the labels."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels")).drop("source", "text_hash")


@query()
def op6_language_id(spark, sf_dir):
    """Predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def vocabulary(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op9_best_fit_packing(spark, sf_dir):
    """Place of every piece of every document in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


@query(
    r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM r"""
)
def op10_arc_to_warc(spark, sf_dir):
    """Records of the archives that the pages were written to."""
    return warc.archive_pages(table(spark, sf_dir, "pages"))


@query(
    r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(len(w)::BIGINT - 3), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
x AS MATERIALIZED (SELECT doc_id, unnest(s) AS h FROM s),
c AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM (SELECT x.* FROM x SEMI JOIN c USING (h)) a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * shared >= 80 * (i.n + j.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
k AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN k ON k.node = n.doc_id"""
)
def op2_minhash_near_dedup(spark, sf_dir):
    """Component of near duplicates of every document, on shingles of four words."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4).drop("text_hash")


@query()
def op7_personal_data(spark, sf_dir):
    """Spans of personal data in every document."""
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


@query()
def op1_license_scan(spark, sf_dir):
    """License of every document, and the lines that state it."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",")
    return found.select("doc_id", "license", F.round("dice", 6).alias("dice"), "n_spans", text.alias("spans"))


@query()
def op5_media_columns(spark, sf_dir):
    """Every document stored as an AVI file and read back."""
    return media.read_media(media.write_media(table(spark, sf_dir, "documents"))).drop("clips", "payload")


@query()
def op3_suffix_dedup(spark, sf_dir):
    """What stays of every document without strings of 50 bytes of documents with smaller ids."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def _lloyd(rounds: int) -> str:
    """SQL of the rounds: ``v(row, vec_id, i, x)`` has the kept components, ``c0`` the first centroids."""
    near = """n{r} AS MATERIALIZED (SELECT row, arg_min(k, (d, k)) AS k, min(d) AS d FROM
  (SELECT v.row, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} c ON c.i = v.i GROUP BY 1, 2) GROUP BY 1)"""
    mean = """m{r} AS (SELECT n.k, v.i, sum(v.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM v JOIN n{r} n ON n.row = v.row GROUP BY 1, 2),
c{s} AS MATERIALIZED (SELECT c.k, c.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x)::BIGINT AS x FROM c{r} c LEFT JOIN m{r} m ON m.k = c.k AND m.i = c.i)"""
    return ",\n".join([x.format(r=r, s=r + 1) for r in range(rounds) for x in (near, mean)] + [near.format(r=rounds)])


@query(
    f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), embedding) AS row, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT row, unnest(range(64)) AS i, floor(256::DOUBLE * unnest(embedding)::DOUBLE)::BIGINT AS x FROM e),
c0 AS MATERIALIZED (SELECT row - 1 AS k, i, x FROM v WHERE row <= 40),
{_lloyd(5)},
h AS (SELECT k, sha256(string_agg(x, ',' ORDER BY i)) AS centroid_sha256 FROM c5 GROUP BY k)
SELECT e.vec_id, n.k::INT AS cluster, n.d::BIGINT AS distance, sum(n.d) OVER (PARTITION BY n.k)::BIGINT AS cluster_inertia, sum(n.d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM e JOIN n5 n ON n.row = e.row JOIN h ON h.k = n.k"""
)
def op12_centroid_clustering(spark, sf_dir):
    """Nearest of 40 centroids of every vector, after five rounds in exact integers."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


@query(
    r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS MATERIALIZED (SELECT row, lang, source, term, count(*) AS n FROM (SELECT row, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
c AS (SELECT lang, source, term, sum(n)::HUGEINT AS n, count(*) AS docs FROM x GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS total FROM c GROUP BY ALL HAVING sum(docs) >= 30),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
f AS (SELECT lang, source, term, coalesce(c.n, 0)::HUGEINT AS n, total FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS MATERIALIZED (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER s + 5 * count(*) OVER s))::BIGINT AS p,
  (1 + 1000000000::HUGEINT * (total + 5) // (sum(total) OVER s + 5 * count(*) OVER s))::BIGINT AS q FROM f WINDOW s AS (PARTITION BY lang, source)),
v AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 50"""
)
def op11_source_divergence(spark, sf_dir):
    """Distances of the sources of each language by their terms, and each source's fifty most overused terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@query(
    r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(len(w)::BIGINT - 3), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
x AS MATERIALIZED (SELECT doc_id, unnest(s) AS h FROM s),
c AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM (SELECT x.* FROM x SEMI JOIN c USING (h)) a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * shared >= 85 * (i.n + j.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
k AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN k ON k.node = n.doc_id"""
)
def op13_ngram_jaccard_join(spark, sf_dir):
    """Component of every document by Jaccard similarities of 0.85 or more of its sets of four-word shingles."""
    return setjoin.similar_sets(table(spark, sf_dir, "documents"), width=4, percent=85)
