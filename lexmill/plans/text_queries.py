"""Queries over texts, keys and rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.registry import query
from lexmill.functions import text as T
from lexmill.operators import filters, tables
from lexmill.plans.layout import spread


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark, sf_dir):
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))


LINES = "l AS (SELECT doc_id, source, unnest(range(len(s))) AS pos, unnest(s) AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents))"
NORM = r"lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'))"


@query("SELECT source, min(lang) AS first_lang, min(doc_id) AS first_doc, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def doc_rollup(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.min("lang").alias("first_lang"), F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT lang, source, count(*) AS n, grouping(lang, source)::BIGINT AS g FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())")
def stats_by_lang_source(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("lang", "source")
    return d.groupingSets([["lang", "source"], ["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("g"))


@query("SELECT quality, toxic, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM labels), 6)::DOUBLE AS share, grouping(quality, toxic)::BIGINT AS g FROM labels GROUP BY GROUPING SETS ((quality, toxic), (quality), ())")
def label_distribution_grouping_sets(spark, sf_dir):
    d = read(spark, sf_dir, "labels")
    g = d.groupingSets([["quality", "toxic"], ["quality"], []], "quality", "toxic").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("g"))
    return g.crossJoin(F.broadcast(d.agg(F.count("*").alias("all")))).select("quality", "toxic", "n", F.round(F.col("n") * 100.0 / F.col("all"), 6).alias("share"), "g")


@query(f"SELECT sha256({NORM}) AS h, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def norm_hash_dup_groups(spark, sf_dir):
    d = read(spark, sf_dir, "documents").groupBy(T.digest(T.normalised(F.col("text"))).alias("h"))
    return d.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(f"SELECT count(*) AS groups, coalesce(sum(n) - count(*), 0)::BIGINT AS redundant FROM (SELECT count(*) AS n FROM documents GROUP BY {NORM} HAVING count(*) > 1)")
def dup_redundant_count(spark, sf_dir):
    return norm_hash_dup_groups(spark, sf_dir).agg(F.count("*").alias("groups"), F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("redundant"))


@query(
    f"""WITH n AS (SELECT doc_id, length(text) AS chars, sha256({NORM}) AS h FROM documents), e AS (SELECT DISTINCT sha256({NORM}) AS h FROM benchmark)
SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY h ORDER BY doc_id) > 1 THEN 'dup_within' WHEN h IN (SELECT h FROM e) THEN 'dup_existing' WHEN chars < 60 THEN 'too_small' ELSE 'ok' END AS flag FROM n"""
)
def ingest_flags(spark, sf_dir):
    """Why a row isn't taken, first reason wins; a flagged first copy still makes later ones copies."""
    h = T.digest(T.normalised(F.col("text"))).alias("h")
    d = read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"), h)
    held = read(spark, sf_dir, "benchmark").select(h).distinct().withColumn("held", F.lit(True))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    flag = F.when(F.col("doc_id") > F.col("first"), "dup_within").when(F.col("held"), "dup_existing").when(F.col("chars") < 60, "too_small").otherwise("ok")
    return d.join(first, "h").join(held, "h", "left").select("doc_id", flag.alias("flag"))


@query(r"SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS by_length, floor(len(regexp_extract_all(text, '[^\s]+')) * 1.3::DOUBLE)::BIGINT AS by_words FROM documents")
def token_estimates(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.tokens_by_length(F.col("text")).alias("by_length"), T.tokens_by_words(F.col("text")).alias("by_words"))


@query("SELECT CASE WHEN t < 50 THEN '0-50' WHEN t < 200 THEN '50-200' WHEN t < 500 THEN '200-500' WHEN t < 1000 THEN '500-1k' WHEN t < 3000 THEN '1k-3k' ELSE '3k+' END AS band, lang, count(*) AS n FROM (SELECT lang, greatest(1, length(text) // 4) AS t FROM documents) GROUP BY 1, 2")
def token_bands(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(T.band(T.tokens_by_length(F.col("text"))).alias("band"), "lang").agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(CASE WHEN r = floor(n * 0.1::DOUBLE) + 1 THEN n_chars END) AS p10, max(CASE WHEN r = floor(n * 0.9::DOUBLE) + 1 THEN n_chars END) AS p90, round(avg(n_chars), 6) AS mean, median(n_chars)::DOUBLE AS median, max(n_chars) AS most FROM r GROUP BY lang"""
)
def size_percentiles(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    stats = d.groupBy("lang").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.median("n_chars").alias("median"), F.max("n_chars").alias("most"))
    return tables.index_percentile(d, "n_chars", {"p10": 0.1, "p90": 0.9}, "lang").join(stats, "lang")


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[ \t\r\f\x0B]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents")
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.digest(T.clean(F.col("text"))).alias("h"))


@query(r"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all('see [[LINK_0002]] ' || text || ' [[LINK_0001]] [[LINK_0002]]', '\[\[LINK_[0-9]{4}\]\]'))), ',') AS found, sha256(regexp_replace('see [[LINK_0002]] ' || text, '\[\[LINK_[0-9]{4}\]\]', '', 'g')) AS h FROM conversations")
def placeholder_strip(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    t = F.concat(F.lit("see [[LINK_0002]] "), F.col("text"))
    return c.select("conv_id", "turn", F.array_join(T.placeholders(F.concat(t, F.lit(" [[LINK_0001]] [[LINK_0002]]"))), ",").alias("found"), T.digest(T.strip_placeholders(t)).alias("h"))


URL = r"""lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/$', '')"""
QUERY = r"array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&')"


@query(f"SELECT page_id, {URL} || CASE WHEN {QUERY} <> '' THEN '?' || {QUERY} ELSE '' END AS canonical FROM pages")
def url_canonicalise(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '')"


@query(f"SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def domain_counts(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(T.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(r"SELECT l_orderkey, l_linenumber, l_partkey || 'B(' || l_linenumber || ')(b)' AS locator, l_partkey || 'B/' || l_linenumber || '/b' AS parts FROM lineitem")
def split_locator(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_partkey").cast("string"), F.lit("B("), F.col("l_linenumber").cast("string"), F.lit(")(b)")).alias("locator"))
    return d.withColumn("parts", F.array_join(T.locator_parts(F.col("locator")), "/"))


def _rules_sql():
    flags = [(n, p) for n, p in filters.UNIVERSAL]
    whens = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in flags)
    return f"CASE WHEN t = '' THEN 'empty' {whens} WHEN length(t) < 45 AND NOT (pos = 0) AND NOT regexp_matches(t, '{filters.SUBSTANCE}') THEN 'thin_no_substance' END"


@query(f"WITH {LINES}, t AS (SELECT doc_id, pos, trim(text) AS t FROM l) SELECT coalesce({_rules_sql()}, 'kept') AS reason, count(*) AS n FROM t GROUP BY 1")
def drop_counts(spark, sf_dir):
    """How many lines each rule drops; a document's first line counts as its heading."""
    return lines(spark, sf_dir).groupBy(F.coalesce(filters.drop_reason(F.col("text"), F.col("pos") == 0), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {LINES}, t AS (SELECT doc_id, pos, trim(text) AS t, source FROM l), r AS (SELECT doc_id, pos, CASE WHEN source = 'src1' AND contains(t, 'License') THEN 'notice' WHEN source = 'src1' AND length(t) > 200 THEN 'long' END AS reason FROM t) SELECT doc_id, pos, reason FROM r WHERE reason IS NOT NULL")
def drop_rules_domain(spark, sf_dir):
    rules = spark.createDataFrame([("src1", 1, "notice", "License"), ("src1", 2, "long", "^.{201,}$")], "domain string, prio int, name string, pattern string")
    return filters.by_domain(lines(spark, sf_dir).withColumn("text", F.trim("text")), rules, "source").where("domain_reason is not null").select("doc_id", "pos", F.col("domain_reason").alias("reason"))


@query(f"WITH {LINES}, t AS (SELECT doc_id, pos, trim(text) = lag(trim(text)) OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM l) SELECT doc_id, pos FROM t WHERE r")
def adjacent_dup_drop(spark, sf_dir):
    return filters.adjacent_duplicates(lines(spark, sf_dir), "doc_id", "pos").where("repeated").select("doc_id", "pos")


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(
    f"""WITH w AS (SELECT item_id, {WORDS} AS w FROM benchmark), s AS (SELECT DISTINCT item_id, unnest(list_transform(range(len(w)::BIGINT - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS s FROM w),
dw AS (SELECT doc_id, {WORDS} AS w FROM documents), d AS (SELECT DISTINCT unnest(list_transform(range(len(w)::BIGINT - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS s FROM dw WHERE len(w) > 4)
SELECT item_id, count(*) AS n, count(d.s) AS found, round(count(d.s) / count(*), 6) AS recall FROM s LEFT JOIN d USING (s) GROUP BY item_id"""
)
def source_recall(spark, sf_dir):
    """Share of each benchmark text's shingles that occur in the documents."""
    s = read(spark, sf_dir, "benchmark").select("item_id", F.explode(T.shingles(F.col("text"))).alias("s"))
    asked = s.select("s").distinct()
    d = spread(read(spark, sf_dir, "documents").select("text")).select(F.explode(T.shingles(F.col("text"))).alias("s")).join(asked, "s", "left_semi").distinct().withColumn("hit", F.lit(1))
    return s.join(d, "s", "left").groupBy("item_id").agg(F.count("*").alias("n"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


@query(
    f"""WITH b AS (SELECT item_id, list_distinct({WORDS}) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct({WORDS}) AS w FROM documents)
SELECT item_id, doc_id, round(len(list_intersect(b.w, d.w)) / (len(b.w) + len(d.w) - len(list_intersect(b.w, d.w))), 6) AS jaccard FROM b, d WHERE len(list_intersect(b.w, d.w)) * 10 >= 4 * (len(b.w) + len(d.w) - len(list_intersect(b.w, d.w)))""",
)
def leakage_near_dups(spark, sf_dir):
    """Pairs of benchmark and document texts with a word Jaccard of 0.4 or more, by an inverted join on words."""
    own = lambda t, i: read(spark, sf_dir, t).select(F.col(i), F.array_distinct(T.words(F.col("text"))).alias("w"), F.length("text").alias("chars"))
    b, d = own("benchmark", "item_id"), own("documents", "doc_id")
    x = b.select("item_id", F.size("w").alias("nb"), F.explode("w").alias("t")).join(d.select("doc_id", F.size("w").alias("nd"), F.explode("w").alias("t")), "t")
    # the intersection is at most the smaller set and the union at least the larger, so other pairs stay below 0.4
    x = x.where("nd * 4 <= nb * 10 and nb * 4 <= nd * 10").groupBy("item_id", "nb", "doc_id", "nd").agg(F.count("*").alias("both"))
    return x.where("both * 10 >= 4 * (nb + nd - both)").select("item_id", "doc_id", F.round(F.col("both") / (F.col("nb") + F.col("nd") - F.col("both")), 6).alias("jaccard"))


@query(
    r"""WITH t AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9\-'']+') AS t FROM benchmark), c AS (SELECT item_id, t, list_filter(t, lambda x: NOT list_contains(string_split('"""
    + " ".join(T.STOPWORDS)
    + """', ' '), lower(x))) AS c FROM t) SELECT item_id, array_to_string(CASE WHEN len(c) > 0 THEN c ELSE t END, ' ') AS terms FROM c"""
)
def query_terms(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'exclusion under PCR 2015 now Public Contracts Regulations 2015' WHEN c_custkey % 3 = 1 THEN 'FOIA request and PA2023 Procurement Act 2023 Freedom of Information Act 2000' ELSE 'plain' END AS expanded, CASE WHEN c_custkey % 3 = 0 THEN 'legacy_query' ELSE 'current_query' END AS intent FROM customer")
def alias_and_intent(spark, sf_dir):
    k = F.col("c_custkey") % 3
    q = F.when(k == 0, "exclusion under PCR 2015 now").when(k == 1, "FOIA request and PA2023").otherwise("plain")
    return read(spark, sf_dir, "customer").select("c_custkey", T.with_aliases(q).alias("expanded"), T.regime_intent(q).alias("intent"))


@query(r"WITH s AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(trim(text), '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM conversations WHERE role = 'user') SELECT conv_id, turn, 'F' || unnest(range(1, len(s) + 1)) AS fact, unnest(s) AS sentence FROM s")
def fact_sentences(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("p", "sentence"))
    return c.select("conv_id", "turn", F.concat(F.lit("F"), (F.col("p") + 1).cast("string")).alias("fact"), "sentence")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def chunk_upsert_last_wins(spark, sf_dir):
    return tables.pick(read(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) = 1")
def edge_insert_or_ignore(spark, sf_dir):
    return tables.insert_or_ignore(read(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], F.col("l_orderkey"), F.col("l_linenumber")).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query(
    f"""WITH n AS (SELECT page_id, {HOST} AS host, regexp_extract(url, '^[a-zA-Z]+://[^/]*/([^/?#]*)', 1) AS section, length(html) AS n FROM pages),
m AS (SELECT *, first_value(page_id) OVER (PARTITION BY host, section ORDER BY n DESC, page_id) AS canonical FROM n) SELECT page_id, canonical, CASE WHEN page_id <> canonical THEN canonical END AS superseded_by FROM m"""
)
def supersede_update(spark, sf_dir):
    """The largest page of a host and section is canonical, the others are superseded by it."""
    p = read(spark, sf_dir, "pages").select("page_id", T.host(F.col("url")).alias("host"), F.regexp_extract("url", r"^[a-zA-Z]+://[^/]*/([^/?#]*)", 1).alias("section"), F.length("html").alias("n"))
    best = p.groupBy("host", "section").agg(F.min(F.struct(-F.col("n"), "page_id")).alias("b")).select("host", "section", F.col("b.page_id").alias("canonical"))
    return p.join(best, ["host", "section"]).select("page_id", "canonical", F.when(F.col("page_id") != F.col("canonical"), F.col("canonical")).alias("superseded_by"))


@query(f"WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('s37|' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, source FROM k WHERE r <= 3")
def stratified_sample(spark, sf_dir):
    """Three documents of each source in a fixed random order."""
    key = F.sha2(F.concat(F.lit("s37|"), F.col("doc_id").cast("string")), 256)
    return tables.pick(read(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], key, F.col("doc_id"), n=3)


@query(f"SELECT {HOST} AS host, arg_min(page_id, (-length(html), page_id)) AS page_id, min(length(url))::BIGINT AS depth FROM pages GROUP BY 1")
def record_merge(spark, sf_dir):
    p = read(spark, sf_dir, "pages").groupBy(T.host(F.col("url")).alias("host"))
    return p.agg(F.min(F.struct(-F.length("html"), "page_id"))["page_id"].alias("page_id"), F.min(F.length("url")).cast("long").alias("depth"))


@query("SELECT user_id, event_type, count(*) AS n, sum(CASE WHEN gap > 3600 OR gap IS NULL THEN 1 ELSE 0 END)::BIGINT AS runs FROM (SELECT *, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events) GROUP BY 1, 2")
def journal_runs(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("s", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long"))  # whole seconds, the nearest ones
    gap = F.col("s") - F.lag("s").over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return e.withColumn("gap", gap).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.when((F.col("gap") > 3600) | F.col("gap").isNull(), 1).otherwise(0)).alias("runs"))
