"""Gold citations, coherence against chance, grouped intervals, prefixes, remaining text and nested documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import benchmark_metrics, coherence, evaluate, filters, gold, graph, quality, retrieve
from lexmill.operators.evaluate import POISSON
from lexmill.plans.checkpoint import Workspace
from lexmill.plans.layout import spread, together
from lexmill.plans.linking_queries import TOPICS, topics
from lexmill.plans.retrieval_queries import OVERLAP, bm25_sql, channels
from lexmill.plans.text_queries import LINES, lines, read
from lexmill.registry import query
from lexmill.sources import nested, statute_records, store

# citations: the first words of benchmark texts and of documents' first lines, some spelled so that nothing has them; chunks: documents cited by their first line
CHUNKS = "SELECT doc_id AS id, string_split(text, chr(10))[1] AS citation, text FROM documents"
CITED = """SELECT 'b' || item_id AS key, CASE item_id % 3 WHEN 0 THEN 'Section Qqzz, ' || item_id WHEN 1 THEN text END AS citation FROM benchmark
UNION ALL SELECT 'd' || doc_id, CASE doc_id % 3 WHEN 0 THEN array_to_string(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')[1:5], ' ') WHEN 1 THEN left(text, 9) ELSE '...' END FROM documents WHERE doc_id % 100 = 0"""
TOKENS = "list_filter(regexp_extract_all({}, '[a-z0-9]+'), lambda t: length(t) > 1)".format(
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(citation, '')), '[.,;:]', ' ', 'g'), '\bsection\b', 's', 'g'), '\bregulation\b', 'reg', 'g'), '\bschedule\b', 'sch', 'g'), '\bparagraph\b', 'para', 'g')"
)


def both_fields(sql: str) -> str:
    """``bm25_sql`` over citations and texts of the chunks, for the tokens of the citations that are left."""
    sql = sql.replace("SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term, 1.0::DOUBLE AS w FROM documents", "SELECT id, unnest(regexp_extract_all(lower(x), '[\\p{L}\\p{N}_]+')) AS term, 1.0::DOUBLE AS w FROM (SELECT id, citation AS x FROM c UNION ALL SELECT id, text FROM c)")
    i = sql.index("q AS (SELECT item_id")
    return sql[:i] + "q AS (SELECT key AS query, unnest(list_distinct(w[1:6])) AS term FROM g WHERE key NOT IN (SELECT key FROM m)),\n" + sql[sql.index("s AS (SELECT query, id, round") :]


@query(
    f"""WITH c AS MATERIALIZED ({CHUNKS}), g AS MATERIALIZED (SELECT key, {TOKENS} AS w FROM ({CITED})),
m AS MATERIALIZED (SELECT key, arg_min(citation, id) AS matched_citation, min(id) AS id, least(count(*), 10) AS n_candidates FROM g JOIN c ON len(w) > 0 AND len(list_filter(w[1:4], lambda t: NOT contains(lower(citation), t))) = 0 GROUP BY key),
{both_fields(bm25_sql())}
SELECT g.key, CASE WHEN m.key IS NOT NULL THEN 'MATCHED' WHEN lex.id IS NOT NULL THEN 'FUZZY_MATCHED' ELSE 'UNRESOLVED' END AS status, coalesce(m.id, lex.id) AS id, coalesce(m.matched_citation, c.citation) AS matched_citation, m.n_candidates::BIGINT AS n_candidates
FROM g LEFT JOIN m ON m.key = g.key LEFT JOIN lex ON lex.query = g.key AND lex.rank = 1 LEFT JOIN c ON c.id = lex.id"""
)
def gold_citations(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("citation"), "text")
    b, k, i = read(spark, sf_dir, "benchmark"), F.col("item_id") % 3, F.col("doc_id") % 3
    of_b = b.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("key"), F.when(k == 0, F.concat(F.lit("Section Qqzz, "), F.col("item_id").cast("string"))).when(k == 1, F.col("text")).alias("citation"))
    short = F.array_join(F.slice(F.split(F.regexp_replace("text", r"\s+", " "), " "), 1, 5), " ")
    of_d = d.where("doc_id % 100 = 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), F.when(i == 0, short).when(i == 1, F.left("text", F.lit(9))).otherwise("...").alias("citation"))
    return gold.resolve(of_b.unionByName(of_d), chunks).select("key", "status", "id", "matched_citation", "n_candidates")


def drawn(name: str, nodes: str, draws: int, seed: str) -> str:
    """SQL of random pairs ``{name}(draw, a, b)`` of the nodes ``nodes(id)``, drawn as ``coherence.random_pairs`` does."""
    h = lambda *parts: f"('0x' || substr(sha256('{seed}|' || {' || chr(124) || '.join(parts)}), 1, 8))::BIGINT"
    return f"""{name}_s AS (SELECT id, slot, row_number() OVER (PARTITION BY slot ORDER BY id) - 1 AS place FROM (SELECT id, {h("'slot'", 'id')} % (SELECT count(*) FROM {nodes}) AS slot FROM {nodes})),
{name}_t AS (SELECT d.i AS draw, s.i AS side, t.i AS try, {h("'at'", 'd.i', 's.i', 't.i')} % (SELECT count(*) FROM {nodes}) AS slot, {h("'place'", 'd.i', 's.i', 't.i')} % {coherence.PLACES} AS place FROM range({draws}) d(i), range(2) s(i), range({coherence.TRIES}) t(i)),
{name}_m AS MATERIALIZED (SELECT draw, side, try, id FROM {name}_t JOIN {name}_s USING (slot, place)),
{name}_a AS (SELECT draw, arg_min(id, try) AS a FROM {name}_m WHERE side = 0 GROUP BY draw),
{name} AS MATERIALIZED (SELECT draw, a, arg_min(id, try) AS b FROM {name}_m JOIN {name}_a USING (draw) WHERE side = 1 AND id <> a GROUP BY ALL)"""


JACCARD = "len(list_intersect({0}.t, {1}.t)) / len(list_distinct(list_concat({0}.t, {1}.t)))::DOUBLE"


@query(
    f"""WITH {TOPICS}, {drawn("r", "tp", 1000, "13")}, b AS (SELECT round(avg({JACCARD.format("x", "y")}), 6) AS baseline FROM r JOIN tp x ON x.id = r.a JOIN tp y ON y.id = r.b),
e AS (SELECT p_brand AS relation, {JACCARD.format("x", "y")} AS j FROM part JOIN tp x ON x.id = p_partkey JOIN tp y ON y.id = p_partkey % 50 + 1)
SELECT relation, count(*) AS edges, round(avg(j), 6) AS mean, round(quantile_cont(j, 0.5), 6) AS median, round(avg((j = 0)::INT), 6) AS zero_share, baseline, CASE WHEN baseline > 0 THEN round(avg(j) / baseline, 2) END AS lift FROM e, b GROUP BY relation, baseline"""
)
def relation_coherence_lift(spark, sf_dir):
    e = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), (F.col("p_partkey") % 50 + 1).alias("target"), F.col("p_brand").alias("relation"))
    return coherence.of_relations(e, topics(spark, sf_dir), draws=1000)


@query(
    f"""WITH {TOPICS}, k AS (SELECT p_partkey AS node, p_brand AS component FROM part), z AS (SELECT component, count(*) AS size FROM k GROUP BY 1 HAVING count(*) >= 3),
w AS (SELECT component, t, row_number() OVER (PARTITION BY component ORDER BY node) AS i FROM k JOIN tp ON tp.id = k.node),
p AS (SELECT component, {JACCARD.format("a", "b")} AS j, row_number() OVER (PARTITION BY component ORDER BY a.i, b.i) AS n FROM w a JOIN w b USING (component) WHERE a.i < b.i)
SELECT component, size, count(*) AS pairs, round(avg(j), 6) AS mean FROM p JOIN z USING (component) WHERE n <= 400 GROUP BY ALL"""
)
def component_coherence(spark, sf_dir):
    """Parts of a brand as a component; its first 400 pairs."""
    k = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("component"))
    return coherence.of_components(k, topics(spark, sf_dir))


@query(
    f"""WITH d AS (SELECT user_id % 200 AS g, avg(round(value, 4) - 20) AS delta FROM events GROUP BY 1), h AS (SELECT ('0x' || substr(sha256('37|' || g), 1, 8))::BIGINT AS h, delta FROM d),
a AS (SELECT i AS r, delta, (h + i * 2654435769) % 4294967296 AS x FROM h, range(500) t(i)), b AS (SELECT r, delta, (xor(x, x >> 16) * {0x21F0AAAD}) % 4294967296 AS x FROM a), c AS (SELECT r, delta, (xor(x, x >> 15) * {0x735A2D97}) % 4294967296 AS x FROM b),
n AS (SELECT r, delta, len(list_filter({POISSON}, lambda y: y <= xor(x, x >> 15))) AS n FROM c), m AS (SELECT r, sum(n * delta) / sum(n) AS m FROM n GROUP BY r),
s AS (SELECT count(*) AS n_groups, round(avg(delta), 6) AS delta, count(*) FILTER (delta > 1e-12) AS wins, count(*) FILTER (abs(delta) <= 1e-12) AS ties, count(*) FILTER (delta < -1e-12) AS losses FROM d)
SELECT n_groups, delta, (SELECT round(quantile_cont(m, 0.025), 6) FROM m) AS low, (SELECT round(quantile_cont(m, 0.975), 6) FROM m) AS high, wins, ties, losses,
  round(least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2.0::DOUBLE))) FROM range(0, least(wins, losses) + 1) t(i))), 6) AS p FROM s"""
)
def grouped_bootstrap_ci(spark, sf_dir):
    """Differences of events from 20, grouped by user; whole groups are drawn."""
    d = read(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("group"), (F.round("value", 4) - 20).alias("delta"))
    return evaluate.grouped_bootstrap(d, 500)


@query(
    r"""WITH h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+/[0-9]{1,2}') AS p FROM pages WHERE page_id % 5 = 0 UNION SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+') FROM pages WHERE page_id % 3 = 0)
SELECT page_id, url, (SELECT arg_max(p, length(p)) FROM h WHERE starts_with(url, p) AND p <> '') AS found FROM pages"""
)
def longest_held_prefix(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    held = p.where("page_id % 5 = 0").select(F.regexp_extract("url", "^[a-z]+://[^/]+/[a-z]+/[0-9]{1,2}", 0).alias("p")).unionByName(p.where("page_id % 3 = 0").select(F.regexp_extract("url", "^[a-z]+://[^/]+", 0).alias("p")))
    return graph.longest_start(p.select("page_id", "url"), "url", held, "p")


CLEANED = r"regexp_replace(regexp_replace({}, '[ \t\r\f\x0B]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(
    f"""WITH {LINES}, k AS (SELECT doc_id, list(text ORDER BY o, pos) AS c FROM (SELECT doc_id, pos, text, 0 AS o FROM l WHERE pos IN (1, 3, 4) UNION ALL SELECT doc_id, pos, text, 1 FROM l WHERE pos = 1) GROUP BY 1),
d AS (SELECT documents.doc_id, {CLEANED.format("coalesce(text, '')")} AS t, list_transform(coalesce(c, []), lambda x: {CLEANED.format('x')}) AS c FROM documents LEFT JOIN k ON k.doc_id = documents.doc_id),
r AS (SELECT doc_id, t, len(c) AS n, list_reduce(c, lambda a, x: CASE WHEN x <> '' AND strpos(a, x) > 0 THEN {CLEANED.format("left(a, strpos(a, x) - 1) || ' ' || substr(a, strpos(a, x) + length(x))")} ELSE a END, t) AS x FROM d)
SELECT doc_id, sha256(CASE WHEN n = 0 THEN t WHEN x = t THEN '' ELSE x END) AS left_sha, CASE WHEN n = 0 THEN length(t) WHEN x = t THEN 0 ELSE length(x) END AS n_left FROM r"""
)
def exclusive_text(spark, sf_dir):
    """Documents without three of their lines, the first of which is asked for twice."""
    k = lines(spark, sf_dir).where("pos in (1, 3, 4)").withColumn("o", F.explode(F.when(F.col("pos") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    k = k.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "pos", "text"))), lambda x: x["text"]).alias("children"))  # four a document
    left = T.exclusive_text(F.col("text"), F.col("children"))
    d = read(spark, sf_dir, "documents").select("doc_id", "text").join(k, "doc_id", "left").select("doc_id", left.alias("left"))
    return d.select("doc_id", T.digest(F.col("left")).alias("left_sha"), F.length("left").cast("long").alias("n_left"))


# a document for each conversation: arrays in objects in arrays, with skipped keys on two levels and values that aren't text
TURN = "{'a': {'b': [{'c': text}, {'c': role}]}, 'Image': text, 'n': turn, 'z': CASE WHEN turn % 2 = 0 THEN {'api_url': role, 'y': [[role]]} END}"


@query(
    f"""WITH t AS (SELECT conv_id, turn, {TURN} AS o FROM conversations), d AS (SELECT conv_id, to_json({{'body': list(o ORDER BY turn), 'image_url': 'http://x', 'title': 'conversation ' || conv_id}}) AS j FROM t GROUP BY 1),
s AS (SELECT conv_id, id, atom->>'$' AS s FROM d, json_tree(d.j) WHERE type = 'VARCHAR' AND NOT regexp_matches(lower(fullkey), '[.]"?(image|image_url|api_url)"?([.]|\\[|$)'))
SELECT conv_id, sha256(string_agg(s, ' ' ORDER BY id)) AS text_sha, (sum(length(s)) + count(*) - 1)::BIGINT AS n_text FROM s GROUP BY 1"""
)
def nested_json_text(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    leaf = lambda x: F.struct(F.col(x).alias("c"))
    z = F.when(F.col("turn") % 2 == 0, F.struct(F.col("role").alias("api_url"), F.array(F.array("role")).alias("y")))
    turn = F.struct("turn", F.struct(F.struct(F.array(leaf("text"), leaf("role")).alias("b")).alias("a"), F.col("text").alias("Image"), F.col("turn").alias("n"), z.alias("z")).alias("o"))
    d = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["o"]).alias("body"))  # a conversation
    doc = F.to_json(F.struct("body", F.lit("http://x").alias("image_url"), F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("title")))
    found = nested.strings(d.select("conv_id", doc.alias("j")), "conv_id", F.col("j"))
    return found.select("conv_id", T.digest(F.col("text")).alias("text_sha"), F.length("text").cast("long").alias("n_text"))


# chunks in full
STRIP = r"regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')"
GROUND = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z][a-z\\-]{{2,}}')), lambda w: NOT list_contains(" + str(quality.COMMON) + ", w))"


def assessed_sql(source: str) -> str:
    """SQL of ``quality.assess`` over ``source`` with its columns: tables ``a`` and ``v``, the latter with the results."""
    like = lambda c, p: f"regexp_matches({c}, '{p.replace(chr(39), chr(39) * 2)}')"
    end = f"(t <> '' AND NOT {like('t', quality.SENTENCE_END)} AND NOT {like('t', quality.CLAUSE_END)})"
    on = f"({like('n', '^' + chr(92) + 'p{Ll}')} AND NOT {like('n', quality.LIST_ITEM)})"
    return f"""a AS (SELECT *, {STRIP.format("text")} AS t, {STRIP.format("after")} AS n, {STRIP.format("title")} AS h, {STRIP.format("summary")} AS s FROM ({source})),
b AS (SELECT *, length(t) AS chars, greatest(1, length(t) // 4) AS tokens, {GROUND.format("s")} AS sw, {GROUND.format("t")} AS tw FROM a),
k AS (SELECT *, CASE WHEN s <> '' AND t <> '' AND len(sw) > 0 THEN len(list_intersect(sw, tw))::DOUBLE / len(sw) ELSE 0 END AS g FROM b),
v AS (SELECT * EXCLUDE (t, n, h, s, sw, tw, g), tokens BETWEEN 200 AND 800 AS in_band, round(g, 3) AS grounding,
  list_filter([CASE WHEN t = '' THEN 'EMPTY_TEXT' END, CASE WHEN {end} AND {on} THEN 'SEVERED_SENTENCE' END, CASE WHEN t <> '' AND {like("right(t, 40)", quality.CONNECTIVE)} THEN 'SEVERED_ENUMERATION' END, CASE WHEN ends_with(t, ':') THEN 'SEVERED_LIST_STEM' END,
  CASE WHEN t <> '' AND {like("t", quality.LIST_ITEM)} AND ordinal > 1 THEN 'ORPHAN_LIST_ITEM' END, CASE WHEN t <> '' AND tokens < 15 THEN 'TOO_SMALL_TO_RETRIEVE' END, CASE WHEN h = '' THEN 'NO_TITLE' END, CASE WHEN s = '' THEN 'NO_SUMMARY' END], lambda x: x IS NOT NULL) AS defects,
  list_filter([CASE WHEN {end} AND NOT {on} THEN 'UNTERMINATED_TAIL' END, CASE WHEN t <> '' AND tokens BETWEEN 15 AND 199 THEN 'BELOW_PREFERRED_BAND' END, CASE WHEN t <> '' AND tokens > 1200 THEN 'ABOVE_PREFERRED_BAND' END, CASE WHEN topics IS NULL THEN 'NO_TOPICS' END,
  CASE WHEN concepts IS NULL THEN 'NO_LEGAL_CONCEPTS' END, CASE WHEN s <> '' AND t <> '' AND g < 0.15 THEN 'SUMMARY_LOW_GROUNDING' END], lambda x: x IS NOT NULL) AS advisories FROM k)"""


LINE_CHUNKS = f"""WITH {LINES} SELECT doc_id, pos, pos + 1 AS ordinal, text, lead(text) OVER w AS after, CASE WHEN pos % 7 <> 3 THEN source END AS title, lag(text) OVER w AS summary, CASE WHEN pos % 2 = 0 THEN [source] END AS topics, CASE WHEN pos % 3 = 0 THEN [source] END AS concepts, source
FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"""


def line_chunks(spark, sf_dir):
    """Lines as chunks: the line before as the summary, the source as title, topic and concept of some."""
    w, p = W.partitionBy("doc_id").orderBy("pos"), F.col("pos")
    return lines(spark, sf_dir).select("doc_id", "pos", (p + 1).alias("ordinal"), "text", F.lead("text").over(w).alias("after"), F.when(p % 7 != 3, F.col("source")).alias("title"), F.lag("text").over(w).alias("summary"), F.when(p % 2 == 0, F.array("source")).alias("topics"), F.when(p % 3 == 0, F.array("source")).alias("concepts"), "source")


@query(f"WITH {assessed_sql(LINE_CHUNKS)} SELECT doc_id, pos, chars, tokens, in_band, grounding, array_to_string(defects, '+') AS defects, array_to_string(advisories, '+') AS advisories FROM v")
def chunk_assessment(spark, sf_dir):
    d = quality.assess(line_chunks(spark, sf_dir))
    return d.select("doc_id", "pos", "chars", "tokens", "in_band", "grounding", F.array_join("defects", "+").alias("defects"), F.array_join("advisories", "+").alias("advisories"))


@query(
    f"WITH {assessed_sql(LINE_CHUNKS)}, x AS (SELECT source, 'defects' AS kind, unnest(defects) AS name FROM v UNION ALL SELECT source, 'advisories', unnest(advisories) FROM v), z AS (SELECT source, count(*) AS n FROM v GROUP BY 1 HAVING count(*) >= 10) SELECT x.source, kind, name, count(*) AS n, round(count(*) / any_value(z.n)::DOUBLE, 6) AS share FROM x JOIN z ON z.source IS NOT DISTINCT FROM x.source GROUP BY ALL"
)
def chunk_detectors(spark, sf_dir):
    """Shares of each defect and advisory by source."""
    return quality.detectors(quality.assess(line_chunks(spark, sf_dir)), "source")


STRATEGIES = f"""WITH RECURSIVE {LINES}, n AS (SELECT doc_id, pos, text, greatest(1, length(text) // 4) AS k FROM l),
r AS (SELECT doc_id, pos, b, 0::BIGINT AS g, 0::BIGINT AS before, k FROM n, (VALUES (400), (800)) t(b) WHERE pos = 0
UNION ALL SELECT n.doc_id, n.pos, r.b, r.g + (r.before + r.k >= r.b)::INT, CASE WHEN r.before + r.k >= r.b THEN 0 ELSE r.before + r.k END, n.k FROM r JOIN n ON n.doc_id = r.doc_id AND n.pos = r.pos + 1),
u AS (SELECT 'fixed_tokens_' || b AS strategy, doc_id, pos, g FROM r UNION ALL SELECT 'block_window_' || b, doc_id, pos, pos // b FROM n, (VALUES (5), (10)) t(b)),
c AS (SELECT strategy, doc_id, g + 1 AS chunk, string_agg(text, chr(10) ORDER BY pos) AS text FROM u JOIN n USING (doc_id, pos) GROUP BY ALL)
SELECT strategy, doc_id, chunk AS ordinal, text, lead(text) OVER (PARTITION BY strategy, doc_id ORDER BY chunk) AS after, 't' AS title, 's' AS summary, NULL AS topics, NULL AS concepts FROM c"""


@query(
    f"WITH {assessed_sql(STRATEGIES)} SELECT strategy, count(*) AS chunks, count(*) FILTER (len(defects) = 0) AS clean, round(100 * count(*) FILTER (len(defects) = 0) / count(*)::DOUBLE, 1) AS clean_pct, sum(len(defects))::BIGINT AS defects, round(sum(len(defects)) / count(*)::DOUBLE, 3) AS defects_per_chunk, count(*) FILTER (in_band) AS in_band, round(avg(tokens), 1) AS mean_tokens, median(tokens)::DOUBLE AS median_tokens FROM v GROUP BY 1"
)
def chunking_strategies(spark, sf_dir):
    """Fixed budgets and windows side by side."""
    c = quality.strategies(spread(read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))), "doc_id", "pos", "text")
    c = c.select("strategy", "text", "after", F.col("chunk").alias("ordinal"), F.lit("t").alias("title"), F.lit("s").alias("summary"), F.lit(None).cast("array<string>").alias("topics"), F.lit(None).cast("array<string>").alias("concepts"))
    return quality.table(quality.assess(c), "strategy")


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1")
def journal_once(spark, sf_dir):
    """Events streamed to a journal by two runs, the second of which finds nothing left."""
    ws = Workspace(spark, "journal")
    schema = read(spark, sf_dir, "events").schema
    for _ in range(2):
        events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream's plain path must be a folder
        store.sink(events, ws.path("table"), ws.path("checkpoint")).trigger(availableNow=True).start().awaitTermination()
    e = store.read(spark, ws.path("table"), schema)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"), F.round(F.sum("value"), 4).alias("value"))


# statutes made of documents: every third line begins a section, the others are its subsections, one of which refers elsewhere and one of which has a note
PIECES = f"""{LINES}, e AS (SELECT doc_id, pos, pos // 3 AS s, pos % 3 AS k, regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), '\\s+', ' ', 'g') AS raw FROM l),
x AS (SELECT doc_id, pos, s, k, trim(raw) AS t, count(*) OVER (PARTITION BY doc_id, s) - 1 AS subs FROM e)"""


def statutes_of(spark, sf_dir):
    x = lines(spark, sf_dir).withColumn("t", F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z0-9 ]", ""), r"\s+", " ")))
    k, s, t = F.col("pos") % 3, F.floor(F.col("pos") / 3).cast("string"), F.col("t")
    start = F.concat(F.when(F.col("pos") > 0, "</section>").otherwise(""), F.lit('<section eId="sec '), s, F.lit('"><num>'), s, F.lit("</num><content>"), t, F.lit("</content>"))
    one = F.concat(F.lit('<subsection><num>(a)</num><content>see <ref href="/id/'), s, F.lit('#x">'), F.left(t, F.lit(5)), F.lit("</ref></content></subsection>"))
    two = F.concat(F.lit("<subsection><content>"), t, F.lit("</content><note>"), F.left(t, F.lit(9)), F.lit("</note></subsection>"))
    piece = F.when(k == 0, start).when(k == 1, one).otherwise(two)
    d = x.select("doc_id", "pos", piece.alias("p")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda y: y["p"]), "").alias("b"))
    d = d.select("doc_id", F.concat(F.lit("<akomaNtoso><act><body>"), "b", F.lit("</section></body></act></akomaNtoso>")).alias("xml"), F.lit("https://law.example/base/").alias("url"))
    return statute_records.parse(d, "doc_id", "xml", "url")


@query(
    f"""WITH {PIECES} SELECT doc_id, (pos + 1)::INT AS ordinal, CASE k WHEN 0 THEN doc_id || '__sec_' || s WHEN 1 THEN doc_id || '__subsection__a' ELSE doc_id || '__subsection__' || (s + 1) || '_2' END AS node_id,
  CASE WHEN k > 0 THEN doc_id || '__sec_' || s END AS parent_id, (k > 0)::INT AS depth, CASE WHEN k = 0 THEN s + 1 ELSE k END::INT AS sibling, CASE WHEN k = 0 THEN (s + 1)::VARCHAR ELSE (s + 1) || '.' || k END AS path FROM x"""
)
def statute_paths(spark, sf_dir):
    """Nodes with their paths and places among siblings."""
    n = statute_records.records_of(statutes_of(spark, sf_dir), "doc_id", "nodes")
    return n.select("doc_id", "ordinal", "node_id", "parent_id", "depth", "sibling", F.array_join("path", ".").alias("path"))


@query(
    f"""WITH {PIECES}, r AS (SELECT doc_id, s, rtrim(left(t, 5)) AS anchor FROM x WHERE k = 1), n AS (SELECT *, doc_id || '__sec_' || s AS node_id, 1 AS i FROM r UNION ALL SELECT *, doc_id || '__subsection__a', 1 FROM r)
SELECT doc_id, node_id || '__REF_0001' AS reference_id, node_id, anchor, 'https://law.example/id/' || s || '#x' AS url, 'https://law.example/id/' || s AS page, 'x' AS fragment FROM n"""
)
def statute_references(spark, sf_dir):
    """References of each structural element around them."""
    return statute_records.records_of(statutes_of(spark, sf_dir), "doc_id", "refs").select("doc_id", "reference_id", "node_id", "anchor", "url", "page", "fragment")


@query(f"WITH {PIECES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS place, 'note' AS element, rtrim(left(t, 9)) AS text FROM x WHERE k = 2 AND t <> ''")
def statute_annotations(spark, sf_dir):
    return statute_records.records_of(statutes_of(spark, sf_dir), "doc_id", "annotations").select("doc_id", "place", "element", "text")


# metrics of a static benchmark over the rankings of three configurations, with labels and requirements made of keys
STATIC = """cf AS (SELECT 'lexical' AS config, query, id, rank FROM lex UNION ALL SELECT 'overlap', query, id, rank FROM ovl UNION ALL SELECT 'fused', query, id, rank FROM fused),
qr AS (SELECT DISTINCT query, id, CASE WHEN (query * 7 + id) % 5 < 4 THEN (query * 7 + id) % 5 END AS grade, [concat('r', id % 3), concat('r', 3 + id % 2)] AS supports, id % 2 = 0 AS binding, id % 4 <> 1 AS applicable FROM cf WHERE id % 11 <> 0),
nd AS (SELECT item_id AS query, unnest([concat('r', item_id % 3), 'r3']) AS requirement, 2 + item_id % 2 AS threshold, CASE WHEN item_id % 2 = 0 THEN 'binding_rule' ELSE 'guidance' END AS role FROM benchmark),
sj AS (SELECT cf.*, qr.* EXCLUDE (query, id), qr.id IS NOT NULL AS held FROM cf LEFT JOIN qr ON qr.query = cf.query AND qr.id = cf.id),
sa AS (SELECT config, query, count(*) AS results, count(*) FILTER (rank <= 10 AND grade IS NULL) AS unjudged, sum((pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) FILTER (rank <= 10) AS dcg, list_reverse_sort(list(coalesce(grade, 0)) FILTER (rank <= 10)) AS grades,
  max((rank <= 10 AND coalesce(grade, 0) >= 2)::INT) AS hit, max((rank <= 10 AND NOT coalesce(applicable, true) AND coalesce(grade, 0) >= 2)::INT) AS wrong, max(binding::INT) FILTER (rank = 1 AND held) AS fb FROM sj GROUP BY 1, 2),
sf AS (SELECT config, query, requirement, min(rank) AS first FROM (SELECT config, query, rank, grade, unnest(supports) AS requirement FROM sj) JOIN nd USING (query, requirement) WHERE grade >= threshold GROUP BY ALL),
sg AS (SELECT config, query, min(first) AS first, count(*) FILTER (first <= 5) AS m5, count(*) FILTER (first <= 10) AS m10 FROM sf GROUP BY ALL),
sc AS (SELECT query, count(*) AS total, max((role = 'binding_rule')::INT) AS binds FROM nd GROUP BY 1),
st AS (SELECT c.config, sc.query, coalesce(results, 0) AS results, coalesce(unjudged, 0) AS unjudged, round(CASE WHEN len(grades) > 0 THEN coalesce(dcg / nullif(list_sum(list_transform(grades, lambda y, i: (pow(2, y) - 1) / log2(i + 1))), 0), 0) END, 4) AS ndcg10, coalesce(hit, 0) AS hit10, round(coalesce(1.0::DOUBLE / first, 0), 4) AS mrr,
  round(coalesce(m5, 0)::DOUBLE / total, 6) AS coverage5, round(coalesce(m10, 0)::DOUBLE / total, 6) AS coverage10, (coalesce(m10, 0) = total)::INT AS complete10, CASE WHEN fb IS NOT NULL THEN CASE WHEN binds = 1 THEN fb ELSE 1 END END AS authority_first, coalesce(wrong, 0) AS regime_error
  FROM sc CROSS JOIN (SELECT DISTINCT config FROM cf) c LEFT JOIN sa ON sa.config = c.config AND sa.query = sc.query LEFT JOIN sg ON sg.config = c.config AND sg.query = sc.query)"""


def static_metrics(spark, sf_dir):
    ws = Workspace(spark, "static")
    own = channels(spark, sf_dir)
    own["fused"] = retrieve.fuse(own)
    runs = ws.table(together(df.select(F.lit(n).alias("config"), "query", "id", "rank") for n, df in own.items()), "runs")
    grade = (F.col("query") * 7 + F.col("id")) % 5
    name = lambda c: F.concat(F.lit("r"), c.cast("string"))
    qrels = runs.select("query", "id").distinct().where("id % 11 <> 0").select("query", "id", F.when(grade < 4, grade).alias("grade"), F.array(name(F.col("id") % 3), name(3 + F.col("id") % 2)).alias("supports"), (F.col("id") % 2 == 0).alias("binding"), (F.col("id") % 4 != 1).alias("applicable"))
    i = F.col("item_id")
    needs = read(spark, sf_dir, "benchmark").select(i.alias("query"), F.explode(F.array(name(i % 3), F.lit("r3"))).alias("requirement"), (2 + i % 2).alias("threshold"), F.when(i % 2 == 0, "binding_rule").otherwise("guidance").alias("role"))
    return benchmark_metrics.per_scenario(runs, qrels, needs)


@query(f"WITH {bm25_sql()}, {OVERLAP}, {STATIC} SELECT * FROM st")
def static_benchmark_scenarios(spark, sf_dir):
    return static_metrics(spark, sf_dir)


@query(f"WITH {bm25_sql()}, {OVERLAP}, {STATIC} SELECT config, count(*) AS n, {', '.join(f'round(avg({m}), 4) AS {m}' for m in benchmark_metrics.MEANS)} FROM st GROUP BY 1")
def static_benchmark_summary(spark, sf_dir):
    return benchmark_metrics.by_configuration(static_metrics(spark, sf_dir))


# expansion along some relations that leaves regimes and jurisdictions out
@query(
    """WITH e AS (SELECT doc_id AS source, doc_id + 1 AS target, CASE WHEN doc_id % 2 = 1 THEN 'CITES' ELSE 'HAS_CHUNK' END AS relation, 0.9::DOUBLE AS confidence FROM documents UNION ALL SELECT doc_id, doc_id + 7, 'REFERS_TO', 0.5::DOUBLE FROM documents),
h AS (SELECT item_id AS query, target AS node, max(confidence) AS confidence FROM benchmark JOIN e ON source = item_id * 5 WHERE relation IN ('CITES', 'REFERS_TO') AND target <> item_id * 5 GROUP BY 1, 2)
SELECT query, node, confidence FROM h JOIN documents ON doc_id = node WHERE (source IS NULL OR source NOT IN ('src0', 'src3')) AND (lang IS NULL OR lang NOT IN ('de'))"""
)
def expansion_exclusions(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    i = F.col("doc_id")
    e = d.select(i.alias("source"), (i + 1).alias("target"), F.when(i % 2 == 1, "CITES").otherwise("HAS_CHUNK").alias("relation"), F.lit(0.9).alias("confidence")).unionByName(d.select(i.alias("source"), (i + 7).alias("target"), F.lit("REFERS_TO").alias("relation"), F.lit(0.5).alias("confidence")))
    seeds = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), (F.col("item_id") * 5).alias("node"))
    found = graph.expand(seeds, graph.along(e, "CITES", "REFERS_TO"), 20)
    open_ = filters.allowed(F.col("source"), "src0", "src3") & filters.allowed(F.col("lang"), "de")
    return found.join(d.where(open_), F.col("node") == F.col("doc_id")).select("query", "node", "confidence")
