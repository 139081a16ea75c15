"""Metrics of rankings against labels and requirements, audits, answers and their citations, costs and freezes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.text import containment, content_words
from lexmill.operators.evaluate import gain
from lexmill.plans.checkpoint import Workspace
from lexmill.plans.layout import together

# Classes of sources, and label states that count as final. Fixed values.
BINDING = ("PRIMARY_LEGISLATION", "SECONDARY_LEGISLATION")
OFFICIAL = (
    *BINDING, "OFFICIAL_GOVERNMENT_GUIDANCE", "OFFICIAL_TECHNICAL_GUIDANCE", "OFFICIAL_REGULATOR_GUIDANCE", "OFFICIAL_WORKFLOW", "PROCUREMENT_POLICY",
    "OFFICIAL_TRAINING", "OFFICIAL_SPECIALIST_GUIDANCE", "OFFICIAL_PA23_TECHNICAL_GUIDANCE", "OFFICIAL_PRACTICE_GUIDANCE",
)
FINAL = ("LLM_CONSENSUS_SILVER", "LLM_ADJUDICATED_SILVER", "HUMAN_REVIEWED", "TEST_FIXTURE", "LLM_SINGLE_JUDGE_SILVER")
# Citation marks, quotations and sentences of an answer. Fixed values.
MARKER, QUOTE, SENTENCE = r"\[E(\d+)\]", "[\"“]([^\"”]{12,})[\"”]", r"[^.!?]+[.!?]"

METRICS = ("requirement_coverage", "content_coverage", "scenario_complete", "mrr_first_sufficient", "hit_ge2", "pooled_ndcg", "precision_ge2_at_k", "binding_requirement_coverage", "official_requirement_coverage", "inapplicable_fraction_returned", "applicability_unknown_fraction")


def role_ok(authority: Column, policy: Column) -> Column:
    return F.when(policy == "BINDING_REQUIRED", authority.isin(*BINDING)).when(policy == "OFFICIAL_ALLOWED", authority.isin(*OFFICIAL)).otherwise(True)


def ranking_faults(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """``(query, fault, n)``: ids that a ranking repeats, labels that repeat, and of the first ``k`` rows those without a final label, of another text version, or with an impossible grade."""
    top = ranked.where(F.col("rank") <= k).join(qrels.select("query", "id", "status", "grade", F.col("sha").alias("label_sha"), F.lit(True).alias("_held")), ["query", "id"], "left")
    final = F.coalesce(F.col("_held") & F.col("status").isin(*FINAL), F.lit(False))
    count = lambda df, name: df.groupBy("query").agg(F.count("*").alias("n")).select("query", F.lit(name).alias("fault"), "n")
    twice = lambda df: df.groupBy("query", "id").count().where("count > 1")
    faults = [count(twice(ranked), "DUPLICATE_ID"), count(twice(qrels), "DUPLICATE_LABEL"), count(top.where(~final), "UNJUDGED"), count(top.where(final & ~F.col("sha").eqNullSafe(F.col("label_sha"))), "STALE_TEXT")]
    return together([*faults, count(top.where(final & ~F.coalesce(F.col("grade").between(0, 3), F.lit(False))), "INVALID_GRADE")])


def evaluate_ranking(ranked: DataFrame, qrels: DataFrame, supports: DataFrame, spec: DataFrame, k: int = 10, strict: bool = True) -> DataFrame:
    """The metrics of every query of ``spec``, one row each.

    ``ranked(query, id, rank, authority, sha)``; ``qrels(query, id, grade, applicability, status, sha)``; ``supports(query, id, requirement, support)``;
    ``spec(query, requirement, policy, mandatory, allow_conditional)``. Only FULL support by an applicable row meets a requirement (a conditional one where the
    requirement allows it): content coverage counts these, requirement coverage those of a source of the wanted role. A ranking with faults is
    an error, or with ``strict`` off is scored with its unjudged rows as grade 0. An empty ranking covers nothing.
    """
    if k < 1:
        raise ValueError("k must be positive")
    top = ranked.where(F.col("rank") <= k)
    final = qrels.where(F.col("status").isin(*FINAL))
    judged = top.join(final.select("query", "id", "grade", "applicability"), ["query", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    by_rank = judged.groupBy("query").agg(
        F.count("*").alias("returned"), F.max((F.col("grade") >= 2).cast("long")).alias("hit_ge2"), F.sum((F.col("grade") >= 2).cast("long")).alias("good"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"),
        F.sum((F.col("applicability") == "INAPPLICABLE").cast("long")).alias("wrong"), F.sum((F.col("applicability") == "UNKNOWN").cast("long")).alias("unknown"),
    )
    ideal = final.select("query", "grade", F.row_number().over(W.partitionBy("query").orderBy(F.desc("grade"))).alias("i")).where(F.col("i") <= k)
    ideal = ideal.groupBy("query").agg(F.sum(gain(F.col("grade"), F.col("i"))).alias("ideal"))
    wanted = spec.where(F.coalesce("mandatory", F.lit(True)))
    full = supports.where("support = 'FULL'").select("query", "id", "requirement")
    met = judged.join(full, ["query", "id"]).join(wanted, ["query", "requirement"])
    met = met.where((F.col("applicability") == "APPLICABLE") | (F.col("applicability") == "CONDITIONAL") & F.coalesce("allow_conditional", F.lit(False)))
    met = met.withColumn("ok", role_ok(F.coalesce("authority", F.lit("UNKNOWN")), F.col("policy")))
    of = met.groupBy("query", "requirement").agg(F.lit(1).alias("content"), F.max(F.col("ok").cast("int")).alias("strict"), F.min(F.when(F.col("ok"), F.col("rank"))).alias("first"))
    share = lambda policy: F.avg(F.when(F.col("policy") == policy, F.coalesce("strict", F.lit(0))))
    by_need = wanted.select("query", "requirement", "policy").join(of, ["query", "requirement"], "left").groupBy("query").agg(
        F.avg(F.coalesce("strict", F.lit(0))).alias("requirement_coverage"), F.avg(F.coalesce("content", F.lit(0))).alias("content_coverage"), F.min("first").alias("first"),
        share("BINDING_REQUIRED").alias("binding_requirement_coverage"), share("OFFICIAL_ALLOWED").alias("official_requirement_coverage"),
    )
    x = by_need.join(by_rank, "query", "left").join(ideal, "query", "left")
    if strict:
        faults = ranking_faults(ranked, qrels, k).groupBy("query").agg(F.array_join(F.array_sort(F.collect_set("fault")), ", ").alias("faults"))
        x = x.join(faults, "query", "left").withColumn("requirement_coverage", F.when(F.col("faults").isNotNull(), F.raise_error(F.concat(F.col("query").cast("string"), F.lit(": "), F.col("faults"))).cast("double")).otherwise(F.col("requirement_coverage")))
    none = F.coalesce("returned", F.lit(0))
    six = lambda c, name: F.round(c, 6).alias(name)
    return x.select(
        "query", none.cast("long").alias("returned"), six(F.col("requirement_coverage"), "requirement_coverage"), six(F.col("content_coverage"), "content_coverage"),
        (F.col("requirement_coverage") == 1).cast("long").alias("scenario_complete"), six(F.coalesce(1 / F.col("first"), F.lit(0.0)), "mrr_first_sufficient"),
        F.coalesce("hit_ge2", F.lit(0)).cast("long").alias("hit_ge2"), six(F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")), "pooled_ndcg"),
        six(F.coalesce("good", F.lit(0)) / k, "precision_ge2_at_k"), six(F.col("binding_requirement_coverage"), "binding_requirement_coverage"), six(F.col("official_requirement_coverage"), "official_requirement_coverage"),
        six(F.col("wrong") / F.col("returned"), "inapplicable_fraction_returned"), six(F.col("unknown") / F.col("returned"), "applicability_unknown_fraction"),
    )


def macro_summary(metrics: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """``(metric, mean, n_defined)``: means over the queries where a metric is defined."""
    x = metrics.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")).select("x.*")
    return x.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n_defined"))


def paired(scores: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """Each two configurations of ``(config, query, value)`` over the queries that both have: ``(a, b, n, delta, wins, losses)``, from b's side.

    The scores are written before they are joined with themselves: planned lazily, a union of branches with literals was read wrongly.
    """
    scores = (ws or Workspace(scores.sparkSession, "paired")).table(scores.where("value is not null").select("config", "query", "value"), "scores")
    x, y = (scores.select("query", F.col("config").alias(c), F.col("value").alias(f"v{c}")) for c in "ab")
    d = x.join(y, "query").where("a < b").withColumn("d", F.round(F.col("vb") - F.col("va"), 9))
    return d.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("delta"), F.sum((F.col("d") > 0).cast("long")).alias("wins"), F.sum((F.col("d") < 0).cast("long")).alias("losses"))


def error_category(diagnosis: Column, in_lexical: Column, in_dense: Column, regime_error: Column, suite: Column, needs_graph: Column, in_union: Column, in_final: Column) -> Column:
    """Why a query failed; the order of the tests matters."""
    unseen = ~in_lexical & ~in_dense
    return (
        F.when(diagnosis == "GENERATION_PROBLEM", F.when(unseen, "MISSING_CORPUS_EVIDENCE").otherwise("QUERY_UNDERSTANDING")).when(diagnosis == "RANKING_PROBLEM", "RANKING_FAILURE")
        .when(regime_error, "WRONG_REGIME").when(suite == "vocabulary_mismatch", "VOCABULARY_MISMATCH").when(needs_graph & in_union & ~in_final, "GRAPH_SEED_FAILURE").otherwise("OTHER")
    )


def claim_support(claims: DataFrame, evidence: DataFrame, threshold: float = 0.45) -> DataFrame:
    """``(answer, claim, best, overlap, grounded)``: the largest share of a claim's content words that one item has which it cites.

    Claims are ``(answer, claim, statement, cites)``, evidence ``(answer, id, text)``. A claim that cites nothing, or only unknown items, has overlap 0; of equal items the first by id counts.
    """
    c = claims.select("answer", "claim", content_words(F.col("statement")).alias("terms"), "cites")
    x = c.select("answer", "claim", "terms", F.explode("cites").alias("id")).join(evidence.select("answer", "id", content_words(F.col("text")).alias("own")), ["answer", "id"])
    best = x.groupBy("answer", "claim").agg(F.max(F.struct(containment(F.col("terms"), F.col("own")).alias("overlap"))).alias("m"))
    out = c.select("answer", "claim").join(best, ["answer", "claim"], "left").withColumn("overlap", F.coalesce("m.overlap", F.lit(0.0)))
    return out.select("answer", "claim", F.round("overlap", 3).alias("overlap"), (F.col("overlap") >= threshold).alias("grounded"))


def grounding_rate(support: DataFrame) -> DataFrame:
    """``(answer, claims, grounded, rate)``."""
    return support.groupBy("answer").agg(F.count("*").alias("claims"), F.sum(F.col("grounded").cast("long")).alias("grounded"), F.round(F.avg(F.col("grounded").cast("double")), 3).alias("rate"))


def verify(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Checks of an answer's citations, with no model: one row for each of ``(answer, text)``, against ``(answer, id, text)`` with ids E1, E2 and so on.

    Sentences of more than 25 characters should carry a mark (``format_pass``: four in five do). ``citations_valid``: some item is cited, none that wasn't supplied, and every quotation of 12
    characters or more stands in an item that is marked within 40 characters behind it, or in any cited one where there is no such mark.
    """
    items = evidence.groupBy("answer").agg(F.map_from_entries(F.collect_list(F.struct("id", F.lower("text")))).alias("items"))
    a = answers.select("answer", "text").join(items, "answer", "left")
    marks = lambda t: F.transform(F.regexp_extract_all(t, F.lit(MARKER), F.lit(1)), lambda n: F.concat(F.lit("E"), n))
    ids = F.coalesce(F.map_keys("items"), F.array().cast("array<string>"))
    long = F.filter(F.transform(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s)), lambda s: F.length(s) > 25)
    quotes, tails = F.regexp_extract_all("text", F.lit(QUOTE), F.lit(1)), F.slice(F.split("text", QUOTE, -1), 2, 1_000_000)
    a = a.withColumn("cited", F.array_distinct(marks(F.col("text")))).withColumn("ids", ids).withColumn("long", long)

    def fails(q: Column) -> Column:
        near = marks(F.substring(q["tail"], 1, 40))
        targets = F.when(F.size(near) > 0, near).otherwise(F.col("cited"))
        return (F.size(targets) > 0) & ~F.exists(targets, lambda t: F.contains(F.coalesce(F.try_element_at("items", t), F.lit("")), F.lower(F.trim(q["quote"]))))

    bad = F.size(F.filter(F.arrays_zip(quotes.alias("quote"), tails.alias("tail")), fails))
    a = a.withColumn("bad_quotes", bad).withColumn("with_mark", F.size(F.filter("long", lambda s: s.rlike(MARKER))))
    share = F.when(F.size("long") > 0, F.col("with_mark") / F.size("long"))
    invalid = F.size(F.array_except("cited", "ids"))
    used = F.size(F.array_intersect("cited", "ids"))
    n = lambda c: c.cast("long")
    return a.select(
        "answer", n(F.size("ids")).alias("supplied"), n(used).alias("used"), n(invalid).alias("invalid"), n(F.size("long")).alias("sentences"), n(F.col("with_mark")).alias("with_citation"), F.round(share, 3).alias("citation_coverage"),
        n(F.col("bad_quotes")).alias("bad_quotes"), F.coalesce(share >= 0.8, F.lit(False)).alias("format_pass"), ((invalid == 0) & (F.col("bad_quotes") == 0) & (used > 0)).alias("citations_valid"),
    )


def bundle_hash(ids: Column) -> Column:
    """The name of an ordered bundle: SHA-256 of its ids as a JSON list of strings."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(ids, lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('"'))), ","), F.lit("]")).cast("binary"), 256)


def pool(runs: DataFrame, depth: int = 20) -> DataFrame:
    """``(query, id, sha, systems)`` of the first ``depth`` rows of all runs ``(query, system, id, rank, sha)``; one id with two texts is an error."""
    g = together([runs.where(F.col("rank") <= depth)]).groupBy("query", "id").agg(F.min("sha").alias("sha"), F.count_distinct("sha").alias("n"), F.array_join(F.array_sort(F.collect_set("system")), "+").alias("systems"))
    return g.select("query", "id", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("one id with two texts: "), F.col("id").cast("string")))).otherwise(F.col("sha")).alias("sha"), "systems")


def judging_cost(pool_: DataFrame, text: str, judges: int, per_call: int, input_price: float, output_price: float, output_tokens: int) -> DataFrame:
    """``(calls, input_tokens, output_tokens, cost)`` of a pool: a call a row and judge, four characters a token, prices for a million tokens."""
    x = pool_.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"))
    calls = F.col("n") * judges
    tokens = F.floor(F.col("chars") / 4) * judges + calls * per_call
    return x.select(calls.cast("long").alias("calls"), tokens.cast("long").alias("input_tokens"), (calls * output_tokens).cast("long").alias("output_tokens"), F.round((tokens * input_price + calls * output_tokens * output_price) / 1e6, 6).alias("cost"))


def review_queue(judged: DataFrame) -> DataFrame:
    """Labels that a person should see: grade 3, confidence below a half, or no grade."""
    return judged.where("grade = 3 or confidence < 0.5 or grade is null")


def judgment_faults() -> Column:
    """What is wrong with a judgment ``(grade, confidence, applicability, rationale)``, as an array."""
    bad = [("GRADE", ~F.coalesce(F.col("grade").between(0, 3), F.lit(False))), ("CONFIDENCE", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))), ("APPLICABILITY", ~F.coalesce(F.col("applicability").isin("APPLICABLE", "CONDITIONAL", "INAPPLICABLE", "UNKNOWN"), F.lit(False))), ("RATIONALE", F.coalesce(F.trim("rationale"), F.lit("")) == "")]
    return F.array_compact(F.array(*(F.when(c, n) for n, c in bad)))


def split_audit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``(id, grp, split, text)``: groups that stand in both splits ``(grp)``, and pairs ``(dev, test)`` of equal texts across splits, by their lower-case letters and digits."""
    shared = rows.groupBy("grp").agg(F.count_distinct("split").alias("n")).where("n > 1").select("grp")
    plain = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), " ")
    x = rows.select("id", "split", plain.alias("plain"))
    same = x.where("split = 'dev'").select(F.col("id").alias("dev"), "plain").join(x.where("split = 'test'").select(F.col("id").alias("test"), "plain"), "plain")
    return shared, same.select("dev", "test")


def changed_since(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, change)`` between two manifests ``(path, sha256)``: CHANGED, MISSING or NEW."""
    x = frozen.select("path", F.col("sha256").alias("was")).join(now.select("path", F.col("sha256").alias("is")), "path", "full")
    change = F.when(F.col("is").isNull(), "MISSING").when(F.col("was").isNull(), "NEW").when(F.col("was") != F.col("is"), "CHANGED")
    return x.select("path", change.alias("change")).where("change is not null")


def unique_index(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table, or an error where a composite key repeats."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    checked = twice.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.concat_ws("|", *keys))).cast("long")).otherwise(F.col("_n")))
    return df.join(checked, keys).where("_n = 1").drop("_n")
