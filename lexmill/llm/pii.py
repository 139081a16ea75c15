"""Personal data: base patterns, and identifiers found by bootstrapped contexts. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.plans.checkpoint import Workspace

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: The kind of identifiers that only the method finds.
SECRET = "secret"
# Patterns with the same leftmost matches as the plain ones, in time linear in the text: a match can begin at a run's
# start only (or where the last match ended), and no repetition gives anything back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Runs of words with a digit or an at sign: what may be an identifier.
TOKEN = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
CANDIDATE = rf"(?<![^\x20\x09-\x0D]){TOKEN}(?:\x20{TOKEN})*+"

# Words that name a secret, and beginnings of well-known ones. Fixed values.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "key", "access_key", "secret_key", "auth", "bearer", "credential", "credentials")
SECRET_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-")
#: What an unknown value weighs against a pattern, where a value of another kind weighs its score there.
UNKNOWN = 0.25

_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def located(text: str, pattern: str) -> Column:
    """Leftmost matches with their limits in code points and the text between them and their neighbours, from the matches and the gaps."""
    found, gaps = f"regexp_extract_all({text}, {quoted(pattern)}, 0)", f"split({text}, {quoted(pattern)}, -1)"
    return F.expr(
        f"""transform(array(named_struct('m', {found}, 'g', {gaps})), x -> aggregate(sequence(0, size(x.m) - 1), named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,before:string,after:string,value:string>>)),
        (a, i) -> named_struct('at', a.at + length(x.g[i]) + length(x.m[i]), 'out', concat(a.out, array(named_struct('start', a.at + length(x.g[i]), 'end', a.at + length(x.g[i]) + length(x.m[i]), 'before', x.g[i], 'after', x.g[i + 1], 'value', x.m[i])))), a -> a.out))[0]"""
    )


def _matches(kind: str, pattern: str, may: str) -> Column:
    rank = KINDS.index(kind)
    hits = F.when(F.expr(f"{may} AND text rlike {quoted(pattern)}"), located("text", pattern))
    hits = F.filter(hits, lambda x: _valid(kind, x["value"]))
    spans = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))
    return F.coalesce(spans, F.expr(f"cast(array() as array<{_SPAN}>)"))


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, "[.]"), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.call_function("luhn_check", F.translate(v, " -", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(v, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base``, the spans of all kinds by start and kind, to a table with ``text``."""
    found = [_matches("email", EMAIL, "instr(text, '@') > 0"), _matches("ip", IP, "instr(text, '.') > 0"), _matches("card", CARD, "true"), _matches("phone", PHONE, "instr(text, '+') > 0")]
    return docs.withColumns(dict(zip(KINDS, found, strict=True))).withColumn("base", F.array_sort(F.concat(*KINDS))).drop(*KINDS)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def contexts(before: Column, after: Column, first: Column) -> tuple[Column, Column]:
    """The two words before and the word after, whole and lower-cased; a mark stands for the text's start or the candidate before, and for the end."""
    blank = lambda c: F.regexp_replace(F.lower(c), r"[\x20\x09-\x0D]+", " ")
    left = F.concat(F.array(F.when(first, "^").otherwise("<n>")), _words(F.substring_index(blank(before), " ", -3)))
    right = F.concat(_words(F.substring_index(blank(after), " ", 2)), F.array(F.lit("$")))
    return F.concat(F.when(F.size(left) < 2, F.array(F.lit(""))).otherwise(F.expr("cast(array() as array<string>)")), F.slice(left, -F.least(F.lit(2), F.size(left)), F.lit(2))), F.element_at(right, 1)


def shape(value: Column) -> Column:
    """The value with a for runs of letters and 9 for digits: runs of up to four as one, up to nineteen one by one; a long mix of hexadecimal digits as its length."""
    hexadecimal = value.rlike("^[0-9a-fA-F]{16,}$") & value.rlike("[a-fA-F]") & value.rlike("[0-9]")
    out = F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), r"[0-9]", "9")
    out = F.regexp_replace(F.regexp_replace(out, r"(?<!9)9{1,4}(?!9)", "9"), r"9{20,}", "9+")
    return F.when(hexadecimal, F.concat(F.lit("hex"), F.length(value).cast("string"))).otherwise(out)


def seed_secret(left: Column, value: Column) -> Column:
    """Whether a value is a secret by its well-known beginning, or assigned to a word that names one."""
    strong = value.rlike(r"^[A-Za-z0-9+/_\-]{16,}={0,2}$") & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    named = F.array_contains(F.array(*map(F.lit, SECRET_WORDS)), F.regexp_replace(left[0], r"^[^a-z]+|[^a-z]+$", "")) & left[1].rlike(r"^(=|:|:=|=>|is)$")
    joined_ = F.array_contains(F.array(*map(F.lit, SECRET_WORDS)), F.regexp_replace(left[1], r"^[^a-z]+|[^a-z]+$", "")) & left[1].rlike("[:=]$")
    return strong & (value.rlike("^(" + "|".join(SECRET_STARTS) + ")") | named | joined_)


def score_patterns(facts: DataFrame, rounds: int, support: float, confidence: float, ws: Workspace, unknown: float = UNKNOWN) -> DataFrame:
    """Patterns with their kind and confidence, from ``(pattern, value, kind)`` facts, kind null where unknown.

    A pattern's mass in a kind is the sum of the scores of its distinct values; its confidence divides that by the masses of all kinds and
    ``unknown`` times its values without a score. A value's score is 1 for a seed of the kind, else 1 - prod(1 - confidence) over
    its patterns of ``support`` mass and ``confidence``. Both are computed in turn; each round is a written table. Counts are over distinct
    values, so copies of a document weigh nothing.
    """
    facts = ws.table(facts.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "facts")
    size = facts.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = ws.table(facts.where("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct(), "seeds")
    scores, patterns = seeds, None
    for k in range(rounds):
        mass = facts.select("pattern", "value").join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("scored"))
        whole = mass.groupBy("pattern").agg(F.sum("mass").alias("masses"), F.sum("scored").alias("scored")).join(size, "pattern")
        rest = F.greatest(F.lit(0), F.col("n") - F.col("scored"))
        patterns = mass.drop("scored").join(whole, "pattern").withColumn("confidence", F.col("mass") / (F.col("masses") + unknown * rest))
        patterns = ws.table(patterns.where((F.col("mass") >= support) & (F.col("confidence") >= confidence)).select("pattern", "kind", "confidence"), f"patterns-{k}")
        if k + 1 < rounds:
            new = facts.where("kind is null").select("pattern", "value").join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.product(1 - F.col("confidence"))).alias("score"))
            scores = ws.table(seeds.unionByName(new.join(seeds.select("value"), "value", "left_anti")), f"scores-{k}")
    return patterns


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, support: float = 2.0, confidence: float = 0.6, ws: Workspace | None = None) -> DataFrame:
    """``(id, base, found)``: arrays of spans (start, rank, end, kind, value) in code points, end exclusive.

    ``base`` has the validated matches of the four patterns, leftmost and non-overlapping for each kind, in whole texts.
    ``found`` has further identifiers among the runs of words with digits or at signs that hold no base span; their outer
    punctuation is cut. Secrets (well-known beginnings, or assigned to a word such as token) are seeds of a fifth kind, and found. Base spans and secrets induce
    patterns: the shape of a value with the two words before it, or with the word on each side.
    A candidate with a pattern of enough support and confidence is of that pattern's kind; of several, the most confident counts.
    Contexts are whole words. Null text counts as empty; empty texts have no spans; an empty table gives an empty result; rows
    that repeat give the same spans each; further columns are ignored.
    """
    ws = ws or Workspace(docs.sparkSession, "pii")
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = base_spans(d).withColumn("hash", F.xxhash64("text"))
    candidates = F.when(F.col("text").rlike("[0-9@]"), located("text", CANDIDATE))

    def slim(c: Column, i: Column) -> Column:
        left, right = contexts(c["before"], c["after"], i == 0)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), left.alias("left"), right.alias("right"), c["value"].alias("value"))

    d = ws.table(d.withColumn("candidates", F.transform(candidates, slim)).drop("text"), "spans")
    c = d.select("id", "hash", "base", F.explode("candidates").alias("c"))
    inside = F.filter("base", lambda s: (s["start"] < F.col("c.end")) & (s["end"] > F.col("c.start")))
    head = F.regexp_extract("c.value", r"^[^\p{L}\p{N}+(]*(?:[A-Za-z_\-]+[\"']?[:=]+[\"']?(?=[A-Za-z0-9+/_\-]{16}))?", 0)
    value = F.regexp_replace(F.substring(F.col("c.value"), F.length(head) + 1, F.length("c.value")), r"[^\p{L}\p{N})=]+$", "")
    glued = F.regexp_replace(F.lower(head), r"[^a-z_\-:=]", "")
    left = F.when(glued.rlike("[:=]"), F.array(F.col("c.left")[1], glued)).otherwise(F.col("c.left"))
    c = c.select("id", "hash", left.alias("left"), F.col("c.right").alias("right"), inside.alias("inside"), (F.col("c.start") + F.length(head)).alias("start"), value.alias("value")).where("value <> ''")
    base = F.col("inside")[0]
    secret = (F.size("inside") == 0) & seed_secret(F.col("left"), F.col("value"))
    c = c.withColumn("kind", F.when(F.size("inside") > 0, base["kind"]).when(secret, SECRET)).withColumn("known", F.when(F.size("inside") > 0, base["value"]).otherwise(F.col("value"))).drop("inside")
    parts = lambda kind, *cols: F.concat_ws("\t", F.lit(kind), *cols, shape(F.col("known")))
    patterns = F.array(parts("LL", F.col("left")[0], F.col("left")[1]), parts("LR", F.col("left")[1], F.col("right")))
    c = c.withColumn("patterns", patterns)
    scored = score_patterns(c.select(F.explode("patterns").alias("pattern"), F.col("known").alias("value"), "kind"), rounds, support, confidence, ws)
    new = c.where("kind is null").select("id", "hash", F.explode("patterns").alias("pattern"), "start", "value").join(scored.withColumnRenamed("kind", "as_kind"), "pattern")
    new = new.groupBy("id", "hash", "start", "value").agg(F.max(F.struct("confidence", "as_kind")).alias("best")).select("id", "hash", "start", "value", F.col("best.as_kind").alias("as_kind"))
    new = new.unionByName(c.where(F.col("kind") == SECRET).select("id", "hash", "start", "value", F.col("kind").alias("as_kind")).distinct())
    ranks = F.create_map(*(x for i, k in enumerate((*KINDS, SECRET)) for x in (F.lit(k), F.lit(i))))
    span = F.struct(F.col("start").cast("int").alias("start"), ranks[F.col("as_kind")].alias("rank"), (F.col("start") + F.length("value")).cast("int").alias("end"), F.col("as_kind").alias("kind"), "value")
    new = new.groupBy(F.col("id").alias("nid"), F.col("hash").alias("nhash")).agg(F.array_sort(F.collect_set(span)).alias("found"))
    d = d.join(new, F.col("id").eqNullSafe(F.col("nid")) & (F.col("hash") == F.col("nhash")), "left")
    return d.select(F.col("id").alias(id_col), "base", F.coalesce("found", F.expr(f"cast(array() as array<{_SPAN}>)")).alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "found"))).alias("spans"))
