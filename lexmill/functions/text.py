"""Text expressions: every function takes and returns columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in any script, the same in Java and RE2.
TOKEN = r"[\p{L}\p{N}_]+"
# Function words that carry no retrieval signal. Fixed values.
STOPWORDS = (
    "a an and are as at be been but by can could do does for from had has have how i if in into is it its may might must of on or "
    "should so such than that the their them then there these they this to under was we were what when where which who why will with would you your about any all"
).split()
# Instrument abbreviations and the names appended for them. Fixed values.
ALIASES = [
    (r"(?i)\bPCR\s?-?\s?2015\b", "Public Contracts Regulations 2015"),
    (r"(?i)\bPA\s?-?\s?2023\b", "Procurement Act 2023"),
    (r"(?i)\bPR\s?-?\s?2024\b", "Procurement Regulations 2024"),
    (r"(?i)\bUCR\s?-?\s?2016\b", "Utilities Contracts Regulations 2016"),
    (r"(?i)\bCCR\s?-?\s?2016\b", "Concession Contracts Regulations 2016"),
    (r"(?i)\bDSPCR\s?-?\s?2011\b", "Defence and Security Public Contracts Regulations 2011"),
    (r"(?i)\bFOIA\b", "Freedom of Information Act 2000"),
    (r"(?i)\bDPA\s?-?\s?2018\b", "Data Protection Act 2018"),
]
# Signals of the wanted regime. Fixed values.
LEGACY = r"pcr\s?2015|public contracts regulations 2015|2015 regulations|legacy|transitional|before the procurement act|old (?:procurement )?regime|pre-?2023|repealed|previously"
PLACEHOLDER = r"\[\[LINK_[0-9]{4}\]\]"


def clean(c: Column) -> Column:
    """Runs of blanks but newlines become one blank; outer white space goes."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \t\r\f\x0B]+", " "), r"^\s+|\s+$", "")


def normalised(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^ | $", ""))


def norm_hash(c: Column) -> Column:
    return F.sha1(normalised(c).cast("binary"))


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def repair(c: Column) -> Column:
    """Undoes layout artefacts in order; only white space changes. Look-behind, so not in RE2."""
    for pattern, by in ((r"(?<=\w)\n \n(?=\w)", " "), (r"[\t\r ]+", " "), (r"(?<=[a-z,;])\n(?=[a-z])", " "), (r"[  ]{2,}", " "), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, by)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def placeholders(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(PLACEHOLDER), F.lit(0))))


def strip_placeholders(c: Column) -> Column:
    return F.regexp_replace(c, PLACEHOLDER, "")


def tokens_by_length(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def tokens_by_words(c: Column) -> Column:
    return F.floor(F.regexp_count(c, F.lit(r"[^\s]+")) * 1.3).cast("long")


def band(tokens: Column) -> Column:
    out = F.when(tokens < 50, "0-50")
    for most, name in ((200, "50-200"), (500, "200-500"), (1000, "500-1k"), (3000, "1k-3k")):
        out = out.when(tokens < most, name)
    return out.otherwise("3k+")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def content_words(c: Column, least: int = 3) -> Column:
    """Distinct lower-case words of ``least`` letters at least, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(rf"[a-z][a-z\-]{{{least - 1},}}"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, STOPWORDS)))


def containment(part: Column, whole: Column) -> Column:
    """Share of the distinct ``part`` that ``whole`` has; 0 if it is empty."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def shingles(c: Column, n: int = 5) -> Column:
    """Distinct word n-grams; the words are bound once, as the element of an array of one."""
    grams = lambda w: F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))))
    return F.coalesce(F.transform(F.array(words(c)), grams)[0], F.array().cast("array<string>"))


def query_terms(c: Column) -> Column:
    """Search terms without stop words, or all terms where none is left."""
    terms = F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9][A-Za-z0-9\-']+"), F.lit(0))
    content = F.filter(terms, lambda t: ~F.lower(t).isin(STOPWORDS))
    return F.when(F.size(content) > 0, content).otherwise(terms)


def with_aliases(c: Column) -> Column:
    extra = [F.when(F.regexp_like(c, F.lit(p)) & ~F.contains(F.lower(c), F.lit(name.lower())), F.lit(name)) for p, name in ALIASES]
    return F.concat_ws(" ", c, *extra)


def regime_intent(c: Column) -> Column:
    legacy = F.regexp_like(c, F.lit(rf"(?i)\b({LEGACY})\b"))
    negated = F.regexp_like(c, F.lit(rf"(?i)\b(not|rather than|instead of|excluding|do not|don't|avoid)\b[^.?!]{{0,60}}?({LEGACY})"))
    return F.when(legacy & ~negated, "legacy_query").otherwise("current_query")


def regime(c: Column) -> Column:
    """Regime of a source by what its metadata mention, in this order."""
    low = F.lower(c)
    has = lambda *xs: F.greatest(*(F.contains(low, F.lit(x)) for x in (*xs, xs[0])))
    return F.when(has("public contracts regulations 2015", "pcr2015"), "PCR2015").when(has("procurement regulations 2024", "pr2024"), "PR2024").when(has("procurement act 2023", "pa2023"), "PA2023")


def locator_parts(c: Column) -> Column:
    """``83B(5)(b)(i)`` -> [83B, 5, b, i]."""
    head = F.regexp_extract(c, r"^\s*([0-9]+[A-Za-z]*)", 1)
    inner = F.transform(F.regexp_extract_all(c, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda x: F.trim(x))
    return F.filter(F.concat(F.array(head), inner), lambda x: x != "")


def locators(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(r"\b(?:section|regulation|schedule|part|article)\s+[0-9]+[a-z]?(?:\([^)]+\))*"), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def sentences(c: Column) -> Column:
    marked = F.regexp_replace(F.trim(c), r"([.?!])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


def ancestors(c: Column, sep: str = "-") -> Column:
    """Ids with trailing parts dropped, nearest first."""
    parts = F.split(c, sep)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), sep))).otherwise(F.array().cast("array<string>"))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Lower host, no fragment, single slashes, no trailing slash, sorted query without campaign keys."""
    start = F.lower(F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/+", "/"), "/$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: (x != "") & ~F.startswith(x, F.lit("utm_"))))
    return F.concat(start, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def instrument_url(url: Column) -> Column:
    plain = F.regexp_replace(F.lower(url), r"^https?://|#.*$", "")
    return F.regexp_replace(F.regexp_replace(plain, r"^www\.", ""), r"(/data\.xml|/contents|/made|/enacted)*/?$", "")


def safe_id(c: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_"), F.lit("_")), 1, 220)


def citation_key(c: Column) -> Column:
    low = F.regexp_replace(F.lower(c), r"[.,;:()\[\]]", " ")
    for long, short in ((r"\bsections?\b", "s"), (r"\bregulations?\b", "reg"), (r"\bschedules?\b", "sch"), (r"\bparagraphs?\b", "para")):
        low = F.regexp_replace(low, long, short)
    return F.trim(F.regexp_replace(low, r"\s+", " "))


def embedding_text(citation: Column, path: Column, title: Column, text: Column) -> Column:
    return F.concat_ws("\n\n", F.concat_ws("\n", citation, path, title), clean(strip_placeholders(text)))


def exclusive_text(text: Column, children: Column) -> Column:
    """A parent's text without the first occurrence of each child's text, in order; '' if no child is in it, the whole if there are no children.

    Every child is looked for in what the children before it left. Null texts count as empty, empty children are passed over.
    """
    whole = clean(F.coalesce(text, F.lit("")))

    def without(left: Column, child: Column) -> Column:
        c = clean(F.coalesce(child, F.lit("")))
        at = F.call_function("instr", left, c)
        return F.when((c != "") & (at > 0), clean(F.concat(F.left(left, at - 1), F.lit(" "), F.substr(left, at + F.length(c))))).otherwise(left)

    # a child that was found leaves less, or a blank in its place, so the text differs
    return F.when(F.coalesce(F.size(children), F.lit(0)) < 1, whole).otherwise(F.aggregate(children, whole, without, lambda left: F.when(left == whole, "").otherwise(left)))
