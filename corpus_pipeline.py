"""From documents to packed sequences: language, exact copies, near duplicates, mix, packing.

Every stage takes and returns whole tables, whatever further columns they have and whatever those are called; an empty table gives an
empty one. What a stage does with nulls, empty texts, ties and repeated rows is said in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import exact, langid, minhash, mixing, packing
from lexmill.llm.queries import table, vocabulary
from lexmill.plans.checkpoint import Workspace


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose text resembles none of the learned languages by its share of known n-grams.

    So null and empty texts go. A null label is not learned from, but the document stays if its text is known; repeated rows stay or go together; equal responses take the first label, which decides nothing here.
    """
    model = langid.learn(docs)
    pred, score, share = mixing.free_names(docs, "_lang_pred", "_lang_score", "_lang_share")
    found = langid.annotate(docs, model, names=(pred, score, share))
    return found.where((F.col(pred) != "und") & (F.col(share) >= model.least)).drop(pred, score, share)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: that with most code points, then the smallest id.

    Null and empty texts are one group, null ids come last, and of rows that repeat id and text one stays.
    """
    of, sha = mixing.free_names(docs, "_of", "_sha")
    kept = exact.exact_duplicates(docs).where("kept").select(F.col("doc_id").alias(of), F.col("text_sha256").alias(sha))
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.sha2(exact.normal(), 256) == F.col(sha))
    return docs.join(kept.hint("merge"), same).dropDuplicates([of, sha]).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: shingles of five words, similarity of 0.8 or more; the smallest id stays, null last.

    Texts without words, null ones too, are nobody's copies and stay. Rows that repeat an id are judged each by its text; those that repeat
    both stay or go together.
    """
    of, hashed = mixing.free_names(docs, "_of", "_hash")
    dropped = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(of), F.col("text_hash").alias(hashed))
    return docs.join(dropped, F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(hashed)), "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, documents repeated or cut as the mix takes them; quality by the labels.

    Documents of which nothing is taken go, so null and empty texts go. Null sources are one source; equal keys go by id; repeated rows are taken one by one.
    """
    return mixing.mixed_documents(docs, labels=table(spark, sf_dir, "labels")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 2048 tokens. Null and empty texts are one token; repeated rows are packed as often as they occur."""
    return packing.pack(docs, vocabulary())


STAGES = [("language_id", language), ("exact_dedup", exact_copies), ("minhash_near_dedup", near_copies), ("source_mix", mix), ("best_fit_packing", pack)]

#: Kernel regression and byte-pair encoding can't be said in SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = ws.table(docs, name)
    return docs
