"""Language identification with string kernels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.textkit import blocks

#: n-gram lengths of the blended spectrum, and bits of the presence space.
GRAMS, BITS = (1, 2, 3, 4), 16
#: Rows whose presence vectors are multiplied at once.
ROWS = 64
#: Characters of such rows, about.
CHARS = 1 << 18
#: Labelled rows that the driver holds at most, each 8 KB of presence, and bytes of their texts.
ROWS_KEPT, MOST_BYTES = 4000, 64 << 20
#: A text is foreign if its share of known n-grams is below FOREIGN times the labelled rows' share at this quantile.
LOW, FOREIGN = 0.01, 0.7
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point below 65,536 is a letter; later ones count as letters."""
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(1 << 16)]))
    return _LETTER[0]


def presence(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Presence vectors of the texts' n-grams, and whether each text has a letter.

    Texts are lower-cased, runs of other characters than letters become one blank, and each n-gram of
    the whole text sets its hashed place, each length with a hash of its own.
    """
    low = [t.lower() for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    letter = letters()[np.minimum(code, (1 << 16) - 1)] | (code >= 1 << 16)
    has = np.zeros(len(low), bool)
    has[row[letter]] = True
    keep = letter.copy()
    if len(keep):
        keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
        keep[0] = True
    code, row = np.where(letter, code, np.uint32(32))[keep], row[keep]
    out = np.zeros((len(low), 1 << bits), np.uint8)
    flat, base = out.reshape(-1), row.astype(np.int64) << bits
    h = code * np.uint32(0x9E3779B1)
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            h = h[:-1] * np.uint32(0x01000193) + code[n - 1 :] * np.uint32(0x85EBCA6B)
        if n in GRAMS and len(h):
            place = h ^ (h >> np.uint32(15))
            place = (place * np.uint32(0x2C1B3C6D + 2 * n)) >> np.uint32(32 - bits)
            inside = row[: len(h)] == row[n - 1 :]
            flat[base[: len(h)][inside] + place[inside]] = 1
    return out, has


class Presence:
    """Presence vectors of many texts, a bit a place; ``parts`` gives them a byte a place, ``ROWS`` at a time."""

    def __init__(self, texts: list[str]):
        self.bits, a = np.empty((len(texts), (1 << BITS) // 8), np.uint8), 0
        while a < len(texts):
            b, size = a + 1, len(texts[a])
            while b < min(len(texts), a + ROWS) and size + len(texts[b]) <= CHARS:
                size += len(texts[b])
                b += 1
            self.bits[a:b] = np.packbits(presence(texts[a:b])[0], axis=1)
            a = b

    def take(self, rows: np.ndarray) -> np.ndarray:
        return np.unpackbits(self.bits[rows], axis=1)

    def parts(self) -> Iterator[tuple[slice, np.ndarray]]:
        for a in range(0, len(self.bits), ROWS):
            yield slice(a, a + ROWS), np.unpackbits(self.bits[a : a + ROWS], axis=1)


@dataclass
class Model:
    """One column of ``weights`` for each label: the landmarks' presence rows times the dual solution.

    ``known`` has the n-grams of each label's rows, ``least`` the share of them that a text in a learned language has.
    """

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    known: np.ndarray
    least: float

    def shares(self, p: np.ndarray) -> np.ndarray:
        """Largest share of each presence row's n-grams that the rows of one label had. Unlike the responses, which sum to the same for any text, it falls for foreign ones."""
        both = p.astype(np.float32) @ self.known.astype(np.float32)
        return both.max(1, initial=0).astype(float) / np.maximum(p.sum(1, dtype=np.int64), 1)

    def scores(self, texts: list[str], seen: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        p, has = seen or presence(texts)
        norm = np.sqrt(np.maximum(p.sum(1, dtype=np.int64), 1)).astype(np.float32)
        return (p.astype(np.float32) @ self.weights) / norm[:, None] + self.bias, has

    def best(self, texts: list[str], seen: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[str], np.ndarray]:
        """Labels and scores; the best response, -1 to 1, is mapped to 0 to 1 and cut there. ``seen`` are the texts' presence vectors, if known."""
        response, has = self.scores(texts, seen)
        if not self.labels:
            return ["und"] * len(texts), np.zeros(len(texts))
        top = response.argmax(1)
        score = np.where(has, np.clip((response[np.arange(len(top)), top].astype(float) + 1) / 2, 0, 1), 0.0)
        return [self.labels[b] if h else "und" for b, h in zip(top, has, strict=True)], score


def fit(texts: list[str], labels: list[str], landmarks: int = 128, ridge: float = 1e-2) -> Model:
    """Kernel ridge regression, one label against the rest, on Nystrom features of the presence kernel.

    k(x, y) = shared n-grams / sqrt(n-grams of x * n-grams of y). Landmarks are dealt evenly to the labels,
    first rows first. With m landmarks the features are K_nm K_mm^(-1/2); because the kernel is a product of
    presence rows, the landmarks' rows times the dual solution give the same scores in one product.
    The least share of known n-grams is set from the labelled rows, each against the other rows of its label.
    """
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32), np.zeros((1 << BITS, 0), bool), 0.0)
    p = Presence(texts)
    n = len(texts)
    grams = np.concatenate([part.sum(1, dtype=np.int64) for _, part in p.parts()])
    norm = np.sqrt(np.maximum(grams, 1)).astype(np.float32)
    which = np.array([names.index(x) for x in labels])
    each = max(1, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(which == k)[:each] for k in range(len(names))])
    marks = p.take(chosen).astype(np.float32)
    marks /= norm[chosen][:, None]
    k_nm = np.concatenate([part.astype(np.float32) @ marks.T for _, part in p.parts()]).astype(np.float64) / norm[:, None]
    k_mm = (marks @ marks.T).astype(np.float64)
    value, vector = np.linalg.eigh(k_mm)
    good = value > 1e-6 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    z = np.hstack([k_nm @ root, np.ones((n, 1))])
    y = np.where(which[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = n / (len(names) * np.bincount(which, minlength=len(names))[which])  # labels count alike
    penalty = ridge * n * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve((z * weight[:, None]).T @ z + penalty, (z * weight[:, None]).T @ y)
    count = np.zeros((len(names), 1 << BITS), np.int32)
    for at, part in p.parts():
        for k in np.unique(which[at]):
            count[k] += part[which[at] == k].sum(0, dtype=np.int32)
    shared = count > 1
    own = np.concatenate([(part & shared[which[at]]).sum(1, dtype=np.int64) for at, part in p.parts()]) / np.maximum(grams, 1)
    least = FOREIGN * float(np.quantile(own, LOW))
    dual = root @ beta[:-1]
    weights = np.concatenate([(marks[:, a : a + 4096].T @ dual).astype(np.float32) for a in range(0, 1 << BITS, 4096)])
    return Model(names, weights, beta[-1].astype(np.float32), np.ascontiguousarray(count.T > 0), least)


def training_rows(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, seed: str, max_labels: int, most_bytes: int) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled rows: about ``per_label`` whole texts of every label, fewer where labels are many (ROWS_KEPT in all), chosen by a hash of the id.

    A label's texts have ``most_bytes`` by the number of labels together at most, and one text an eighth of that; longer ones are not learned from.
    """
    d = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in d.groupBy(label_col).count().limit(max_labels + 1).collect()}
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    if not counts:
        return [], []
    per_label, budget = max(1, min(per_label, ROWS_KEPT // len(counts))), most_bytes // len(counts)
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1 << 40))
    bound = F.coalesce(*(F.when(F.col(label_col) == k, F.lit(int(min(1.0, per_label / n) * (1 << 40)))) for k, n in counts.items()))
    size = F.octet_length(text_col)
    rows = d.where((draw < bound) & (size <= budget // 8)).select(F.col(label_col).alias("label"), draw.alias("draw"), F.col(text_col).alias("text"), size.alias("size"))
    rows = rows.withColumn("sum", F.sum("size").over(W.partitionBy("label").orderBy("draw", "text"))).where(F.col("sum") <= budget)  # about ``per_label`` rows
    rows = sorted((r[0], r[1], r[2]) for r in rows.select("label", "draw", "text").collect())
    return [r[2] for r in rows], [r[0] for r in rows]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` of whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for rows, _, _ in blocks(batches):
            for i in range(0, rows.num_rows, ROWS):
                part = rows.slice(i, ROWS)
                names, score = own.best([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def annotate(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("_lang_pred", "_lang_score", "_lang_share")) -> DataFrame:
    """All rows and columns with predicted label, score and share of known n-grams under ``names``, which the table must lack, in one pass without a join.

    Null and empty texts, and those without a letter, are ``und`` with score and share 0; equal responses take the first label in order; rows that repeat
    get the same; an empty table gives an empty result.
    """
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    names_out = [*docs.columns, *names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in blocks(batches, text_col):
            for i in range(0, rows.num_rows, ROWS):
                part = rows.slice(i, ROWS)
                texts = [t or "" for t in part.column(at).to_pylist()]
                seen = presence(texts)
                labels, score = sent.value.best(texts, seen)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(sent.value.shares(seen[0]), pa.float64())], names=names_out)

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 400, landmarks: int = 128, ridge: float = 1e-2, seed: str = "fit", max_labels: int = 500, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Learns the labels and predicts one for every whole text: ``(id, held_out, lang_pred, score)``.

    Learns from text and label of rows whose crc32(id) mod 3 is not 1, about ``per_label`` rows of each label
    and ``most_bytes`` of text (the bounds of the sample that the driver holds). Equal responses take the first label in order. ``und`` with score 0 for null text, text without a letter,
    or where nothing could be learned. Labels that are null are not learned; an empty table gives an empty
    result; rows that repeat give the same prediction; further columns are ignored.
    """
    model = learn(docs, id_col, text_col, label_col, per_label, landmarks, ridge, seed, max_labels, most_bytes)
    return predict(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 400, landmarks: int = 128, ridge: float = 1e-2, seed: str = "fit", max_labels: int = 500, most_bytes: int = MOST_BYTES) -> Model:
    return fit(*training_rows(docs.where(~held_out(id_col)), id_col, text_col, label_col, per_label, seed, max_labels, most_bytes), landmarks, ridge)
