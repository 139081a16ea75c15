"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexmill.functions.batches import pieces

# The rules of the paper: suffix and what takes its place. Fixed values.
PLURALS = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
SECOND = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
THIRD = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
FOURTH = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

# A y after a consonant is a vowel and stands as Y while the steps run.
V, C = "[aeiouY]", "[^aeiouY]"
VOWEL = V
MEASURE_0 = f"^{C}*{V}+{C}"  # the measure is above 0
MEASURE_1 = f"^{C}*{V}+{C}+{V}+{C}"  # the measure is above 1
DOUBLE = "(" + "|".join(x * 2 for x in "bcdfghjkmnpqrtvwx") + ")$"  # but ll, ss and zz
SHORT = f"{C}{V}[^aeiouYwxy]$"




def suffixed(w: str, rules: list[tuple[str, str, str]]) -> str:
    """The longest suffix that the word has decides: it is replaced if the rest meets its pattern, else nothing happens."""
    for suffix, by, pattern in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            return rest + by if re.search(pattern, rest) else w
    return w


@functools.lru_cache(1 << 17)
def porter(w: str) -> str:
    """The stem of a lower-case word; words of other letters than a-z, or of fewer than three, stay."""
    if not re.fullmatch("[a-z]{3,}", w):
        return w
    w = suffixed(re.sub("([^aeiou])y", r"\1Y", w), [(s, by, "") for s, by in PLURALS])
    cut = suffixed(w, [("eed", "ee", MEASURE_0), ("ed", "+", VOWEL), ("ing", "+", VOWEL)])
    if cut.endswith("+"):
        w = cut[:-1]
        short = re.search(MEASURE_0, w) and not re.search(MEASURE_1, w) and re.search(SHORT, w)
        w = w + "e" if re.search("(at|bl|iz)$", w) else w[:-1] if re.search(DOUBLE, w) else w + "e" if short else w
    else:
        w = cut
    w = suffixed(w, [(s, "i", VOWEL) for s in "yY"])
    for rules in (SECOND, THIRD):
        w = suffixed(w, [(s, by, MEASURE_0) for s, by in rules])
    w = suffixed(w, [(s, "", f"(?=.*[st]$){MEASURE_1}" if s == "ion" else MEASURE_1) for s in FOURTH])
    if w.endswith("e") and (re.search(MEASURE_1, w[:-1]) or re.search(MEASURE_0, w[:-1]) and not re.search(SHORT, w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and re.search(MEASURE_1, w):
        w = w[:-1]
    return w.lower()


def with_stem(df: DataFrame, term: str, name: str = "stem") -> DataFrame:
    """Adds the stem of a column of lower-case words; null stays null. Meant for tables of distinct words."""
    at = df.columns.index(term)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if w is None else porter(w) for w in b.column(at).to_pylist()], pa.string())], names=[*b.schema.names, name])

    return df.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


def with_stems(df: DataFrame, columns: list[str]) -> DataFrame:
    """Arrays of words become arrays of their stems; each distinct word of a megabyte is stemmed once."""

    def stems(column: pa.Array) -> pa.Array:
        flat = column.flatten().dictionary_encode()
        own = pa.array([None if w is None else porter(w) for w in flat.dictionary.to_pylist()], pa.string())
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())].astype(np.int32)), own.take(flat.indices))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in pieces(batch)):
            yield pa.RecordBatch.from_arrays([stems(c) if n in columns else c for n, c in zip(b.schema.names, b.columns, strict=True)], names=b.schema.names)

    return df.mapInArrow(work, df.schema)
