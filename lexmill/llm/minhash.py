"""Near duplicates by an inverted join of MinHash signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.cells import Forest, groups, in_cells
from lexmill.llm.shingles import exact_sets, shingle_sets, signature, text_key
from lexmill.llm.textkit import blocks, mix, ordered_id, own_id, string_bytes
from lexmill.operators.graph import connected_components
from lexmill.plans.checkpoint import Workspace
from lexmill.plans.skew import hot_join

#: Coordinates of a signature, and collisions from which a pair is a candidate. Two sets with a Jaccard similarity of
#: 0.8 have fewer than 14 of 32 with a probability near 1e-6.
COORDINATES, MATCHES = 32, 14
#: Members of a posting list, and shingles of a family, that one cell's block holds about.
LIST_BLOCK, FAMILY_BLOCK = 2048, 1_000_000


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, coordinates: int) -> DataFrame:
    """``(id, t, n, k, sig)``: set size, 128-bit name of the words in order, and signature (null for an empty set); ``t`` names the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches):
            sets = shingle_sets(data, at, width)
            full = [s for s in sets if len(s)]
            sig = iter(signature(full, coordinates))
            raw = data.tobytes()
            keys = [text_key(raw[a:b]) if len(x) else None for a, b, x in zip(at[:-1], at[1:], sets, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([next(sig).astype("<u8").tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["id", "t", "n", "k", "sig"],
            )

    return docs.select(ordered_id(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t")).mapInArrow(work, "id long, t long, n long, k binary, sig binary")


def postings(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """``(token, k)``: the prefix of every set's coordinate-value pairs, rarest first.

    Two sets with ``matches`` collisions share one of the first ``coordinates - matches + 1`` pairs of both in
    any common order. Pairs that one set alone has come first in it and need no posting, so that of the m others the
    first m - matches + 1 are posted, and a set with fewer than ``matches`` others has no candidate.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(coordinates, dtype=np.uint64))
        for batch in batches:
            sig = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), "<u8").reshape(-1, coordinates)
            token = mix(sig ^ salt).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(token), batch.column(0).take(pa.array(np.repeat(np.arange(len(sig)), coordinates)))], names=["token", "k"])

    tokens = classes.select("k", "sig").mapInArrow(work, "token long, k binary")
    common = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    own = tokens.join(common, "token").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("own"))  # at most ``coordinates`` each
    own = own.where(F.size("own") >= matches)
    return own.select("k", F.explode(F.slice("own", F.lit(1), F.size("own") - matches + 1)).alias("x")).select("x.token", "k")


def matches_of(sig: np.ndarray, matches: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row its later rows with ``matches`` equal coordinates: prefix merging of its rarest lists, skipping the others.

    A list has the rows with one value in one coordinate. Of a row's lists the ``matches - 1`` longest are never merged: a partner is on one of
    the others, which are merged from the row on; only rows met there are probed in the long ones. A caller may send rows that need no probe.
    """
    n, coordinates = sig.shape
    order = np.argsort(sig, axis=0, kind="stable")
    value = np.take_along_axis(sig, order, 0)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], 0)
    ends = np.full((n, coordinates), n)
    ends[:-1] = np.where(value[1:] != value[:-1], np.arange(1, n)[:, None], n)
    last = np.take_along_axis(np.minimum.accumulate(ends[::-1], 0)[::-1], place, 0)
    after = last - place  # rows of the list from this one on
    rare = np.argpartition(after, coordinates - matches, 1)[:, : coordinates - matches + 1]
    for i in range(n - 1):
        met = [order[place[i, c] + 1 : last[i, c], c] for c in rare[i] if after[i, c] > 1]
        if met:
            skip = yield i, (met := np.unique(np.concatenate(met)))
            met = met[~skip[met]]
            yield i, met[(sig[met] == sig[i]).sum(1) >= matches]


def candidate_links(posted: DataFrame, classes: DataFrame, matches: int, list_block: int) -> DataFrame:
    """Links ``(a, b)`` that join the same families as all pairs with ``matches`` collisions.

    The members of a posting list meet in cells; there collisions are counted by merging the members' own lists, and a cell gives
    a spanning forest of its pairs, not the pairs: a member that is in the tree already is skipped.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ("token", "cell")):
            keys, side = g["k"].to_pylist(), g["side"].to_numpy()
            sig = np.frombuffer(b"".join(x.as_py() for x in g["sig"]), "<u8").reshape(len(keys), -1)
            forest = Forest(len(keys))
            merging = matches_of(sig, matches)
            for i, _ in merging:
                _, found = merging.send((forest.root == forest.root[i]) | ((side == side[i]) & (side[i] != 0)))
                for j in found.tolist():
                    forest.link(i, j)
            if forest.edges:
                yield pa.RecordBatch.from_arrays([pa.array([keys[e[x]] for e in forest.edges], pa.binary()) for x in (0, 1)], names=["a", "b"])

    cells = in_cells(posted.join(classes.select("k", "sig"), "k"), "token", "k", F.lit(1), list_block)
    return cells.select("token", "cell", "side", "k", "sig").mapInArrow(work, "a binary, b binary").distinct()


def confirmed_links(families: DataFrame, width: int, matches: int, percent: int, family_block: int) -> DataFrame:
    """Links ``(a, b)`` that join the same components as all pairs of a family that are similar enough on their full sets.

    A pair of a family counts if it has ``matches`` collisions and 100 * intersection >= ``percent`` * union; shingles are compared as words, not as hashes. Members of one tree
    of a cell's forest aren't compared again.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ("family", "cell")):
            keys, side = g["k"].to_pylist(), g["side"].to_numpy()
            sets = exact_sets(*string_bytes(g["text"]), width)
            sig = np.frombuffer(b"".join(x.as_py() for x in g["sig"]), "<u8").reshape(len(keys), -1)
            size = np.array([len(s) for s in sets])
            begin = np.concatenate([[0], np.cumsum(size)])
            value, number = np.unique(np.concatenate(sets), return_inverse=True)
            mark, forest = np.zeros(len(value), bool), Forest(len(keys))
            number = number.astype(np.int32)
            for i in range(len(keys) - 1):
                a, b = np.minimum(size[i + 1 :], size[i]), np.maximum(size[i + 1 :], size[i])
                hit = (100 * a >= percent * b) & ((side[i + 1 :] != side[i]) | (side[i] == 0)) & (forest.root[i + 1 :] != forest.root[i])
                js = np.flatnonzero(hit)
                js = js[(sig[i + 1 + js] == sig[i]).sum(1) >= matches] + i + 1
                if not len(js):
                    continue
                own = number[begin[i] : begin[i + 1]]
                mark[own] = True
                for j in js:
                    if forest.root[i] != forest.root[j]:
                        both = int(np.count_nonzero(mark[number[begin[j] : begin[j + 1]]]))
                        if 100 * both >= percent * (size[i] + size[j] - both):
                            forest.link(i, int(j))
                mark[own] = False
            if forest.edges:
                yield pa.RecordBatch.from_arrays([pa.array([keys[e[x]] for e in forest.edges], pa.binary()) for x in (0, 1)], names=["a", "b"])

    cells = in_cells(families, "family", "k", F.col("n"), family_block)
    return cells.select("family", "cell", "side", "k", "sig", "text").mapInArrow(work, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES, list_block: int = LIST_BLOCK, family_block: int = FAMILY_BLOCK, ws: Workspace | None = None) -> DataFrame:
    """Components of near duplicates: ``(id, n_shingles, component_id, kept, text_hash)``, one row per row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z; a text's set has its distinct shingles of ``width`` words, or
    its whole sequence where it has fewer. Texts are linked if 100 * intersection >= ``percent`` * union on full sets,
    and a component has the smallest id that links reach. Texts of the same words in order are one class, so copies are compared
    once. Classes are posted under their rarest signature coordinates; classes with ``matches`` collisions form families; the
    full sets of a family's members are compared in cells. Null and empty texts, and those without
    words, have n_shingles 0 and are linked with nothing, also not with one another. Ids are integers, null larger than any other. An empty table gives an empty result; rows that repeat are
    linked, and all that repeat the smallest id are kept; further columns are ignored.
    """
    ws = ws or Workspace(docs.sparkSession, "minhash")
    own = ws.table(signatures(docs, id_col, text_col, width, coordinates), "signatures")
    classes = ws.table(own.where("k is not null").groupBy("k").agg(F.min(F.struct("id", "t")).alias("rep"), F.min("n").alias("n"), F.min("sig").alias("sig"), F.count("*").alias("rows")), "classes")
    posted = ws.table(postings(classes, coordinates, matches), "postings")
    near = ws.table(candidate_links(posted, classes, matches, list_block), "near")
    families = connected_components(near, ws, "family").select(F.col("node").alias("k"), F.col("component").alias("family"))
    members = ws.table(families.join(classes.select("k", "rep", "n", "sig"), "k"), "members")
    texts = docs.select(ordered_id(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    texts = members.select("k", "family", "n", "sig", "rep.id", "rep.t").hint("merge").join(texts, ["id", "t"]).dropDuplicates(["k"])
    links = ws.table(confirmed_links(texts, width, matches, percent, family_block), "links")
    found = connected_components(links, ws, "component")
    found = ws.table(classes.select("k", "rep.id").join(found.withColumnRenamed("node", "k"), "k"), "found")
    least = found.groupBy("component").agg(F.min("id").alias("component_id"))
    found = found.join(least, "component").select("k", F.col("component_id").alias("linked"))
    alone = classes.select("k", F.col("rep.id").alias("alone"))
    named = ws.table(alone.join(found, "k", "left").join(classes.select("k", "rows"), "k").select(F.col("k").alias("of"), F.coalesce("linked", "alone").alias("least"), "rows"), "named")
    result = hot_join(own.select("id", "n", "k", "t"), named, "k", "of", "rows", "id").withColumn("component_id", F.coalesce("least", "id"))
    return result.select(own_id("id").alias(id_col), F.col("n").alias("n_shingles"), own_id("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"), F.col("t").alias("text_hash"))
