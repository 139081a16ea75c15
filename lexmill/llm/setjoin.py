"""Similarity join of shingle sets: fixed-size subsets of small sets, inverted lists of large ones, with the boundary chosen by cost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.cells import Forest, groups, in_cells
from lexmill.llm.shingles import exact_sets, shingle_sets, text_key
from lexmill.llm.textkit import blocks, give_back, mix, ordered_id, own_id, string_bytes
from lexmill.operators.graph import connected_components
from lexmill.plans.checkpoint import Workspace
from lexmill.plans.skew import hot_join

#: Members of a subset of a small set.
SUBSET = 2
#: Boundaries between small and large that are weighed, in tokens that a set posts.
BOUNDS = (0, 4, 8, 16, 32, 64, 128, 256)
#: Costs of an enumerated subset, of a row on an inverted list and of a pair of its rows: microseconds of a core, as measured on two corpora of 50,000 texts.
SUBSET_COST, ROW_COST, PAIR_COST = 10.0, 30.0, 0.08
#: Members of a list, and shingles of a family, that one cell's block holds about.
LIST_BLOCK, FAMILY_BLOCK = 2048, 1_000_000
#: Bits of a set's parity map.
BITS = 1024
#: Lists of up to SHORT members are compared at once, those of about CHUNK rows; longer ones one by one, as members that are joined already needn't be compared.
SHORT, CHUNK = 12, 1 << 15


def overlap(n, percent: int):
    """Least intersection that a set of ``n`` has with any set that it is linked with, and so a partner's least size."""
    return -(-percent * n // 100)


def required(n, percent: int):
    """Tokens that two linked sets of ``n`` or more share of the prefixes that ``prefix`` gives: all tokens by which a set may differ, again, and ``SUBSET`` where its overlap has as many."""
    t = overlap(n, percent)
    return np.minimum(t, np.maximum(SUBSET, n - t))


def prefix(n, percent: int):
    """Length of a set's prefix. Two sets with t tokens in common, one common order and any r <= t share r of their first (size - t + r) tokens."""
    return n - overlap(n, percent) + required(n, percent)


def prefixes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """``(id, t, n, k, tokens, bits)``: set size, 128-bit name of the words in order, prefix by hash and parity map; ``t`` names the text. ``k`` is null for an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches):
            sets = shingle_sets(data, at, width)
            raw = data.tobytes()
            keys = [text_key(raw[a:b]) if len(x) else None for a, b, x in zip(at[:-1], at[1:], sets, strict=True)]
            first = [s[: int(prefix(len(s), percent))].view(np.int64) for s in sets]
            size = np.array([len(x) for x in first])
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate(first)))
            bits = [np.packbits(np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), tokens, pa.array(bits, pa.binary())], names=["id", "t", "n", "k", "tokens", "bits"])

    return docs.select(ordered_id(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t")).mapInArrow(work, "id long, t long, n long, k binary, tokens array<long>, bits binary")


def common_tokens(classes: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """``(k, n, r)``: the tokens that a set posts, rarest first.

    A token of one set alone is shared with nothing and goes; so does a set with fewer tokens left than a partner must share with it. Of m tokens that are left and q that must be
    shared, two sets have one in common among the first m - q + 1, and ``SUBSET`` among the first m - q + ``SUBSET``.
    """
    tokens = classes.select("k", "n", F.explode("tokens").alias("token"))
    counts = ws.table(tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1").select(F.col("token").alias("of"), F.col("f").alias("rows"), "f"), "counts")
    own = hot_join(tokens, counts, "token", "of", "rows", "k").where("f is not null")
    own = own.groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("own"))  # a set's prefix at most
    least = F.ceil(F.col("n") * percent / 100).cast("long")
    met = F.ceil(least * percent / 100).cast("long")
    need = F.least(met, F.greatest(F.lit(SUBSET), least - met))
    own = own.withColumn("need", need).where(F.size("own") >= F.col("need"))
    return own.select("k", "n", F.transform(F.slice("own", F.lit(1), (F.size("own") - F.col("need")).cast("int") + SUBSET), lambda x: x["token"]).alias("r"))


def boundary(posted: DataFrame) -> int:
    """The bound of ``BOUNDS`` with the least cost: sets that post no more tokens are small. One aggregation; the driver gets a number for each bound."""
    size = F.size("r")
    tokens = posted.select(size.alias("s"), F.explode("r").alias("token")).groupBy("token").agg(F.count("*").alias("f"), *(F.sum((F.col("s") > b).cast("long")).alias(f"l_{b}") for b in BOUNDS))
    lists = tokens.agg(*(F.sum(F.when(F.col(f"l_{b}") > 0, F.col("f") * ROW_COST + F.col(f"l_{b}") * F.col("f").cast("double") * PAIR_COST)).alias(f"b_{b}") for b in BOUNDS)).first()
    subsets = posted.agg(*(F.sum(F.when(size <= b, size.cast("double") * (size - 1) / 2 * SUBSET_COST)).alias(f"b_{b}") for b in BOUNDS)).first()
    return min(BOUNDS, key=lambda b: (lists[f"b_{b}"] or 0) + (subsets[f"b_{b}"] or 0))


def subset_links(small: DataFrame, ws: Workspace) -> DataFrame:
    """Links ``(a, b)`` from every small set to the first set of each subset that it has: as many as subsets, and joining the same families as all pairs with a subset in common."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, r in ((batch.column(0).slice(i, 1), batch.column(1)[i].values.to_numpy()) for i in range(batch.num_rows)):
                x = r.astype(np.int64).view(np.uint64)
                i, j = np.triu_indices(len(x), 1) if len(x) > 1 else (np.zeros(1, np.int64), np.zeros(1, np.int64))  # a set of one shingle is its own subset
                subset = mix(mix(x[i]) + x[j])
                yield pa.RecordBatch.from_arrays([pa.array(subset.view(np.int64)), keys.take(pa.array(np.zeros(len(i), np.int64)))], names=["subset", "k"])

    subsets = small.select("k", "r").mapInArrow(work, "subset long, k binary")
    first = ws.table(subsets.groupBy("subset").agg(F.min("k").alias("a"), F.count("*").alias("rows")).where("rows > 1").withColumnRenamed("subset", "of"), "subsets")
    return hot_join(subsets, first, "subset", "of", "rows", "k").where("a is not null AND a <> k").select("a", F.col("k").alias("b")).distinct()


def alike(n: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs ``(i, j)`` may be linked: sizes fit, and no more parities differ than elements may."""
    a, b = n[i], n[j]
    fit = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    at = np.flatnonzero(fit)
    both = (a + b)[at]
    fit[at] = np.bitwise_count(bits[j[at]] ^ bits[i[at]]).sum(1, dtype=np.int64) <= both - 2 * -(-percent * both // (100 + percent))
    return fit


def alike_to(n: np.ndarray, bits: np.ndarray, i: int, js: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``js`` that ``alike`` lets pair with ``i``."""
    a, b = int(n[i]), n[js]
    js = js[(100 * b >= percent * a) & (percent * b <= 100 * a)]
    if not len(js):
        return js
    both = a + n[js]
    return js[np.bitwise_count(bits[js] ^ bits[i]).sum(1, dtype=np.int64) <= both + 2 * (-percent * both // (100 + percent))]


def pivots(root: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Members to compare, each with those of other trees that weren't given before; the caller joins trees in ``root`` as it finds links.

    Only members outside the largest tree so far are given: a pair that isn't given ends in one tree. So a list of near copies takes a few comparisons with all its members.
    """
    done = np.zeros(len(root), bool)
    while True:
        left = root != np.bincount(root).argmax()
        left &= ~done
        i = int(left.argmax())
        if not left[i]:
            return
        done[i] = True
        yield i, np.flatnonzero((root != root[i]) & ~done)


def chunks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of rows with equal keys of sorted batches, about ``rows`` rows at once, and the runs' limits."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        t = pa.Table.from_batches(held).combine_chunks()
        at = [t[k].to_numpy() for k in keys]
        limits = np.r_[0, np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], 0)) + 1]
        held.clear()
        if not last:
            held.extend(t.slice(int(limits[-1])).to_batches())
            t = t.slice(0, int(limits[-1]))
        else:
            limits = np.r_[limits, len(t)]
        if len(t):
            yield t.combine_chunks(), limits

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(x.num_rows for x in held) >= rows:
                yield from cut(False)
    if held:
        yield from cut(True)
    give_back()


def _bits(g: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(g["bits"].to_pylist()), np.uint64).reshape(g.num_rows, -1)


def _edges(keys: list[bytes], forest: Forest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([keys[e[x]] for e in forest.edges], pa.binary()) for x in (0, 1)], names=["a", "b"])


def list_links(posted: DataFrame, classes: DataFrame, bound: int, percent: int, list_block: int) -> DataFrame:
    """Links ``(a, b)`` that join the same families as all pairs of a list with a large set in it, whose sizes and parity maps fit.

    Every set is posted under the tokens of which it shares one with each partner. The members of a list meet in cells; a cell gives a spanning forest of its pairs, and
    members of one tree aren't compared again. Two small sets are left to their subsets.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, limits in chunks(batches, ("token", "cell"), CHUNK):
            side, n, large, bits = g["side"].to_numpy(), g["n"].to_numpy(), g["large"].to_numpy(), _bits(g)
            end = np.repeat(limits[1:], np.diff(limits))
            few = np.repeat(np.diff(limits) <= SHORT, np.diff(limits))
            found = [np.zeros((2, 0), np.int64)]

            def open_(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                return (large[j] | large[i]) & ((side[j] != side[i]) | (side[i] == 0))  # noqa: B023

            for d in range(1, SHORT):
                i = np.flatnonzero(few & (np.arange(len(n)) + d < end))
                i = i[open_(i, i + d)]
                i = i[alike(n, bits, i, i + d, percent)]
                found.append(np.stack([i, i + d]))
            for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
                if b - a > SHORT:
                    root, trees, size, own, big, part = np.arange(b - a), [], n[a:b], bits[a:b], large[a:b], side[a:b]
                    for i, js in pivots(root):
                        if part[i]:
                            js = js[part[js] != part[i]]
                        js = alike_to(size, own, i, js if big[i] else js[big[js]], percent)
                        if len(js):
                            each, first = np.unique(root[js], return_index=True)
                            trees.append(np.stack([np.full(len(first), i), js[first]]))
                            joined = np.zeros(b - a, bool)
                            joined[each] = True
                            root[joined[root]] = root[i]
                    found += [t + a for t in trees]
            edges = np.concatenate(found, 1)
            name = g["k"].combine_chunks().dictionary_encode()
            code = np.sort(name.indices.to_numpy()[edges].astype(np.int64), 0)
            code = np.unique(code[0] * len(name.dictionary) + code[1])  # a pair on several lists
            if len(code):
                yield pa.RecordBatch.from_arrays([name.dictionary.take(pa.array(x)) for x in (code // len(name.dictionary), code % len(name.dictionary))], names=["a", "b"])

    own = posted.select("k", "n", (F.size("r") > bound).alias("large"), F.explode(F.slice("r", F.lit(1), F.greatest(F.lit(1), F.size("r") - SUBSET + 1))).alias("token"))
    wanted = own.where("large").select(F.col("token").alias("t")).distinct()
    members = own.where("large").unionByName(own.where("not large").join(wanted, F.col("token") == F.col("t"), "left_semi"))
    cells = in_cells(members.join(classes.select("k", "bits"), "k"), "token", "k", F.lit(1), list_block)
    return cells.select("token", "cell", "side", "k", "n", "large", "bits").mapInArrow(work, "a binary, b binary").distinct()


def _compared(width: int, percent: int):
    """Links between the members of a cell that full sets confirm, word by word; members that are joined already, or on one side, aren't compared."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ("family", "cell")):
            keys, side, bits = g["k"].to_pylist(), g["side"].to_numpy(), _bits(g)
            sets = exact_sets(*string_bytes(g["text"]), width)
            n = np.array([len(s) for s in sets])
            begin = np.concatenate([[0], np.cumsum(n)])
            value, number = np.unique(np.concatenate(sets), return_inverse=True)
            mark, forest, number = np.zeros(len(value), bool), Forest(len(keys)), number.astype(np.int32)
            joined = g["joined"].combine_chunks().dictionary_encode().indices.to_numpy()
            forest.root = np.unique(joined, return_index=True)[1][joined]
            for i, js in pivots(forest.root):
                js = js[(side[js] != side[i]) | (side[i] == 0)]
                js = alike_to(n, bits, i, js, percent)
                own = number[begin[i] : begin[i + 1]]
                mark[own] = True
                for j in js.tolist():
                    if forest.root[i] != forest.root[j]:
                        both = int(np.count_nonzero(mark[number[begin[j] : begin[j + 1]]]))
                        if 100 * both >= percent * (n[i] + n[j] - both):
                            forest.link(i, j)
                mark[own] = False
            if forest.edges:
                yield _edges(keys, forest)

    return work


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.select("family", "cell", "side", "k", "bits", "joined", "text").repartition("family", "cell").sortWithinPartitions("family", "cell")


def confirmed_links(members: DataFrame, width: int, percent: int, family_block: int, ws: Workspace) -> DataFrame:
    """Links ``(a, b)`` that join the same components as all pairs of a family that full sets confirm.

    A family is dealt into blocks of about ``family_block`` shingles, each with the family's two leaders, the members with the least and the greatest name. First each block is compared within
    itself, which joins near copies of a leader across blocks; work is linear in the family. Then only members outside the family's largest component meet the other blocks.
    """
    work, schema = _compared(width, percent), "a binary, b binary"
    sums = members.groupBy("family").agg(F.sum("n").alias("w"), F.count("*").alias("rows"), F.min("k").alias("low"), F.max("k").alias("high")).where("rows > 1")
    sums = ws.table(sums.select(F.col("family").alias("of"), "rows", F.ceil(F.col("w") / family_block).cast("int").alias("blocks"), "low", "high"), "sums")
    m = hot_join(members, sums, "family", "of", "rows", "k").where("blocks is not null").withColumn("cell", F.pmod(F.xxhash64("k", F.lit("block")), F.col("blocks")).cast("int"))
    leads = (F.col("blocks") > 1) & ((F.col("k") == F.col("low")) | (F.col("k") == F.col("high")))
    every = F.when(leads, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("cell"))
    inside = m.withColumn("cell", F.explode(every)).withColumn("side", F.lit(0)).withColumn("joined", F.col("k"))
    links = ws.table(_dealt(inside).mapInArrow(work, schema).distinct(), "links-1")
    if not sums.where("blocks > 1").limit(1).count():
        return links
    part = connected_components(links, ws, "part").withColumnRenamed("node", "k")
    wide = ws.table(m.where("blocks > 1").select("k", "family", "n", "bits", "text", "blocks").join(part, "k", "left").withColumn("joined", F.coalesce("component", "k")).drop("component"), "wide")
    sizes = wide.groupBy("family", "joined").agg(F.sum("n").alias("w"))
    main = sizes.groupBy(F.col("family").alias("of")).agg(F.max_by("joined", F.struct("w", "joined")).alias("main"), F.count("*").alias("rows"), F.sum("w").alias("w"), F.max("w").alias("most")).where("rows > 1")
    main = ws.table(main.select("of", "rows", "main", F.greatest(F.lit(1), F.ceil((F.col("w") - F.col("most")) / family_block)).cast("int").alias("outer")), "main")
    far = hot_join(wide, main, "family", "of", "rows", "k").where("main is not null")
    at = lambda name, n: F.pmod(F.xxhash64("k", F.lit(name)), F.col(n)).cast("int")
    outer = far.where("joined <> main").withColumn("o", at("outer", "outer")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    inner = far.withColumn("i", at("inner", "blocks")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("outer") - 1))).withColumn("side", F.lit(2))
    met = outer.unionByName(inner).withColumn("cell", F.col("o") * F.col("blocks") + F.col("i"))
    more = ws.table(_dealt(met).mapInArrow(work, schema).distinct(), "links-2")
    return links.unionByName(more)


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bound: int | None = None, list_block: int = LIST_BLOCK, family_block: int = FAMILY_BLOCK, ws: Workspace | None = None) -> DataFrame:
    """Components of texts whose shingle sets are similar: ``(id, n_shingles, component_id)``, one row per row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z; a text's set has its distinct shingles of ``width`` words, or its whole sequence where it has fewer. Texts are linked if
    100 * intersection >= ``percent`` * union, which full sets confirm, and a component has the smallest id that links reach. Texts of the same words in order are one class. A class keeps a prefix of its
    set, and of that the tokens which other classes have, rarest first. Classes with up to ``bound`` of them (by cost, if not given) enumerate their subsets of two; the others are compared along inverted
    lists with all classes on them. Null and empty texts, and those without words, have n_shingles 0 and are linked with nothing, also not with one another. Ids are integers, null larger than any other.
    An empty table gives an empty result; rows that repeat are linked; further columns are ignored.
    """
    ws = ws or Workspace(docs.sparkSession, "setjoin")
    own = ws.table(prefixes(docs, id_col, text_col, width, percent), "prefixes")
    classes = own.where("k is not null").groupBy("k").agg(F.min(F.struct("id", "t")).alias("rep"), F.min("n").alias("n"), F.first("tokens").alias("tokens"), F.first("bits").alias("bits"), F.count("*").alias("rows"))
    classes = ws.table(classes, "classes")
    posted = ws.table(common_tokens(classes, percent, ws), "posted")
    bound = boundary(posted) if bound is None else bound
    met = subset_links(posted.where(F.size("r") <= bound), ws).unionByName(list_links(posted, classes, bound, percent, list_block))
    families = connected_components(ws.table(met, "met"), ws, "family").select(F.col("node").alias("k"), F.col("component").alias("family"))
    members = ws.table(families.join(classes.select("k", "rep", "n", "bits"), "k"), "members")
    texts = docs.select(ordered_id(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    texts = members.select("k", "family", "n", "bits", "rep.id", "rep.t").hint("merge").join(texts, ["id", "t"]).dropDuplicates(["k"]).drop("id", "t")
    links = confirmed_links(ws.table(texts, "texts"), width, percent, family_block, ws)
    found = connected_components(links, ws, "component")
    found = ws.table(classes.select("k", "rep.id").join(found.withColumnRenamed("node", "k"), "k"), "found")
    least = found.groupBy("component").agg(F.min("id").alias("least"))
    named = classes.select("k", "rows", F.col("rep.id").alias("alone")).join(found.join(least, "component").select("k", "least"), "k", "left")
    named = ws.table(named.select(F.col("k").alias("of"), F.coalesce("least", "alone").alias("least"), "rows"), "named")
    result = hot_join(own.select("id", "n", "k"), named, "k", "of", "rows", "id")
    result = result.withColumn("least", F.coalesce("least", "id"))
    return result.select(own_id("id").alias(id_col), F.col("n").alias("n_shingles"), own_id("least").alias("component_id"))
