"""Packing tokenised documents into sequences by linear grouping and best fit."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.llm.textkit import LOWER, SPACE, blocks, digests, pieces
from lexmill.plans.checkpoint import Workspace

#: Pieces whose ids a worker keeps before it starts anew.
PIECES_KEPT = 250_000
#: Plan rows up to which the plan is sent to every task; the plan's size depends on the capacity, not on the rows.
PLAN_ROWS = 200_000
#: Least length of a large piece as a part of the capacity, and number of groups: each pair is planned, the plan with fewest sequences stays.
SHAPES = ((8, 128), (4, 256), (3, 512))
#: Room of a configuration that small pieces can fill closely.
FINE = 64


#: Of a byte: an ASCII letter or digit; other visible ASCII.
ALNUM, PUNCT = np.zeros(256, bool), np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
PUNCT[33:127] = ~ALNUM[33:127]
LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in a byte-level vocabulary: visible Latin-1 for itself, the rest from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {b: 256 + k for k, b in enumerate(rest)}


def pieces_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts texts at white space, and where the splitter cuts in any context: between ASCII letters or digits and visible
    ASCII next to them, but not after an apostrophe. Starts, ends, and each text's first piece."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside, alnum, punct = ~SPACE[data], ALNUM[data], PUNCT[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = ~inside[:-1] | ~inside[1:] | (alnum[:-1] & punct[1:]) | (punct[:-1] & alnum[1:] & (data[:-1] != 39))
    new[at] = True
    start = np.flatnonzero(inside & new[:-1])
    return start, np.flatnonzero(inside & new[1:]) + 1, np.searchsorted(start, at)


class PieceTokenizer:
    """Ids of whole texts from ids of their pieces.

    The vocabulary's normaliser turns white space to blanks and lowers letters, and its splitter drops blanks and never crosses
    them, so a text's ids are those of its pieces in order; each piece is encoded once and kept. Pieces of Latin letters go to
    the merges directly. Where special tokens may occur, pieces are the words as they stand.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        self.keys, self.check, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.offset, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def ids(self, texts: list[str]) -> list[list[int]]:
        merge, out, other = self.tokenizer.model.tokenize, [], []
        for i, text in enumerate(texts):
            if text.isascii() and text.isalpha() and text.islower():
                out.append([x.id for x in merge(text)])
            elif LATIN.fullmatch(text):
                out.append([x.id for x in merge(text.encode().decode("latin-1").translate(self.letters))])
            else:
                out.append([])
                other.append(i)
        if other:
            for i, e in zip(other, self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Adds new pieces under their 128-bit digests; they are kept in order, without an object for each."""
        found = self.ids(texts)
        length = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for ids in found for x in ids), np.uint32, int(length.sum()))
        k = len(self.keys)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(keys) > len(self.offset):
            self.offset, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length))
        self.flat[self.used : self.used + len(flat)] = flat
        self.offset[k : k + len(keys)] = self.used + np.cumsum(length) - length
        self.length[k : k + len(keys)] = length
        order = np.argsort(keys[:, 0])
        at = np.searchsorted(self.keys, keys[order, 0])
        self.keys, self.check = np.insert(self.keys, at, keys[order, 0]), np.insert(self.check, at, keys[order, 1])
        self.slot = np.insert(self.slot, at, k + order.astype(np.int32))
        self.used += len(flat)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where the pieces of these digests are kept; -1 for a new one."""
        out = np.full(len(keys), -1, np.int64)
        place = np.searchsorted(self.keys, keys[:, 0])
        live = np.flatnonzero(place < len(self.keys))
        while len(live):  # digests with one first half stand side by side
            live = live[self.keys[place[live]] == keys[live, 0]]
            same = self.check[place[live]] == keys[live, 1]
            out[live[same]] = self.slot[place[live[same]]]
            live = live[~same]
            place[live] += 1
            live = live[place[live] < len(self.keys)]
        return out

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts on end, and each text's limits."""
        raw = data.tobytes()
        if b"<|" in raw:
            inside = np.concatenate([[False], ~SPACE[data], [False]])
            edge = np.zeros(len(data) + 1, bool)
            edge[at] = True
            start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
            end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
            first = np.searchsorted(start, at)
        else:
            data = LOWER[data]
            raw = data.tobytes()
            start, end, first = pieces_of(data, at)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        own = pieces(data, start, end).dictionary_encode()
        texts = own.dictionary.to_pylist()
        key = digests(texts)
        if len(self.keys) > PIECES_KEPT:
            self.clear()
        where = self.slots(key)
        new = np.flatnonzero(where < 0)
        if len(new):
            self.learn(key[new], [texts[i].decode("utf-8", "replace") for i in new.tolist()])
            where = self.slots(key)
        where = where[own.indices.to_numpy()]
        length = self.length[where]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.repeat(self.offset[where] - total[:-1], length) + np.arange(total[-1])]
        return ids, total[first]


#: A worker's tokenizer, for all of its tasks.
_own: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    if path not in _own:
        _own[path] = PieceTokenizer(path)
    return _own[path]


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])``: each text's ids and ``end_id``, cut every ``capacity`` ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for rows, data, at in blocks(batches):
            ids, limit = own.encode(data, at)
            out = []
            for i in range(rows.num_rows):
                doc = np.append(ids[limit[i] : limit[i + 1]], np.uint32(end_id)).astype("<u4")
                out += [(i, k, s, doc[s : s + capacity]) for k, s in enumerate(range(0, len(doc), capacity))]
            cols = [rows.column(0).take(pa.array([x[0] for x in out], pa.int64())), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64()), pa.array([len(x[3]) for x in out], pa.int64()), pa.array([zlib.crc32(x[3].tobytes()) for x in out], pa.int64())]
            if with_ids:
                cols.append(pa.array([x[3].astype(np.int32) for x in out], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _best_configs(sizes: np.ndarray, value: np.ndarray, sand: float, capacity: int, most: int) -> np.ndarray:
    """The configurations with the largest value above 1, one for each sum of sizes at most; room of FINE or more has ``sand`` a token."""
    sums = np.arange(capacity + 1)
    from_ = sums[:, None] - sizes[None, :]
    fits, from_ = from_ >= 0, np.maximum(from_, 0)
    layer = np.where(sums == 0, 0.0, -np.inf)
    best, depth, picks = layer, np.zeros(capacity + 1, np.int64), []
    for k in range(1, capacity // int(sizes.min()) + 1):  # best sums of exactly k pieces
        choice = np.where(fits, layer[from_] + value, -np.inf)
        pick = choice.argmax(1)
        layer = choice[sums, pick]
        picks.append(pick)
        depth = np.where(layer > best, k, depth)
        best = np.maximum(best, layer)
    total = best + sand * _usable(capacity - sums)
    chosen = [w for w in np.argsort(-total, kind="stable")[:most].tolist() if total[w] > 1 + 1e-9]
    out = np.zeros((len(chosen), len(sizes)), np.int64)
    for row, w in zip(out, chosen, strict=True):
        for k in range(depth[w], 0, -1):
            g = picks[k - 1][w]
            row[g] += 1
            w -= sizes[g]
    return out


def _usable(room: np.ndarray) -> np.ndarray:
    return np.where(room >= FINE, room, 0)


def configurations(sizes: list[int], demand: list[int], capacity: int, sand: int, rounds: int = 60, near: float = 1e-3) -> list[tuple[np.ndarray, float]]:
    """The fractional optimum ``(configuration, times)`` of few sizes, by column generation.

    Besides the demand, the configurations' usable room must hold the small pieces' ``sand`` tokens, so that room goes where small pieces
    fill it. Starts with the patterns of best fit on these sizes; ends where no configuration is worth more than 1 + ``near``.
    """
    s, m = np.array(sizes), len(sizes)
    column = lambda config: np.append(config, _usable(capacity - config @ s)).astype(float)
    basis = np.array([*(column(np.where(np.arange(m) == g, capacity // n, 0)) for g, n in enumerate(sizes)), np.zeros(m + 1)]).T
    need = np.append(np.array(demand, float), float(sand))
    spare = basis[m, :m] @ (need[:m] / basis[:m, :m].diagonal()) - sand
    more = [(np.append(np.zeros(m), -1.0), 0.0), (np.append(np.zeros(m), float(capacity)), 1.0)]  # room left over; a sequence of small pieces
    basis[:, m], last = more[0] if spare >= 0 else more[1]
    cost = np.append(np.ones(m), last)
    inverse = np.linalg.inv(basis)
    x = inverse @ need
    place = {n: g for g, n in enumerate(sizes)}
    patterns = {parts for _, parts in best_fit([], dict(zip(sizes, demand, strict=True)), capacity)}
    new = [np.bincount([place[n] for n in parts], minlength=m) for parts in patterns]
    for k in range(rounds):
        pool = np.array([*map(column, new), *(c for c, _ in more)]).T
        price = np.append(np.ones(len(new)), [c for _, c in more])
        for step in range(100 if k else 4 * m):
            reduced = price - (cost @ inverse) @ pool
            j = int(reduced.argmin())
            if reduced[j] > -1e-7:
                break
            move = inverse @ pool[:, j]
            ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
            out = int(ratio.argmin())
            x = np.maximum(x - ratio[out] * move, 0)
            x[out] = ratio[out]
            row = inverse[out] / move[out]
            inverse -= np.outer(move, row)
            inverse[out] = row
            basis[:, out], cost[out] = pool[:, j], price[j]
            if step % 50 == 49:
                inverse = np.linalg.inv(basis)
                x = np.maximum(inverse @ need, 0)
        dual = cost @ inverse
        grain = max(dual[m], 0.0)
        new = list(_best_configs(s, dual[:m], grain, capacity, 64))
        if not new or max(c @ dual[:m] + grain * column(c)[m] for c in new) < 1 + near:
            break
    return [(c, t) for c, t in zip(np.rint(basis[:m].T).astype(np.int64), x.tolist(), strict=True) if c.any()]


def whole_numbers(found: list[tuple[np.ndarray, float]], demand: list[int]) -> list[tuple[np.ndarray, int]]:
    """Whole multiples of configurations that never exceed the demand: rounded down, then once more where the most was cut and the demand allows it."""
    left, out = np.array(demand, np.int64), []
    for config, x in sorted(found, key=lambda f: -f[1]):
        n = int(min(np.floor(x + 1e-6), min(left[config > 0] // config[config > 0])))
        left -= n * config
        out.append([config, n, x - n])
    for part in sorted(out, key=lambda p: -p[2]):
        if part[2] > 0.3 and (left >= part[0]).all():
            left -= part[0]
            part[1] += 1
    return [(config, n) for config, n, _ in out if n]


def grouped(large: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Linear grouping: lengths, falling, in groups of equal cardinality (or one for each length, where there are no more); groups of one largest length are one."""
    each = max(1, -(-sum(large.values()) // groups))
    out: list[list[list[int]]] = []
    free = 0
    for n in sorted(large, reverse=True):
        count = large[n]
        if len(large) <= groups:
            free = 0
        while count:
            if not free:
                free = count if len(large) <= groups else each
                if not out or out[-1][0][0] != n:
                    out.append([])
            k = min(count, free)
            out[-1].append([n, k])
            count, free = count - k, free - k
    return out


def take(group: list[list[int]], want: int) -> list[list[int]]:
    """The next ``want`` pieces of a group, longest first."""
    run = []
    while want:
        k = min(want, group[0][1])
        run.append([group[0][0], k])
        want -= k
        group[0][1] -= k
        if not group[0][1]:
            group.pop(0)
    return run


def plan_shape(histogram: dict[int, int], capacity: int, part: int, groups: int) -> tuple[list[tuple[int, tuple[int, ...]]], int]:
    """The plan of one shape, and how many large pieces stand in configurations."""
    small = capacity // part
    rest = {n: c for n, c in histogram.items() if c and n < capacity}
    whole = [(histogram[capacity], (capacity,))] if histogram.get(capacity) else []
    made = grouped({n: rest.pop(n) for n in list(rest) if n > small}, groups)
    filled, inside = [], 0
    if made:
        demand = [sum(k for _, k in g) for g in made]
        found = configurations([g[0][0] for g in made], demand, capacity, sum(n * c for n, c in rest.items()))
        for config, n in whole_numbers(found, demand):
            inside += n * int(config.sum())
            slots = [take(made[g], n) for g, a in enumerate(config.tolist()) for _ in range(a)]
            while n:
                k = min(run[0][1] for run in slots)
                filled.append((k, tuple(run[0][0] for run in slots)))
                n -= k
                for run in slots:
                    run[0][1] -= k
                    if not run[0][1]:
                        run.pop(0)
    for group in made:
        for n, k in group:
            rest[n] = rest.get(n, 0) + k
    return whole + best_fit(filled, rest, capacity), inside


def plan_sequences(histogram: dict[int, int], capacity: int = 2048, shapes: tuple[tuple[int, int], ...] = SHAPES) -> list[tuple[int, tuple[int, ...]]]:
    """Packs a histogram of lengths: ``(number of sequences, lengths in each)``.

    Linear grouping: lengths above a part of the capacity, falling, are cut into groups of equal cardinality and
    each counts as its group's largest; configurations of these few sizes are optimised, real lengths take
    their groups' places, and what rounding leaves over, then the small ones, go where they fit best, falling. No configuration is dissolved.
    Each of the ``shapes`` is planned so, and the plan with the fewest sequences stays. Work depends on the capacity and the groups, not on the number of documents.
    """
    return min((plan_shape(histogram, capacity, *shape)[0] for shape in shapes), key=lambda plan: sum(k for k, _ in plan))


def best_fit(filled: list[tuple[int, tuple[int, ...]]], rest: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Adds the rest, falling, to the filled sequences and new ones where it fits best."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(count: int, lengths: tuple[int, ...]) -> None:
        room.setdefault(capacity - sum(lengths), []).append((count, lengths))

    for count, lengths in filled:
        put(count, lengths)
    for n in sorted(rest, reverse=True):
        count = rest[n]
        while count:
            fit = next((r for r in range(n, capacity) if room.get(r)), None)
            if fit is None:
                per = capacity // n
                if count >= per:
                    put(count // per, (n,) * per)
                if count % per:
                    put(1, (n,) * (count % per))
                break
            have, lengths = room[fit].pop()
            k = min(have, count)
            if have > k:
                room[fit].append((have - k, lengths))
            put(k, (*lengths, n))
            count -= k
    return [b for r in sorted(room) for b in room[r]]


def plan_rows(blocks: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, rank after the last, first sequence, offset)``: ranks of a length take these places in turn."""
    rows, rank, sequence = [], {}, 0
    for count, lengths in blocks:
        offset = 0
        for n in lengths:
            r = rank.get(n, 0)
            rows.append((n, r, r + count, sequence, offset))
            rank[n] = r + count
            offset += n
        sequence += count
    return rows


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, stretch: int = 4096, ws: Workspace | None = None) -> DataFrame:
    """Places every piece of every text: ``(id, piece, start, length, ids_crc32, sequence_id, offset)``.

    Null text counts as empty and is one piece of ``end_id`` alone. Pieces of a length are ranked
    in stretches dealt by a hash, so a length that many pieces share is split; ranks meet the plan's places. Rows
    that repeat are packed as often as they occur; an empty table gives an empty result; further columns are ignored.
    """
    ws = ws or Workspace(docs.sparkSession, "pack")
    pieces = ws.table(token_pieces(docs, path, id_col, text_col, capacity, end_id), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    rows = plan_rows(plan_sequences(histogram, capacity))
    plan = docs.sparkSession.createDataFrame(rows, "of long, rank_from long, rank_to long, sequence long, offset long")
    plan = F.broadcast(plan) if len(rows) <= PLAN_ROWS else plan
    salts = max(1, -(-max(histogram.values(), default=1) // stretch))
    p = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)))
    sums = p.groupBy("length", "salt").agg(F.count("*").alias("n"))
    sums = sums.select(F.col("length").alias("len"), F.col("salt").alias("part"), F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = p.withColumn("in_part", F.row_number().over(W.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(sums, (F.col("length") == F.col("len")) & (F.col("salt") == F.col("part"))).withColumn("rank", F.col("base") + F.col("in_part"))
    placed = ranked.join(plan, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")
