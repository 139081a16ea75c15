"""Removing byte strings that repeat across documents, with suffix sorting by induction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.induced import Sorter, Tape, Text, Work, suffix_order
from lexmill.llm.textkit import blocks, digests, give_back, mix, ordered_id, own_id
from lexmill.plans.checkpoint import Workspace
from lexmill.plans.skew import hot_join

#: Bytes of text for each bucket of fingerprints, and for each shard of suffixes; neither is held in memory.
BUCKET_BYTES, SHARD_BYTES = 8 << 20, 3 << 20
#: Rows that sorting a bucket, and sorting a shard, hold in memory.
BUCKET_ROWS, SHARD_ROWS = 1 << 19, 1 << 16
#: Bytes of text that a worker handles at once.
BLOCK = 1 << 18
#: Parts of a stretch that are judged apart before a shard is sorted: its strings by the distance to their least-hashed gram.
LEVELS = 4


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:]) if len(x) > k else x[:0]
        k *= 2
    rest = width - k
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else x[: max(0, len(x) - rest)]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all strings of ``gram`` bytes, a multiple of eight, read eight bytes at a time."""
    n = len(data) - gram + 1
    words = np.ndarray(len(data) - 7, "<u8", data.tobytes(), 0, (1,)).copy()
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k, step in zip(range(8, gram, 8), (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53), strict=False):
        h ^= h >> np.uint64(29)
        h += words[k : k + n] * np.uint64(step)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def minimizers(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string of ``length`` bytes in one text: its start, and the place of its least-hashed gram; and all grams' hashes.

    The place depends on the string's bytes alone (the first of equal grams), so equal strings have it at the same distance.
    """
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data, gram)
    low = (np.uint64(1) << np.uint64(max(20, n.bit_length()))) - np.uint64(1)
    key = h & ~low
    key |= np.arange(n - gram + 1, dtype=np.uint64)
    place = sliding_min(key, length - gram + 1)
    place &= low
    room = np.ones(n, bool)
    for edge in at[1:]:
        room[max(0, edge - length + 1) : edge] = False
    window = np.flatnonzero(room[: len(place)])
    return window, place.view(np.int64)[window], h


def fingerprints(docs: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """``(bucket, low, high, class, place)``: packed fingerprints of the texts; those that two texts of a block share come as ``known``.

    Of a fingerprint of several texts of a block only one is posted, so a passage of many texts posts once for each block.
    """
    shift = 64 - int(buckets).bit_length() + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, limit=BLOCK):
            own = rows.column(1).to_numpy()
            _, place, h = minimizers(data, at, length, gram)
            met = np.zeros(len(data), bool)
            met[place] = True
            place = np.flatnonzero(met)
            spread = mix(h[place])  # least hashes have low high bits
            key = spread >> np.uint64(24)  # 40 bits, the buckets' bits first
            row = np.searchsorted(at, place, "right") - 1
            cls, local = own[row], (place - at[row]).astype(np.uint32)
            order = np.argsort(key, kind="stable")
            k, c = key[order], cls[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
            shared = np.zeros(len(k), bool)
            if len(k):
                many = np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)
                shared = np.repeat(many, np.diff(np.concatenate([first, [len(k)]])))
            known = np.zeros(len(key), bool)
            known[order[shared]] = True
            posted = ~known
            posted[order[first]] = True
            bucket = (spread >> np.uint64(shift)).astype(np.int32) if buckets > 1 else np.zeros(len(place), np.int32)
            out = []
            for kind, chosen in ((0, np.flatnonzero(posted)), (1, np.flatnonzero(known))):
                order = chosen[np.argsort(bucket[chosen], kind="stable")]
                b = bucket[order]
                cut = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]]) if len(b) else [0]
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    which = order[x:y]
                    bits = key[which]
                    out.append((int(b[x]), kind, (bits >> np.uint64(8)).astype("<u4").tobytes() if not kind else b"", (bits & np.uint64(255)).astype(np.uint8).tobytes() if not kind else b"", cls[which].astype("<i8").tobytes(), local[which].astype("<u4").tobytes()))
            if out:
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["bucket", "kind", "high", "low", "class", "place"])

    return docs.select("text", "class").mapInArrow(work, "bucket int, kind int, high binary, low binary, class binary, place binary")


def _values(batch: pa.RecordBatch, name: str, row: int, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_py(), kind)


def shared_rows(sorter: Sorter) -> Iterator[np.ndarray]:
    """Rows whose key different classes have, from rows ordered by key and class; a key's rows that wait for another class are each text's places once."""
    waiting, open_key = np.zeros(0, sorter.kind), None
    for rows in sorter.blocks():
        rows = np.concatenate([waiting, rows])
        if not len(rows):
            continue
        first = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
        last = np.append(first[1:], len(rows)) - 1
        many = rows["class"][first] != rows["class"][last]
        many[0] |= open_key is not None and rows["key"][0] == open_key
        yield rows.take(np.flatnonzero(np.repeat(many, last - first + 1)))
        open_key = rows["key"][-1] if many[-1] else None
        waiting = np.unique(rows[first[-1] :]) if not many[-1] else rows[:0]


def shared_places(posted: DataFrame, buckets: int, rows: int) -> DataFrame:
    """``(class, place)`` of fingerprints that occur in different texts, bucket by bucket, each sorted outside memory."""
    kind = [("key", "<u8"), ("class", "<i8"), ("place", "<u4")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(cls: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(cls), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(cls[a : a + (1 << 16)]), pa.array(place[a : a + (1 << 16)].astype(np.int64))], names=["class", "place"])

        bucket, sorter = None, None
        for batch in batches:
            for i, b in enumerate(batch.column(0).to_pylist()):
                if b != bucket:
                    for x in shared_rows(sorter) if sorter else ():
                        yield from out(x["class"], x["place"])
                    bucket, sorter = b, Sorter(kind, 2, Work(rows))
                cls, place = _values(batch, "class", i, "<i8"), _values(batch, "place", i, "<u4")
                if batch.column(1)[i].as_py():
                    yield from out(cls, place)
                else:
                    sorter.put((_values(batch, "high", i, "<u4").astype(np.uint64) << np.uint64(8)) | _values(batch, "low", i, "u1"), cls, place)
        for x in shared_rows(sorter) if sorter else ():
            yield from out(x["class"], x["place"])
        give_back()

    return posted.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(work, "class long, place long")


def equal_candidates(gram: np.ndarray, distance: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Stretches that may have the bytes of another one: those that aren't alone with their gram's hash, its distance and their number of strings."""
    key = mix(gram ^ mix((distance.astype(np.uint64) << np.uint64(32)) | count.astype(np.uint64)))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    return np.sort(order[np.append(False, same) | np.append(same, False)])


def segments(marked: DataFrame, length: int, gram: int, shards: int) -> DataFrame:
    """Stretches of text whose strings share a marked fingerprint, dealt by it: packed ``(shard, kind, id, start, number, distance, bytes)``; a distance is from the first string's start to its gram.

    Equal strings meet in one shard. A stretch that several texts of a block have is sent for the smallest id, wherever that one has it; the others' strings
    are found already and go as ``kind`` 1: id, first string, number of strings.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, limit=BLOCK):
            ids = rows.column(1).to_numpy()
            marks, limit = _list_values(rows.column(2))
            mark = np.zeros(len(data) + 1, bool)
            mark[(marks + np.repeat(at[:-1], limit))[marks < np.repeat(np.diff(at), limit)]] = True
            window, place, h = minimizers(data, at, length, gram)
            ok = mark[place]
            window, place = window[ok], place[ok]
            if not len(window):
                continue
            first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)]))
            count = np.diff(np.concatenate([first, [len(window)]]))
            begin, anchor = window[first], place[first]
            end = begin + count + length - 1
            row = np.searchsorted(at, begin, "right") - 1
            raw = data.tobytes()
            alike = equal_candidates(h[anchor], anchor - begin, count)
            name = digests([raw[x:y] for x, y in zip(begin[alike].tolist(), end[alike].tolist(), strict=True)]).copy()
            name[:, 1] ^= mix((anchor - begin)[alike].astype(np.uint64))
            order = np.lexsort((ids[row[alike]], name[:, 1], name[:, 0]))
            n, i = name[order], ids[row[alike[order]]]
            lead = np.append([True], (n[1:] != n[:-1]).any(1))[: len(n)]
            least = i[np.maximum.accumulate(np.where(lead, np.arange(len(n)), 0))]
            done = alike[order[i != least]]
            own = np.ones(len(begin), bool)
            own[done] = False
            sent = np.flatnonzero(own)
            shard = ((mix(h[anchor] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(16)) % np.uint64(shards)).astype(np.int32)
            out = []
            for kind, chosen in ((0, sent), (1, done)):
                chosen = chosen[np.argsort(shard[chosen], kind="stable")]
                s = shard[chosen]
                cut = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]]) if len(s) else [0]
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    w = chosen[a:b]
                    text = b"".join(raw[x:y] for x, y in zip(begin[w].tolist(), end[w].tolist(), strict=True)) if not kind else b""
                    out.append((int(s[a]), kind, ids[row[w]].astype("<i8").tobytes(), (begin[w] - at[row[w]]).astype("<i4").tobytes(), count[w].astype("<i4").tobytes(), (anchor - begin)[w].astype("<i2").tobytes() if not kind else b"", text))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["shard", "kind", "id", "start", "number", "distance", "bytes"])

    return marked.select("text", "id", "places").mapInArrow(work, "shard int, kind int, id binary, start binary, number binary, distance binary, bytes binary")


def _list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def context_hashes(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` bytes from each place, eight or more; ``words`` has the eight bytes from every place."""
    h = np.full(len(at), size, np.uint64)
    for k in (*range(0, size - 8, 8), size - 8):
        h = mix(h ^ words[at + k])
    return h


class Shard:
    """Stretches of one shard, on disk: ``add`` takes them as they come, ``repeats`` sorts them and finds what smaller ids have too."""

    def __init__(self, length: int, rows: int, gram: int = 24):
        self.length, self.gram, self.work = length, gram, Work(rows)
        self.bytes, self.at = Tape("u1"), Tape("<i8")
        self.ids, self.start, self.number, self.distance = Tape("<i8"), Tape("<i4"), Tape("<i4"), Tape("<i2")
        self.names = Sorter([("a", "<u8"), ("b", "<u8"), ("k", "<i8"), ("id", "<i8")], 2, self.work)

    def add(self, ids: np.ndarray, start: np.ndarray, number: np.ndarray, text: bytes, distance: np.ndarray | None = None) -> None:
        at = np.concatenate([[0], np.cumsum(number.astype(np.int64) + self.length - 1)])
        name = digests([text[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
        self.names.put(name[:, 0], name[:, 1], np.arange(self.ids.size, self.ids.size + len(ids)), ids)
        self.at.put(self.bytes.size + at[:-1])
        self.bytes.put(np.frombuffer(text, np.uint8))
        for tape, x in ((self.ids, ids), (self.start, start), (self.number, number), (self.distance, np.full(len(ids), -1) if distance is None else distance)):
            tape.put(x)

    def _shared(self, first: Tape) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct stretch and level of distances whether its strings there may be another's, on disk; and where levels begin.

        Equal strings have their least-hashed gram at the same distance. Those of a level have the bytes around it in common that all strings of the level have;
        a stretch that is alone with these bytes' hash shares none of them. Stretches without a distance may share all.
        """
        span = self.length - self.gram
        levels = min(LEVELS, span + 1)
        lows = np.arange(levels + 1) * (span + 1) // levels
        shared, keys = Tape("?").zeros(first.size * levels), Sorter([("key", "<u8"), ("k", "<i8")], 1, self.work)
        words = np.ndarray(max(0, self.bytes.size - 7), "<u8", self.bytes.array(), 0, (1,))
        number, begins, distance, base = self.number.array(), self.at.array(), self.distance.array(), 0
        for k in first.blocks(4096):
            far, own, at = distance[k].astype(np.int64), number[k], begins[k]
            shared[((base + np.flatnonzero(far < 0))[:, None] * levels + np.arange(levels)).ravel()] = True
            for j in range(levels):
                w = np.flatnonzero((far >= lows[j]) & (far - own < lows[j + 1] - 1))
                keys.put(mix(context_hashes(words, at[w] + far[w] - lows[j], self.length - (lows[j + 1] - 1 - lows[j])) + np.uint64(j)), (base + w) * levels + j)
            base += len(k)
        last = None
        for rows in keys.blocks():
            same = rows["key"][1:] == rows["key"][:-1]
            goes_on = last is not None and rows["key"][0] == last["key"]
            if goes_on:
                shared[last["k"]] = True
            shared[rows["k"][np.append(goes_on, same) | np.append(same, False)]] = True
            last = rows[-1]
        return shared, lows

    def repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs ``(id, start, number)`` of strings that a smaller id of the shard has too.

        Stretches of the same bytes (by 128-bit digests) are sorted once, and only their parts that others may share. The suffixes of these parts, parted by a byte that UTF-8 lacks, are
        ordered by external induction, which carries common prefixes; among those that begin strings, neighbours with a common prefix of the string's length are one string.
        """
        if not self.ids.size:
            return
        of, first, least = Tape("<i8").zeros(self.ids.size), Tape("<i8"), Tape("<i8")
        now, classes = None, 0
        for rows in self.names.blocks():
            new = np.append(now is None or rows["a"][0] != now[0] or rows["b"][0] != now[1], (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1]))
            cls = classes - 1 + np.cumsum(new)
            of[rows["k"]] = cls
            at = np.unique(np.append(0, np.flatnonzero(new)))
            low = np.minimum.reduceat(rows["id"], at)
            if not new[0]:  # the class of the last block goes on
                least.array(True)[classes - 1] = min(int(low[0]), int(least.read(classes - 1, classes)[0]))
                low, at = low[1:], at[1:]
            least.put(low)
            first.put(rows["k"][at])
            now, classes = (rows["a"][-1], rows["b"][-1]), int(cls[-1]) + 1
        number, raw, begins, distance = self.number.array(), self.bytes.array(), self.at.array(), self.distance.array()
        shared, lows = self._shared(first)
        levels, least_of = len(lows) - 1, least.array()
        text, to, of_parts, starts, least_parts = Text.tape(False), Tape("<i8"), Tape("<i8"), Tape("?"), Tape("<i8")
        strings, smallest = Tape("<i8"), Tape("<i8")
        place = count = base = 0
        for k in first.blocks(4096):
            own, far, low = number[k].astype(np.int64), distance[k].astype(np.int64), least_of[base : base + len(k)]
            total = count + np.cumsum(own) - own
            strings.put(total)
            smallest.put(np.repeat(low, own))  # what no other stretch has
            kept = np.pad(shared[base * levels : (base + len(k)) * levels].reshape(-1, levels)[:, ::-1], ((0, 0), (1, 1)))  # in the order of strings: by falling distance
            row, begin = np.nonzero(kept[:, 1:-1] & ~kept[:, :-2])
            end = np.nonzero(kept[:, 1:-1] & ~kept[:, 2:])[1]
            count, base = count + int(own.sum()), base + len(k)
            if not len(row):
                continue
            a = np.where(far[row] < 0, 0, np.maximum(0, far[row] - lows[levels - begin] + 1))
            part_of = np.where(far[row] < 0, own[row], np.minimum(own[row], far[row] - lows[levels - 1 - end] + 1)) - a
            size = part_of + self.length
            to.put(place + np.cumsum(size) - size)
            of_parts.put(total[row] + a)
            least_parts.put(low[row])
            ends = np.cumsum(size)
            part = raw[np.minimum(np.arange(ends[-1]) + np.repeat(begins[k[row]] + a - ends + size, size), len(raw) - 1)]
            part[ends - 1] = 255
            text.put(part)
            starts.put(np.repeat(np.tile([True, False], len(row)), np.stack([part_of, size - part_of], 1).ravel()))
            place += int(size.sum())
        to.put(np.array([place]))
        smallest = smallest.array(True)
        if place:
            self._smallest(text, to.array(), of_parts.array(), starts.array(), least_parts.array(), smallest)
        strings_of, step = strings.array(), max(1, self.work.rows // 64)
        for a in range(0, self.ids.size, step):
            b = min(self.ids.size, a + step)
            ids, start, own, c = self.ids.read(a, b), self.start.read(a, b), number[a:b].astype(np.int64), of[a:b]
            total = np.concatenate([[0], np.cumsum(own)])
            offset = np.arange(total[-1]) - np.repeat(total[:-1], own)
            gone = smallest[np.repeat(strings_of[c], own) + offset] < np.repeat(ids, own)
            row = np.repeat(np.arange(len(ids)), own)
            edge = gone & np.concatenate([[True], ~gone[:-1] | (row[1:] != row[:-1])])
            last = gone & np.concatenate([~gone[1:] | (row[1:] != row[:-1]), [True]])
            x, y = np.flatnonzero(edge), np.flatnonzero(last)
            yield ids[row[x]], start[row[x]] + offset[x], y - x + 1

    def _smallest(self, text: Tape, to: np.ndarray, strings: np.ndarray, starts: np.ndarray, least: np.ndarray, out: np.ndarray) -> None:
        """Sets the smallest id of each string of the parts in ``out``, from ``strings`` of its part on; ``starts`` tells which places begin strings."""
        met, minima = Tape([("string", "<u4"), ("group", "<u4")]), Tape("<i8")
        breaks, at, open_min = 0, None, None  # breaks so far, and at the last string that was met; that one's group so far

        def visit(pos: np.ndarray, prefix: np.ndarray) -> None:
            nonlocal breaks, at, open_min
            begins = np.flatnonzero(starts[pos])  # the rest are cut by a part's end: none shares a string with its neighbours
            turn = breaks + np.cumsum(prefix < self.length)
            breaks = int(turn[-1]) if len(turn) else breaks
            if not len(begins):
                return
            pos, turn = pos[begins], turn[begins]
            stretch = np.searchsorted(to, pos, "right") - 1
            new = np.append(at is None or turn[0] != at, turn[1:] != turn[:-1])
            if new[0] and at is not None:
                minima.put(np.array([open_min]))
                open_min = None
            cut = np.append(0, np.flatnonzero(new[1:]) + 1)
            low = np.minimum.reduceat(least[stretch], cut)
            low[0] = low[0] if open_min is None else min(int(low[0]), open_min)
            rows = np.empty(len(pos), met.kind)
            rows["string"] = strings[stretch] + pos - to[stretch]
            rows["group"] = minima.size + np.cumsum(new) - bool(new[0])
            met.put(rows)
            minima.put(low[:-1])
            at, open_min = int(turn[-1]), int(low[-1])

        suffix_order(text, False, self.work, self.length, None, visit)
        if open_min is not None:
            minima.put(np.array([open_min]))
        group_min = minima.array()
        for rows in met.blocks(self.work.rows):
            out[rows["string"]] = group_min[rows["group"]]


def repeats(dealt: DataFrame, length: int, shards: int, rows: int, gram: int = 24) -> DataFrame:
    """``(id, start, number)``: runs of strings that occur in a document with a smaller id, shard by shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)].astype(np.int64)) for x in columns], names=["id", "start", "number"])

        number, shard = None, None
        for batch in batches:
            for i, s in enumerate(batch.column(0).to_pylist()):
                if s != number:
                    for found in shard.repeats() if shard else ():
                        yield from out(*found)
                    number, shard = s, Shard(length, rows, gram)
                columns = _values(batch, "id", i, "<i8"), _values(batch, "start", i, "<i4"), _values(batch, "number", i, "<i4")
                if batch.column(1)[i].as_py():
                    yield from out(*columns)
                else:
                    shard.add(*columns, batch.column(batch.schema.get_field_index("bytes"))[i].as_py(), _values(batch, "distance", i, "<i2"))
        for found in shard.repeats() if shard else ():
            yield from out(*found)
        give_back()

    return dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(work, "id long, start long, number long")


def cut_texts(hit: DataFrame, length: int, with_text: bool) -> DataFrame:
    """``(class, n_removed, n_spans, kept_sha256, kept)`` of texts with runs of removed strings."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, limit=BLOCK):
            (start, limit), (number, _) = (_list_values(rows.column(k)) for k in (2, 3))
            begin = start + np.repeat(at[:-1], limit)
            cover = np.zeros(len(data) + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + number + length - 1, -1)
            gone = np.cumsum(cover[:-1]) > 0
            out = []
            for i in range(rows.num_rows):
                own, g = data[at[i] : at[i + 1]], gone[at[i] : at[i + 1]]
                kept = own[~g].tobytes()
                out.append((int(g.sum()), int(g[0]) + int((g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(1), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=["class", "n_removed", "n_spans", "kept_sha256", "kept"])

    return hit.select("text", "class", "starts", "numbers").mapInArrow(work, "class long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 24, bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES, bucket_rows: int = BUCKET_ROWS, shard_rows: int = SHARD_ROWS, with_text: bool = False, ws: Workspace | None = None) -> DataFrame:
    """What stays of every text without byte strings of earlier ones: ``(id, n_bytes, n_removed, n_spans, kept_sha256[, kept])``.

    A byte is removed if a string of ``length`` bytes that covers it also starts in a document with a smaller integer id; strings
    don't cross documents and are judged on the input. Every string of that length has a least-hashed gram; only
    strings whose gram's hash occurs in different texts can repeat, so only their stretches are dealt to shards, by that gram, and
    suffix-sorted there, on disk: a shard may be of any size, ``shard_rows`` bound the memory. Texts equal (by SHA-256) to that of a smaller id are removed whole if they have ``length`` bytes. Null text counts as
    empty; null ids count as larger than any other; shorter texts lose nothing; an empty table gives an empty result; rows that repeat an id lose the same, and aren't
    compared with one another; further columns are ignored.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "suffix")
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(ordered_id(id_col).alias("id"), text.alias("text"), F.xxhash64(F.sha2(text, 256)).alias("class"))
    rows = ws.table(d.select("id", "class", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    long_ones = d.where(F.octet_length("text") >= length)
    buckets, shards = max(1, -(-total // bucket_bytes)), max(1, -(-total // shard_bytes))
    places = ws.table(shared_places(fingerprints(long_ones, length, gram, buckets), buckets, bucket_rows), "places")
    classes = ws.table(rows.groupBy("sha").agg(F.min("class").alias("class"), F.min("id").alias("rep"), F.count("*").alias("rows")), "classes")
    marks = ws.table(places.distinct().groupBy("class").agg(F.collect_list("place").alias("places")), "marks").join(classes.select("class", "rep"), "class")
    ws.drop("places")
    ws.release()
    marks = marks.select(F.col("rep").alias("id"), "class", "places").hint("merge")
    marked = d.join(marks, ["id", "class"]).dropDuplicates(["class"]) if _repeated(rows) else d.join(marks, ["id", "class"])
    found = ws.table(repeats(segments(marked, length, gram, shards), length, shards, shard_rows, gram), "repeats")
    runs = ws.table(found.groupBy("id").agg(F.collect_list(F.struct("start", "number")).alias("x")).select("id", F.col("x.start").alias("starts"), F.col("x.number").alias("numbers")), "runs")
    ws.drop("repeats")
    ws.release()
    owners = runs.join(classes.select("class", F.col("rep").alias("id")), "id").hint("merge")
    hit = d.join(owners, ["id", "class"])
    hit = hit.dropDuplicates(["class"]) if _repeated(rows) else hit
    cut = ws.table(cut_texts(hit, length, with_text), "cut")
    named = classes.join(cut, "class", "left").select(F.col("sha").alias("of"), "rows", "rep", *cut.drop("class").columns)
    result = hot_join(rows, ws.table(named, "named"), "sha", "of", "rows", "id")
    copy = (F.col("id") > F.col("rep")) & (F.col("n_bytes") >= length)
    result = result.select(
        own_id("id").alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
    return result


def _repeated(rows: DataFrame) -> bool:
    return not rows.groupBy("id").count().where("count > 1").isEmpty()
