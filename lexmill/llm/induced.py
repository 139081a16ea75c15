"""External suffix sorting by induction.

The text, the sorted pieces, the strings of names and the orders lie on disk; what is held in memory is bounded by a number of rows. Suffixes leave
queues in their order as tuples of position, preceding symbols and common prefix, and induce the suffixes before them; symbols come from the tuples, which are
filled up from the text once their preceding symbols are used up. Files have no names and end with their task.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

#: Rows that one sort, queue or batch holds in memory.
ROWS = 1 << 18
#: Names that are ordered in memory, for each row that may be held: five words of a name take less than the copies of a queue's item.
HELD = 8
#: A common prefix that isn't known yet.
OPEN = 255

Block = tuple[np.ndarray, np.ndarray]


class Tape:
    """Rows on disk: appended at the end, read anywhere."""

    def __init__(self, kind):
        self.kind, self.file, self.size = np.dtype(kind), tempfile.TemporaryFile(buffering=0), 0

    def put(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        data, at = memoryview(np.ascontiguousarray(rows, self.kind).view("u1")), self.size * self.kind.itemsize
        while len(data):  # a call may write less than all
            done = os.pwrite(self.file.fileno(), data, at)
            data, at = data[done:], at + done
        self.size += len(rows)

    def read(self, a: int, b: int) -> np.ndarray:
        out = np.empty(max(0, b - a), self.kind)
        data, at = memoryview(out.view("u1")), a * self.kind.itemsize
        while len(data):
            done = os.preadv(self.file.fileno(), [data], at)
            if not done:
                raise EOFError("rows past the end of a tape")
            data, at = data[done:], at + done
        return out

    def blocks(self, rows: int) -> Iterator[np.ndarray]:
        for a in range(0, self.size, rows):
            yield self.read(a, min(self.size, a + rows))

    def array(self, writable: bool = False) -> np.ndarray:
        """The rows as an array that is mapped, not read."""
        return np.asarray(np.memmap(self.file, self.kind, "r+" if writable else "r", shape=(self.size,))) if self.size else np.zeros(0, self.kind)

    def zeros(self, size: int) -> np.ndarray:
        self.file.truncate(size * self.kind.itemsize)
        self.size = size
        return self.array(True)

    def close(self) -> None:
        self.file.close()


@dataclass
class Work:
    """Bounds of one sort, and what it did: runs and queue parts that went to disk, levels of recursion."""

    rows: int = ROWS
    spilled: int = 0
    levels: int = 0


class Sorter:
    """Rows in the order of one or two key columns: sorted runs of bounded size go to disk and are merged block by block."""

    def __init__(self, kind: list[tuple[str, str]], keys: int, work: Work):
        self.kind, self.keys, self.work = np.dtype(kind), [name for name, _ in kind[:keys]], work
        self.held: list[np.ndarray] = []
        self.count, self.runs, self.tape, self.size = 0, [], None, 0

    def put(self, *columns: np.ndarray) -> None:
        rows = np.empty(len(columns[0]), self.kind)
        for name, column in zip(self.kind.names, columns, strict=True):
            rows[name] = column
        self.size += len(rows)
        self.held.append(rows)
        self.count += len(rows)
        if self.count >= self.work.rows:
            self.tape = self.tape or Tape(self.kind)
            self.runs.append((self.tape.size, self.tape.size + self.count))
            self.tape.put(self._sorted(self.held))
            self.held, self.count = [], 0
            self.work.spilled += 1

    def _sorted(self, parts: list[np.ndarray], merge: bool = False) -> np.ndarray:
        """Rows of all parts in order, equal ones in any; with ``merge`` the parts are sorted, which a stable sort makes use of."""
        rows = joined(parts)
        return rows.take(key_order([rows[k] for k in self.keys], "stable" if merge else None))

    def _upto(self, rows: np.ndarray, last: np.void) -> int:
        """How many of the sorted rows aren't above ``last``."""
        a, b = 0, len(rows)
        for k in self.keys:
            part = rows[k][a:b]
            a, b = a + int(np.searchsorted(part, last[k])), a + int(np.searchsorted(part, last[k], "right"))
        return b

    def blocks(self) -> Iterator[np.ndarray]:
        if not self.runs:
            if self.held:
                rows = self._sorted(self.held)
                self.held = []
                for a in range(0, len(rows), self.work.rows):
                    yield rows[a : a + self.work.rows]
            return
        if self.held:
            self.runs.append((self.tape.size, self.tape.size + self.count))
            self.tape.put(self._sorted(self.held))
            self.held = []
        step = max(64, self.work.rows // len(self.runs))
        at, ends = [a for a, _ in self.runs], [b for _, b in self.runs]
        have = [np.zeros(0, self.kind) for _ in self.runs]
        while True:
            for i in range(len(at)):
                if not len(have[i]) and at[i] < ends[i]:
                    b = min(ends[i], at[i] + step)
                    have[i], at[i] = self.tape.read(at[i], b), b
            live = [i for i in range(len(at)) if len(have[i])]
            if not live:
                break
            waiting = [have[i][-1] for i in live if at[i] < ends[i]]  # of these runs larger rows are still on disk
            last = min(waiting, key=lambda r: tuple(r[k] for k in self.keys)) if waiting else None
            parts = []
            for i in live:
                cut = len(have[i]) if last is None else self._upto(have[i], last)
                parts.append(have[i][:cut])
                have[i] = have[i][cut:]
            yield self._sorted(parts, True)
        self.tape.close()


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """Parts of rows as one; as plain words, since NumPy compares the fields of all parts otherwise."""
    kind = parts[0].dtype
    return parts[0].copy() if len(parts) == 1 else np.concatenate([x.view(f"V{kind.itemsize}") for x in parts]).view(kind)


def key_order(keys: list[np.ndarray], kind: str | None) -> np.ndarray:
    """The order of rows by one or two columns; rows with equal first ones by the ranks of the second. Equal rows come in any order."""
    if len(keys) == 2 and len(keys[0]) and keys[0].min() == keys[0].max():
        keys = keys[1:]
    order = np.argsort(keys[0], kind=kind)
    if len(keys) == 1:
        return order
    first = keys[0].take(order)
    same = first[1:] == first[:-1]
    tied = np.flatnonzero(np.append(False, same) | np.append(same, False))
    if len(tied):
        rows, first = order.take(tied), first.take(tied)
        group = np.cumsum(np.append(False, first[1:] != first[:-1]))
        rank = np.empty(len(rows), np.int64)
        rank[np.argsort(keys[1].take(rows))] = np.arange(len(rows))
        order[tied] = rows.take(np.argsort((group << 32) | rank))
    return order


def ahead(blocks: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.void | None]]:
    """Blocks with the first row of the next one."""
    last = None
    for b in blocks:
        if not len(b):
            continue
        if last is not None:
            yield last, b[0]
        last = b
    if last is not None:
        yield last, None


class Text:
    """Symbols on disk, of one byte or of four, with room before them so that the symbols before any place are one word."""

    def __init__(self, tape: Tape, wide: bool):
        self.bits, self.each = (32, 2) if wide else (8, 8)
        data = tape.array()
        self.size = tape.size - self.each
        self.symbols = data[self.each :]
        self.words = np.ndarray(self.size + 1, "<u8", data, 0, (data.itemsize,)) if self.size else np.zeros(1, "<u8")

    @staticmethod
    def tape(wide: bool) -> Tape:
        out = Tape("<u4" if wide else "u1")
        out.put(np.zeros(2 if wide else 8, out.kind))
        return out


def rising_starts(text: Text, rows: int) -> np.ndarray:
    """Left-most rising places (smaller than the next suffix, where the one before isn't), rising, on disk."""
    tape, after, up_after = Tape("<u4"), None, False
    for end in range(text.size, 0, -rows):
        a = max(0, end - rows)
        x = np.array(text.symbols[a:end])
        final = after is not None and (x[-1] < after or x[-1] == after and up_after)
        change = np.flatnonzero(x[1:] != x[:-1])  # ends of runs of equal symbols but the last
        up = np.repeat(np.append(x[change] < x[change + 1], final), np.diff(np.concatenate([[-1], change, [len(x) - 1]])))
        if after is not None and up_after and not up[-1]:
            tape.put(np.array([end]))
        tape.put((np.flatnonzero(up[1:] & ~up[:-1]) + a + 1)[::-1])
        after, up_after = x[0], bool(up[0])
    return tape.array()[::-1]


def piece_keys(text: Text, at: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """The symbols of pieces from ``depth`` on, as many as fit one word. Past a piece's end stands what is larger than any symbol: where one piece
    begins another, its last symbol rises and the other's falls. Past the text's end stands what is smaller."""
    bits, each = (31, 2) if text.bits == 32 else (9, 7)
    most = np.uint64((1 << bits) - 1)
    key = np.zeros(len(at), np.uint64)
    for k in range(depth, depth + each):
        p = at + k
        inside = p < end
        s = text.symbols[np.minimum(p, text.size - 1)].astype(np.uint64) + np.uint64(1)
        key = (key << np.uint64(bits)) | np.where(inside, s, np.where(end < text.size, most, np.uint64(0)))
    return key


def name_pieces(text: Text, at: np.ndarray, depth: int, work: Work) -> tuple[Tape, bool, list[int]]:
    """The string of names of the pieces from each left-most rising place to the next one, its first symbol included; whether all differ; and frequent names.

    A name is the number of smaller pieces. Pieces are sorted by a word of symbols at a time, from disk; those alone or at their end leave. Beyond ``depth`` symbols (0: all)
    pieces count as equal.
    """
    m, each = len(at), 2 if text.bits == 32 else 7

    def ends(k: np.ndarray) -> np.ndarray:
        return np.where(k + 1 < m, at[np.minimum(k + 1, m - 1)].astype(np.int64) + 1, text.size)

    named = Sorter([("k", "<i8"), ("name", "<i8")], 1, work)
    turn = Sorter([("group", "<i8"), ("key", "<u8"), ("k", "<i8")], 2, work)
    for a in range(0, m, work.rows):
        k = np.arange(a, min(m, a + work.rows))
        turn.put(np.zeros(len(k), np.int64), piece_keys(text, at[k].astype(np.int64), ends(k), 0), k)
    done, distinct, frequent = each, True, []
    while turn.size:
        after = Sorter([("group", "<i8"), ("key", "<u8"), ("k", "<i8")], 2, work)
        index, group, key, first, place, run = 0, -1, None, 0, 0, (-1, 0)
        for rows, following in ahead(turn.blocks()):
            here = np.arange(index, index + len(rows))
            fresh = np.concatenate([[rows["group"][0] != group], rows["group"][1:] != rows["group"][:-1]])
            new = fresh | np.concatenate([[key is None or rows["key"][0] != key], rows["key"][1:] != rows["key"][:-1]])
            firsts = np.maximum.accumulate(np.where(fresh, here, first))
            places = np.maximum.accumulate(np.where(new, here, place))
            name = rows["group"] + places - firsts
            index, group, key, first, place = index + len(rows), rows["group"][-1], rows["key"][-1], firsts[-1], places[-1]
            alone = new & np.append(new[1:], following is None or following["group"] != group or following["key"] != key)
            start = at[rows["k"]].astype(np.int64)
            end = ends(rows["k"])
            left = ~alone & (end >= start + done) & (not depth or done < depth)
            named.put(rows["k"][~left], name[~left])
            if not (alone | left).all():
                distinct = False
                same = name[~left & ~alone]
                value, count = np.unique(same, return_counts=True)
                for v, c in zip(value.tolist(), count.tolist(), strict=True):
                    run = (v, c + (run[1] if run[0] == v else 0))
                    if run[1] > work.rows // 2 and (not frequent or frequent[-1] != v):
                        frequent.append(v)
            if left.any():
                after.put(name[left], piece_keys(text, start[left], end[left], done), rows["k"][left])
        turn, done = after, done + each
    out = Text.tape(True)
    for rows in named.blocks():
        out.put(rows["name"])
    return out, distinct, sorted(set(frequent))


#: A suffix in a queue: its place and first symbol, the symbols before it and how many of them are left; of the batch that induced it the number,
#: the smallest common prefix up to the inducing suffix and after it, and the common prefix with the one induced before in the same queue.
ITEM = np.dtype([("pos", "<u4"), ("before", "<u8"), ("symbol", "<u4"), ("turn", "<i4"), ("left", "u1"), ("head", "u1"), ("tail", "u1"), ("same", "u1")])


class Queues:
    """A priority queue of suffixes: one queue for each range of first symbols, first in first out, as induction meets suffixes in their order. Together they
    hold a bounded number of items in memory; further parts go to disk."""

    def __init__(self, count: int, work: Work):
        self.parts: list[list] = [[] for _ in range(count)]
        self.held, self.work = 0, work
        self.tape, self.live = None, {}

    def put(self, queue: int, items: np.ndarray) -> None:
        if self.held + len(items) > self.work.rows:
            if self.tape is None or self.tape.size > self.work.rows:
                self.tape = Tape(ITEM)
                self.live[self.tape] = 0
            self.parts[queue].append((self.tape.size, self.tape.size + len(items), self.tape))
            self.live[self.tape] += len(items)
            self.tape.put(items)
            self.work.spilled += 1
        else:
            self.held += len(items)
            self.parts[queue].append(items)

    def close(self) -> None:
        for tape in self.live:
            tape.close()
        self.live = {}

    def take(self, queue: int) -> np.ndarray | None:
        """The next items, a bounded number."""
        parts, out, size = self.parts[queue], [], 0
        while parts and size < self.work.rows:
            x = parts[0]
            if isinstance(x, tuple):
                a, b = x[0], min(x[1], x[0] + self.work.rows - size)
                out.append(x[2].read(a, b))
                parts[0] = (b, x[1], x[2])
                if b == x[1]:
                    parts.pop(0)
                self.live[x[2]] -= b - a
                if not self.live[x[2]] and x[2] is not self.tape:  # a file whose items have all left gives its room back
                    del self.live[x[2]]
                    x[2].close()
            else:
                out.append(parts.pop(0))
                self.held -= len(x)
            size += len(out[-1])
        return joined(out) if out else None

    def put_all(self, queue: np.ndarray, items: np.ndarray) -> None:
        """Items in this order into their queues."""
        for a, b in runs_of(queue):
            self.put(int(queue[a]), items[a:b])


def runs_of(x: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]).tolist() if len(x) else [0]
    yield from zip(cut[:-1], cut[1:], strict=True)


def exponents(x: np.ndarray) -> np.ndarray:
    """The exponents of positive whole numbers as floats: the place of the highest bit of those that a float holds exactly."""
    return (x.astype(np.float64).view(np.int64) >> 52) - 1023


def range_minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of ``x[a:b]``, none empty, from minima of stretches of powers of two."""
    if not len(a):
        return np.zeros(0, x.dtype)
    level = exponents(b - a).astype(np.uint8)
    out = np.empty(len(a), x.dtype)
    for k in range(int(level.max()) + 1):
        if k:
            x = np.minimum(x[: -(1 << (k - 1))], x[1 << (k - 1) :])
        i = np.flatnonzero(level == k)
        out[i] = np.minimum(x[a[i]], x[b[i] - (1 << k)])
    return out


def common(text: Text, p: np.ndarray, q: np.ndarray, limit: int) -> np.ndarray:
    """Common prefixes of suffixes of bytes, up to ``limit``, from the text."""
    out = np.full(len(p), limit, np.int64)
    far = np.maximum(p, q) + -(-limit // 8) * 8 <= text.size
    live = np.flatnonzero(far)
    a, b = p[live] + 8, q[live] + 8
    for k in range(0, limit, 8):
        x = text.words[a] ^ text.words[b]
        differ, equal = np.flatnonzero(x), np.flatnonzero(x == 0)
        x = x[differ]
        out[live[differ]] = k + exponents(x & (~x + np.uint64(1))) // 8
        live, a, b = live[equal], a[equal] + 8, b[equal] + 8
        if not len(live):
            break
    for i in np.flatnonzero(~far).tolist():  # near the text's end
        s, t = np.asarray(text.symbols[p[i] : p[i] + limit]), np.asarray(text.symbols[q[i] : q[i] + limit])
        n = min(len(s), len(t))
        differ = np.flatnonzero(s[:n] != t[:n])
        out[i] = differ[0] if len(differ) else n
    return np.minimum(out, limit)


@dataclass
class Sweep:
    """One pass of induction: falling suffixes from the order of left-most rising ones, by rising symbols, or rising ones from all falling ones, by falling symbols.

    Of each symbol first the induced suffixes are met, then the given ones; each meets the suffix before it, which is induced if its symbol isn't nearer
    (for a given one: farther). ``lows`` begin ranges of symbols; a range of one symbol is a stream of any length, one of several is ordered in memory.
    With ``limit``, every range is one symbol, and common prefixes are carried: of two induced neighbours one more than the smallest among the
    suffixes that were met between their successors.
    """

    text: Text
    lows: np.ndarray
    single: np.ndarray
    down: bool
    work: Work
    limit: int = 0
    minima: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.queues = Queues(len(self.lows), self.work)
        self.tops = np.append(self.lows[1:], np.uint64(1) << np.uint64(33)).astype(np.int64)

    def range_of(self, symbol: np.ndarray) -> np.ndarray:
        if self.text.bits == 8:  # each byte is a range
            return symbol
        return np.searchsorted(self.lows, symbol, "right") - 1

    def refill(self, items: np.ndarray) -> None:
        empty = np.flatnonzero(items["left"] == 0)
        items["before"][empty] = self.text.words[items["pos"][empty]]
        items["left"][empty] = self.text.each

    def given(self, pos: np.ndarray) -> np.ndarray:
        items = np.zeros(len(pos), ITEM)
        items["pos"] = pos
        items["symbol"] = self.text.symbols[pos]
        return items

    def before(self, items: np.ndarray, induced: np.ndarray | bool) -> tuple[np.ndarray, np.ndarray]:
        """Which items induce the suffix before them, and that one's symbol."""
        self.refill(items)
        symbol = (items["before"] >> np.uint64(64 - self.text.bits)).astype(np.int64)
        own = items["symbol"].astype(np.int64)
        farther = symbol < own if self.down else symbol > own
        return (items["pos"] > 0) & (farther | (symbol == own) & induced), symbol

    def made(self, items: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The suffixes before these items, a copy that is changed in place."""
        items["pos"] -= np.uint32(1)
        items["symbol"] = symbol
        items["before"] <<= np.uint64(self.text.bits)
        items["left"] -= np.uint8(1)
        return items

    def meet(self, items: np.ndarray, induced: bool, prefix: np.ndarray | None) -> None:
        """Induces from a batch in order; ``prefix`` has each one's common prefix with the one met before."""
        ok, symbol = self.before(items, induced)
        which = np.flatnonzero(ok)
        to = self.range_of(symbol[which])
        order = np.argsort(to.astype(np.uint8 if len(self.lows) <= 1 << 8 else np.uint16) if len(self.lows) <= 1 << 16 else to, kind="stable")
        to, which = to[order], which[order]
        out = self.made(items.take(which), symbol[which])  # take: indexing copies rows field by field
        if prefix is not None:
            out["turn"] = len(self.minima)
            out["head"] = np.minimum.accumulate(prefix)[which]
            out["tail"] = np.append(np.minimum.accumulate(prefix[::-1])[::-1], OPEN)[which + 1]
            out["same"] = OPEN
            next_ = np.flatnonzero(to[1:] == to[:-1]) + 1
            out["same"][next_] = range_minima(prefix, which[next_ - 1] + 1, which[next_] + 1)
            self.minima.append(int(prefix.min(initial=OPEN)))
        self.queues.put_all(to, out)

    def carried(self, items: np.ndarray, last: np.void | None) -> np.ndarray:
        """Common prefixes of a queue's next items with the ones before them."""
        between = items["same"].astype(np.int64)
        turn = np.concatenate([[-2 if last is None else last["turn"]], items["turn"][:-1]])
        tail = np.concatenate([[0 if last is None else last["tail"]], items["tail"][:-1]]).astype(np.int64)
        for i in np.flatnonzero(turn != items["turn"]).tolist():
            between[i] = min([int(tail[i]), int(items["head"][i]), *self.minima[turn[i] + 1 : items["turn"][i]]]) if turn[i] > -2 else -1
        return np.minimum(between + 1, self.limit).astype(np.uint8)

    def run(self, given: Callable[[int], Iterator[Block]], out: Callable[[int, np.ndarray, np.ndarray | None, bool], None]) -> None:
        """Meets all suffixes; ``given(range)`` has blocks of places and common prefixes, ``out`` takes (range, places, common prefixes, induced) in order."""
        order = range(len(self.lows) - 1, -1, -1) if self.down else range(len(self.lows))
        for r in order:
            (self.stream if self.single[r] else self.gather)(r, given, out)

    def stream(self, r: int, given, out) -> None:
        last = None
        while (items := self.queues.take(r)) is not None:
            prefix = self.carried(items, last) if self.limit else None
            last = items[-1]
            out(r, items["pos"].astype(np.int64), prefix, True)
            self.meet(items, True, prefix)
        for pos, prefix in given(r):
            if self.limit and last is not None:  # the seam of induced and given ones, from the text
                prefix = prefix.copy()
                prefix[0] = common(self.text, np.array([int(last["pos"])]), pos[:1], self.limit)[0]
                last = None
            out(r, pos, prefix, False)
            self.meet(self.given(pos), False, prefix)

    def gather(self, r: int, given, out) -> None:
        """A range of several symbols, in memory: suffixes that are induced within the range are ordered by what they lead to, by doubling."""
        parts, induced = [], []
        while (items := self.queues.take(r)) is not None:
            parts.append(items)
            induced.append(np.ones(len(items), bool))
        for pos, _ in given(r):
            parts.append(self.given(pos))
            induced.append(np.zeros(len(pos), bool))
        if not parts:
            return
        low, top = int(self.lows[r]), int(self.tops[r])
        roots = sum(map(len, parts))
        jump = [np.full(roots, -1)]
        frontier, kind, base = np.concatenate(parts), np.concatenate(induced), 0
        kinds = [np.where(kind, 0, 2)]
        parts, push, symbols = [], [], []
        while len(frontier):
            ok, symbol = self.before(frontier, kind)
            inside = ok & (symbol >= low) & (symbol < top)
            parts.append(frontier)
            push.append(ok & ~inside)
            symbols.append(symbol)
            which = np.flatnonzero(inside)
            fresh = self.made(frontier.take(which), symbol[which])
            jump.append(base + which)
            kinds.append(np.ones(len(which), np.int64))
            base += len(frontier)
            frontier, kind = fresh, np.ones(len(fresh), bool)
        items, jump, kind = np.concatenate(parts), np.concatenate(jump), np.concatenate(kinds)
        push, symbol = np.concatenate(push), np.concatenate(symbols)
        own = items["symbol"].astype(np.int64)
        arrival = np.where(kind == 1, 0, np.arange(len(items)))
        rank = ranks(-own if self.down else own, kind, arrival)
        while (jump >= 0).any():
            rank = ranks(rank, np.where(jump >= 0, rank[jump] + 1, 0))
            jump = np.where(jump >= 0, jump[jump], -1)
        order = np.argsort(rank)
        out(r, items["pos"][order].astype(np.int64), None, kind[order] < 2)
        order = order[push[order]]
        made = self.made(items.take(order), symbol[order])
        to = self.range_of(symbol[order])
        stable = np.argsort(to, kind="stable")
        self.queues.put_all(to[stable], made.take(stable))


def ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows by their columns."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def ranges_of(text: Text, names: int, frequent: list[int], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges of symbols begin, and which are one symbol: each byte, or names in stretches of ``rows`` (a name is the number of smaller ones) with frequent ones apart."""
    if text.bits == 8:
        return np.arange(256), np.ones(256, bool)
    own = np.array(sorted({f for f in frequent}), np.int64)
    lows = np.unique(np.concatenate([np.arange(0, max(names, 1), max(1, rows // 2)), own, own + 1]))
    return lows, np.isin(lows, own)


def by_name(names: Tape, work: Work) -> np.ndarray:
    """Places in the order of their names alone."""
    out, order = Sorter([("name", "<u4"), ("k", "<u4")], 1, work), Tape("<u4")
    for a in range(2, names.size, work.rows):
        name = names.read(a, min(names.size, a + work.rows))
        out.put(name, np.arange(a - 2, a - 2 + len(name)))
    for rows in out.blocks():
        order.put(rows["k"])
    return order.array()


def held_order(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a string of names that fits memory, by their first ``depth`` names at least (0: by all), by doubling; one sort of words for each."""
    m = len(names)
    bits = np.uint64(m.bit_length())
    place = np.arange(m, dtype=np.uint64)
    rank, far = names.astype(np.uint64) + np.uint64(1), 1
    while True:
        key = rank << bits
        key[:-far] |= rank[far:]
        if 3 * int(bits) <= 64:
            key = (key << bits) | place
            key.sort()
            order = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            key >>= bits
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        rank[order] = np.cumsum(np.append(True, key[1:] != key[:-1])).astype(np.uint64)
        far *= 2
        if int(rank[order[-1]]) == m or far >= m or 0 < depth <= far:
            return order


def suffix_order(tape: Tape, wide: bool, work: Work, depth: int = 0, frequent: list[int] | None = None, visit: Callable[[np.ndarray, np.ndarray], None] | None = None) -> np.ndarray | None:
    """Suffixes in order, by their first ``depth`` symbols at least (0: by all), on disk.

    ``tape`` is made by ``Text.tape``. The pieces between left-most rising suffixes are named in order; the string of names is sorted by
    recursion, down to one that fits memory; from its order first the falling, then the rising suffixes are induced. With ``visit``, of bytes only, places and common prefixes of neighbours up to ``depth``
    are handed out in falling order instead: each prefix is that with the place before.
    """
    text = Text(tape, wide)
    if text.size >= 1 << 32:
        raise ValueError("places have 32 bits")
    work.levels += 1
    if wide and 0 < text.size <= HELD * work.rows:
        return held_order(np.asarray(text.symbols), depth)
    limit = depth if visit else 0
    lows, single = ranges_of(text, text.size, frequent or [], work.rows)
    at = rising_starts(text, work.rows)
    starts = Tape("<u4")
    if len(at):
        names, distinct, often = name_pieces(text, at, depth, work)
        if distinct or 0 < depth <= 2:  # one name decides
            order = by_name(names, work)
        else:
            order = suffix_order(names, True, work, (depth + 1) // 2, often)
        for a in range(0, len(order), work.rows):
            starts.put(at[np.asarray(order[a : a + work.rows]).astype(np.int64)])
        names.close()

    def neighbours(pos: np.ndarray, last: int | None) -> np.ndarray:
        before = np.concatenate([[pos[0] if last is None else last], pos[:-1]])
        out = common(text, before, pos, limit).astype(np.uint8)
        if last is None:
            out[0] = 0
        return out

    # falling suffixes, range by range on one tape
    falls, prefixes, where = Tape("<u4"), Tape("u1"), {}
    sweep = Sweep(text, lows, single, False, work, limit)
    end = sweep.given(np.array([text.size - 1])) if text.size else np.zeros(0, ITEM)
    end["turn"] = -1
    sweep.queues.put_all(sweep.range_of(end["symbol"].astype(np.int64)), end)
    at_start, ready, ready_range = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)  # starts that were read and wait for their ranges

    def given(r: int) -> Iterator[Block]:
        nonlocal at_start, ready, ready_range
        last = None
        while len(ready) or at_start < starts.size:
            if not len(ready):
                end = min(starts.size, at_start + work.rows)
                ready = starts.read(at_start, end).astype(np.int64)
                ready_range, at_start = sweep.range_of(text.symbols[ready].astype(np.int64)), end
            inside = int(np.searchsorted(ready_range, r, "right"))
            if not inside:
                return
            pos, ready, ready_range = ready[:inside], ready[inside:], ready_range[inside:]
            yield pos, neighbours(pos, last) if limit else None
            last = int(pos[-1])

    def keep(r: int, pos: np.ndarray, prefix: np.ndarray | None, induced) -> None:
        if induced is False:
            return
        if induced is not True:
            pos = pos[induced]
        where.setdefault(r, falls.size)
        falls.put(pos)
        if limit:
            prefixes.put(prefix)

    sweep.run(given, keep)
    sweep.queues.close()
    starts.close()
    bounds = {r: (a, b) for (r, a), b in zip(where.items(), [*list(where.values())[1:], falls.size], strict=True)}

    # rising suffixes, and all suffixes in falling order
    result = None if visit else Tape("<u4")
    back = Sweep(text, lows, single, True, work, limit)

    def given_back(r: int) -> Iterator[Block]:
        a, b = bounds.get(r, (0, 0))
        first = True
        for end in range(b, a, -work.rows):
            begin = max(a, end - work.rows)
            pos, prefix = falls.read(begin, end)[::-1].astype(np.int64), None
            if limit:  # the prefix with the place before is now that of the place after
                prefix = np.append(prefixes.read(begin + 1, end), 0 if first else prefixes.read(end, end + 1)[0])[::-1].astype(np.uint8)
            first = False
            yield pos, prefix

    def hand_out(r: int, pos: np.ndarray, prefix: np.ndarray | None, induced) -> None:
        visit(pos, prefix) if visit else result.put(pos)

    back.run(given_back, hand_out)
    back.queues.close()
    falls.close()
    return None if visit else result.array()[::-1]


def order_of(symbols: np.ndarray, wide: bool, work: Work, depth: int = 0) -> np.ndarray:
    """Suffixes of symbols in memory, in order: bytes, or (``wide``) names, each of which is the number of smaller symbols."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    tape = Text.tape(wide)
    tape.put(symbols)
    return np.array(suffix_order(tape, wide, work, depth))
