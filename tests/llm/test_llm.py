"""The ten operators against brute force, and at the edges."""

import hashlib
import json
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import exact, induced, jpeg, langid, licenses, media, minhash, mixing, packing, pii, suffix, textkit, warc
from lexmill.llm.queries import vocabulary
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("id", "key", "n", "k", "rank", "digest", "size", "class", "start", "number", "base", "family", "cell", "side", "length", "t", "sha")
LONG = "quite a long text of many words " * 20000
EDGE = [
    (1, "the same words in a text that is repeated here and there again", "en", "a", 1),
    (2, "the same words in a text that is repeated here and there again", "en", "a", 1),
    (2, "the same words in a text that is repeated here and there again", "en", "a", 1),
    (3, "the  same words in a text that is repeated here\nand there again", "en", None, 1),
    (4, None, None, None, None),
    (5, "", "en", "b", 0),
    (6, "", "de", "b", 0),
    (7, " \t\n", None, "b", 3),
    (8, LONG, "en", "c", len(LONG)),
    (9, "1234 !!", "en", "c", 7),
    (None, "no id but the same words in a text that is repeated here and there again", "fr", "c", 7),
    (10, "Été \U0001f600 " + "é" * 80, "fr", "a", 80),
]


@pytest.fixture(scope="module")
def edge(spark):
    d = spark.createDataFrame(EDGE, SCHEMA)
    return d.withColumns({c: F.lit(c) for c in CLASH})


OPERATORS = {
    "licenses": licenses.scan_licenses,
    "minhash": lambda d: minhash.near_duplicates(d, width=4),
    "suffix": suffix.remove_repeats,
    "exact": exact.exact_duplicates,
    "media": lambda d: media.read_media(media.write_media(d)),
    "langid": langid.identify,
    "pii": lambda d: pii.digest(pii.find_personal_data(d)),
    "mixing": mixing.mix_sources,
    "packing": lambda d: packing.pack(d, vocabulary()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges_and_empty_table(spark, edge, name):
    got = OPERATORS[name](edge).collect()
    ids = [r["doc_id"] for r in got if "piece" not in r or r["piece"] == 0]
    assert sorted(ids, key=str) == sorted((r[0] for r in EDGE), key=str)
    assert OPERATORS[name](edge.where("false")).count() == 0


def test_exact_edges_and_weak_digest(edge):
    for digest in (None, lambda c: F.substring(F.sha2(c, 256), 1, 1)):
        got = {r.doc_id: r for r in exact.exact_duplicates(edge, digest=digest, memtable=3, fanout=2).collect()}
        assert (got[1].keep_id, got[1].group_size, got[1].kept) == (3, 4, False)
        assert (got[3].keep_id, got[3].kept) == (3, True)
        assert {got[i].keep_id for i in (4, 5, 6, 7)} == {7} and got[5].group_size == 4
        assert got[4].text_sha256 == hashlib.sha256(b"").hexdigest()
        assert got[None].keep_id is None and got[None].kept is None or got[None].group_size == 1


def test_filters_let_every_held_digest_through(spark):
    have = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    held = exact.filters(have.where("digest < '8'"), 3)
    seen = exact.probe(have, held, 3).groupBy(F.col("digest") < "8", "maybe").count().collect()
    got = {(r[0], r[1]): r[2] for r in seen}
    assert (True, False) not in got and got[False, True] < 0.02 * got[False, False]


def sets(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not w else {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(rows, width=4):
    own = {i: sets(t, width) for i, t in rows}
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(own)
    for a in ids:
        for b in ids:
            if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(own[i]), find(i)) for i in ids}


def near_rows(n=160):
    rnd = random.Random(3)
    base = [[rnd.choice(["a", "be", "cat", "dog", "E", "f", "gnu"]) + str(rnd.randint(0, 60)) for _ in range(rnd.randint(2, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "ONE")]


@pytest.mark.parametrize("blocks", [{}, {"list_block": 5, "family_block": 900}])
def test_near_duplicates_against_all_pairs(spark, blocks):
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, **blocks).collect()}
    assert got == components(rows)


def test_suffix_order_with_small_memory():
    rnd = np.random.default_rng(0)
    for n in range(200):
        t = rnd.integers(0, int(rnd.integers(1, 6)), int(rnd.integers(1, 80))).astype(np.uint8)
        t = np.tile(t, 3) if n % 3 == 0 else t
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        for rows in (2, 5, 1000):
            assert induced.order_of(t, False, induced.Work(rows)).tolist() == want
            assert induced.order_of(np.searchsorted(np.sort(t), t), True, induced.Work(max(rows, 4))).tolist() == want
            out, tape = [], induced.Text.tape(False)
            tape.put(t)
            induced.suffix_order(tape, False, induced.Work(rows), 9, None, lambda p, c: out.extend(zip(p.tolist(), c.tolist(), strict=True)))
            assert sorted(p for p, _ in out) == list(range(len(t)))
            for (a, _), (b, c) in zip(out[:-1], out[1:], strict=True):
                x, y = t[a:].tolist(), t[b:].tolist()
                same = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
                assert c == min(same, 9) and (same >= 9 or y < x)


def test_a_shard_ten_times_the_memory():
    """Queues and sorts go to disk, names are sorted by recursion, and memory is that of the bound; the repeats are those of brute force."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(40)]
    shared = [" ".join(rnd.choice(words) for _ in range(14)) for _ in range(30)]
    shard, rows = suffix.Shard(50, 4000), []
    for i in range(500):
        t = f"{i} " + rnd.choice(shared) + f" {rnd.choice(words)}{i} " + rnd.choice(shared)
        rows.append((i, t))
        shard.add(np.array([i]), np.array([0]), np.array([len(t) - 49]), t.encode())
    got = {}
    for ids, start, number in shard.repeats():
        for i, a, n in zip(ids.tolist(), start.tolist(), number.tolist(), strict=True):
            got.setdefault(i, set()).update(range(a, a + n))
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    want = {i: {k for k in range(len(t) - 49) if first[t[k : k + 50]] < i} for i, t in rows}
    assert got == {i: x for i, x in want.items() if x}
    assert shard.bytes.size > 10 * shard.work.rows and shard.work.spilled > 10 and shard.work.levels > 1


def test_names_are_sorted_in_memory_where_they_fit_it():
    t = np.random.default_rng(3).integers(0, 2, 4000).astype(np.uint8)
    want = sorted(range(len(t)), key=lambda i: t[i:].tobytes())
    large, small = induced.Work(1000), induced.Work(20)
    assert induced.order_of(t, False, large).tolist() == want and large.levels == 2
    assert induced.order_of(t, False, small).tolist() == want and small.levels > 2


def test_held_names_by_all_and_by_some():
    rnd = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 300):
        for symbols in (1, 2, 50):
            t = rnd.integers(0, symbols, n)
            t = np.searchsorted(np.sort(t), t)
            assert induced.held_order(t, 0).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
            some = [t[i : i + 7].tolist() for i in induced.held_order(t, 7)]
            assert some == sorted(some)


def test_starts_are_read_once(monkeypatch):
    read, seen = induced.Tape.read, []
    monkeypatch.setattr(induced.Tape, "read", lambda tape, a, b: seen.append(b - a) or read(tape, a, b))
    t = np.random.default_rng(5).integers(0, 256, 20000).astype(np.uint8)
    assert induced.order_of(t, False, induced.Work(1 << 14)).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tobytes())
    assert sum(seen) < 5 * len(t)


def test_suffixes_are_not_copied_field_by_field(monkeypatch):
    """Indexing rows of several fields copies them field by field, some twenty times as slowly as taking them whole."""
    slow = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if self.dtype.names and isinstance(key, np.ndarray):
                slow.append(len(key))
            return super().__getitem__(key)

    take = induced.Queues.take
    monkeypatch.setattr(induced.Queues, "take", lambda q, r: None if (x := take(q, r)) is None else x.view(Watched))
    t = np.random.default_rng(6).integers(0, 9, 5000).astype(np.uint8)
    assert induced.order_of(t, False, induced.Work(1 << 10)).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tobytes())
    assert not slow


def test_rows_by_two_columns(monkeypatch):
    """Rows whose first column decides, or never does, aren't sorted by both."""
    rnd, both = np.random.default_rng(7), []
    lexsort = np.lexsort
    monkeypatch.setattr(induced.np, "lexsort", lambda keys: both.append(len(keys[0])) or lexsort(keys))
    for first in (rnd.integers(0, 1 << 60, 3000), np.zeros(3000, np.int64), rnd.integers(0, 40, 3000)):
        for rows in (5000, 100):
            second = rnd.integers(0, 50, 3000)
            sorter = induced.Sorter([("a", "<u8"), ("b", "<u8"), ("k", "<i8")], 2, induced.Work(rows))
            for a in range(0, 3000, 60):
                sorter.put(first[a : a + 60], second[a : a + 60], np.arange(a, a + 60))
            got = [tuple(r) for block in sorter.blocks() for r in block.tolist()]
            assert [r[:2] for r in got] == sorted(zip(first.tolist(), second.tolist(), strict=True))
            assert sorted(got, key=lambda r: r[2]) == list(zip(first.tolist(), second.tolist(), range(3000), strict=True))
    assert not both


class Stages:
    """Stands for a table: its batches go through a stage in this process, each a block of its own."""

    def __init__(self, batches):
        self.batches = batches

    def select(self, *_):
        return self

    repartition = sortWithinPartitions = select

    def mapInArrow(self, work, _):
        return Stages(list(work(iter(self.batches))))


def marked_texts(rows):
    return Stages([pa.RecordBatch.from_arrays([pa.array([t]), pa.array([i]), pa.array([list(range(len(t)))])], names=["text", "id", "places"]) for i, t in rows])


def test_repeats_within_a_text_of_another_block():
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    passage = text(400)
    rows = [(1, text(60) + passage + text(60)), (2, text(90) + passage + text(70) + passage + text(80))]
    gone = set()
    for batch in suffix.repeats(suffix.segments(marked_texts(rows), 50, 24, 1), 50, 1, 1000).batches:
        for i, start, number in zip(*batch.to_pydict().values(), strict=True):
            gone.update((i, k) for k in range(start, start + number + 49))
    assert len(gone) == cut(rows)[2][1] and {i for i, _ in gone} == {2}


def test_stretches_that_differ_need_no_digest(monkeypatch):
    rnd, named = random.Random(8), []
    digests = suffix.digests
    monkeypatch.setattr(suffix, "digests", lambda values: named.extend(values) or digests(values))
    text = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    passage = text(200)
    sent = suffix.segments(marked_texts([(1, text(3000) + passage + text(500) + passage)]), 50, 24, 1).batches
    stretches = sum(len(x) // 4 for batch in sent for x in batch.column("number").to_pylist())
    assert stretches > 150 and 0 < len(named) < stretches // 3


def test_only_what_other_stretches_may_share_is_sorted(monkeypatch):
    """Stretches that share a gram of 24 bytes but no string aren't sorted; the repeats are those of brute force."""
    rnd, sizes = random.Random(11), []
    order = suffix.suffix_order
    monkeypatch.setattr(suffix, "suffix_order", lambda tape, *x: sizes.append(tape.size) or order(tape, *x))
    text = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    grams, passages = [text(30) for _ in range(20)], [text(n) for n in (50, 51, 57, 64, 80, 200)]
    rows = [(i, "".join(text(rnd.randint(40, 60)) + rnd.choice(grams) for _ in range(8)) + rnd.choice(passages) + text(40)) for i in range(1, 60)]
    gone, sent = {}, suffix.segments(marked_texts(rows), 50, 24, 1)
    for batch in suffix.repeats(sent, 50, 1, 1000).batches:
        for i, start, number in zip(*batch.to_pydict().values(), strict=True):
            gone.setdefault(i, set()).update(x for k in range(start, start + number) for x in range(k, k + 50))
    assert {i: len(x) for i, x in gone.items()} == {i: x[1] for i, x in cut(rows).items() if x[1]}
    assert len(sizes) <= 3 and 0 < sizes[0] < sum(len(x) for batch in sent.batches for x in batch.column("bytes").to_pylist()) // 3


def test_fingerprints_are_dealt_evenly():
    rnd = random.Random(12)
    rows = [(i, "".join(rnd.choice("abcdefghij ") for _ in range(4000))) for i in range(10)]
    dealt = np.zeros(16, int)
    for batch in suffix.fingerprints(marked_texts(rows), 50, 24, 16).batches:
        for b, x in zip(batch.column("bucket").to_pylist(), batch.column("class").to_pylist(), strict=True):
            dealt[b] += len(x) // 8
    assert dealt.sum() > 2000 and dealt.max() < 2 * dealt.mean()


def cut(rows, n=50):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            first.setdefault(b[k : k + n], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < i:
                gone[k : k + n] = b"\1" * n
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 2000, "shard_bytes": 1500, "bucket_rows": 50, "shard_rows": 40}])
def test_repeats_against_brute_force(spark, sizes):
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "é", "delta", "x", "yy"]) for _ in range(n))
    passages = [text(12) for _ in range(4)]
    rows = [(i, rnd.choice(["", None, text(3), "a" * rnd.randint(40, 120), text(5) + rnd.choice(passages) + text(rnd.randint(0, 9)) + rnd.choice(passages), rnd.choice(passages)])) for i in range(150)]
    got = {r[0]: tuple(r)[1:5] for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **sizes).collect()}
    assert got == cut(rows)


def test_media_round_trip_and_general_decoder(spark, edge):
    read = media.read_media(media.write_media(edge), with_payload=True).join(edge.select("doc_id", "text").distinct(), F.lit(True)).select("payload", "payload_bytes", "n_bytes", "tail_crc32")
    payloads = {bytes(r.payload) for r in read.distinct().collect()}
    for _, text, *_ in EDGE:
        b = (text or "").encode()
        assert b + bytes(max(64, -(-len(b) // 64) * 64) - len(b)) in payloads
    s = np.random.default_rng(1).integers(0, 256, (5, 64)).astype(np.uint8)
    frame = jpeg.Frame(jpeg.encode_rows(s.ravel(), np.array([5]))[0])
    assert (jpeg.decode_flat([frame])[0] == s).all() and (jpeg.decode(frame)[::8, ::8] == s).all()


def test_shots_at_a_change():
    h = np.zeros((30, 4))
    h[:10, 0] = h[10:, 2] = 64
    assert [x[:2] for x in media.shots(h)] == [(0, 10), (10, 30)]


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    x = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert x.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_language_und(edge):
    got = {r.doc_id: r for r in langid.identify(edge).collect()}
    assert {got[i].lang_pred for i in (4, 5, 7, 9)} == {"und"} and got[1].lang_pred != "und"
    assert got[1].held_out == (zlib.crc32(b"1") % 3 == 1)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    luhn = sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]


def test_personal_data_against_plain_patterns(spark):
    texts = ["", "a@b.com_x@y.z q.r@s.t.u. é x@y", None, "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111111111111111 4111111111111111 12 34  5 - 6 0000000000000000 000000000000000000000000", "+1 (555) 555-5555 ext +44.20.7946.0958- +1+2 +12 345 678 901 234 567 \U0001f600 x@y.z", "9 " * 20000, "1" * 30000, "a" * 50000 + "@", "a.b@c." * 500 + "d"]
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, t in enumerate(texts):
        base = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if valid(kind, m.group()))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in base).encode()).hexdigest()


def test_contexts_find_unseen_identifiers(spark):
    """Seeds in a context teach it; unseen identifiers there are found, and numbers elsewhere are not."""
    seeds, unseen, secret = ["4111111111111111", "4012888888881881", "5555555555554444"], ["4111111111111112", "4999999999999991"], "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"
    rows = [f"please charge card no {v} today" for v in (*seeds, *unseen)]  # by the two words before
    rows += [f"{w} host {v} answers" for w, v in zip("abcde", ("10.0.0.1", "10.0.0.2", "10.0.0.3", "10.0.0.300", "10.0.0.400"), strict=True)]  # by the words on both sides
    rows += [f'x token = "{secret}" y', f'token="{secret}"', f"the year {1990} and {2020} of {16} to {4111111111111119}", *(f"of the {4111111111111113 + 10 * i} in" for i in range(30)), "of the 4111111111111111 in"]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).collect()}
    assert [got[i] for i in range(5)] == ["card:22:38"] * 5
    assert [got[i] for i in (5, 8, 9)] == ["ip:7:15", "ip:7:17", "ip:7:17"]
    assert got[10] == "secret:11:51" and got[11] == "secret:7:47" and got[12] == ""
    assert [got[i] for i in range(13, 43)].count("") >= 27 and got[43] == "card:7:23"


def test_pattern_scores_against_brute_force(spark):
    from lexmill.plans.checkpoint import Workspace

    rnd = random.Random(4)
    kinds = {f"v{i}": rnd.choice([None, None, "a", "b"]) for i in range(40)}
    facts = [(f"p{rnd.randint(0, 12)}", v, kinds[v]) for v in kinds for _ in range(rnd.randint(1, 4))]
    score = {(v, k): 1.0 for v, k in kinds.items() if k}
    for turn in range(3):
        kept = {}
        for p in {f[0] for f in facts}:
            own = {f[1] for f in facts if f[0] == p}
            mass = {k: sum(score.get((v, k), 0.0) for v in own) for k in "ab"}
            rest = max(0, len(own) - sum((v, k) in score for v in own for k in "ab"))
            for k in "ab":
                if mass[k] >= 1.5 and mass[k] / (sum(mass.values()) + 0.25 * rest) >= 0.5:
                    kept[p, k] = mass[k] / (sum(mass.values()) + 0.25 * rest)
        score = {(v, k): 1.0 for v, k in kinds.items() if k}
        for v in (v for v, k in kinds.items() if not k):
            for k in "ab":
                own = [kept[p, k] for p in {f[0] for f in facts if f[1] == v} if (p, k) in kept]
                if own:
                    score[v, k] = 1 - float(np.prod([1 - c for c in own]))
    got = pii.score_patterns(spark.createDataFrame(facts, "pattern string, value string, kind string"), 3, 1.5, 0.5, Workspace(spark, "t")).collect()
    assert {(r.pattern, r.kind): r.confidence for r in got} == pytest.approx(kept) and kept


def test_mix_meets_targets(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(EDGE, SCHEMA))
    r = mixing.mix_sources(d, stretch=7).collect()
    by = {}
    for x in r:
        assert x.taken <= 2 * x.size
        by.setdefault(x.source, []).append(x)
    for xs in by.values():
        assert abs(sum(x.taken for x in xs) - xs[0].target) <= 1
    total = sum(x.size for x in r)
    assert sum(xs[0].target for xs in by.values()) == pytest.approx(1.5 * total)
    assert [x.taken for x in sorted(r, key=str)] == [x.taken for x in sorted(mixing.mix_sources(d, stretch=50).collect(), key=str)]


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(vocabulary()), packing.PieceTokenizer(vocabulary())
    for x in ["", "It's (don't) !'s a'b x'll 'S 12ab3.5 ..a… —b é. É ß STRASSE İx", "a<|endoftext|>b STR", "x\x1cy \x85\xa0a 1'll", "a.'s b,'ve -'d", "\x00a hello\x0bworld"]:
        import pyarrow as pa

        ids, _ = own.encode(*textkit.string_bytes(pa.array([x])))
        assert ids.tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_packing_places(spark, edge):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    got = packing.pack(edge, vocabulary(), stretch=2).collect()
    rows = sorted((r.sequence_id, r.offset, r.length) for r in got)
    at = {}
    for s, offset, n in rows:
        assert offset == at.get(s, 0)
        at[s] = offset + n
    assert max(at.values()) <= 2048
    ids = [*t.encode(LONG, add_special_tokens=False).ids, 0]
    own = sorted((r for r in got if r.doc_id == 8), key=lambda r: r.piece)
    assert [r.start for r in own] == list(range(0, len(ids), 2048))
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)


HISTOGRAMS = {"wide": lambda r: r.lognormal(6, 0.9, 50000), "short": lambda r: r.lognormal(5.5, 1.2, 50000), "middle": lambda r: r.integers(300, 900, 50000)}


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_plan_by_configurations(name):
    lengths = np.clip(HISTOGRAMS[name](np.random.default_rng(0)), 1, 2048).astype(int)
    h = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plans = [packing.plan_shape(h, 2048, *shape) for shape in packing.SHAPES]
    plan = packing.plan_sequences(h)
    count = {}
    for n, parts in plan:
        assert sum(parts) <= 2048
        for p in parts:
            count[p] = count.get(p, 0) + n
    assert count == h
    rest = {n: c for n, c in h.items() if n < 2048}
    assert sum(n for n, _ in plan) <= h.get(2048, 0) + sum(n for n, _ in packing.best_fit([], rest, 2048))
    for (part, _), (_, inside) in zip(packing.SHAPES, plans, strict=True):
        assert inside >= 0.9 * sum(c for n, c in rest.items() if n > 2048 // part)


def fewest(lengths, capacity):
    best = [len(lengths)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for r in {*rooms}:
            if r >= lengths[i]:
                k = rooms.index(r)
                put(i + 1, [*rooms[:k], r - lengths[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best[0]


def test_plan_of_small_optima():
    rnd = random.Random(2)
    for _ in range(25):
        lengths = sorted((rnd.randint(1, 100) for _ in range(rnd.randint(1, 11))), reverse=True)
        h = {n: lengths.count(n) for n in lengths}
        assert sum(n for n, _ in packing.plan_sequences(h, 100)) <= fewest(lengths, 100) + 1


def thue_morse(n):
    """A word of a and b and its complement, which collide under any polynomial hash modulo a power of two."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 8192])
def test_no_polynomial_collisions(spark, n):
    from tokenizers import Tokenizer

    t, (a, b) = Tokenizer.from_file(vocabulary()), thue_morse(n)
    texts = [f"x y z {a}", f"x y z {b}"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert all(r.kept for r in minhash.near_duplicates(d, width=4).collect())
    got = {r.doc_id: r for r in packing.pack(d, vocabulary()).where("piece = 0").collect()}
    for i, x in enumerate(texts):
        assert got[i].ids_crc32 == zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0][:2048], "<u4").tobytes())
    got = {r[0]: tuple(r)[1:5] for r in suffix.remove_repeats(d).collect()}
    assert got == cut(list(enumerate(texts)))


@pytest.mark.parametrize("quality", [0, 1, None])
def test_mix_stretches_hold_equal_rows(spark, quality):
    d = spark.range(60000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    labels = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(quality)).otherwise(1).cast("int").alias("quality"))
    plan = mixing.mix_sources(d, labels=labels, stretch=1000, with_stretch=True)
    rows = [r[1] for r in plan.groupBy("stretch").count().collect()]
    assert max(rows) < 1400 and sum(rows) == 60000
    by = {r[0]: r[1] for r in mixing.mix_sources(d, labels=labels, share=0.5).join(labels, "doc_id").groupBy("quality").agg(F.avg("taken")).collect()}
    assert quality == 1 or by[1] > 1.2 * by[quality]


def test_equal_keys_go_by_id(spark):
    d = spark.createDataFrame([(7, "a b"), (7, "a b"), (7, "a b c"), (None, "x"), (None, None)], "doc_id long, text string").withColumn("source", F.lit("s"))
    got = mixing.mix_sources(d, share=0.5, stretch=1).collect()
    assert sum(r.taken for r in got) == 4 and len(got) == 5
    assert mixing.mixed_documents(d, share=0.5).count() >= 1


def test_arc_versions_and_warc(spark):
    for version in (1, 2):
        data = warc.arc_file(version, "x.arc", "20240102030405", [("http://a/ b", "text/html", b"HTTP/1.1 200 OK\r\n\r\nhi\n\nthere"), ("ftp://c", "text/plain", b"")])
        records = list(warc.parse_arc(data))
        assert [h["url"] for h, _ in records] == ["filedesc://x.arc", "http://a/%20b", "ftp://c"] and records[1][1].endswith(b"hi\n\nthere")
        made = [next(warc.parse_warc(warc.to_warc(*r) + b"\r\n\r\n")) for r in records]
        assert [h["warc-type"] for h, _ in made] == ["warcinfo", "response", "resource"]
        assert made[1][0]["warc-date"] == "2024-01-02T03:04:05Z" and made[1][0]["warc-payload-digest"] == f"sha1:{warc.digest32(b'hi' + b'\n\n' + b'there')}"


def test_pages_edges(spark):
    pages = spark.createDataFrame([(1, "http://a b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (None, "u", "é\r\n\r\n" * 50), (5, "u", "<p>x</p>"), (6, "u", LONG), (7, "u", LONG), (8, "u", "a\r\n\r\n"), (9, "u", "\r\n\r\n\r\n\r\n"), (None, "u", "<p>x</p>")], "page_id long, url string, html string").withColumn("sha", F.lit(1))
    rows = warc.archive_pages(pages, file_records=2).collect()
    got = {r.page_id: r for r in rows if r.page_id or r.payload_bytes == 300}
    assert len(rows) == 11 and [r.refers_to for r in rows if r.page_id is None and r.payload_bytes == 8] == [5]
    assert (got[6].refers_to, got[7].payload_bytes, got[8].payload_bytes, got[9].payload_bytes, got[9].record_type) == (7, len(LONG), 5, 8, "response")
    assert (got[1].record_type, got[1].refers_to, got[2].refers_to, got[5].record_type) == ("revisit", 5, 5, "response")
    assert (got[3].refers_to, got[4].record_type, got[3].payload_bytes) == (4, "response", 0) and got[None].record_type == "response" and got[None].payload_bytes == 300
    assert warc.archive_pages(pages.where("false")).count() == 0


def test_license_statements_and_pruning(spark):
    body = licenses.TEMPLATES["MIT"][1]
    d = spark.createDataFrame([(1, "Words here.\nReleased under the MIT License.\nMore."), (2, body.upper()), (3, body.replace(" of ", "\nof ", 3)), (4, "Released"), (5, None), (6, "x\n" + body.replace("merge", "melt") + "\ny")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    assert [got[i].license for i in range(1, 7)] == ["MIT", "MIT", "MIT", None, None, "MIT"]
    assert [(s.start, s.end) for s in got[1].spans] == [(1, 2)] and [(s.start, s.end) for s in got[6].spans] == [(1, 2)]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    d = spark.createDataFrame(EDGE, SCHEMA).unionByName(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id > 100"))
    d = d.withColumns({c: F.lit(c) for c in (*CLASH, "_id", "_of", "_sha", "_hash", "_lang_pred", "_lang_score", "_lang_share", "_size", "_taken", "_copy", "_row", "piece")})
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == d.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, d = d, spark.read.parquet(path)
        if name == "language_id":
            assert {r[0] for r in before.subtract(d).select("doc_id").collect()} == {4, 5, 6, 7, 9}
        if name == "exact_dedup":
            assert d.count() == d.select(exact.normal()).distinct().count() == before.select(exact.normal()).distinct().count()
        if name == "minhash_near_dedup":
            want = components([(-1 if i is None else i, t) for i, t in before.select("doc_id", "text").collect()], 5)
            assert d.count() == len({c for _, c in want.values()})
        if name == "source_mix":
            words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
            plan = {(r.doc_id, r.text_hash): r for r in mixing.mix_sources(before, labels=spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            size = {}
            for r in d.select("doc_id", "text", F.xxhash64("text").alias("h")).collect():
                size[r.doc_id] = size.get(r.doc_id, 0) + len(words(r.text))
            assert size == {r.doc_id: r.taken for r in plan.values() if r.taken}
        if name == "best_fit_packing":
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(vocabulary())
            want = sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.select("text").collect())
            got = {}
            for r in d.collect():
                got.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert sum(want) == sum(n for x in got.values() for _, n in x) and sum(-(-n // 2048) for n in want) == d.count()
            assert all(o == sum(n for _, n in sorted(x)[:k]) for x in got.values() for k, (o, _) in enumerate(sorted(x)))
    assert {"sequence_id", "offset"} <= set(d.columns) and json.dumps(d.columns)


def test_pipeline_stages_of_an_empty_table(spark):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0


def test_language_kernel_against_brute_force():
    """Responses of the model against kernel ridge regression on Nystrom features, with presence vectors as Python sets."""
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(w) for _ in range(20)) for w in (["the", "and", "of"], ["der", "und", "von"]) for _ in range(12)]
    labels = ["en"] * 12 + ["de"] * 12
    model = langid.fit(texts, labels, landmarks=8, ridge=1e-2)
    sets_ = [frozenset(np.flatnonzero(langid.presence([t])[0][0]).tolist()) for t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    marks = [*sets_[12:16], *sets_[:4]]  # labels in order: de, en
    mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(mm)
    good = value > 1e-6 * value[-1]
    feature = lambda s: np.append(np.array([kernel(s, b) for b in marks]) @ (vector[:, good] / np.sqrt(value[good])), 1.0)
    z = np.array([feature(s) for s in sets_])
    y = np.array([[1.0 if x == k else -1.0 for k in ("de", "en")] for x in labels])
    penalty = 1e-2 * len(z) * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    want = z @ np.linalg.solve(z.T @ z + penalty, z.T @ y)
    assert model.labels == ["de", "en"] and np.allclose(model.scores(texts)[0], want, atol=2e-3)


def test_language_model_is_fitted_in_little_memory():
    rnd = random.Random(2)
    words = {k: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(200)] for k in ("de", "en", "es", "fr")}
    labels = [k for k in words for _ in range(400)]
    texts = [" ".join(rnd.choice(words[k]) for _ in range(40)) for k in labels]
    tracemalloc.start()
    model = langid.fit(texts, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 96 << 20 and model.best(texts)[0] == labels


def test_media_facts_of_every_row(spark, edge):
    rows = edge.select("doc_id", "text").distinct()
    stored = {r.doc_id: bytes(r.media) for r in media.write_media(rows).collect()}
    got = {r.doc_id: r for r in media.read_media(media.write_media(rows)).collect()}
    for i, text, *_ in {(r[0], r[1]) for r in EDGE}:
        b = (text or "").encode()
        full = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        x = got[i]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(b), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert (x.media_bytes, x.media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
    clips = media.clip_rows(media.read_media(media.write_media(rows))).collect()
    assert {c.doc_id for c in clips} == set(got) and all(c.end_s > c.start_s >= 0 and c.frames > 0 for c in clips)
    assert sum(c.frames for c in clips if c.doc_id == 8) == -(-len(LONG) // (64 * media.FRAME_ROWS))


def test_pipeline_rejects_foreign_texts(spark):
    import corpus_pipeline

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("bcdfghjklmnpqrstvwxzaeiouy") for _ in range(rnd.randint(3, 9)))
    foreign = ["Η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί", "Быстрая коричневая лиса перепрыгивает через ленивую собаку", "敏捷的棕色狐狸跳过懒狗", "привет", "xq zvk wqpj", *(" ".join(word() for _ in range(n)) for n in (60, 3000))]
    own = spark.read.parquet(f"{SF}/documents.parquet")
    d = own.unionByName(spark.createDataFrame([(-1 - i, t, None, "x", len(t)) for i, t in enumerate(foreign)], SCHEMA))
    got = [r[0] for r in corpus_pipeline.language(spark, d, SF).select("doc_id").collect()]
    assert sorted(got) == sorted(r[0] for r in own.where(F.col("text").rlike("[a-zA-Z]")).select("doc_id").collect())


def test_licenses_wrapped_and_joined(spark):
    import textwrap

    mit, bsd, apache = (licenses.TEMPLATES[k][-1] for k in ("MIT", "BSD-2-Clause", "Apache-2.0"))
    wrap = lambda t, n: "\n".join(textwrap.wrap(t, n, break_on_hyphens=False))
    texts = [*(wrap(mit, n) for n in (50, 60, 66)), wrap(bsd, 60), "MIT License\nCopyright (c) 2020 Some Body\n" + wrap(mit, 64), wrap(mit, 80) + "\n\n" + wrap(apache, 80), wrap(apache, 80) + "\n" + wrap(mit, 80)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[i].license, got[i].dice) for i in range(4)] == [("MIT", 1.0)] * 3 + [("BSD-2-Clause", 1.0)]
    assert got[4].license == "MIT" and [s.license for s in got[5].spans] == ["MIT", "Apache-2.0"] and [s.license for s in got[6].spans] == ["Apache-2.0", "MIT"]
    assert all(s.dice == 1.0 for i in (5, 6) for s in got[i].spans)


def test_licenses_embedded(spark):
    mit, apache = licenses.TEMPLATES["MIT"][1], licenses.TEMPLATES["Apache-2.0"][1]
    texts = ["Some prose before. Released under the MIT License. And some prose of the author behind.", f"we said: {mit} and so on, {apache} that is all", "the of and in to a permission is hereby", licenses.TEMPLATES["BSD-3-Clause"][0].lower()]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0].license, got[0].dice) == ("MIT", 1.0) and [(x.license, x.dice) for x in got[1].spans] == [("MIT", 1.0), ("Apache-2.0", 1.0)]
    assert got[2].license is None and got[3].license == "BSD-3-Clause"


def test_licenses_against_brute_force():
    """The best coefficient over all windows of words and all templates."""
    rnd = random.Random(6)
    templates = {name: [" ".join(rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(n))] for name, n in (("A", 9), ("B", 14), ("C", 25))}
    own = licenses.Matcher(templates, 0.8)

    def grams(w):
        return set(zip(["", *w[:-1]], w, strict=True))

    sets_ = {name: grams(t[0].split()) for name, t in templates.items()}
    hits = 0
    for _ in range(150):
        w = [rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(rnd.randint(0, 12))]
        for _ in range(rnd.randint(0, 2)):
            t = list(templates[rnd.choice("ABC")][0].split())
            for _ in range(rnd.choice([0, 1, 1, 2])):
                t[rnd.randrange(len(t))] = "new"
            w += t + [rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(rnd.randint(0, 9))]
        want = max((2 * len(grams(w[a:b]) & s) / (b - a and len(grams(w[a:b])) + len(s)) for a in range(len(w)) for b in range(a + 1, len(w) + 1) for s in sets_.values()), default=0)
        data = np.frombuffer(" ".join(w).encode(), np.uint8)
        gram, first, _ = licenses.bigrams(data, np.array([0, len(data)]))
        found = own.windows(gram, first, own.held(gram))
        assert bool(found) == (want >= 0.8)
        hits += bool(found)
        if found:
            assert all(found[k][1] <= found[k + 1][0] for k in range(len(found) - 1)) and max(x[2] for x in found) <= want + 1e-12
    assert hits > 40
