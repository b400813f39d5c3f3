"""Known results of the encoding, the samples, the folds and the file formats."""

import random
import struct
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.functions.keys import key_after, next_prefix, prefix_range
from keyloom.functions.tuples import Float32, Subspace, Versionstamp, compare, pack, pack_with_versionstamp, tuple_range, unpack
from keyloom.operators import profiler, stats
from keyloom.operators.folds import apply_legacy, apply_mutation, fold, unstamped_range
from keyloom.operators.layers import from_paths, to_paths
from keyloom.operators.stats import Order
from keyloom.operators.versions import resolve_batch
from keyloom.sources import backup
from keyloom.streaming.changes import Registry, pack_replies

@pytest.mark.parametrize(
    ("value", "digits"),
    [
        (b"foo\x00bar", "01666f6f00ff62617200"),
        ("FÔO\u0000bar", "0246c3944f00ff62617200"),
        ((b"foo\x00bar", None, ()), "0501666f6f00ff6261720000ff050000"),
        (-5551212, "11ab4b93"),
        (Float32(-42.0), "203dd7ffff"),
        (0, "14"),
        (None, "00"),
        (True, "27"),
    ],
)
def test_packed_bytes(value, digits):
    assert pack((value,)).hex() == digits
    assert unpack(bytes.fromhex(digits)) == (value,)


elements = st.recursive(
    st.none() | st.booleans() | st.binary(max_size=6) | st.text(max_size=6) | st.integers(-(1 << 200), 1 << 200) | st.floats(allow_nan=False) | st.uuids(),
    lambda inner: st.lists(inner, max_size=3).map(tuple),
    max_leaves=6,
)


@settings(max_examples=200, deadline=None)
@given(st.lists(elements, max_size=4))
def test_pack_round_trip(items):
    assert unpack(pack(items)) == tuple(items)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(1 << 70), 1 << 70), min_size=2, max_size=5))
def test_integers_sort_as_keys(numbers):
    assert sorted(numbers) == sorted(numbers, key=lambda n: pack((n,)))


def test_floats_sort_in_total_order():
    order = [float("-inf"), -1.5, -0.0, 0.0, 1.5, float("inf")]
    assert [pack((x,)) for x in order] == sorted(pack((x,)) for x in order)


def test_versionstamps():
    open_ = Versionstamp(None, 7)
    key = pack_with_versionstamp(("a", open_), b"p")
    at = int.from_bytes(key[-4:], "little")
    assert key[at : at + 10] == b"\xff" * 10
    with pytest.raises(ValueError):
        pack_with_versionstamp((open_, open_))
    with pytest.raises(ValueError):
        pack_with_versionstamp((1,))
    low, high = unstamped_range(key)
    assert low < key[:at] + b"\x01" * 10 + key[at + 10 : -4] < high
    with pytest.raises(ValueError):
        unstamped_range(b"abc" + struct.pack("<I", 1))


def test_subspaces_and_ranges():
    s = Subspace(("x",))["y"]
    assert s.unpack(s.pack((3,))) == (3,) and s.contains(s.pack())
    begin, end = s.range((1,))
    assert begin < s.pack((1, 0)) < end and not begin <= s.pack((2,)) < end
    assert tuple_range(())[0] == b"\x00" and compare((1, "a"), (1, "b")) == -1
    with pytest.raises(ValueError):
        s.unpack(b"zz")
    assert unpack(pack((uuid.UUID(int=5),)))[0].int == 5


def test_key_helpers():
    assert next_prefix(b"ab\xff") == b"ac" and key_after(b"a") == b"a\x00" and prefix_range(b"a") == (b"a", b"b")
    with pytest.raises(ValueError):
        next_prefix(b"\xff\xff")


def sampled(seed):
    """Sorted (key, size) pairs over some even numbers."""
    rng = random.Random(seed)
    return sorted((2 * k, rng.choice([1, 5, 20, 90, 300])) for k in rng.sample(range(60), rng.randint(1, 40)))


def held(pairs, begin, end):
    return sum(n for k, n in pairs if begin <= k < end)


@pytest.mark.parametrize("seed", range(40))
def test_range_estimates_and_split_points(seed):
    pairs, rng = sampled(seed), random.Random(-seed)
    begin, end = sorted(rng.sample(range(125), 2))
    order = Order(pairs)
    assert order.between(begin, end) == held(pairs, begin, end)
    chunk = rng.choice([1, 50, 200, 1000])
    cuts, at = [], begin
    while True:  # the next cut is the first key behind which more than a chunk was passed, and no cut stands twice
        far = [k for k, n in pairs if k >= at and held(pairs, at, k) + n > chunk and k != at]
        if not far or far[0] >= end:
            break
        at = far[0]
        cuts.append(at)
    for limit in (None, 0, 2):
        assert stats.split_points(order, begin, end, chunk, limit) == cuts[:limit]


@pytest.mark.parametrize("seed", range(40))
def test_hot_ranges(seed):
    pairs, rng = sampled(seed), random.Random(-seed)
    reads = [(k, n * rng.choice([0, 1, 9])) for k, n in sampled(seed + 100)]
    begin, end = sorted(rng.sample(range(125), 2))
    chunk, keys = rng.choice([30, 100, 400]), [k for k, _ in pairs]
    size = held(pairs, begin, end)
    pieces, at = [], begin
    while size > chunk:
        behind = [k for k, n in pairs if held(pairs, 0, k) + n > held(pairs, 0, at) + chunk and k > at]
        if not behind:
            break
        to = min(behind[0], min((k for k in keys if k >= end), default=behind[0]))
        if to <= at:
            break
        pieces.append((at, to))
        at = to
    hot = [p for p in pieces if held(reads, *p) > 2 * max(chunk, held(pairs, *p))]
    merged = []
    for b, e in hot:
        merged[-1:] = [(merged[-1][0], e)] if merged and merged[-1][1] == b else [*merged[-1:], (b, e)]
    if size <= chunk:
        merged = [(begin, end)] if size and held(reads, begin, end) > 2 * size else []
    assert [(b, e) for b, e, *_ in stats.hot_ranges(Order(pairs), Order(reads), begin, end, 2.0, chunk)] == merged


def test_split_metrics_cuts_by_what_is_left():
    order, rates = Order((k, 10) for k in range(1000)), Order((k, 1) for k in range(1000))
    cuts = stats.split_metrics(order, rates, 0, 1000, 3000, 10**9, 100)
    sizes = [held([(k, 10) for k in range(1000)], b, e) for b, e in zip([0, *cuts], [*cuts, 1000], strict=True)]
    left = 10_000
    for size in sizes[:-1]:  # a key has 10
        assert abs(size - left * 3000 / (left + 1500)) <= 10
        left -= size
    assert left <= left * 3000 / (left + 1500) and max(sizes) <= 3000
    tight = stats.split_metrics(order, rates, 0, 1000, 3000, 100, 100)
    assert len(tight) > len(cuts) and all(b - a >= 10 for a, b in zip(tight, tight[1:], strict=False))
    assert stats.split_metrics(order, rates, 0, 1000, 3000, 100, 6000) == []



def test_log_folds():
    le = lambda n, w: n.to_bytes(w, "little")
    assert apply_mutation("add", le(255, 1), le(1, 1)) == b"\x00"
    assert apply_mutation("add", le(300, 2), le(1, 1)) == le((300 + 1) % 256, 1)
    assert apply_mutation("add", le(5, 1), le(1, 4)) == le(6, 4)
    assert apply_mutation("add", None, b"\x07") == b"\x07" and apply_mutation("add", b"\x01", b"") == b""
    assert apply_mutation("and", None, b"\x07") == b"\x07" and apply_legacy("and", None, b"\x07") == b"\x00"
    assert apply_mutation("min", None, b"\x07") == b"\x07" and apply_legacy("min", None, b"\x07") == b"\x00"
    assert apply_mutation("max", le(256, 2), le(3, 2)) == le(256, 2) and apply_mutation("min", le(256, 2), le(3, 2)) == le(3, 2)
    assert apply_mutation("byte_max", b"b", b"abc") == b"b" and apply_mutation("byte_min", b"b", b"abc") == b"abc"
    assert apply_mutation("compare_and_clear", b"x", b"x") is None and apply_mutation("compare_and_clear", b"x", b"y") == b"x"
    big = b"x" * 99_999
    assert apply_mutation("append_if_fits", big, b"yy") == big and apply_mutation("append_if_fits", b"a", b"b") == b"ab"
    assert fold([("set", b"a"), ("append_if_fits", b"b"), ("clear", b""), ("xor", b"\x03"), ("xor", b"\x01")]) == b"\x02"


def test_documents_round_trip():
    doc = {"user": {"name": "x", "tags": ["a", {"b": None}], "none": {}, "list": []}, "n": [1, [2, 3]]}
    assert from_paths(to_paths(doc)) == doc
    assert to_paths({"a": {"b": 1}, "c": []}) == [("a", "b", 1), ("c", -1)]


def test_conflicts_in_a_batch():
    one = lambda k: [(k, k + 1)]
    rows = [(1, 10, one(1), one(2), None), (2, 10, one(2), one(3), None), (3, 10, one(3), one(4), None), (4, 1, one(9), [], None), (5, 10, one(7), one(8), (7, 8)), (6, 10, one(8), [], None)]
    got = resolve_batch(rows, 5)
    # 2 reads what 1 wrote and aborts, so 3 may read what 2 would have written
    assert [g[1] for g in got] == ["committed", "conflict", "committed", "too_old", "conflict", "committed"]


def test_conflicts_match_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        rows = []
        for t in range(12):
            spans = lambda: [(a, a + rng.randint(1, 5)) for a in (rng.randint(0, 40) for _ in range(2))]
            rows.append((t, 10, spans(), spans(), None))
        written, want = set(), []
        for _, _, reads, writes, _ in rows:
            bad = any(k in written for b, e in reads for k in range(b, e))
            want.append("conflict" if bad else "committed")
            if not bad:
                written |= {k for b, e in writes for k in range(b, e)}
        assert [g[1] for g in resolve_batch(rows, 0)] == want


def test_backup_files_round_trip():
    pairs = [(b"k%03d" % i, b"v" * (i % 40)) for i in range(100)]
    data = backup.encode_range(pairs, b"a", b"z", 256)
    blocks = [backup.decode_range(data[i : i + 256]) for i in range(0, len(data), 256)]
    assert [p for _, own, _ in blocks for p in own] == pairs and blocks[0][0] == b"a" and blocks[-1][2] == b"z"
    assert all(a[2] == b[0] for a, b in zip(blocks, blocks[1:], strict=False))
    log = [(v, s, s % 2, b"key%d" % v, b"x" * s) for v in range(30) for s in range(3)]
    data = backup.encode_log(log, 200)
    assert [m for i in range(0, len(data), 200) for m in backup.decode_log(data[i : i + 200])] == log
    with pytest.raises(ValueError):
        backup.decode_range(backup.encode_log(log, 200)[:200])


def test_buckets_of_profiles():
    assert profiler.write_buckets([("a", 3), ("b", 1), ("c", 4), ("d", 2)], 3) == [("a", "a", 3), ("b", "c", 5), ("d", "d", 2)]
    got = profiler.read_buckets([(1, 5), (2, 3), (6, 8), (7, 9)], 2)
    assert got == [(1, 3, 2, 2), (3, 8, 2, 3), (8, 9, 0, 1)]  # the last reads end behind a bucket that was full at 8
    assert [g[:2] for g in profiler.read_buckets([(1, 2), (5, 6)], 2)] == [(1, 2), (5, 6)]
    assert profiler.read_buckets([], 2) == []
    line = [(0, 1, 5), (1, 2, 5), (2, 3, 9), (3, 4, 1)]
    assert stats.merge_shards(line, 3, 10) == (2, 4, 10) and stats.merge_shards(line, 0, 10) == (0, 2, 10) and stats.merge_shards(line, 2, 9) is None
    assert stats.merge_shards(line, 1, 100) == (0, 4, 20) and stats.merge_shards(line, 1, 100, most=2) == (1, 3, 14)
    assert stats.merge_small(line, 10, 6) == [(0, 2, 10), (2, 4, 10)]
    assert pack_replies([(1, 5), (2, 5), (3, 20), (4, 1)], 10) == [[1, 2], [3], [4]]


def test_stream_registry():
    r = Registry()
    assert r.register("a", 0, 5) == r.register("a", 0, 5)
    with pytest.raises(ValueError):
        r.register("a", 0, 6)
    r.acknowledge("a", 9)
    assert r.resume("a", 9) == 10
    with pytest.raises(ValueError):
        r.resume("a", 8)
