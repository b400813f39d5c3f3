"""N-gram Jaccard join by PartEnum signatures (any style: NumPy for shingles, DataFrames for the rest).

A document's set holds the 64-bit hashes of its distinct shingles. Sizes fall into bands
[L, 2L); a set also joins the bands above its own in which it is large enough to match a set. Sets
of sizes r and s with Jaccard >= t differ in at most k = floor((1 - t) / t * r) features.
A band cuts the feature domain by a hash into n1 partitions and each of them into n2 parts; a signature is made of
one partition and a subset of n2 - k2 of its parts, for all such subsets, and hashes the features in
them, of which there must be one. ``Scheme.plan`` chooses n1, n2 and k2
for every band: of the plans with at most some 1.5 (k + 1) signatures that whose signatures cover most features.

Why similar sets share a signature: call a partition thin for a set if its features stand in k2 parts or fewer.
Where two sets differ in at most k2 parts of a partition that is not thin for one of them, they agree on a subset with a
feature. Partitions in which more parts differ take k2 + 1 differing features each, so there are at most
k / (k2 + 1) of them. Each set signs its partitions up to the floor(k / (k2 + 1)) + 1st that is not thin, and one mark
for all sets of the band if it has not so many; so either both have the mark or they share a subset.

Sets that are equal become one class first. In each bucket of a signature the members are compared
with one member (a star), which joins large groups of copies with few comparisons. Where
members of one bucket are still in different components, all pairs between
components are compared inside the bucket, in blocks of BLOCK members. A block whose pairs that may be similar
are few gives them all; any other gives a minimum spanning forest of them at first, which joins large groups, and
all pairs between the components that are left in a second round. Pairs are compared by sketches first: the features
are dealt into cells, one byte of each cell's sum is kept, and the cells that differ are a lower
bound of the features that differ, so that no similar pair is lost. What
passes is verified with the texts. Nothing is capped.

Rows: one for each input row. Null and empty texts have no set and link with nothing;
component_id is then the smallest id its other rows reach, or doc_id. Rows with equal ids are one document in the graph, whatever
their texts. A row without an id gets the smallest id of the component of the documents with its set, or null. Very long
texts are read whole. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import annotate, discard, fits, materialise, settle

#: Words of a shingle, and the threshold as a ratio of integers.
SHINGLE = 4
SIMILAR = (85, 100)
#: Ids that are broadcast at most to pick the texts that are verified.
BROADCAST_IDS = 200_000
#: Members of a bucket that one task compares with as many others.
BLOCK = 1024
#: Pairs for each member of a block that are given without a spanning forest first.
FEW = 8
#: Sets that a task remembers to have signed.
MET = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LONG_WORD = 48


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (one more entry than texts)."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(d) + 1 for d in data])
    raw = _LOWER[np.frombuffer(b" ".join([*data, b""]), np.uint8)]
    inside = ~_SPACE[raw]
    edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    by_size, first = lengths[order], starts[order]
    h = np.zeros(len(starts), np.uint64)
    for step in range(min(LONG_WORD, int(by_size[0])) if len(by_size) else 0):
        n = int(np.searchsorted(-by_size, -step, side="left"))  # words of more than ``step`` bytes
        h[:n] = h[:n] * _MIX + _CODE[raw[first[:n] + step]]
    for i in range(int(np.searchsorted(-by_size, -LONG_WORD, side="left"))):
        word = raw[first[i] : first[i] + by_size[i]].tobytes()
        h[i] = np.uint64(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
    out = np.empty_like(h)
    out[order] = mix(h + by_size.astype(np.uint64))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return out, np.searchsorted(starts, begins)


def shingle_sets(texts: Sequence[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words, at = word_hashes(texts)
    n = len(words)
    run = np.zeros(n, np.uint64)
    for k in range(size):
        if n > k:
            run[: n - k] = mix(run[: n - k] * _MIX + words[k:] + np.uint64(k))
    out = []
    for a, b in zip(at, at[1:], strict=False):
        if b - a >= size:
            out.append(np.unique(run[a : b - size + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = mix(h * _MIX + w + np.uint64(b - a) * np.uint64(1000))
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Scheme:
    """Bands, partitions and signatures for a threshold of num / den."""

    #: Where bands of sizes begin.
    EDGES = tuple(1 << b for b in range(40))

    def __init__(self, num: int = SIMILAR[0], den: int = SIMILAR[1]):
        self.num, self.den = num, den
        self.plans: dict[int, tuple[int, int, int]] = {}

    def differ(self, n: int) -> int:
        """Features in which a set of n and a similar one differ at most."""
        return (self.den - self.num) * n // self.num

    def bands(self, n: int) -> list[int]:
        own = bisect.bisect_right(self.EDGES, n) - 1
        out = [own]
        while self.num * self.EDGES[out[-1] + 1] <= self.den * n:
            out.append(out[-1] + 1)
        return out

    def plan(self, band: int) -> tuple[int, int, int]:
        """n1, n2 and k2 of a band."""
        if band not in self.plans:
            k = self.differ(self.EDGES[band + 1] - 1)
            options = []
            for k2 in range(min(k, 3) + 1):
                n1 = k // (k2 + 1) + 1
                n1 += 1 + n1 // 16 if n1 > 1 else 0  # so that a set with thin partitions still has enough
                for n2 in range(k2 + 1, k2 + 4):
                    if (k // (k2 + 1) + 1) * math.comb(n2, k2) <= 1.5 * (k + 1) + 2:
                        options.append(((n2 - k2) / (n1 * n2), -math.comb(n2, k2), (n1, n2, k2)))
            self.plans[band] = max(options)[2]
        return self.plans[band]

    def signatures(self, features: np.ndarray) -> np.ndarray:
        n = len(features)
        if not n:
            return np.zeros(0, np.uint64)
        out = []
        for band in self.bands(n):
            n1, n2, k2 = self.plan(band)
            need = self.differ(n) // (k2 + 1) + 1
            seed = mix(np.array([band + 1], np.uint64) * _MIX)
            spread = mix(features ^ seed)
            part = ((spread >> np.uint64(32)) * np.uint64(n1 * n2) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(n1 * n2, np.uint64)
            np.add.at(sums, part, mix(spread + _MIX))
            sums = sums.reshape(n1, n2)
            held = np.bincount(part, minlength=n1 * n2).reshape(n1, n2) > 0
            full = np.flatnonzero(held.sum(axis=1) > k2)  # the others are thin
            upto = full[need - 1] + 1 if len(full) >= need else n1
            place = seed + np.arange(upto, dtype=np.uint64) * np.uint64(64)
            for k, subset in enumerate(itertools.combinations(range(n2), n2 - k2)):
                h = place + np.uint64(k)
                for c in subset:
                    h = mix(h * _MIX + sums[:upto, c])
                out.append(h[held[:upto][:, subset].any(axis=1)])
            if len(full) < need:
                out.append(seed)
        return np.concatenate(out)


def cells_of(n: int) -> int:
    """Cells of the sketch of a set of n."""
    return 1 << max(2, (n - 1).bit_length() - 1)


def sketch(features: np.ndarray) -> bytes:
    """One byte of the sum of the features in each cell."""
    if not len(features):
        return b""
    cells = cells_of(len(features))
    spread = mix(features + np.uint64(77))
    at = spread >> np.uint64(64 - cells.bit_length() + 1)
    return np.bincount(at.astype(np.int64), weights=(spread & np.uint64(255)).astype(float), minlength=cells).astype(np.int64).astype(np.uint8).tobytes()


def fold_to(sketch_bytes: bytes, cells: int) -> np.ndarray:
    """The sketch with fewer cells: neighbours are added."""
    own = np.frombuffer(sketch_bytes, np.uint8)
    return own.reshape(cells, -1).sum(axis=1, dtype=np.uint8)


def may_be_similar(a: bytes, b: bytes, n: int, m: int, num: int, den: int) -> bool:
    cells = min(len(a), len(b))
    return int((fold_to(a, cells) != fold_to(b, cells)).sum()) <= (den - num) * (n + m) // (den + num)


def compare_bucket(
    ids: np.ndarray, sizes: np.ndarray, parts: np.ndarray, sketches: list[bytes], num: int, den: int, halves: np.ndarray | None = None, forest: bool = False
) -> tuple[list[tuple[int, int]], bool]:
    """Pairs (x, y), x < y, of different parts that may be similar, and whether these are all; with ``halves`` only pairs between the two.

    With ``forest``, where they are over FEW for each member, only those that join parts, the most alike first.
    """
    cells = min(map(len, sketches))
    table = np.stack([fold_to(s, cells) for s in sketches])
    left, right, apart = [], [], []
    for i in range(len(ids) - 1):
        other = (parts[i + 1 :] != parts[i]) & (ids[i + 1 :] != ids[i])
        if halves is not None:
            other &= halves[i + 1 :] != halves[i]
        most = (den - num) * (sizes[i] + sizes[i + 1 :]) // (den + num)
        other &= np.abs(sizes[i + 1 :] - sizes[i]) <= most
        j = np.flatnonzero(other)
        if not len(j):
            continue
        differ = np.count_nonzero(table[i + 1 + j] != table[i], axis=1)
        near = differ <= most[j]
        if near.any():
            right.append(j[near] + i + 1)
            left.append(np.full(len(right[-1]), i))
            apart.append(differ[near])
    if not left:
        return [], True
    x, y, d = np.concatenate(left), np.concatenate(right), np.concatenate(apart)
    whole = not forest or len(x) <= FEW * len(ids)
    if not whole:
        parts = np.unique(parts, return_inverse=True)[1]
        root = list(range(int(parts.max()) + 1))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        keep = []
        for k in np.argsort(d, kind="stable"):
            a, b = find(int(parts[x[k]])), find(int(parts[y[k]]))
            if a != b:
                root[a] = b
                keep.append(k)
        x, y = x[keep], y[keep]
    return [(min(ids[i], ids[k]), max(ids[i], ids[k])) for i, k in zip(x, y, strict=True)], whole


def fingerprint(features: np.ndarray) -> tuple[int, int]:
    """Two numbers that tell sets apart."""
    if not len(features):
        return 0, 0
    a = mix(np.add.reduce(mix(features + np.uint64(1)), keepdims=True) + np.uint64(len(features)))
    b = mix(np.add.reduce(mix(features ^ np.uint64(0x5555555555555555)), keepdims=True))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def connected(links: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex of each vertex's component, over links (a, b) by minimum labels and pointer jumping."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")))
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("c").alias("near"))
        low = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("c").alias("was"), F.least("c", "near").alias("c"))
        low = materialise(low)
        to = low.select(F.col("v").alias("to"), F.col("c").alias("jump"))
        after = materialise(low.join(to, F.col("c") == F.col("to")).select("v", "was", F.least("c", "jump").alias("c")))
        discard(labels, low)
        labels = after
        if not labels.where("c <> was").limit(1).count():
            discard(both)
            return labels


def compare_runs(batches, num: int, den: int, forest: bool = False):
    """``compare_bucket`` for each run of equal (sig, i, j) in sorted rows; a run that a batch leaves open waits for the next.

    Rows with a sig instead of a pair name the buckets that have more pairs than were given.
    """
    held: pa.Table | None = None

    def work(table: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        ids, sizes, own, sig = (table.column(c).to_numpy() for c in ("sid", "n", "own", "sig"))
        parts = np.unique(table.column("c").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
        sketches = table.column("sketch").to_pylist()
        pairs: set[tuple[int, int]] = set()
        more: set[int] = set()
        for a, b in zip(first, [*first[1:], len(ids)], strict=True):
            halves = own[a:b] if i[a] != j[a] else None
            found, whole = compare_bucket(ids[a:b], sizes[a:b], parts[a:b], sketches[a:b], num, den, halves, forest)
            pairs.update(found)
            if not whole:
                more.add(int(sig[a]))
        columns = [[p[k] for p in pairs] + [None] * len(more) for k in (0, 1)] + [[None] * len(pairs) + list(more)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["x", "y", "sig"])

    def starts(table: pa.Table) -> np.ndarray:
        keys = [table.column(c).to_numpy() for c in ("sig", "i", "j")]
        return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        first = starts(held)
        if len(first) > 1:
            yield work(held.slice(0, first[-1]).combine_chunks(), first[:-1])
            held = held.slice(first[-1]).combine_chunks()
    if held is not None:
        yield work(held.combine_chunks(), starts(held))
    settle()


def link_documents(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: tuple[int, int] = SIMILAR, size: int = SHINGLE
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach)."""
    docs = documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text"))
    num, den = similar
    scheme = Scheme(num, den)

    def make():
        met: dict[int, None] = {}  # sets that this task has signed already: a group of copies signs once in a task

        def signed(print_: int, features: np.ndarray) -> np.ndarray:
            if print_ in met:
                return np.zeros(0, np.int64)
            if len(met) >= MET:
                met.clear()
            met[print_] = None
            return scheme.signatures(features).view(np.int64)

        def work(texts):
            sets = shingle_sets(texts, size)
            prints = [fingerprint(s) for s in sets]
            sigs = [signed(p[0], s) for p, s in zip(prints, sets, strict=True)]
            return {"n": [len(s) for s in sets], "sid": [p[0] for p in prints], "more": [p[1] for p in prints], "sigs": sigs, "sketch": [sketch(s) for s in sets]}

        return work

    signed = materialise(annotate(docs, ["doc_id"], "text", make, "n bigint, sid bigint, more bigint, sigs array<bigint>, sketch binary"))
    # one exchange by signature; a bucket is kept if it has two sets
    bucket = Window.partitionBy("sig")
    spread = signed.select("sid", F.explode("sigs").alias("sig")).repartition("sig")
    shared = spread.select("sig", "sid", F.min("sid").over(bucket).alias("low"), F.max("sid").over(bucket).alias("high")).where("low < high")
    members = materialise(shared.select("sig", "sid").distinct())
    rows = materialise(signed.select("doc_id", "n", "sid", "more"))
    classes = materialise(rows.where("n > 0 and doc_id is not null").groupBy("sid", "more", "n").agg(F.min("doc_id").alias("rep")))
    # sketches of the sets that are in shared buckets at all; equal sets have equal sketches, so any of a class will do
    ids = materialise(members.select("sid").distinct())
    few = fits(ids, BROADCAST_IDS)
    near_ids = F.broadcast(ids) if few else ids
    drawn = signed.select("sid", "n", "sketch").join(near_ids, "sid", "left_semi")
    sketches = materialise(drawn.groupBy("sid").agg(F.min(F.struct("n", "sketch")).alias("s")).select("sid", "s.n", "s.sketch"))
    discard(signed)
    # and the texts of one document of each, which pairs are verified with
    wanted = classes.join(ids, "sid", "left_semi").select(F.col("rep").alias("id"))
    wanted = materialise(wanted.distinct())
    chosen = docs.join(F.broadcast(wanted) if fits(wanted, BROADCAST_IDS) else wanted, F.col("doc_id") == F.col("id"), "left_semi")
    texts = materialise(chosen.dropDuplicates(["doc_id", "text"]) if _repeats(rows) else chosen)

    def sketched(pairs: DataFrame) -> DataFrame:
        """Pairs (x, y) of sids whose sketches do not rule them out."""
        one = sketches.select(F.col("sid").alias("x"), F.col("n").alias("n_x"), F.col("sketch").alias("s_x"))
        two = sketches.select(F.col("sid").alias("y"), F.col("n").alias("n_y"), F.col("sketch").alias("s_y"))
        near = pairs.join(one, "x").join(two, "y").where(f"{den} * least(n_x, n_y) >= {num} * greatest(n_x, n_y)").select("x", "y", "n_x", "n_y", "s_x", "s_y")

        def run(batches):
            for batch in batches:
                n, m, a, b = (batch.column(i).to_pylist() for i in range(2, 6))
                ok = [may_be_similar(p, q, i, j, num, den) for p, q, i, j in zip(a, b, n, m, strict=True)]
                yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))
            settle()

        return near.mapInArrow(run, "x bigint, y bigint")

    def verify(pairs: DataFrame) -> DataFrame:
        """Links (a, b), a < b, between representatives among pairs (x, y) of sids."""
        one = classes.select(F.col("sid").alias("x"), F.col("rep").alias("rep_x"))
        two = classes.select(F.col("sid").alias("y"), F.col("rep").alias("rep_y"))
        near = pairs.join(one, "x").join(two, "y").where("rep_x <> rep_y")
        near = materialise(near.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct())
        # only the texts of these pairs are dealt out
        asked = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        held = texts.join(F.broadcast(asked) if fits(near, BROADCAST_IDS // 2) else asked, F.col("doc_id") == F.col("id"), "left_semi")
        joined = near.join(held.select(F.col("doc_id").alias("a"), F.col("text").alias("t")), "a")
        joined = joined.join(held.select(F.col("doc_id").alias("b"), F.col("text").alias("u")), "b").select("a", "b", "t", "u")

        def check(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, 128):
                    part = batch.slice(start, 128)
                    left, right = shingle_sets(part.column(2).to_pylist(), size), shingle_sets(part.column(3).to_pylist(), size)
                    ok = []
                    for s, u in zip(left, right, strict=True):
                        common = len(np.intersect1d(s, u, assume_unique=True))
                        ok.append(den * common >= num * (len(s) + len(u) - common))
                    yield part.select([0, 1]).filter(pa.array(ok, pa.bool_()))
            settle()

        links = materialise(joined.mapInArrow(check, near.schema))
        discard(near)
        return links

    # every bucket around one member; the same few members are the centres of most buckets of a group
    centre = members.groupBy("sig").agg(F.min(F.struct(F.xxhash64("sid").alias("o"), F.col("sid").alias("y"))).alias("m")).select("sig", "m.y")
    star = members.join(centre, "sig").where("sid <> y").select(F.least("sid", "y").alias("x"), F.greatest("sid", "y").alias("y")).distinct()
    links = verify(sketched(star)).union(_same_id(rows, classes))
    components = connected(links)

    # buckets of three or more that are still in several components, all pairs between components
    todo = members
    for forest in (True, False):
        at = classes.join(components, F.col("rep") == F.col("v"), "left").groupBy("sid").agg(F.min(F.coalesce("c", "rep")).alias("c"))
        here = todo.join(materialise(at), "sid")
        open_ = here.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("p"), F.max("c").alias("q")).where("k > 2 and p < q").select("sig", "k")
        blocks = F.ceil(F.col("k") / BLOCK).cast("bigint")
        placed = here.join(open_, "sig").select("sig", "sid", "c", F.pmod(F.xxhash64("sid", "sig"), blocks).alias("own"), blocks.alias("blocks"))
        dealt = placed.select("sig", "sid", "c", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("sig", "sid", "c", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        dealt = dealt.join(sketches, "sid").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
        run = functools.partial(compare_runs, num=num, den=den, forest=forest)
        found = materialise(dealt.select("sig", "i", "j", "sid", "n", "c", "own", "sketch").mapInArrow(run, "x bigint, y bigint, sig bigint").distinct())
        more = verify(found.where("sig is null").select("x", "y"))
        if more.limit(1).count():
            links = links.unionByName(more)
            discard(components)
            components = connected(links)
        rest = found.where("sig is not null").select("sig")
        if not rest.limit(1).count():
            break
        todo = members.join(rest, "sig", "left_semi")

    final = classes.join(components, F.col("rep") == F.col("v"), "left").select(
        F.col("sid").alias("s"), F.col("more").alias("m"), F.col("n").alias("k"), F.coalesce("c", "rep").alias("component")
    )
    joined = rows.join(final, (F.col("sid") == F.col("s")) & (F.col("more") == F.col("m")) & (F.col("n") == F.col("k")), "left")
    discard(members, ids, sketches, wanted, texts)
    if not _repeats(rows):
        return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    own = components.select(F.col("v").alias("o"), F.col("c").alias("by_id"))
    joined = joined.join(own, F.col("doc_id") == F.col("o"), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "by_id", "doc_id").alias("component_id"))


def _again(rows: DataFrame) -> DataFrame:
    """Ids of several rows."""
    return rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")


def _repeats(rows: DataFrame) -> bool:
    return bool(_again(rows).limit(1).count())


def _same_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) from an id of several rows to the representatives of all its sets."""
    own = rows.where("n > 0").join(_again(rows), "doc_id", "left_semi").join(classes, ["sid", "more", "n"])
    return own.where("doc_id <> rep").select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).distinct()
