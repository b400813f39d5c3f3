"""Repeated passages by sparse suffix arrays (any style: NumPy over Arrow).

Of all suffixes (one for each word) those are kept that start at a content-selected
minimiser: the smallest hash of GRAM words among WINDOW in a row. GRAM + WINDOW - 1 is
``min_words``, so every passage of that many words holds a kept suffix, the same one in all
its copies. Suffixes whose first GRAM words occur once are dropped after a count; the
others go, with the words around them, to the task of their first words. Each stands there for the
passages of ``min_words`` whose minimiser it is; these are sorted, and those that occur twice
are reported. Passages of a document that touch or overlap are merged.

Suffixes that share first words in over GROUP_ROWS places are dealt over several tasks
by a hash of the place (of about GROUP_ROWS each). There they are not compared: each gives the passages of
``min_words`` whose minimiser it is, places with equal passages together, which are counted by content over all tasks, so that two
places with the same passage meet however common their first words are.
Words are compared as 32-bit hashes (lower case a-z) and passages as 64-bit hashes beside those of their first words.

Rows: one for each repeated passage of a row: doc_id, start_word, end_word (exclusive), n_words,
match_id (a document with a passage in it, the smallest, but the largest for the smallest itself), matches (places that share a passage). Null
and empty texts have none; rows without an id are left out, as results go by id;
a repeated row repeats all passages of min_words, and is reported once; rows of one id with other texts are looked at each by its own words. Very long texts are read whole. Empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import annotate, fits, materialise, settle
from keyloom.llm.jaccard import mix, word_hashes

MIN_WORDS = 50
GRAM = 16
GROUP_ROWS = 4096
CHUNK_ROWS = 16_384
#: Places with equal passages that go as one row at most, so that a very common passage is unfolded by many tasks.
LIST_ROWS = 64
OWN = 1 << 12  # two small numbers in one
NAMES = ["doc_id", "row", "at", "s", "e", "match_id", "h", "run", "p", "w"]
#: Very common first words that are broadcast at most to be counted apart.
BROADCAST_HOT = 200_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def kept_suffixes(words: np.ndarray, min_words: int = MIN_WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of minimisers, the hashes of the ``gram`` words from there, and of the passages whose minimiser it is (they follow each other)
    how far before the place the first begins and how many there are."""
    window = min_words - gram + 1
    if len(words) < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(words) - gram + 1
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = h * _MULTIPLIER + words[k : k + n]
    h = mix(h)
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    least = view.argmin(axis=1) + np.arange(len(view))  # never falls
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    at = least[first]
    return at, h[at], at - first, np.diff(first, append=len(least))


def repeated_passages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    docs = documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text"), F.xxhash64(documents[text]).alias("row")).where("doc_id is not null")
    left, right = min_words - gram, min_words

    def make():
        def work(texts):
            hashes, at = word_hashes(texts)
            kept = [kept_suffixes(hashes[a:b], min_words, gram) for a, b in zip(at, at[1:], strict=False)]
            own = [(k[2] * OWN + k[3]).astype(np.int32) for k in kept]
            return {"at": [k[0].astype(np.int32) for k in kept], "h": [k[1].view(np.int64) for k in kept], "own": own}

        return work

    kept = materialise(annotate(docs, ["doc_id", "row"], "text", make, "at array<int>, h array<bigint>, own array<int>").where("size(at) > 0"))
    suffixes = kept.select("doc_id", "row", F.explode(F.arrays_zip("at", "h", "own")).alias("x")).select("doc_id", "row", "x.at", "x.h", "x.own")
    shared = materialise(suffixes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot = shared.where(F.col("n") > GROUP_ROWS)
    if hot.limit(1).count() and fits(hot, BROADCAST_HOT):  # one key may have a third of all places: it meets its count where it stands
        rest = suffixes.join(F.broadcast(hot.select("h")), "h", "left_anti").join(shared, "h")
        counted = rest.unionByName(suffixes.join(F.broadcast(hot), "h"))
    else:
        counted = suffixes.join(shared, "h")
    places = counted.groupBy("doc_id", "row").agg(F.collect_set(F.struct("at", "h", "n", "own")).alias("x"))
    todo = docs.join(places, ["doc_id", "row"]).select("doc_id", "text", "x", "row")

    def around(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                hashes, at = word_hashes(part.column(1).to_pylist())
                words = (hashes >> np.uint64(32)).astype(np.uint32)
                lists = part.column(2)
                offsets = lists.offsets.to_numpy()
                flat = lists.values
                own = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                if not len(own):
                    continue
                lo, hi = offsets[0], offsets[-1]
                pos = flat.field("at").to_numpy()[lo:hi].astype(np.int64)
                centre = at[:-1][own] + pos
                padded = np.concatenate([np.zeros(left, np.uint32), words, np.zeros(right, np.uint32)])
                index = centre[:, None] + np.arange(left + right)[None, :]  # in padded: left words before, right words from the place on
                context = padded[index]
                rows = context.astype(">u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        flat.field("h").slice(lo, hi - lo), flat.field("n").slice(lo, hi - lo), part.column(0).take(pa.array(own)), part.column(3).take(pa.array(own)),
                        pa.array(pos.astype(np.int32)), flat.field("own").slice(lo, hi - lo),
                        pa.array([r.tobytes() for r in rows], pa.binary()),
                    ],
                    names=["h", "n", "doc_id", "row", "at", "own", "words"],
                )

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    known = todo.mapInArrow(around, f"h bigint, n bigint, doc_id {id_kind}, row bigint, at int, own int, words binary")
    deal = F.pmod(F.xxhash64("doc_id", "row", "at"), F.ceil(F.col("n") / GROUP_ROWS).cast("bigint"))
    dealt = known.withColumn("deal", deal).withColumn("hot", F.col("n") > GROUP_ROWS).drop("n").repartition("h", "deal").sortWithinPartitions("h", "deal")
    most = LIST_ROWS
    compared = materialise(
        dealt.select("h", "deal", "hot", "doc_id", "row", "at", "own", "words").mapInArrow(
            lambda batches: compare(batches, left, right, min_words, most), f"doc_id {id_kind}, row bigint, at int, s int, e int, match_id {id_kind}, h bigint, run bigint, p array<struct<doc_id:{id_kind},row:bigint,s:int>>, w array<bigint>"
        )
    )
    found = compared.where("w is null").select("doc_id", "row", "s", "e", "match_id")
    common = compared.where("w is not null").select("h", "run", "p", "w")
    if common.limit(1).count():
        found = found.unionByName(_repeated(common, min_words))
    # matched stretches of a document, merged where they touch
    order = Window.partitionBy("doc_id", "row").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spread = found.groupBy("doc_id", "row", "s").agg(F.max("e").alias("e"), F.min("match_id").alias("match_id"), F.count(F.lit(1)).alias("matches"))
    islands = spread.withColumn("fresh", (F.coalesce(reach, F.lit(-1)) < F.col("s")).cast("int")).withColumn("island", F.sum("fresh").over(order))
    return islands.groupBy("doc_id", "row", "island").agg(
        F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min("match_id").alias("match_id"), F.sum("matches").alias("matches")
    ).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "match_id", "matches")


def _repeated(places: DataFrame, min_words: int) -> DataFrame:
    """Of places (p, those of one task together; w: hashes of the passages one after another, run: of all of them) the stretch whose passages stand at other places too.

    Equal runs are counted before their passages are; places meet their run in lists of at most LIST_ROWS, which are spread over
    all tasks before they are unfolded. The other document
    is the smallest, or the largest for the smallest itself.
    """
    runs = places.groupBy("h", "run").agg(F.sum(F.size("p")).alias("n"), F.min(F.array_min("p.doc_id")).alias("low"), F.max(F.array_max("p.doc_id")).alias("high"), F.first("w").alias("w"))
    passages = materialise(runs).select("h", "run", "n", "low", "high", F.posexplode("w").alias("k", "word"))
    counts = passages.groupBy("h", "word").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    counts = materialise(counts.where("n > 1").drop("n"))  # then the joins read plain exchanges, whose large keys can be split
    hits = passages.select("h", "run", "k", "word").join(counts, ["h", "word"]).groupBy("h", "run")
    hits = materialise(hits.agg(F.min("k").alias("first"), F.max("k").alias("last"), F.min("low").alias("low"), F.max("high").alias("high")))
    other = F.when(F.col("low") != F.col("doc_id"), F.col("low")).otherwise(F.col("high"))
    met = places.drop("w").join(hits, ["h", "run"]).repartition(F.col("p")[0])  # the lists of one run go apart before they are unfolded
    met = met.select("first", "last", "low", "high", F.explode("p").alias("p"))
    return met.select("p.*", "first", "last", "low", "high").select(
        "doc_id", "row", (F.col("s") + F.col("first")).alias("s"), (F.col("s") + F.col("last") + min_words).alias("e"), other.alias("match_id")
    )


def windows_of(words: np.ndarray, own: np.ndarray, min_words: int, left: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every passage of ``min_words`` a place stands for: the row of the place, how far before the place it begins, a hash of its words."""
    back, count = own // OWN, own % OWN
    row = np.repeat(np.arange(len(own)), count)
    before = back[row] - (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    power = np.cumprod(np.full(words.shape[1], _MULTIPLIER), dtype=np.uint64)
    sums = np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(words.astype(np.uint64) * power, axis=1, dtype=np.uint64)], axis=1)
    begin = left - before
    return row, before, mix(sums[row, begin + min_words] - sums[row, begin] + mix(before.astype(np.uint64)))


def compare(batches, left: int, right: int, min_words: int, list_rows: int):
    """What is repeated in each run of equal (h, deal), the passages of hot runs; the last run of a chunk waits for the next batch."""
    held = []

    def runs(table: pa.Table):
        h, deal = table.column("h").to_numpy(), table.column("deal").to_numpy()
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (deal[1:] != deal[:-1])])
        return fresh

    def passages(table: pa.Table):
        words = np.frombuffer(b"".join(table.column("words").to_pylist()), ">u4").reshape(table.num_rows, left + right)
        own = table.column("own").to_numpy().astype(np.int64)
        row, before, w = windows_of(words, own, min_words, left)
        begin = (table.column("at").to_numpy() - own // OWN).astype(np.int32)
        starts = np.concatenate([[0], np.cumsum(own % OWN)])
        run = mix(np.add.reduceat(mix(w + before.astype(np.uint64)), starts[:-1]) + own.astype(np.uint64))
        h = table.column("h").to_numpy()
        order = np.lexsort((run, h))  # places with one run stand together
        fresh = np.concatenate([[True], (run[order][1:] != run[order][:-1]) | (h[order][1:] != h[order][:-1])])
        begun = np.flatnonzero(fresh)
        first = np.flatnonzero((np.arange(len(order)) - begun[np.cumsum(fresh) - 1]) % list_rows == 0)
        one = order[first]
        ids = table.column("doc_id").combine_chunks().take(pa.array(order))
        rows = table.column("row").combine_chunks().take(pa.array(order))
        own_places = pa.StructArray.from_arrays([ids, rows, pa.array(begin[order])], names=["doc_id", "row", "s"])
        offsets = np.append(first, len(order)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(w.view(np.int64)))
        none = len(one)
        return pa.RecordBatch.from_arrays(
            [
                pa.nulls(none, ids.type), pa.nulls(none, pa.int64()), *[pa.nulls(none, pa.int32())] * 3, pa.nulls(none, ids.type),
                pa.array(h[one]), pa.array(run[one].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), own_places), lists.take(pa.array(one)),
            ],
            names=NAMES,
        )

    def work(table: pa.Table):
        hot = table.filter(table.column("hot"))
        for start in range(0, hot.num_rows, CHUNK_ROWS):
            yield passages(hot.slice(start, CHUNK_ROWS).combine_chunks())
        cold = table.filter(pc.invert(table.column("hot")))
        if cold.num_rows:
            yield from repeats(cold.combine_chunks())

    def repeats(table: pa.Table):
        group = np.cumsum(runs(table)).astype(np.int64)
        words = np.frombuffer(b"".join(table.column("words").to_pylist()), ">u4").reshape(len(group), left + right)
        row, before, w = windows_of(words, table.column("own").to_numpy().astype(np.int64), min_words, left)
        ids = table.column("doc_id").combine_chunks()
        distinct = ids.unique()
        distinct = distinct.take(pc.sort_indices(distinct))
        rank = pc.index_in(ids, distinct).to_numpy().astype(np.int64)
        order = np.lexsort((w, group[row]))
        row, before, w = row[order], before[order], w[order]
        fresh = np.concatenate([[True], (w[1:] != w[:-1]) | (group[row[1:]] != group[row[:-1]])])
        first = np.flatnonzero(fresh)
        low, high = np.minimum.reduceat(rank[row], first), np.maximum.reduceat(rank[row], first)
        size = np.diff(first, append=len(row))
        of = np.cumsum(fresh) - 1
        twice = size[of] > 1
        row, before, of = row[twice], before[twice], of[twice]
        if not len(row):
            return
        order = np.argsort(row, kind="stable")
        row, before, of = row[order], before[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        mine = row[first]
        at = table.column("at").to_numpy().astype(np.int64)[mine]
        start, end = at - np.maximum.reduceat(before, first), at - np.minimum.reduceat(before, first) + min_words  # all hold the place
        low, high = np.minimum.reduceat(low[of], first), np.maximum.reduceat(high[of], first)
        other = np.where(low != rank[mine], low, high)
        none = len(mine)
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(mine)), table.column("row").combine_chunks().take(pa.array(mine)), pa.array(at.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), distinct.take(pa.array(other)),
                pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()),
                pa.nulls(none, pa.list_(pa.struct([("doc_id", ids.type), ("row", pa.int64()), ("s", pa.int32())]))), pa.nulls(none, pa.list_(pa.int64())),
            ],
            names=NAMES,
        )

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(runs(table))[-1])
            if cut:
                yield from work(table.slice(0, cut).combine_chunks())
            rest = table.slice(cut).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield from work(pa.Table.from_batches(held).combine_chunks())
    settle()
