"""Benchmark decontamination by a hash set of normalised n-grams (native: DataFrame functions only).

Words of benchmark items make windows of ``n`` words (an item of fewer is one window).
Every window of a document's words is hashed and looked up in the hash set of the
benchmark's windows, which is sent to every task if it has at most BROADCAST_WINDOWS
and else joined by a shuffle; a hit is verified word by word. Hit places are counted as the words
they cover together.

Rows: one for each input row. Null and empty texts have no words, no hits and are
clean. Items without words have no window. Very long texts are scanned whole.
Repeated rows (same id and text) get equal results; items that repeat a text each count. Empty
tables: no benchmark means no hits. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import ascii_lower, fits, materialise
from keyloom.llm.licenses import RAW_WORD, SEPARATORS

NGRAM = 13
BROADCAST_WINDOWS = 20_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _starts(words: str, n: int) -> Column:
    """Places, from 1, where windows of n words start; none where there are fewer words."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))


def _in(value: Column, numbers: set[int]) -> Column:
    """Membership in a hash set of literals."""
    return F.call_function("coalesce", value.isin(*sorted(numbers)), F.lit(False))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = NGRAM) -> DataFrame:
    """(size, hash, gram, items): distinct windows with the items that have them."""
    own = benchmark.select(benchmark[item].cast("string").alias("item"), _words(benchmark[text]).alias("w")).where("size(w) > 0")
    own = own.withColumn("size", F.least(F.lit(n), F.size("w")))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.slice(F.col("w"), i, F.col("size")))
    return (
        own.select("item", "size", F.explode(grams).alias("gram"))
        .groupBy("size", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select("size", F.xxhash64("gram").alias("hash"), "gram", "items")
    )


def find_hits(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = NGRAM
) -> DataFrame:
    """(doc_id, text_hash, spans, items): for documents with hits, word spans [start, end) and the items that hit."""
    windows = materialise(benchmark_windows(benchmark, item, item_text, n))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    small = fits(windows, BROADCAST_WINDOWS)
    own = documents.select(documents[doc_id].alias("doc_id"), F.xxhash64(documents[text]).alias("text_hash"), _words(documents[text]).alias("w"))
    hits = None
    for size in sizes:
        known = windows.where(F.col("size") == size).select("hash", "gram", "items")
        if small:  # the hash set goes with the plan, and only windows that are in it leave their row
            hashes = {r["hash"] for r in known.select("hash").collect()}
            places = F.array_compact(F.transform(_starts("w", size), lambda i: F.when(_in(F.xxhash64(F.slice(F.col("w"), i, F.lit(size))), hashes), i)))
            scanned = own.select("doc_id", "text_hash", "w", places.alias("p"))
        else:  # (place, hash) of every window meets the benchmark's in a shuffle; the words follow for documents that hit
            rows = own.select("doc_id", "text_hash", F.posexplode(F.transform(_starts("w", size), lambda i: F.xxhash64(F.slice(F.col("w"), i, F.lit(size))))).alias("at", "hash"))
            met = rows.join(known.select("hash").distinct(), "hash").groupBy("doc_id", "text_hash").agg(F.collect_set(F.col("at") + 1).alias("p"))
            met = met.select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), "p")
            scanned = own.join(met, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash"))).select("doc_id", "text_hash", "w", "p")
        grams = F.transform("p", lambda i: F.struct((i - 1).alias("at"), F.slice(F.col("w"), i, F.lit(size)).alias("gram")))
        # an inner explode would infer a filter, whose lambda would split the text again for every window
        found = scanned.select("doc_id", "text_hash", F.explode_outer(grams).alias("g"))
        known = known.select(F.col("gram").alias("known"), "items")
        known = F.broadcast(known) if small else known
        found = found.join(known, F.col("g.gram") == F.col("known"))  # word by word
        found = found.select("doc_id", "text_hash", F.struct(F.col("g.at").alias("s"), (F.col("g.at") + size).alias("e")).alias("span"), "items")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return documents.sparkSession.createDataFrame([], f"doc_id {documents.schema[doc_id].dataType.simpleString()}, text_hash bigint, spans array<struct<s:int,e:int>>, items array<string>")
    return hits.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )


def covered(spans: str = "spans") -> Column:
    """Distinct word places inside the spans."""
    return F.array_distinct(F.flatten(F.transform(F.col(spans), lambda x: F.sequence(x["s"], x["e"] - 1))))


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    doc_id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    n: int = NGRAM,
    min_percent: int = 5,
) -> DataFrame:
    """``keep``, n_words, n_hit, n_items, items, hit_spans (of words), contaminated (hit words are ``min_percent`` of all or more)."""
    hits = find_hits(documents, benchmark, doc_id, text, item, item_text, n).select(
        F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), "spans", "items"
    )
    own = documents.select(
        F.struct(*[documents[c] for c in keep]).alias("k"), documents[doc_id].alias("o_id"), F.xxhash64(documents[text]).alias("o_hash"),
        F.regexp_count(F.coalesce(documents[text], F.lit("")), F.lit(RAW_WORD)).cast("bigint").alias("n_words"),
    )
    n_hit = F.coalesce(F.size(covered()), F.lit(0)).cast("bigint")
    joined = own.join(hits, F.col("o_id").eqNullSafe(F.col("h_id")) & (F.col("o_hash") == F.col("h_hash")), "left")
    joined = joined.select("k", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("spans").alias("hit_spans"))
    return joined.select(
        *[F.col("k").getField(c).alias(c) for c in keep],
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        "items",
        "hit_spans",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * min_percent)).alias("contaminated"),
    )


def without_hits(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = NGRAM) -> DataFrame:
    """``documents`` with the hit words taken out of contaminated spans; words left in such a text are joined by one space, other texts stay as they are."""
    hits = find_hits(documents, benchmark, doc_id, text, item, item_text, n).select(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), covered().alias("places"))
    own = documents.select(F.struct("*").alias("k"), documents[doc_id].alias("o_id"), F.xxhash64(documents[text]).alias("o_hash"))
    joined = own.join(hits, F.col("o_id").eqNullSafe(F.col("h_id")) & (F.col("o_hash") == F.col("h_hash")), "left")
    words = F.array_remove(F.split(F.col("k").getField(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")
    left = joined.select("k", "places", words.alias("w"))
    rest = F.array_join(F.filter(F.col("w"), lambda x, i: ~F.array_contains(F.col("places"), i)), " ")
    new = F.when(F.col("places").isNull(), F.col("k").getField(text)).otherwise(rest)
    return left.select(*[(new if c == text else F.col("k").getField(c)).alias(c) for c in documents.columns])
