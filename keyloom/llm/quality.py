"""Quality rules and an isolation forest over their statistics (any style: Python over Arrow).

One pass over the texts yields rule statistics, which go to a small table. The forest
is fitted on a bounded sample of them: every tree splits ``leaf_sample`` rows at random
features and values, and rows that are split off early (short paths) are anomalous.
The threshold is calibrated on all labelled rows: of the cuts that reject at most
``good_loss`` of the rows labelled good, the one that rejects most rows labelled bad
beyond that loss; with no labelled row nothing is rejected by the forest.

Rows: one for each input row. Null text and empty text have no words and fail the base
rules (fewer than 50 words). Very long texts are read whole. Labels that repeat an id
count once, bad if any says so. Repeated rows get equal results. Empty tables give
empty results. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import SPACE_WORD, annotate, materialise

#: Fit sample: rows that reach the driver at most; trees; rows that a tree splits.
SAMPLE_ROWS = 8192
TREES = 100
LEAF_SAMPLE = 256
#: Share of the rows labelled good that the threshold may reject.
GOOD_LOSS = 0.005
BINS = 4096
SEED = 20240101

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics beyond the base ones, each a share or a mean in the text.
MORE = ("top_word", "distinct_words", "alpha_chars", "end_marks", "upper_words")
STATS = ", ".join([f"{c} bigint" for c in BASE] + [f"{c} double" for c in MORE])
FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", *MORE)

_words = re.compile(SPACE_WORD).findall
_symbols = re.compile(r"[#*$%&|<>]").findall
_not_letters = re.compile(r"[\W\d_]+")


def rule_statistics(text: str | None) -> tuple:
    """STATS of one text."""
    words = _words(text or "")
    n = len(words)
    if not n:
        return (0, 0, len(_symbols(text or "")), 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)
    chars = len("".join(words))
    seen, dups = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dups += 1
            elif _words(line):
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeats = 0
    if len(set(windows)) < len(windows):
        counts: dict = {}
        for w in windows:
            counts[w] = counts.get(w, 0) + 1
        end = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeats += i + 3 - max(i, end)
                end = i + 3
    by_word: dict = {}
    for w in words:
        by_word[w] = by_word.get(w, 0) + 1
    letters = len(_not_letters.sub("", text))
    marks = text.count(". ") + text.count(".\n") + text.count("! ") + text.count("? ") + (text.rstrip()[-1:] in ".!?")
    upper = sum(w[0].isupper() for w in words)
    return (n, chars, len(_symbols(text)), dups, repeats, max(by_word.values()) / n, len(by_word) / n, letters / max(1, chars), marks / n, upper / n)


def statistics(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    names = [*BASE, *MORE]

    def make():
        def work(texts):
            rows = [rule_statistics(t) for t in texts]
            return dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}

        return work

    return annotate(df, list(keep), text, make, STATS)


def features(stats: Sequence[np.ndarray]) -> np.ndarray:
    """Rows of FEATURES from the columns of STATS."""
    n, chars, symbols, dups, repeats, *more = [np.asarray(s, float) for s in stats]
    some = np.maximum(1, n)
    return np.column_stack([np.log1p(n), chars / some, np.log1p(100 * symbols / some), np.log1p(dups), repeats / some, *more])


class IsolationForest:
    """Trees as arrays: feature, cut, left child (right is next), path length at leaves."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, leaf_sample: int = LEAF_SAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(leaf_sample, len(rows))
        depth = int(np.ceil(np.log2(max(2, self.size))))
        self.trees = [self._tree(rows[rng.choice(len(rows), self.size, replace=False)], depth, rng) for _ in range(trees)] if len(rows) else []

    @staticmethod
    def expected(n: int) -> float:
        """Mean path of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0

    def _tree(self, rows, depth, rng):
        feature, cut, child, path = [], [], [], []
        todo = [(rows, 0, None)]
        while todo:
            own, at, parent = todo.pop()
            i = len(feature)
            if parent is not None:
                child[parent[0]][parent[1]] = i
            low, high = own.min(axis=0), own.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if len(own) < 2 or at >= depth or not len(open_):
                feature.append(-1), cut.append(0.0), child.append([i, i]), path.append(at + self.expected(len(own)))
                continue
            f = int(rng.choice(open_))
            x = float(rng.uniform(low[f], high[f]))
            feature.append(f), cut.append(x), child.append([i, i]), path.append(0.0)
            below = own[:, f] < x
            todo += [(own[below], at + 1, (i, 0)), (own[~below], at + 1, (i, 1))]
        return np.array(feature), np.array(cut), np.array(child), np.array(path), depth

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): towards 1 for rows that are split off early."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for feature, cut, child, path, depth in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                f = feature[at]
                side = (rows[np.arange(len(rows)), np.maximum(f, 0)] >= cut[at]).astype(np.int64)
                at = child[at, side]
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(1e-9, self.expected(self.size)))


def score_quality(
    documents: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    sample_rows: int = SAMPLE_ROWS,
    good_loss: float = GOOD_LOSS,
) -> DataFrame:
    """doc_id, the base statistics, base_failed, anomaly (0 to 1), kept."""
    own = documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text"))
    marked = labels.groupBy(labels["doc_id"].alias("id")).agg(
        F.min("quality").alias("quality"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("toxic")
    ).where("id is not null and quality is not null")
    stats = materialise(statistics(own))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)

    # a row is drawn by its hash, so the sample is the same at every run and its size is bounded
    n = stats.where("not base_failed").count()
    drawn = stats.where("not base_failed").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.8 * sample_rows / max(1, n))))
    fit = drawn.select("doc_id", *BASE, *MORE).limit(sample_rows).toPandas().sort_values("doc_id")
    forest = IsolationForest(features([fit[c].to_numpy() for c in (*BASE, *MORE)]))

    @F.pandas_udf("double")
    def anomaly(*cols):
        import pandas as pd

        return pd.Series(forest.score(features([c.to_numpy() for c in cols])))

    scored = stats.withColumn("anomaly", anomaly(*[F.col(c) for c in (*BASE, *MORE)]))
    known = stats.where("not base_failed").join(marked, F.col("doc_id") == F.col("id"))
    known = known.withColumn("anomaly", anomaly(*[F.col(c) for c in (*BASE, *MORE)]))
    bins = known.groupBy((F.col("anomaly") * BINS).cast("int").alias("bin"), (F.col("quality") > 0).alias("good")).count().collect()
    threshold = calibrate([(r["bin"], r["good"], r["count"]) for r in bins], good_loss)
    return scored.select(
        "doc_id", *BASE, "base_failed", "anomaly", (~F.col("base_failed") & (F.col("anomaly") < F.lit(threshold))).alias("kept")
    )


def calibrate(bins: list[tuple[int, bool, int]], good_loss: float = GOOD_LOSS) -> float:
    """The score from which rows are rejected; above 1 if no cut rejects more of the bad than of the good."""
    good = np.zeros(BINS + 2)
    bad = np.zeros(BINS + 2)
    for b, is_good, n in bins:
        (good if is_good else bad)[min(b, BINS)] += n
    lost = good[::-1].cumsum()[::-1] / max(1, good.sum())
    caught = bad[::-1].cumsum()[::-1] / max(1, bad.sum())
    gain = np.where(lost <= good_loss, caught - lost, -1.0)
    best = int(len(gain) - 1 - gain[::-1].argmax())
    return best / BINS if gain[best] > 0 else 2.0
