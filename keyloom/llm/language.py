"""Language identification by cross-parsing entropy (any style: NumPy over Arrow).

For each language a suffix automaton is built over a bounded sample of labelled
text. A text is parsed greedily into the longest phrases that occur in that sample;
few phrases mean that the text looks like the language. Phrases are normalised to
bits a character, phrases * log2(sample length) / characters, and the lowest wins.

To parse many texts at once each text is cut into blocks of ``block`` characters
(all blocks, so whole texts), and one step moves every block and every language on
by one table look-up. Every block is parsed as if a phrase began there; then blocks are parsed again
from the state in which the block before ended, until that parse meets the first one, which it
follows from there on. This is repeated while any block ends otherwise than
its next one assumed, so phrases do cross block borders, and the parse is that of the whole text.

Rows: one for each input row. Null text, empty text and text without a letter (Unicode category L): lang
``und``, score 0. Ties go to the language first in the alphabet. Very long texts are
only more blocks. No labelled row at all: every row is ``und``. Repeated rows get
repeated results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import annotate, hold

#: Bounds of the training sample: texts of a language, and characters used of each (from its middle).
SAMPLE_TEXTS = 40
SAMPLE_CHARS = 500
BLOCK = 1024
#: Characters after which two parses of a block are compared.
CHECK = 64
UNKNOWN = "und"
SPACE = 1  # codes: 0 ends a block without a step, 1 is any run of non-letters, letters follow, the last is any other letter
_letter = regex.compile(r"\p{L}")
_others = regex.compile(r"\P{L}+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def training_sample(df: DataFrame, doc_id: str, text: str, lang: str, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """A bounded sample of labelled text, by language; ``df`` holds the rows that may be learnt from.

    The first pass counts rows by language (columns doc_id and lang only). The
    second keeps rows whose hash is under twice the wanted share, so that some
    2 * ``texts`` rows of each language reach the driver, ``chars`` of each.
    """
    rows = df.select(df[doc_id].alias("d"), df[text].alias("t"), df[lang].alias("l")).where("l is not null and t is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64(F.col("d"), F.length("t")), F.lit(1 << 40))
    limit = F.lit(-1).cast("bigint")
    for name, n in counts.items():
        limit = F.when(F.col("l") == name, F.lit(min(1 << 40, int((1 << 40) * min(1.0, 2 * texts / n))))).otherwise(limit)
    middle = F.greatest(F.lit(1), (F.length("t") / 2 - chars / 2).cast("int"))
    drawn = rows.where(draw < limit).select("l", draw.alias("h"), F.substring(F.col("t"), middle, F.lit(chars)).alias("t")).collect()
    out: dict[str, list] = {}
    for r in sorted(drawn, key=lambda r: (r["l"], r["h"], r["t"])):
        own = out.setdefault(r["l"], [])
        if len(own) < texts and _letter.search(r["t"]):
            own.append(r["t"])
    return {name: "\n".join(own) for name, own in out.items() if own}


class CrossParser:
    """Suffix automata of all languages in one transition table."""

    def __init__(self, sample: dict[str, str], block: int = BLOCK):
        self.langs = sorted(sample)
        self.block = block
        texts = {name: _others.sub(" ", sample[name].lower()) for name in self.langs}
        letters = sorted(set("".join(texts.values())) - {" "})
        self.width = len(letters) + 3
        self.code_of = np.full(0x110000, self.width - 1, np.uint8 if self.width < 256 else np.uint16)
        for c, a in enumerate(letters):
            self.code_of[ord(a)] = c + 2
        tables, self.roots, self.bits, base = [], [], [], 0
        for name in self.langs:
            codes = [self.code_of[ord(a)] if a != " " else SPACE for a in texts[name]]
            table = self._automaton([int(c) for c in codes])
            self.roots.append(base)
            self.bits.append(np.log2(max(2, len(codes))))
            table[table >= 0] += base
            tables.append(table)
            base += len(table)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def _automaton(self, codes: list[int]) -> np.ndarray:
        """Rows of states; code 0 keeps the state. The suffix automaton grows by one letter at a time."""
        arcs: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            new = len(arcs)
            arcs.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and c not in arcs[at]:
                arcs[at][c] = new
                at = link[at]
            if at >= 0:
                to = arcs[at][c]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    twin = len(arcs)
                    arcs.append(dict(arcs[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    link[to] = link[new] = twin
                    while at >= 0 and arcs[at].get(c) == to:
                        arcs[at][c] = twin
                        at = link[at]
            last = new
        table = np.full((len(arcs), self.width), -1, np.int32)
        table[:, 0] = np.arange(len(arcs))
        for s, own in enumerate(arcs):
            for c, to in own.items():
                table[s, c] = to
        return table

    def _advance(self, letters: np.ndarray, state: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and ended phrases after the letters (a row for each step)."""
        count = np.zeros(len(state), np.int32)
        for letter in letters:
            nxt = self.table[state * self.width + letter]
            stuck = np.flatnonzero(nxt < 0)
            if len(stuck):
                again = self.table[roots[stuck] * self.width + letter[stuck]]
                count[stuck] += (state[stuck] != roots[stuck]).astype(np.int32) + (again < 0)
                nxt[stuck] = np.where(again < 0, roots[stuck], again)  # a letter that the language lacks is a phrase alone
            state = nxt
        return state, count

    def phrases(self, codes: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Phrases of each block (row of ``codes``) by language; ``head`` marks blocks that begin a text."""
        blocks, langs = len(codes), len(self.roots)
        roots = np.repeat(np.array(self.roots, np.int32), blocks)
        steps = np.ascontiguousarray(codes.T).astype(np.int32)
        block_of = np.tile(np.arange(blocks), langs)
        cuts = range(0, self.block, CHECK)
        state, count = roots, np.zeros(len(roots), np.int32)
        met, so_far = [], []  # of the parse that counts: state and count behind every CHECK letters
        for a in cuts:
            state, more = self._advance(np.tile(steps[a : a + CHECK], langs), state, roots)
            count = count + more
            met.append(state.copy())
            so_far.append(count)
        met, so_far = np.stack(met), np.stack(so_far)
        begun = roots.copy()
        inner = np.flatnonzero(~np.tile(head, langs))  # the block before is the row before
        while True:
            rows = inner[met[-1, inner - 1] != begun[inner]]
            if not len(rows):
                break
            state = met[-1, rows - 1]
            begun[rows] = state
            count = np.zeros(len(rows), np.int32)
            for k, a in enumerate(cuts):
                state, more = self._advance(steps[a : a + CHECK, block_of[rows]], state, roots[rows])
                count = count + more
                same = state == met[k, rows]
                so_far[k:, rows[same]] += count[same] - so_far[k, rows[same]]
                rows, state, count = rows[~same], state[~same], count[~same]
                met[k, rows], so_far[k, rows] = state, count
                if not len(rows):
                    break
        last = np.tile(np.append(head[1:], True), langs)
        return (so_far[-1] + ((met[-1] != roots) & last)).reshape(langs, blocks).T

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        chosen = [i for i, t in enumerate(texts) if t and _letter.search(t)] if self.langs else []
        if not chosen:
            return lang, score
        lowered = [_others.sub(" ", texts[i].lower()) for i in chosen]
        sizes = np.array([len(t) for t in lowered])
        held = -(-sizes // self.block)
        first = np.concatenate([[0], np.cumsum(held)])
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code_of[points]
        codes[points == 32] = SPACE
        flat = np.zeros(first[-1] * self.block, codes.dtype)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        flat[np.arange(len(points)) + np.repeat(first[:-1] * self.block - starts, sizes)] = codes
        head = np.zeros(first[-1], bool)
        head[first[:-1]] = True
        by_block = self.phrases(flat.reshape(-1, self.block), head)
        total = np.add.reduceat(by_block, first[:-1], axis=0)
        bits = total * np.array(self.bits) / sizes[:, None]
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(bits)), best]
        rest = np.sort(bits, axis=1)[:, 1] if len(self.langs) > 1 else low * 2
        for i, b, x, y in zip(chosen, best, low, rest, strict=True):
            lang[i], score[i] = self.langs[b], float(max(0.0, min(1.0, 1 - x / y if y > 0 else 0.0)))
        return lang, score


def parser(sample: dict[str, str], block: int = BLOCK) -> CrossParser:
    return hold(("language", tuple(sorted(sample.items())), block), lambda: CrossParser(sample, block))


def identify(df: DataFrame, sample: dict[str, str], text: str = "text", keep: Sequence[str] = ("doc_id",), lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``keep``, the predicted language and a score: how much shorter the best parse is than the next (0 to 1)."""

    def make():
        p = parser(sample)

        def work(texts):
            lang, score = p.predict(texts)
            return {lang_out: lang, score_out: score}

        return work

    return annotate(df, list(keep), text, make, f"`{lang_out}` string, `{score_out}` double")
