"""BPE encoding and decoding by a tokenization automaton (any style: Python over Arrow).

The automaton's arcs bear tokens. It begins with one state and a loop for every letter, and every merge
(u, v) -> w of rank k changes it by one gadget: the state behind u is copied without
its v-arc, all u-arcs are led to the copy, and wherever a u-arc starts a w-arc is added that ends
where v ended. Copies are kept as what they lack: the state behind a label is that of
its right part as it was before the label's own merge, less the arcs that later gadgets took, so all
states together hold one entry for each merge (``Gadgets``).

``WordAutomaton`` composes these arcs with the trie of the labels' letters into a deterministic automaton over letters, whose
transitions are made once, when they are first met, and then read from a table. A prefix of a word has exactly one accepting path, so a state
is the label that ends there and the places (label before, trie node) at which a longer label may still end. A word is read from left
to right, one look-up a letter and without a step back; the labels that end at its borders, followed from the
end, are its tokens. Words of a batch are read side by side. Decoding emits the labels' letters.

Rows: one for each input row. Null text counts as empty: no tokens, empty strings.
Empty text: the same. Very long texts are cut at pre-token borders only, never
shortened. Repeated rows and ids are encoded independently. Columns of the input
that are not asked for do not reach the result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Sequence

import numpy as np
import regex
from pyspark.sql import DataFrame

from keyloom.llm.common import annotate, hold

#: Words after which those a worker met before are given up, unless they are met again (bounded memory).
CACHE_WORDS = 60_000
#: Words that are encoded side by side.
WORDS = 16_384
#: States of the transition table in a worker at most, but for those of one call; then it is made afresh.
STATES = 220_000
END = 256  # stands for the end-of-word mark; letters are the bytes
ALWAYS = 1 << 60

RESULT = "n_tokens bigint, ids array<int>, decoded string, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 is itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Gadgets:
    """The token automaton after all merges, by what each gadget took away and added."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        """``merges`` are (u, v, w) by rank."""
        self.gone: dict[tuple[int, int], int] = {}  # the gadget of this rank took the v-arc from the state behind u
        self.born: dict[int, tuple[int, int, int]] = {}  # w-arcs stand from this rank on where u-arcs start, and end in the state behind v before it
        idle: set[int] = set()  # labels that no path bears, as their merge found no arc
        for k, (u, v, w) in enumerate(merges):
            alive = not {u, v} & idle and self.stands(u, v, k)
            self.gone.setdefault((u, v), k)
            if not alive:
                if w not in self.born:
                    idle.add(w)
            elif w in self.born:
                raise ValueError(f"two merges make label {w}, so one state cannot stand for it")
            else:
                idle.discard(w)
                self.born[w] = (k, u, v)

    def stands(self, t: int, x: int, before: int = ALWAYS) -> bool:
        """Whether an x-arc leaves the state behind t when the gadgets of rank under ``before`` are made."""
        state, limit = t, before
        while True:
            arc, until = x, before
            while True:
                made = self.born.get(arc)
                k = self.gone.get((state, arc))
                # a gadget that took the arc while it was looked at: it comes after the arc and not after what was made from the arc
                if k is not None and k < limit and k <= until and (made is None or k > made[0]):
                    return False
                if made is None:
                    break
                until, arc = made[0], made[1]
            came = self.born.get(state)
            if came is None:
                return True
            limit, state = min(limit, came[0]), came[2]


class WordAutomaton:
    """A deterministic automaton over letters: state and letter give the next state by one look-up."""

    def __init__(self, labels: dict[int, tuple[int, ...]], gadgets: Gadgets, states: int = STATES):
        """``labels`` are the letters of every label that some path bears."""
        self.gadgets, self.most = gadgets, states
        self.trie: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.inner: set[int] = {0}
        self.size = np.ones(max(labels, default=0) + 1, np.int64)
        nodes = 1
        for i, letters in labels.items():
            self.size[i] = len(letters)
            at = 0
            for c in letters:
                self.inner.add(at)
                key = at << 9 | c
                if key not in self.trie:
                    self.trie[key] = nodes
                    nodes += 1
                at = self.trie[key]
            self.ends[at] = i
        self._clear()

    def _clear(self) -> None:
        """An empty table: sorted numbers of state and letter, and the next states."""
        self.keys = np.zeros(0, np.int64)
        self.to = np.zeros(0, np.int32)
        self.numbers: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.last = array("i")
        self._number([0, 0])

    def _number(self, numbers: list[int]) -> int:
        """Of a state: label that ends here, then label before and trie node in one number for each open place; labels plus one."""
        key = array("q", numbers).tobytes()
        got = self.numbers.get(key)
        if got is None:
            got = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.last.append(numbers[0] - 1)
        return got

    def _step(self, state: int, c: int) -> int:
        """The transition, made from the places at which a label may still end."""
        open_, last = [0], 0
        for place in memoryview(self.states[state]).cast("q")[1:]:
            before, at = place >> 24, place & 0xFFFFFF
            to = self.trie.get(at << 9 | c)
            if to is None:
                continue
            label = self.ends.get(to)
            if label is not None and (not before or self.gadgets.stands(before - 1, label)):
                last = label + 1
            if to in self.inner:
                open_.append(before << 24 | to)
        if last:
            open_[0] = last
            open_.append(last << 24)
        return self._number(open_)

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """The table's entries at the numbers of state and letter; those not met before are made first."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if not known.all():
            new = np.unique(keys[~known])
            to = np.array([self._step(int(k) >> 9, int(k) & 511) for k in new], np.int32)
            place = np.searchsorted(self.keys, new)
            self.keys, self.to = np.insert(self.keys, place, new), np.insert(self.to, place, to)
            at = np.searchsorted(self.keys, keys)
        return self.to[at]

    def encode(self, words: Sequence[bytes], mark: bool = False) -> list[list[int]]:
        """Of non-empty words the labels on their accepting paths; ``mark`` adds the end-of-word mark. All words move on by one letter at a time."""
        if not words:
            return []
        if len(self.states) >= self.most:
            self._clear()
        n, more = len(words), int(mark)
        sizes = np.array([len(w) + more for w in words])
        first = np.cumsum(sizes) - sizes
        letters = np.full(int(sizes.sum()), END, np.int64)
        plain = np.frombuffer(b"".join(words), np.uint8)
        letters[np.arange(len(plain)) + np.repeat(np.arange(n) * more, sizes - more)] = plain
        order = np.argsort(-sizes, kind="stable")
        by_size, at = sizes[order], first[order]
        state = np.zeros(n, np.int64)
        ends = np.full(len(letters), -1, np.int64)
        for step in range(int(by_size[0])):
            m = int(np.searchsorted(-by_size, -step, side="left"))  # words with more letters than ``step``
            here = at[:m] + step
            nxt = self._next(state[:m] << 9 | letters[here])
            state[:m] = nxt
            ends[here] = np.frombuffer(self.last, np.int32)[nxt]
        # labels from the end of every word back to its start
        own, stop = np.arange(n), first + sizes
        rows, labels = [], []
        while len(own):
            label = ends[stop - 1]
            if (label < 0).any():
                raise ValueError(f"no path spells {words[own[label < 0][0]]!r}")
            rows.append(own)
            labels.append(label)
            stop = stop - self.size[label]
            left = stop > first[own]
            own, stop = own[left], stop[left]
        row = np.concatenate(rows[::-1])
        by_word = np.concatenate(labels[::-1])[np.argsort(row, kind="stable")].tolist()
        cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).tolist()
        return [by_word[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


def compile_merges(vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "", letters: list[str] | None = None) -> WordAutomaton:
    """The automaton of a vocabulary. ``letters`` are the letters of the bytes; ``suffix`` marks labels that end a word."""
    gadgets = Gadgets([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
    code = {a: b for b, a in enumerate(letters if letters is not None else byte_letters())}
    made = {a + b for a, b in merges}
    spelled = {}
    for name, i in vocab.items():
        own, mark = (name[: -len(suffix)], (END,)) if suffix and name.endswith(suffix) else (name, ())
        if (i in gadgets.born or (name not in made and len(own) == 1)) and all(c in code for c in own):
            spelled[i] = (*[code[c] for c in own], *mark)  # other names are special tokens, or of merges that never come
    return WordAutomaton(spelled, gadgets)


class WordCodec:
    """Normaliser, pre-tokenizer and automaton of a word-level BPE file of the tokenizers library."""

    def __init__(self, file: str, strings: bool = True):
        self.strings = strings
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model.get("end_of_word_suffix") or ""
        self.mark = bool(suffix)
        self.automaton = compile_merges(model["vocab"], merges, suffix)
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        self.digits = {i: str(i) for i in self.names}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.marks = [t[:4] for t in self.special]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def decode(self, ids) -> list[str]:
        """The arc labels, as text."""
        return [self.names[i] for i in ids]

    def learn(self, words: set[str]) -> None:
        """Encode words that are not known. Words of before the last CACHE_WORDS go, unless they are met again."""
        new = []
        for w in words:
            got = self.older.get(w)
            if got is None:
                new.append(w)
            else:
                self.known[w] = got
        for a in range(0, len(new), WORDS):
            part = new[a : a + WORDS]
            for w, ids in zip(part, self.automaton.encode([w.encode("utf-8") for w in part], self.mark), strict=True):
                self.known[w] = (ids, " ".join([self.digits[i] for i in ids]), " ".join(self.decode(ids))) if self.strings else (ids, None, None)

    def found(self, texts: Sequence[str | None]) -> list[list[tuple[list[int], str, str]]]:
        """For every pre-split word of every text: ids, and ids and labels joined by spaces."""
        if len(self.known) >= CACHE_WORDS:
            self.older, self.known = self.known, {}
        parts = [self._parts(t or "") for t in texts]
        missing = {w for words in parts for w in words}
        missing.difference_update(self.known)
        if missing:
            self.learn(missing)
        known = self.known
        return [[known[w] for w in words] for words in parts]

    def _parts(self, text: str) -> list[str]:
        """Pre-split words; special tokens as they are, which no pre-split word is."""
        if not any(m in text for m in self.marks):
            return self._plain(text)
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                self.known[part] = ([self.special[part]], str(self.special[part]), part)
                out.append(part)
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # letter by letter: no final sigma
        return self.words(text.lower())


def codec(file: str, strings: bool = True) -> WordCodec:
    """``strings``: whether ids and labels are wanted as text too."""
    return hold(("bpe", file, strings), lambda: WordCodec(file, strings))


def encode_documents(
    df: DataFrame,
    file: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
) -> DataFrame:
    """``keep`` and the ``outputs`` asked for, out of those in RESULT. ``file`` is a vocabulary file every worker can open."""
    kinds = dict(x.strip().split(" ") for x in RESULT.split(","))
    wanted = {n: kinds[n] for n in outputs}

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest()

    makers = {
        "n_tokens": lambda found: sum([len(x[0]) for x in found]),
        "ids": lambda found: [i for x in found for i in x[0]],
        "decoded": lambda found: " ".join([x[2] for x in found]),
        "ids_sha256": lambda found: sha(" ".join([x[1] for x in found])),
        "decoded_sha256": lambda found: sha(" ".join([x[2] for x in found])),
    }

    def make():
        c = codec(file, strings=any(n not in ("n_tokens", "ids") for n in wanted))

        def work(texts):
            found = c.found(texts)
            return {n: [makers[n](x) for x in found] for n in wanted}

        return work

    return annotate(df, list(keep), text, make, ", ".join(f"{n} {k}" for n, k in wanted.items()))
