"""Personal data by a semi-Markov conditional random field (any style: Python over Arrow).

Base rules find e-mail addresses, IP numbers, card numbers and phone numbers; what they
find stays. The model adds spans: its segments are runs of one to ``MAX_TOKENS`` tokens
(a bounded entity), each scored as a whole by features of the entire span (shape, digit
count, checksum, hexadecimal share, word before it) and its type; dynamic programming
picks boundaries and types jointly. Its weights are the maximum of the conditional
likelihood over examples generated here from a fixed seed.

A segment holds a token that bears a sign (digit, ``@``, ``=``, ``+``), all other tokens are outside with score 0, so
a text falls into independent regions, each of the tokens that a segment with a sign can reach, and only those are decoded.

Rows: one for each input row. Null text counts as empty: no spans. Very long texts and
very long tokens are read whole: every base rule and every feature runs in time linear in the text. Model
spans that touch a base span are dropped. Repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import random
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from keyloom.llm.common import annotate

KINDS = ("email", "ip", "card", "phone")
#: Types that only the model finds.
MODEL_KINDS = ("secret", "account")
LABELS = ("out", *KINDS, *MODEL_KINDS)
MAX_TOKENS = 4

_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_not_digit = re.compile(r"[^0-9]")


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[-1::-2]]
    even = [2 * int(c) for c in digits[-2::-2]]
    return (sum(odd) + sum(d - 9 if d > 9 else d for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From every ``@`` back over the local part and on over the domain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if _digit.search(text):
        if "." in text:
            found["ip"] = [m.span() for m in _ip.finditer(text) if all(_octet(p) for p in m[0].split("."))]
        for m in _card.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _not_digit.sub("", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _phone.finditer(text) if 9 <= len(_not_digit.sub("", m[0])) <= 15]
    return found


# ---- the model -------------------------------------------------------------

_sign = re.compile(r"[0-9@=+]")
_token = re.compile(r"\S+")
_hex = re.compile(r"[0-9a-fA-F]{16,}")
_key = re.compile(r"[A-Z0-9]{16,}$")
_trim = ".,;:!?\"'()[]"
_cue_words = frozenset(("token", "password", "secret", "key", "apikey", "api_key", "passwd", "pwd"))
_account = re.compile(r"(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}|[0-9]{3}-[0-9]{2}-[0-9]{4})$")


def span_features(tokens: Sequence[str], i: int, j: int) -> list[str]:
    """Of the segment tokens[i:j] as a whole, with the word before it."""
    span = " ".join(tokens[i:j])
    bare = span.strip(_trim)
    digits = len(_not_digit.sub("", bare))
    out = ["bias", f"tokens={j - i}", f"digits={min(digits, 20)}"]
    if "@" in bare:
        out.append("mail" if re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", bare) else "at")
    if bare[:1] == "+" and digits == len(re.sub(r"[+\x20().-]", "", bare)):
        out.append(f"plus={9 <= digits <= 15}")
    if re.fullmatch(r"[0-9]++(?:[\x20-][0-9]++)*+", bare):
        out.append(f"number={13 <= digits <= 19}:{13 <= digits <= 19 and luhn(_not_digit.sub('', bare))}")
    if re.fullmatch(r"[0-9]{1,9}(?:\.[0-9]{1,9}){3}", bare):
        out.append(f"quad={all(int(p) < 256 for p in bare.split('.'))}")
    if _account.fullmatch(bare):
        out.append("account")
    if _key.fullmatch(bare) and digits < len(bare) and digits:
        out.append("key")
    if _hex.search(bare) and digits < len(bare):
        out.append("hex")
    head, eq, tail = bare.partition("=")
    if eq and head.strip().lower() in _cue_words and len(tail.strip()) >= 6:
        out.append(f"assigned:{j - i == 1 + (' ' in bare) * 2}")
    if i and tokens[i - 1].strip(_trim).lower() in (*_cue_words, "=", ":"):
        out.append("after_cue")
    if not _sign.search(tokens[i]) and not (eq and head.strip().lower() in _cue_words):
        out.append("plain_start")
    if not _sign.search(tokens[j - 1]):
        out.append("plain_end")
    return out


class SpanModel:
    """Weights of (feature, type); segments of type out are single tokens with score 0."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    def segments(self, tokens: Sequence[str]) -> dict[tuple[int, int], list[str]]:
        """Candidates: at most MAX_TOKENS tokens, of which one bears a sign."""
        n, signed = len(tokens), [bool(_sign.search(t)) for t in tokens]
        return {
            (i, j): span_features(tokens, i, j)
            for i in range(n)
            for j in range(i + 1, min(n, i + MAX_TOKENS) + 1)
            if any(signed[i:j])
        }

    def scores(self, found: list[str]) -> np.ndarray:
        none = np.zeros(len(LABELS) - 1)
        return sum((self.weights.get(f, none) for f in found), none)

    def decode(self, tokens: Sequence[str]) -> list[tuple[int, int, str]]:
        """The best segmentation: best[j] over the segments that end at j."""
        n = len(tokens)
        ends: dict[int, list] = {}
        for (i, j), found in self.segments(tokens).items():
            s = self.scores(found)
            k = int(s.argmax())
            if s[k] > 0:
                ends.setdefault(j, []).append((float(s[k]), i, LABELS[k + 1]))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j], back[j] = best[j - 1], None
            for s, i, kind in ends.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, kind)
        out, j = [], n
        while j > 0:
            if back[j]:
                i, kind = back[j]
                out.append((i, j, kind))
                j = i
            else:
                j -= 1
        return out[::-1]


def examples(count: int = 240, seed: int = 7) -> list[tuple[list[str], list[tuple[int, int, str]]]]:
    """Generated token lists with their entity segments, and numbers that are none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8)))
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    digits = "0123456789"

    def card() -> str:
        body = pick(digits, 15)
        return next(body + d for d in digits if luhn(body + d))

    makers = [
        ("email", lambda: [f"{word()}.{pick(digits, 2)}@{word()}.{rng.choice(['com', 'org', 'example.net'])}"]),
        ("ip", lambda: [".".join(str(rng.randint(1, 255)) for _ in range(4))]),
        ("card", lambda: [card()]),
        ("card", lambda: (lambda c: [c[:4], c[4:8], c[8:12], c[12:]])(card())),
        ("phone", lambda: [f"+{rng.randint(1, 99)}", f"({pick(digits, 3)})", f"{pick(digits, 3)}-{pick(digits, 4)}"]),
        ("phone", lambda: [f"+{pick(digits, 11)}"]),
        ("secret", lambda: [rng.choice(["token", "key", "password"]), "=", f'"{pick("0123456789abcdef", 40)}"']),
        ("secret", lambda: [f"{rng.choice(['password', 'secret', 'pwd'])}={pick('0123456789abcdefgh', rng.randint(8, 30))}"]),
        ("secret", lambda: ["A" + pick("KSJI", 3) + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 15) + rng.choice(digits)]),
        ("account", lambda: [rng.choice(["DE", "FR", "ES", "GB"]) + pick(digits, 2) + pick(digits, rng.randint(14, 20))]),
        ("account", lambda: [f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}"]),
        ("out", lambda: [pick(digits, rng.randint(1, 8))]),
        ("out", lambda: [f"{rng.randint(1, 9)}.{rng.randint(0, 99)}"]),
        ("out", lambda: [f"{word()}{rng.randint(0, 99)}"]),
        ("out", lambda: [word(), "=", word()]),
        ("out", lambda: [f"20{pick(digits, 2)}-{pick('01', 2)}-{pick('012', 2)}"]),
        ("out", lambda: [".".join(str(rng.randint(256, 999)) for _ in range(4))]),
        ("out", lambda: [f"{rng.randint(1, 30)}+{rng.randint(1, 30)}"]),
    ]
    out = []
    for k in range(count):
        tokens, spans = [word() for _ in range(rng.randint(1, 3))], []
        for kind, make in (makers[k % len(makers)], rng.choice(makers)):
            own = make()
            if kind != "out":
                spans.append((len(tokens), len(tokens) + len(own), kind))
            tokens += own
            tokens[-1] += rng.choice(["", "", ".", ","])
            tokens += [word() for _ in range(rng.randint(1, 2))]
        out.append((tokens, spans))
    return out


def train(data=None, rounds: int = 12, rate: float = 0.5, shrink: float = 1e-3) -> SpanModel:
    """Gradient ascent on the log-likelihood; expectations by the forward and backward sums over segmentations."""
    data = examples() if data is None else data
    weights: dict[str, np.ndarray] = {}
    model = SpanModel(weights)
    kinds = len(LABELS) - 1
    prepared = [(t, model.segments(t), s) for t, s in data]
    for r in range(rounds):
        step = rate / (1 + 0.2 * r)
        for tokens, segments, spans in prepared:
            n = len(tokens)
            score = {ij: model.scores(f) for ij, f in segments.items()}
            begin, end = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            begin[0] = end[n] = 0.0
            ends: dict[int, list] = {}
            starts: dict[int, list] = {}
            for i, j in segments:
                ends.setdefault(j, []).append(i)
                starts.setdefault(i, []).append(j)
            total = {ij: float(np.logaddexp.reduce(s)) for ij, s in score.items()}
            for j in range(1, n + 1):
                begin[j] = np.logaddexp.reduce([begin[j - 1], *(begin[i] + total[i, j] for i in ends.get(j, ()))])
            for i in range(n - 1, -1, -1):
                end[i] = np.logaddexp.reduce([end[i + 1], *(end[j] + total[i, j] for j in starts.get(i, ()))])
            true = {(i, j): LABELS.index(k) - 1 for i, j, k in spans}
            for ij, found in segments.items():
                grad = -np.exp(begin[ij[0]] + score[ij] + end[ij[1]] - begin[n])
                if ij in true:
                    grad[true[ij]] += 1
                if np.abs(grad).max() > 1e-4:
                    for f in found:
                        w = weights.setdefault(f, np.zeros(kinds))
                        w += step * (grad - shrink * w)
    return model


@functools.cache
def trained() -> SpanModel:
    return train()


def trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and text[s] in _trim:
        s += 1
    while e > s and text[e - 1] in _trim:
        e -= 1
    return s, e


def model_spans(text: str, model: SpanModel) -> list[tuple[int, int, str]]:
    """Code point spans the model finds, region by region: MAX_TOKENS - 1 tokens on both sides of a sign and one before them, which features look at."""
    if not _sign.search(text):
        return []
    spans = [m.span() for m in _token.finditer(text)]
    starts = [s for s, _ in spans]
    regions: list[list[int]] = []  # of tokens
    known = -1
    for m in _sign.finditer(text):
        if m.start() < known:
            continue
        k = bisect.bisect_right(starts, m.start()) - 1
        known = spans[k][1]
        left, right = max(0, k - MAX_TOKENS + 1), min(len(spans), k + MAX_TOKENS)
        if regions and left < regions[-1][1]:
            regions[-1][1] = right
        else:
            regions.append([left, right])
    out = []
    for a, b in regions:
        a = max(0, a - 1)
        for i, j, kind in model.decode([text[s:e] for s, e in spans[a:b]]):
            s, e = trimmed(text, spans[a + i][0], spans[a + j - 1][1])
            if s < e:
                out.append((s, e, kind))
    return out


def all_spans(text: str | None, model: SpanModel) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind, and all spans by kind then start."""
    text = text or ""
    base = base_spans(text)
    listed = [(k, s, e) for k in KINDS for s, e in base[k]]
    taken = sorted((s, e) for _, s, e in listed)
    reach = list(itertools.accumulate((e for _, e in taken), max))
    more = []
    for s, e, kind in model_spans(text, model):
        i = bisect.bisect_left(reach, s + 1)  # the first base span that ends behind s, or one that a longer one holds
        if i == len(taken) or taken[i][0] >= e:
            more.append((kind, s, e))
    order = {k: i for i, k in enumerate((*KINDS, *MODEL_KINDS))}
    return base, sorted(listed + more, key=lambda x: (order[x[0]], x[1]))


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of spans that overlap, one mark for all."""
    if text is None or not spans:
        return text
    out, done = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[done:s], f"<{kind}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def find_spans(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), masked: str | None = None) -> DataFrame:
    """``keep``, n_email, n_ip, n_card, n_phone, base_spans, spans (``kind:start:end``, comma-joined), n_spans, and with ``masked`` that column of masked text."""
    model = trained()
    result = ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_spans string, spans string, n_spans bigint" + (f", `{masked}` string" if masked else "")
    join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

    def make():
        def work(texts):
            out = {f"n_{k}": [] for k in KINDS} | {"base_spans": [], "spans": [], "n_spans": []} | ({masked: []} if masked else {})
            for t in texts:
                base, spans = all_spans(t, model)
                for k in KINDS:
                    out[f"n_{k}"].append(len(base[k]))
                out["base_spans"].append(join((k, s, e) for k in KINDS for s, e in base[k]))
                out["spans"].append(join(spans))
                out["n_spans"].append(len(spans))
                if masked:
                    out[masked].append(mask(t, spans))
            return out

        return work

    return annotate(df, list(keep), text, make, result)
