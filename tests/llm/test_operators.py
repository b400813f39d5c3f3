"""Every training-data operator against a brute-force version, with odd rows among the documents."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from keyloom.llm import bpe, chat, jaccard, language, licenses, pii, quality, suffixes, urls
from keyloom.llm.decontaminate import decontaminate, without_hits
from keyloom.llm.queries import vocabulary_file

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, score double, labels string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def texts():
    rng = random.Random(1)
    syllables = {"en": "the of and ing er ion", "fr": "le que é aux tion ê", "de": "der und sch ung ü keit"}
    out = []
    for i in range(60):
        lang = sorted(syllables)[i % 3]
        own = syllables[lang].split()
        words = ["".join(rng.choice(own) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 180))]
        out.append((lang, " ".join(words[: len(words) // 2]) + "\n" + " ".join(words[len(words) // 2 :])))
    return out


BASE = texts()


def documents():
    rng = random.Random(2)
    rows = [(i, t, lang) for i, (lang, t) in enumerate(BASE)]
    long = " ".join(BASE[i % 60][1] for i in range(120))
    extra = [
        None, "", " \n\t ", "x", "a b", long, BASE[3][1], BASE[3][1], BASE[4][1] + " end", "same " * 300, "\u00c9\u212a \u0130 \x00 \x1c \x85 Σας",
        "Call +1 (234) 555-0199 or 4111 1111 1111 1111, mail a.b@c.example.org now; 10.0.0.255 256.1.1.1 " + BASE[5][1],
        "Released under the MIT License.\n" + BASE[6][1], "Licensed under the Apache License, Version 2.0.\nCC BY-NC 4.0 the mit license the MIT license",
        BASE[7][1] + " " + " ".join(BASE[8][1].split()[:60]), "&&& *** ### " * 40, "line one\nline one\nline one\n" * 20,
    ]
    rows += [(100 + i, t, None) for i, t in enumerate(extra)]
    for i in range(8):  # near copies of one text, chained
        w = BASE[9][1].split(" ")
        for k in range(i):
            w[-1 - 2 * k] = f"edit{k}"
        rows.append((200 + i, " ".join(w), BASE[9][0]))
    rows += [(3, BASE[3][1], BASE[3][0]), (None, BASE[10][1], BASE[10][0]), (300, rng.choice(BASE)[1].upper(), None)]
    return [(i, t, lang, "s", len(t) if t else None, -1, 0.5, "clash") for i, t, lang in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def checked(df, expected, docs=None):
    """``expected(text)`` for every row, as often as rows repeat."""
    got = Counter(tuple(r) for r in df.collect())
    assert got == Counter((d[0], *expected(d[1])) for d in documents())


# ---- 1 ---------------------------------------------------------------------------


def rules(text):
    words = space_words(text)
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    twice = {w for w, c in Counter(windows).items() if c > 1}
    hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if space_words(line):
            dups += line in seen
            seen.add(line)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_rules(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(115, 0, 0), (2, 1, 0), (2, 1, 0), (None, 0, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")
    found = quality.score_quality(docs, labels)
    checked(found.select("doc_id", *quality.BASE, "base_failed"), rules)
    rows = found.collect()
    assert all(not r["kept"] for r in rows if r["base_failed"])
    good = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 60 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.95 * len(good)
    assert not any(r["kept"] for r in rows if r["doc_id"] == 115)
    assert quality.score_quality(empty, labels).count() == 0
    unlabelled = quality.score_quality(docs, labels.limit(0))
    assert all(r["kept"] == (not r["base_failed"]) for r in unlabelled.collect())


def test_isolation_forest_ranks_outliers_first():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(size=(500, 4)), np.full((5, 4), 9.0)])
    score = quality.IsolationForest(rows).score(rows)
    assert set(np.argsort(-score)[:5]) == set(range(500, 505))
    assert quality.calibrate([(10, True, 99), (900, False, 10), (950, True, 1)], 0.02) == 900 / quality.BINS


# ---- 2 ---------------------------------------------------------------------------


def phrase_rows(text):
    words, hits = plain_words(text), []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        hits += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    at = [k for k, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def template_rows(text):
    words, out, best = plain_words(text), set(filter(None, phrase_rows(text)[4].split(","))), 0.0
    for label, t, names in licenses.TEMPLATES:
        own = licenses.words_of(t)
        tokens = set(own)
        for i in range(max(1, len(words) - len(own) + 1)):
            held = set(words[i : i + len(own)])
            if set(licenses.words_of(names)) <= held and len(tokens & held) >= 0.8 * len(tokens):
                out.add(label)
                best = max(best, len(tokens & held) / len(tokens))
    return ",".join(sorted(out)), best


def test_license_scans(spark, docs, empty):
    found = licenses.scan(docs)
    checked(found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), phrase_rows)
    checked(found.select("doc_id", "labels", "score"), template_rows)
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(docs, templates=(), phrases=()).where("labels <> ''").count() == 0
    filler = " ".join(f"f{i}" for i in range(300))
    lines = [
        ("Released under the Apache License 1.1", ""), ("Licensed under the BSD License, Version 2.0", "bsd"), ("released under license the", ""),
        (f"{filler} {licenses.TEMPLATES[1][1]} {filler}", "mit"), (f"x {filler} {licenses.TEMPLATES[3][1].replace('Unless', 'if')}", "apache-2"), (None, ""), ("", ""),
    ]
    rows = [(7, t) for t, _ in lines] + [(None, lines[3][0])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["labels"] for r in got.collect()) == sorted([x for _, x in lines] + ["mit"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "tile_token" in plan and "BroadcastHashJoin" in plan and "Python" not in plan


def test_license_phrases_are_those_of_the_contract(spark):
    rows = [
        (1, "the MIT license"), (2, "Released under the MIT License, not under the X license"), (3, "under the MIT-license; UNDER THE\x00MIT LICENSE"),
        (4, "the apache license version 2 cc by nc"), (5, "under the mit licenses"), (6, "CC BY NC under the MIT license"),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 3, 0, None, None, ""), (2, 10, 1, 1, 1, "mit"), (3, 8, 2, 0, 4, "mit"), (4, 8, 2, 1, 5, "apache-2,cc-by-nc"), (5, 4, 0, None, None, ""),
        (6, 7, 2, 0, 3, "cc-by-nc,mit"),
    ]


# ---- 3 ---------------------------------------------------------------------------


def slow_phrases(sample, text):
    text = regex.sub(r"\P{L}+", " ", text.lower())
    sample = regex.sub(r"\P{L}+", " ", sample.lower())
    count = at = 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in sample:
            n += 1
        at += max(1, n - 1)
        count += 1
    return count


def test_phrases_match_greedy_search():
    sample = {lang: "\n".join(t for own, t in BASE[:30] if own == lang)[:800] for lang in ("de", "en", "fr")}
    texts = ["\n".join([BASE[40][1], "x q 7 zz", BASE[41][1]]), sample["en"], sample["de"][100:700] + " " + sample["fr"], "a", "qqq" * 200]
    for block in (64, 192, 1024):
        parser = language.CrossParser(sample, block=block)
        lang, score = parser.predict([texts[0], None, "12 34", "", "\u00bd 12 \u00b2 \u2460", *texts[1:]])
        assert lang[1:5] == ["und"] * 4 and score[1:5] == [0.0] * 4
        for text, found, x in zip(texts, [lang[0], *lang[5:]], [score[0], *score[5:]], strict=True):
            bits = {k: slow_phrases(v, text) * parser.bits[i] for i, (k, v) in enumerate(sorted(sample.items()))}
            low = sorted(bits.values())
            assert found == min(bits, key=bits.get) and x == pytest.approx(1 - low[0] / low[1])


def test_language_id(spark, docs, empty):
    learn = docs.where(~F.coalesce(language.held_out(F.col("doc_id")), F.lit(False)))
    found = by_id(language.identify(docs, language.training_sample(learn, "doc_id", "text", "lang")))
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 5 and all(found[i][0]["lang_pred"] == BASE[i][0] for i in held)
    assert [found[100 + k][0]["lang_pred"] for k in range(3)] == ["und"] * 3
    assert sum(map(len, found.values())) == len(documents())
    assert language.identify(empty, {}).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, language.training_sample(empty, "doc_id", "text", "lang")).collect()} == {"und"}


# ---- 4 ---------------------------------------------------------------------------


def covered_places(rows, n=50):
    words = [(i, space_words(lowered(t))) for i, t in rows if i is not None]
    seen = Counter(tuple(w[k : k + n]) for _, w in words for k in range(len(w) - n + 1))
    out = defaultdict(set)
    for i, w in words:
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                out[i] |= set(range(k, k + n))
    return {i: s for i, s in out.items() if s}


def test_suffix_dedup(docs, empty):
    found = suffixes.repeated_passages(docs).collect()
    got = defaultdict(set)
    for r in found:
        assert r["n_words"] == r["end_word"] - r["start_word"] >= 50
        assert not got[r["doc_id"]] & set(range(r["start_word"], r["end_word"]))
        got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert dict(got) == covered_places([d[:2] for d in documents()])
    assert suffixes.repeated_passages(empty).count() == 0


def test_suffix_dedup_deals_large_groups(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP_ROWS", 20)
    monkeypatch.setattr(suffixes, "LIST_ROWS", 3)
    common = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{' '.join(f'x{i}y{k}' for k in range(i % 7 + 3))} {common} z{i}") for i in range(40)]
    found = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in found} == {(i, i % 7 + 3, i % 7 + 63) for i in range(40)}


def test_suffix_dedup_of_rows_that_share_an_id(spark, monkeypatch):
    word = [" ".join(f"w{k}n{i}" for i in range(80)) for k in range(2)]
    rows = [(2, word[0]), (9, word[0]), (9, "v0 v1 v2 v3 v4"), (9, "x " + word[1]), (11, word[1]), (12, None), (13, word[1]), (13, word[1])]
    for most in (suffixes.GROUP_ROWS, 1):
        monkeypatch.setattr(suffixes, "GROUP_ROWS", most)
        found = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in found) == [(2, 0, 80), (9, 0, 80), (9, 1, 81), (11, 0, 80), (13, 0, 80)]


def passages_of(spark, rows):
    """doc_id -> places in the repeated passages found."""
    got = defaultdict(set)
    for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    return dict(got)


def test_suffix_dedup_finds_rare_passages_around_a_common_line(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP_ROWS", 20)
    line = " ".join(f"w{i}" for i in range(20))
    rows = [(i, " ".join(f"x{i}y{k}" for k in range(40)) + f" {line} " + " ".join(f"x{i}z{k}" for k in range(40))) for i in range(300)]
    for i in range(0, 120, 2):  # 60 words around the line that only two documents share
        around = [" ".join(f"p{i}q{k}" for k in range(a, a + 20)) for a in (0, 20)]
        rows += [(1000 + i + k, f"a{i}b{k} {around[0]} {line} {around[1]} c{i}d{k}") for k in range(2)]
    want = covered_places(rows)
    assert len(want) == 120
    assert passages_of(spark, rows) == want


def test_suffix_dedup_finds_a_passage_that_nearer_rows_hide(spark):
    rng = random.Random(4)
    own = lambda n: [f"u{rng.randint(0, 10**12)}" for _ in range(n)]
    rows = []
    while len(rows) < 6 * 20:  # the first two of six rows share 53 words; with others the first shares more on one side, and under 50 in all
        left, line, right = own(25), own(16), own(12)
        x, y = own(1), own(1)
        first = own(14) + y + left + line + right + x + own(27)
        if 40 not in suffixes.kept_suffixes(jaccard.word_hashes([" ".join(first)])[0])[0]:
            continue  # the minimiser is to be where all six agree
        group = [first, own(15) + left + line + right + own(28)]
        group += [own(40) + line + right + x + own(27) for _ in range(2)] + [own(14) + y + left + line + own(40) for _ in range(2)]
        rows += [(len(rows) + k, " ".join(words)) for k, words in enumerate(group)]
    want = covered_places(rows)
    assert sorted(want) == sorted(i for i in range(len(rows)) if i % 6 < 2)
    assert passages_of(spark, rows) == want


# ---- 5 ---------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/x?q", "https://example.net/EN/", "ftp://x.net", "http://net/", "http://x.org/fr/#a", "http://xorg/fr/",
    "http://sub.example.com/de/a", "http://example.com/den", "http://example.com/de", "a://b://c.net/y", "http://u@h.net:80/p", "http://example.net/en/" + "z" * 5000, "http://x.net/", "http://x.net/",
    "http://" + ".".join("a" * 3000) + ".net/",
]


def rule_of(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url[url.index("://") + 3 :], re.S)
        host, path = lowered(m[1]), m[2]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_url_filters(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "<html>", "r") for i, u in enumerate(URLS)], "page_id bigint, url string, html string, rule string")
    known = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    want = Counter((i, *rule_of(u)) for i, u in enumerate(URLS))
    assert Counter(tuple(r) for r in urls.judge(pages, known).collect()) == want
    monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    assert Counter(tuple(r) for r in urls.judge(pages, known).collect()) == want
    assert {r["verdict"] for r in urls.judge(pages, known.limit(0), otherwise="block").collect()} == {"block"}
    assert urls.judge(pages.limit(0), known).count() == 0
    monkeypatch.setattr(urls, "SHORT", 0)  # all digests begin alike: the full ones decide
    assert Counter(tuple(r) for r in urls.judge(pages, known).collect()) == want
    odd = known.union(spark.createDataFrame([("allow", None, "/x"), (None, "net", "/"), ("allow", "x.net", None), ("block", "x.net", "")], known.schema))
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, odd).collect()}[16] == ("x.net", "block")


# ---- 6 ---------------------------------------------------------------------------


def benchmark_rows():
    return [(1, " ".join(BASE[7][1].split()[5:30])), (2, BASE[10][1].upper()), (10, "x"), (11, None), (12, "..."), (3, " ".join(BASE[7][1].split()[5:30])), (4, "a b")]


def hits_of(text):
    windows = defaultdict(set)
    for i, t in benchmark_rows():
        w = plain_words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    words, hit, items = plain_words(text), set(), set()
    for n in {len(k) for k in windows}:
        for k in range(len(words) - n + 1):
            own = windows.get(tuple(words[k : k + n]))
            if own:
                hit |= set(range(k, k + n))
                items |= own
    return words, hit, items


def test_decontamination(spark, docs, empty, monkeypatch):
    from keyloom.llm import decontaminate as module

    bench = spark.createDataFrame(benchmark_rows(), "item_id bigint, text string")

    def want(text):
        words, hit, items = hits_of(text)
        return len(words), len(hit), len(items), ",".join(sorted(map(str, items))), len(hit) > 0 and 20 * len(hit) >= len(words)

    for bound in (module.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(module, "BROADCAST_WINDOWS", bound)
        found = decontaminate(docs, bench)
        checked(found.select("doc_id", "n_words", "n_hit", "n_items", F.array_join("items", ","), "contaminated"), want)
    assert not decontaminate(docs, bench.limit(0)).where("contaminated or n_hit > 0").count()
    assert decontaminate(empty, bench).count() == 0
    left = by_id(without_hits(docs, bench))
    assert plain_words(left[10][0]["text"]) == [] and left[0][0]["text"] == BASE[0][1]


# ---- 7 ---------------------------------------------------------------------------


def test_chat_formatting(spark):
    rows = [
        (1, True, 0, "user", "q"), (1, True, 1, "assistant", "a"), (1, True, 2, "user", "r"), (1, False, 0, "user", "q"), (1, False, 1, "assistant", "b"),
        (2, True, 0, "user", "same"), (2, False, 0, "user", "same"), (3, False, 0, "assistant", "alone"), (4, True, None, None, None), (4, False, 300, "user", ""),
        (5, True, 0, "user", "p"), (5, True, 0, "user", "p"), (5, False, 0, "user", "p"),
        (None, True, 0, "user", "n"), (None, False, 0, "user", "m"),
    ]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "pair_id bigint, chosen boolean, turn bigint, role string, text string, block string")
    found = chat.format_preferences(turns).collect()
    got = {r["pair_id"]: r for r in found}
    assert len(got) == len(found) == 6
    show = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    one = got[1]
    assert one["prompt"] == show("user", "q") and one["chosen"] == show("assistant", "a") + show("user", "r") and one["rejected"] == show("assistant", "b")
    assert one["chosen_mask"] == f"{len(show('assistant', 'a'))}:1,{len(show('user', 'r'))}:0"
    assert got[2]["prompt"] == show("user", "same") and got[2]["chosen"] == got[2]["rejected"] == ""
    assert got[3]["prompt"] == "" and got[3]["rejected"] == show("assistant", "alone")
    assert got[4]["chosen"] == show("unknown", "") and got[4]["rejected"] == show("user", "")
    assert got[5]["prompt"] == "" and got[5]["chosen"] == show("user", "p") * 2
    assert got[None]["rejected"] == show("user", "m")
    assert chat.format_preferences(turns.limit(0)).count() == 0


def test_chat_formatting_of_a_long_pair(spark):
    same = [(t, "assistant" if t % 2 else "user", f"t{t}") for t in range(300)]
    rows = [(9, side, *x) for side in (True, False) for x in same]
    rows += [(9, True, 300, "assistant", "good " * 50_000), (9, False, 300, "assistant", ""), (9, True, 301, "user", "more")]
    conv = spark.createDataFrame([(2 * p + (not c), t, r, x) for p, c, t, r, x in rows] + [(None, 0, "user", "no id"), (2**53 + 3, 0, "user", "far")], "conv_id bigint, turn bigint, role string, text string")
    got = {r["pair_id"]: r for r in chat.format_preferences(chat.adjacent_pairs(conv), block_turns=32).collect()}
    show = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert set(got) == {9, None, 2**52 + 1}
    assert got[9]["n_prompt_turns"] == 300 and got[9]["prompt"] == "".join(show(r, x) for _, r, x in same)
    assert got[9]["chosen"] == show("assistant", "good " * 50_000) + show("user", "more") and got[9]["rejected"] == show("assistant", "")
    assert got[2**52 + 1]["rejected"] == show("user", "far") and got[None]["prompt"] == ""


# ---- 8 ---------------------------------------------------------------------------


def test_bpe_is_the_librarys(docs, empty):
    from tokenizers import Tokenizer

    file = vocabulary_file()
    t = Tokenizer.from_file(file)

    def want(text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False)

    found = bpe.encode_documents(docs, file, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"))
    checked(found.select("doc_id", "n_tokens", F.array_join("ids", " "), "decoded"), want)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    checked(found.select("doc_id", "ids_sha256", "decoded_sha256"), lambda s: tuple(map(sha, want(s)[1:])))
    assert bpe.encode_documents(empty, file).count() == 0
    codec, rng = bpe.codec(file), random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("aaabcdeehilnorst 'stvmé.!?9<|endoftext|>\n\u3000") for _ in range(60))
        assert [i for x in codec.found([text])[0] for i in x[0]] == t.encode(text, add_special_tokens=False).ids


def test_automaton_follows_the_merges():
    rng = random.Random(6)
    for _ in range(200):
        letters = "abc"
        vocab = {c: i for i, c in enumerate(letters)}
        merges = []
        for _ in range(rng.randint(1, 8)):
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        auto = bpe.compile_merges(vocab, merges)
        auto.most = rng.choice([3, 1000])  # the table is made afresh between words
        names = {i: t for t, i in vocab.items()}
        words, want = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(40)], []
        for word in words:
            parts = list(word)
            while True:
                ranked = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges]
                if not ranked:
                    break
                _, i = min(ranked)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            want.append(parts)
        for a in (0, 20):
            assert [[names[i] for i in ids] for ids in auto.encode([w.encode() for w in words[a : a + 20]])] == want[a : a + 20]


# ---- 9 ---------------------------------------------------------------------------


def shingle_set(text, n=4):
    w = space_words(lowered(text))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def component_rows(rows):
    sets = defaultdict(set)
    for i, t in rows:
        sets[i].add(shingle_set(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(s and u and 100 * len(s & u) >= 85 * len(s | u) for s in sets[a] for u in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_ngram_jaccard(docs, empty):
    rows = [d[:2] for d in documents()]
    want = component_rows([r for r in rows if r[0] is not None])
    got = jaccard.link_documents(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    sizes = {(i, len(shingle_set(t))) for i, t in rows}
    for r in got:
        assert (r["doc_id"], r["n_shingles"]) in sizes
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]
    assert len({want[200 + i] for i in range(8)}) < 8
    assert jaccard.link_documents(empty).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    c, d, e = ("alpha beta gamma delta epsilon", "one two three four five", "uno dos tres cuatro cinco")
    rows = [(5, c), (9, c), (9, d), (12, d), (12, None), (20, e), (21, e), (None, d), (None, "zeta eta theta iota"), (30, None), (5, c)]
    got = jaccard.link_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter([(5, 5), (9, 5), (9, 5), (12, 5), (12, 5), (20, 20), (21, 20), (None, 5), (None, None), (30, 30), (5, 5)])


def test_plans_cover_the_difference():
    scheme = jaccard.Scheme()
    for band in range(16):
        n1, n2, k2 = scheme.plan(band)
        k = scheme.differ((2 << band) - 1)
        assert n1 * (k2 + 1) > k and n2 > k2 and (n2 > 1 or k == 0)


def test_similar_sets_share_a_signature_and_pass_the_sketch():
    rng, scheme = np.random.default_rng(3), jaccard.Scheme()
    for _ in range(300):
        n = int(rng.integers(1, 900))
        features = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        n = len(features)
        gone = int(rng.integers(0, scheme.differ(n) + 1))
        other = np.unique(np.concatenate([features[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, gone + 1)), dtype=np.uint64)]))
        common = len(np.intersect1d(features, other))
        if 100 * common < 85 * (n + len(other) - common) or not len(other):
            continue
        assert len(np.intersect1d(scheme.signatures(features), scheme.signatures(other)))
        assert jaccard.may_be_similar(jaccard.sketch(features), jaccard.sketch(other), n, len(other), 85, 100)


def test_bucket_blocks_find_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "FEW", 0)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        for k in range(i % 9):
            w[rng.randrange(60)] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == component_rows(rows)


# ---- 10 --------------------------------------------------------------------------


def regex_spans(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) < 256 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in tests.items()}


def test_base_spans_are_the_regexes():
    rng = random.Random(9)
    for alphabet in ("a1@.+- ()%Zé", "0123456789-. +", "12.@a"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(40))
            assert pii.base_spans(text) == regex_spans(text)


def test_pii(docs, empty):
    found = pii.find_spans(docs, masked="masked")

    def want(text):
        spans = regex_spans(text)
        return (*[len(spans[k]) for k in pii.KINDS], ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in spans[k]))

    checked(found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_spans"), want)
    rows = by_id(found)
    assert all(set(filter(None, r["base_spans"].split(","))) <= set(r["spans"].split(",")) for own in rows.values() for r in own)
    assert "a.b@c" not in rows[111][0]["masked"] and "<email>" in rows[111][0]["masked"] and "<card>" in rows[111][0]["masked"]
    assert rows[0][0]["masked"] == BASE[0][1] and rows[100][0]["masked"] is None
    assert pii.find_spans(empty).count() == 0


def test_span_model_decodes_unseen_examples():
    model = pii.trained()
    data = pii.examples(120, seed=99)
    assert sum(model.decode(t) == s for t, s in data) >= 0.95 * len(data)
    assert [k for *_, k in pii.model_spans("key: token = \"0123456789abcdef0123456789abcdef01234567\" ok", model)] == ["secret"]


def test_regions_are_decoded_like_the_whole_text():
    model, rng = pii.trained(), random.Random(12)
    for gap in (1, 4, 5, 30):
        for tokens, _ in pii.examples(150, seed=gap):
            tokens = [rng.choice(tokens) for _ in range(rng.randint(0, 6))] + ["plain"] * rng.randint(0, 9) + tokens + ["words"] * rng.randint(0, 9) + tokens[:3]
            text = (" " * gap).join(tokens)
            spans = [m.span() for m in re.finditer(r"\S+", text)]
            whole = [(*pii.trimmed(text, spans[i][0], spans[j - 1][1]), kind) for i, j, kind in model.decode(tokens)]
            assert pii.model_spans(text, model) == [x for x in whole if x[0] < x[1]]


def test_long_tokens_are_read_whole():
    model = pii.trained()
    for n in (150, 199, 250, 5000):
        assert [k for *_, k in pii.model_spans(f"see password={'a1b2c3d4e5' * (n // 10)} now", model)] == ["secret"]
    assert [k for *_, k in pii.model_spans("card 4111     1111     1111     1111 end", model)] == ["card"]


def test_best_segmentation_is_the_best_of_all():
    model = pii.trained()

    def best(tokens, i=0):
        if i == len(tokens):
            return 0.0
        out = best(tokens, i + 1)
        for j in range(i + 1, min(len(tokens), i + pii.MAX_TOKENS) + 1):
            found = segments.get((i, j))
            if found:
                out = max(out, float(model.scores(found).max()) + best(tokens, j))
        return out

    for tokens, _ in pii.examples(25, seed=5):
        tokens = tokens[:9]
        segments = model.segments(tokens)
        got = sum(float(model.scores(segments[i, j]).max()) for i, j, _ in model.decode(tokens))
        assert got == pytest.approx(best(tokens))


def test_long_odd_texts_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1" * 60 + "x=", ("1" * 50_000 + "x ") * 4, "a." * 100_000, "+1" + "(" * 200_000, "1.2." * 50_000, "@" * 100_000, "x@y" * 50_000):
        pii.all_spans(text, pii.trained())
        quality.rule_statistics(text)
