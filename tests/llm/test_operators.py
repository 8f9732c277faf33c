"""Every operator against a brute-force version or a library, over nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from priorlens.llm import bitplane, byte_bpe, kdtree, langid, minhash, mixing, preference, quality, sharding, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, size long, shard int, _h long, before long, key string, part int"


def text_of(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = "the of and to a in is that river stone window garden little morning water house paper never always under".split()
    return " ".join(r.choice(words) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def rows():
    base = text_of(1, 300).split()
    near = base.copy()
    near[100] = "CHANGED"
    other = [
        (None, None), ("", None), (" \n\t ", "s1"), ("one", "s1"), ("one two three four", "s2"), ("ONE two THREE four", "s2"), (" ".join(base), "s1"), (" ".join(near), None), (" ".join(base), "s3"),
        ("a b c " * 80, "s1"), ("line one\nline one\n\nline two " * 30, "s2"), ("***&&&###%%% " * 70, "s1"), ("日本語 été naïve 😀 " * 40, "s2"), ("a" * 5000, "s1"), (text_of(9, 60_000), "s1"), ("1234 5678", "s3"), ("  lead space  and   runs  ", "s3"), ("<s> </s> <|endoftext|> ▁x", "s1"),
    ] + [(text_of(k, 40 + k), f"s{k % 3}") for k in range(20, 80)]
    out = [(i, t, "en" if i % 7 else None, s) for i, (t, s) in enumerate(other)]
    out += [out[6], out[6], (None, "no id here", "en", "s1"), (None, None, None, None), (6, "same id, another text", "en", "s1")]
    return [(*r, 1, 2, 3, 4, 5, "k", 6) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table():
    return [(r[0], r[1], r[2], r[3]) for r in rows()]


# 1 quality rules


def brute_base(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def brute_distance(p, q):
    p, q = np.array(p, float), np.array(q, float)
    if not p.sum() or not q.sum():
        return None
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    return math.sqrt(max(0, (kl(p) + kl(q)) / 2))


def test_quality_counts_and_distances(docs):
    got = quality.divergence_rules(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got if r.doc_id is not None) == sorted((i, *brute_base(t)) for i, t, *_ in table() if i is not None)
    assert len(got) == len(table())

    def classes_of(text):
        rest, classes = text or "", []
        import regex

        for p in quality.CLASSES:
            left = regex.sub(p, "", rest)
            classes.append(len(rest) - len(left))
            rest = left
        return classes + [len(rest)]

    words_of = lambda text: Counter(w.lower() for w in WORD.findall(text or ""))
    sample = defaultdict(Counter)  # all of a label are drawn here: there are fewer than SAMPLE_DOCS
    for _, t, lang, _ in table():
        if lang and len(t or "") >= quality.MIN_CHARS:
            sample[lang] += words_of(t)
            sample[None] += words_of(t)
    lists = {k: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON]] for k, c in sample.items() if k is None or sum(c.values()) >= quality.MIN_REFERENCE_WORDS}
    bins = lambda c, key: [c[w] for w in lists[key]] + [sum(c.values()) - sum(c[w] for w in lists[key])]
    own = lambda lang: lang if lang in lists else None
    passed = [(t, lang) for _, t, lang, _ in table() if not brute_base(t)[5]]
    total = lambda some, f: np.sum([f(x) for x in some], axis=0)
    want = {}
    for i, t, lang, _ in table():
        key = own(lang)
        qc = total([x for x, k in passed if key is None or k == lang], classes_of)
        qw = bins(sample[None], None) if key is None else total([x for x, k in passed if k == lang], lambda x: bins(words_of(x), key))
        want[i, *brute_base(t)] = (brute_distance(classes_of(t), qc), brute_distance(bins(words_of(t), key), qw))
    for r in got:
        for x, y in zip((r.class_distance, r.word_distance), want[r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed]):
            if r.doc_id != 6:  # ids that repeat with another text are told apart by their counts only
                assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-6)
    by = {r.doc_id: r for r in got}
    assert not by[11].kept and by[25].kept and not by[0].kept


def test_quality_empty(empty):
    assert quality.divergence_rules(empty).collect() == []


def test_words_of_any_language(spark, monkeypatch):
    """Words are learned per label from a bounded sample: the rule fires in a language that nothing is known of, whatever
    share of its documents is bad, and what fails the base rules is no reference."""
    r = random.Random(6)
    common, rare = [f"ka{i}" for i in range(20)], [f"zu{i}x" for i in range(4000)]
    good = [" ".join(r.choice(common if r.random() < 0.6 else rare) for _ in range(200)) for _ in range(60)]
    bad = [" ".join(r.choice(rare) for _ in range(200)) for _ in range(12)]
    loops = ["loop again loop " * 100] * 200
    rows = [(i, t, "xx") for i, t in enumerate(good + bad)] + [(1000 + i, t, "xx") for i, t in enumerate(loops)] + [(5000 + i, text_of(i, 200), "en") for i in range(20)] + [(6000, good[0], "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {x.doc_id: x for x in quality.divergence_rules(docs).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[60 + i].kept or got[60 + i].base_failed for i in range(12))
    assert got[1000].base_failed and got[6000].kept in (True, False)
    words = {x.lang: x.vocabulary for x in quality.common_words(docs).collect()}
    assert set(words) == {None, "xx", "en"} and set(common) < set(words["xx"]) and len(words["xx"]) == quality.COMMON
    monkeypatch.setattr(quality, "SAMPLE_DOCS", 40)
    few = {x.doc_id: x.kept for x in quality.divergence_rules(docs.where("doc_id < 1000 or doc_id >= 5000")).collect()}
    assert [few[i] for i in range(72)] == [True] * 60 + [False] * 12


def test_words_come_from_all_documents(spark, monkeypatch):
    """However few documents a sample would draw, words are counted in all of a label; a sample is drawn only if it is asked for."""
    monkeypatch.setattr(quality, "SAMPLE_DOCS", 3)
    rows = [(i, " ".join(f"own{i % 25}x{k % 7}" for k in range(100)), "en" if i % 3 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    want = defaultdict(Counter)
    for _, t, lang in rows:
        want[lang].update(t.split())
        want[None].update(t.split())
    got = {r.lang: (r.vocabulary, r.share) for r in quality.common_words(docs).collect()}
    assert set(got) == set(want)
    for lang, c in want.items():
        best = sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON]
        total = sum(c.values())
        assert got[lang] == ([w for w, _ in best], [n / total for _, n in best] + [(total - sum(n for _, n in best)) / total])
    few = quality.common_words(docs, sample_docs=3).where("lang is null").first()
    assert len({w.split("x")[0] for w in few.vocabulary}) <= 6


# 2 top-k


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(4)
    vecs = [(int(i), [float(x) for x in r.normal(0, 0.3, 6)]) for i in range(900)] + [(1000 + i, [0.5] * 6) for i in range(400)]
    vecs += [(2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, [1.0]), (None, [0.1] * 6), (20, [0.2] * 6), (40, [-0.2] * 6)]
    df = spark.createDataFrame([(i, v, 7, 8) for i, v in vecs], "vec_id long, embedding array<float>, shard int, v int")
    got = kdtree.top_k(df, 20, 64.0, 20, shard_rows=150, query_block=16).collect()
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in vecs if i is not None and v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in ok:
        if i % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:20]
            want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert kdtree.top_k(df.where("vec_id < 0")).collect() == []
    few = kdtree.top_k(df.where("vec_id in (0, 1, 2)")).collect()
    assert [(r.query_id, r.rank) for r in sorted(few)] == [(0, 1), (0, 2)]


# 3 language ID


def test_topk_of_large_components_and_lengths(spark):
    """Components beyond 2^26 are exact, those whose scores can't be held are refused; every length is searched by itself."""
    big = float(2**21)
    rows = [(0, [big, 1.0]), (1, [big, -1.0]), (2, [1.0, 1.0]), (20, [3.0]), (21, [5.0]), (22, [-5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in kdtree.top_k(df, 2).collect())
    assert got == [(0, 1, 1, (64 * 2**21) ** 2 - 64 * 64), (0, 2, 2, 64 * 64 * 2**21 + 64 * 64), (20, 1, 21, 64 * 64 * 15), (20, 2, 22, -64 * 64 * 15)]
    with pytest.raises(Exception, match="fit 64 bits"):
        kdtree.top_k(spark.createDataFrame([(0, [1e9, 1.0])], "vec_id long, embedding array<double>")).collect()


def test_suffix_automaton_accepts_substrings_only():
    r = random.Random(2)
    for _ in range(30):
        s = [r.randint(0, 3) for _ in range(30)]
        step = langid.suffix_automaton(s)

        def accepts(x, step=step):
            p = 0
            for c in x:
                p = step[p].get(c, -1)
                if p < 0:
                    return False
            return True

        subs = {tuple(s[i:j]) for i in range(31) for j in range(i, 31)}
        for _ in range(200):
            x = tuple(r.randint(0, 3) for _ in range(r.randint(0, 6)))
            assert accepts(x) == (x in subs)


def test_cross_parsing_phrases():
    samples = {"x": [text_of(1, 400)], "y": ["el perro come la casa azul con mucho sol " * 20]}
    p = langid.Parser(samples)
    texts = ["", "12 34", "The River!!  stone\nwindow", "perro azul", text_of(3, 900), "Ω日 the"]
    counts, n = p.phrases(texts)
    for k, lang in enumerate(sorted(samples)):
        sample = p.symbols(samples[lang][0]).tolist()[: langid.SAMPLE_SYMBOLS]
        joined = "".join(map(chr, [c + 1 for c in sample]))
        for i, t in enumerate(texts):
            s = "".join(chr(c + 1) for c in p.symbols(t).tolist())
            if not any(c != "\x01" for c in s):
                assert n[i] == 0 and counts[i, k] == 0
                continue
            phrases = 0
            for a in range(0, len(s), langid.SEGMENT):
                part, at = s[a : a + langid.SEGMENT], 0
                while at < len(part):
                    m = 1
                    while at + m <= len(part) and part[at : at + m] in joined:
                        m += 1
                    phrases += 1
                    at += max(1, m - 1)
            assert phrases == counts[i, k], (lang, t)


def test_language_id(spark, docs, empty):
    assert langid.identify(empty, langid.learn(empty)).collect() == []
    got = plain(langid.identify(docs, langid.learn(docs)).select("doc_id", "lang_pred", "score"))
    assert len(got) == len(table())
    by = dict((r[0], r[1:]) for r in got)
    assert by[0] == ("und", 0.0) and by[15] == ("und", 0.0) and by[25][0] == "en"
    none = langid.identify(docs, {}).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]
    kept = langid.keep_identified(docs, langid.learn(docs))
    assert kept.columns == docs.columns and kept.count() == sum(p != "und" for _, p, _ in got)


def test_no_label_is_lost(spark):
    """A label whose rows share an id, repeat, or are few beside another label's has a sample all the same."""
    for doc in (7, 11, 13, 17, 23):
        rows = [(doc, f"{text_of(k, 20)}", "one") for k in range(1_000)] + [(1, "el perro y la casa", "two")] * 1_000 + [(3, "la maison et le chat", "few")]
        got = langid.learn(spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2], "doc_id long, text string, lang string"))
        assert set(got) == {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2} and all(any(v) for v in got.values())


def test_many_labels_and_letters(spark, monkeypatch):
    """More labels than are learned: the most frequent ones; an alphabet too large for full tables parses alike."""
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    d = spark.createDataFrame([(ids[6 * k + j], f"text number {k}", f"l{k}") for k in range(6) for j in range(k + 1)], "doc_id long, text string, lang string")
    assert set(langid.learn(d)) == {"l3", "l4", "l5"}
    wide = {"han": ["".join(chr(0x4E00 + i * 7 % 5000) for i in range(3000))], "en": [text_of(1, 300)]}
    texts = ["".join(chr(0x4E00 + i) for i in range(0, 4000, 7)), text_of(5, 60), "日本語 and the river", "Ω"]
    full = langid.Parser(wide).phrases(texts)
    monkeypatch.setattr(langid, "MAX_PLACES", 0)
    listed = langid.Parser(wide).phrases(texts)
    assert (full[0] == listed[0]).all() and (full[1] == listed[1]).all()


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(d, langid.learn(d)).join(d.select("doc_id", "lang"), "doc_id").where(langid.held_out("doc_id"))
    n, right = out.count(), out.where("lang = lang_pred").count()
    assert n > 200 and right / n > 0.98


# 4 token counts


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(P.path("piece_bpe_32k.model"))


def test_counts_match_library(counter):
    r = random.Random(8)
    bits = ["a", "aa", "b", " ", "  ", "é", "the", "日", "\n", "1", "😀", "-", "--", "er", "tion", "▁", "<s>", "\t", "́", "=", "i", "n", "g"]
    for _ in range(1500):
        x = "".join(r.choice(bits) for _ in range(r.randint(0, 50)))
        n = len(counter.model.encode(x))
        assert counter.count(x) == n and counter.count(x, 5) == n, x
    long = "ab" * 60_000 + " tail"
    assert counter.count(long, 1 << 12) == len(counter.model.encode(long))


def test_state_maps_are_associative(counter):
    t = counter.transducer
    chunks = ["▁th", "e▁qu", "ick", "▁▁brown", "▁", "▁fox"]
    maps = [token_counts.StateMap.of(t, c) for c in chunks]
    whole = t.run(t.START, "".join(chunks))[1]
    left = maps[0]
    for m in maps[1:]:
        left = left.then(t, m)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = m.then(t, right)
    assert left.apply(t, t.START)[1] == right.apply(t, t.START)[1] == token_counts.prefix_scan(t, maps)[-1].apply(t, t.START)[1] == whole


def test_state_maps_without_spaces(counter):
    """Chunks without a synchronising point: maps hold no text of other chunks, and any entry state gives what running does."""
    t = counter.transducer
    r = random.Random(6)
    text = "".join(r.choice(["日本語", "東京", "ation", "er", "th", "の", "不", "é", "in"]) for _ in range(400))
    maps = [token_counts.StateMap.of(t, text[i : i + 37]) for i in range(0, len(text), 37)]
    scanned = token_counts.prefix_scan(t, maps)
    assert all(m.text == "" for m in scanned[1:]) and all(m.head < 0 for m in maps)
    for before in ("", "▁th", "▁inte", "東", "日"):
        entry, _ = t.run(t.START, before)
        for k, m in enumerate(scanned):
            assert m.apply(t, entry) == t.run(entry, text[: 37 * (k + 1)])


def test_long_text_without_spaces_takes_linear_memory(counter):
    import tracemalloc

    r = random.Random(2)
    kana = "".join(chr(r.randint(0x3041, 0x3096)) for _ in range(5_000))
    peaks = []
    for times in (20, 1_000):  # 0.1 M and 5 M characters
        text = kana * times
        tracemalloc.start()
        n = counter.count(text)
        peaks.append(tracemalloc.get_traced_memory()[1] - 4 * len(text))
        tracemalloc.stop()
        if times == 20:
            assert n == len(counter.model.encode(text))
    assert peaks[1] < peaks[0] + 100_000_000


def test_count_table_limits(monkeypatch):
    monkeypatch.setattr(token_counts, "TRANSITIONS", 50)
    monkeypatch.setattr(token_counts, "UNITS", 5)
    c = token_counts.Counter(P.path("piece_bpe_32k.model"))
    for k in range(20):
        x = text_of(k, 50)
        assert c.count(x, 64) == len(c.model.encode(x))


def test_token_counts(docs, empty, counter):
    got = plain(token_counts.token_counts(docs, P.path("piece_bpe_32k.model")))
    want = [(i, len((t or "").encode()), n := len(counter.model.encode(t or "")), n > 4096) for i, t, *_ in table()]
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(empty, P.path("piece_bpe_32k.model")).collect() == []


# 5 byte-level BPE


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    b = byte_bpe.ByteBPE(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return b, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})


def test_bpe_matches_library(tik):
    b, enc = tik
    r = random.Random(5)
    bits = ["a", "aa", "b", " ", "  ", "é", "the", "日", "\n", "1", "'s", "😀", "x", "\r\n", " "]
    for _ in range(1500):
        x = "".join(r.choice(bits) for _ in range(r.randint(0, 60)))
        assert np.frombuffer(b.encode(x), "<u4").tolist() == enc.encode_ordinary(x)
        assert b.decode(b.encode(x)) == x.encode()
    long = "ab" * 30_000 + "aaaa" * 10_000
    assert b.decode(b.encode(long)) == long.encode()
    assert np.frombuffer(b.encode("abc" * 700), "<u4").tolist() == enc.encode_ordinary("abc" * 700)


def test_bpe_long_text_and_full_table(tik, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK", 50)
    b, enc = tik
    monkeypatch.setattr(b, "limit", 7)
    x = text_of(3, 500)
    assert np.frombuffer(b.encode(x), "<u4").tolist() == enc.encode_ordinary(x)


def test_bpe_query(docs, empty, tik):
    _, enc = tik
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = plain(byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path, P.PATTERN)))
    want = []
    for i, t, *_ in table():
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert plain(byte_bpe.digests(byte_bpe.round_trip(docs, path, P.PATTERN))) == got
    assert byte_bpe.encode(empty, path, P.PATTERN).collect() == []


# 6 near duplicates


def sets_of(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(pairs):
    """pairs: (id, text). The smallest id reachable by links between texts."""
    classes = defaultdict(list)
    for i, t in pairs:
        classes[sets_of(t)].append(i)
    own = [s for s in classes if s]
    parent = {s: s for s in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            both = len(own[a] & own[b])
            if 100 * both >= 85 * (len(own[a]) + len(own[b]) - both):
                parent[find(own[a])] = find(own[b])
    least = defaultdict(lambda: None)
    for s in own:
        ids = [i for i in classes[s] if i is not None]
        if ids:
            r = find(s)
            least[r] = min([*ids, *([least[r]] if least[r] is not None else [])])
    return lambda i, t: least[find(sets_of(t))] if sets_of(t) else i


def test_near_duplicates(docs, empty):
    got = plain(minhash.near_duplicates(docs))
    of = brute_components([(i, t) for i, t, *_ in table()])
    want = [(i, len(sets_of(t)), c := of(i, t), i == c) for i, t, *_ in table()]
    assert got == sorted(want, key=repr)
    assert minhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("n_words", [40, 75, 150])
def test_near_duplicate_families(spark, monkeypatch, n_words):
    """Families round the threshold, in buckets small and large."""
    monkeypatch.setattr(minhash, "SMALL", 8)
    monkeypatch.setattr(minhash, "BLOCK", 32)
    r = random.Random(n_words)
    pairs = []
    for f in range(3):
        base = [f"w{f}x{r.randint(0, 10**9)}" for _ in range(n_words)]
        for _ in range(70):
            w = base.copy()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(n_words)] = f"e{r.randint(0, 10**9)}"
            pairs.append((len(pairs), " ".join(w)))
    r.shuffle(pairs)
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(pairs)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(df).collect()}
    of = brute_components([(i, t) for i, (_, t) in enumerate(pairs)])
    assert got == {i: of(i, t) for i, (_, t) in enumerate(pairs)}


def test_one_bucket_of_thousands(spark):
    """A family of 5,000 near copies, many just under the threshold, in the sizes that production uses."""
    r = np.random.default_rng(5)
    base = [f"base{i}" for i in range(60)]
    texts = []
    for _ in range(5_000):
        w = base.copy()
        for at in r.integers(0, 60, r.integers(1, 5)):
            w[at] = f"edit{r.integers(0, 40)}"
        texts.append(" ".join(w))
    order = r.permutation(len(texts))
    df = spark.createDataFrame([(int(i), texts[i]) for i in order], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(df).collect()}
    found = [sets_of(t) for t in texts]
    many = {g: k for k, g in enumerate(g for g, n in Counter(g for x in found for g in x).items() if n > 1)}
    m = np.zeros((len(texts), len(many)), np.float32)
    for i, x in enumerate(found):
        m[i, [many[g] for g in x if g in many]] = 1
    n = np.array([len(x) for x in found])
    want = np.arange(len(texts))
    edges = []
    for i in range(0, len(texts), 500):
        both = m[i : i + 500] @ m.T
        edges.append(np.argwhere(100 * both >= 85 * (n[i : i + 500, None] + n - both)) + [i, 0])
    a, b = np.concatenate(edges).T
    while True:
        new = want.copy()
        np.minimum.at(new, a, want[b])
        if (new == want).all():
            break
        want = new
    assert len(set(want.tolist())) > 100
    assert got == dict(enumerate(want.tolist()))


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    r = np.random.default_rng(3)
    a, b = ([np.unique(r.integers(0, 60, k).astype(np.uint64)) for k in r.integers(0, 40, 9)] for _ in range(2))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert minhash.shared_counts(a, b).tolist() == want


def test_agreement_follows_the_threshold():
    assert minhash.agree(85) == 48 and minhash.agree(80) == 42


def test_stage_takes_near_duplicates_from_080(spark):
    """40 words, one replaced 3 from the end: 33 of 39 shingles (0.846); two replaced: 0.80 is not reached."""
    from priorlens.llm import stages

    base = [f"w{i}" for i in range(40)]
    edited = lambda *at: " ".join("new" if i in at else w for i, w in enumerate(base))
    rows = [(1, edited(), "x"), (2, edited(37), "x"), (3, edited(10, 20), "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in stages.distinct_texts(d).collect()) == [1, 3]
    assert {r.doc_id for r in minhash.near_duplicates(d).where("kept").collect()} == {1, 2, 3}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (200, 201)]
    r = random.Random(1)
    r.shuffle(edges)
    got = {x.id: x.component for x in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 105: 100, 103: 100, 200: 200, 201: 200}


# 7 mixing


def test_water_filling():
    t = mixing.targets([10, 1000, 50], [1, 2, 3], 1060, 3)
    assert t == [30.0, 880.0, 150.0]
    assert mixing.targets([0, 5], [1, 2], 5, 3) == [0.0, 5.0]
    assert mixing.targets([], [], 0, 3) == []


def test_mix(docs, empty):
    got = mixing.curriculum(docs).collect()
    assert len(got) == len(table())
    assert plain(mixing.curriculum(docs)) == plain(mixing.curriculum(docs.repartition(3)))
    size, taken, largest, target = Counter(), Counter(), Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size == len(r.positions) * r.size
        assert all(0 <= p <= 1 for p in r.positions)
    assert dict(size) == {s: sum(len(WORD.findall(t or "")) for _, t, _, x in table() if x == s) for s in {x[3] for x in table()}}
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 or all(t >= 3 * size[s] - 1e-6 for s, t in target.items())
    names = sorted(s for s in size if s is not None) + [None]
    want = mixing.targets([size[s] for s in names], [1 + k % 3 for k in range(len(names))], sum(size.values()), 3)
    assert [target[s] for s in names] == pytest.approx(want)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    assert mixing.curriculum(empty).collect() == []


def test_schedule_positions(spark):
    """A source whose weight doubles half-way has a third of its words in the first half."""
    df = spark.createDataFrame([(i, "w " * 10, s) for s in "ab" for i in range(600)], "doc_id long, text string, source string")
    schedules = [[(0.0, 1.0), (0.5, 2.0)], [(0.0, 2.0), (0.5, 1.0)]]
    got = mixing.curriculum(df, lambda k: schedules[k]).collect()
    a = sorted(p for r in got if r.source == "a" for p in r.positions)
    assert len(a) == 600 and sum(p < 0.5 for p in a) == 200
    order = mixing.training_order(mixing.curriculum(df, lambda k: schedules[k]), 4).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and len(order) == 1200


def test_default_schedules_change_in_time(docs, spark):
    assert [mixing.integral(mixing.ramps(k)) for k in range(6)] == [1.0, 2.0, 3.0, 1.0, 2.0, 3.0]
    assert all(len({w for _, w in mixing.ramps(k)}) > 1 for k in range(6))
    df = spark.createDataFrame([(i, "w " * 10, s) for s in "ab" for i in range(400)], "doc_id long, text string, source string")
    mix = mixing.curriculum(df)
    early = Counter(r.source for r in mix.collect() for p in r.positions if p < 0.5)
    late = Counter(r.source for r in mix.collect() for p in r.positions if p >= 0.5)
    assert early["a"] * 2 < late["a"] and early["b"] > 2 * late["b"]
    for d in (mix, mixing.curriculum(docs)):
        out = mixing.training_ranks(d, 4).collect()
        assert len(out) == d.count()
        copies = sorted((p, j == 0, r.doc_id if r.doc_id is not None else -1) for r in d.collect() for j, p in enumerate(r.positions))
        ranks = [r.first_rank for r in out if r.first_rank is not None]
        assert ranks == sorted(ranks) and all(copies[r.first_rank - 1][0] == r.first_position == r.positions[0] for r in out if r.copies)
        assert all(r.first_rank is None for r in out if not r.copies) and len(set(ranks)) == len(ranks)
    assert mixing.training_ranks(mixing.curriculum(docs.limit(0)), 4).collect() == []


# 8 sharding


def test_sharding(docs, empty):
    got = sharding.interleave(docs, 8).collect()
    assert len(got) == len(table())
    key = lambda r: (r.doc_id, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, got), key=repr) == sorted(map(key, sharding.interleave(docs.repartition(2), 8).collect()), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in table()), key=repr)
    assert sorted(r.position for r in got) == list(range(len(got)))
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s, n in Counter(r.source for r in got).items():
        for k in range(8):
            assert abs(sum(r.source == s and r.shard == k for r in got) - n / 8) <= 2
    assert sharding.interleave(empty, 8).collect() == []


def test_fewer_rows_than_shards(docs):
    got = sharding.interleave(docs.where("doc_id in (1, 2, 3)"), 8).collect()
    assert sorted(r.slot for r in got) == [0, 0, 0] and len({r.shard for r in got}) == 3


# 9 preference pairs


def test_preference_format(spark):
    t = lambda *x: [{"role": r, "text": s} for r, s in x]
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("assistant", "")
    pairs = [(1, t(a, b), t(a, c)), (2, t(a, b), t(a, b)), (3, t(a), t(a, b)), (4, [], t(b)), (5, None, None), (6, t(b), t(a))]
    df = spark.createDataFrame(pairs, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r.pair_id: r for r in preference.preference_format(df).collect()}
    ren = lambda *x: "".join(f"<|{r}|>\n{s}\n<|end|>\n" for r, s in x)
    assert (got[1].prefix_turns, got[1].prompt, got[1].chosen, got[1].rejected) == (1, ren(a), ren(b), ren(c))
    assert [(s.text, s.loss) for s in got[1].chosen_segments] == [("<|assistant|>\n", 0), ("hello\n<|end|>\n", 1)]
    assert got[2].identical and got[2].prefix_turns == 2 and got[2].chosen == got[2].rejected == ""
    assert (got[3].prefix_turns, got[3].chosen, got[3].rejected) == (1, "", ren(b))
    assert (got[4].prefix_turns, got[4].prompt, got[4].chosen) == (0, "", "")
    assert got[5].identical and got[5].prompt == ""
    assert [s.loss for s in got[6].rejected_segments] == [0, 0] and got[6].prefix_turns == 0
    for r in got.values():
        assert "".join(s.text for s in r.chosen_segments) == r.chosen and "".join(s.text for s in r.rejected_segments) == r.rejected


def test_swapped_replies(spark):
    """Pairs part at varied turns; every conversation with a reply has one."""
    r = random.Random(3)
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "x"), (0, 2, "user", "tail"), (1, 1, "assistant", None), (1, 0, None, "q"), (2, 0, "user", "alone"), (None, 0, "user", "?"), (4, None, "assistant", "n"), (5, 0, "assistant", "n"), (5, 0, "assistant", "n")]
    turns += [(c, k, ("user", "assistant")[k % 2], f"{c} {k}") for c in range(10, 70) for k in range(r.randint(1, 11))]
    df = spark.createDataFrame([(*x, 1) for x in turns], "conv_id long, turn long, role string, text string, turns int")
    got = {r.pair_id: r for r in preference.preference_format(preference.swapped_replies(df.repartition(3))).collect()}
    by = defaultdict(list)
    for c, k, role, text, in turns:
        if c is not None:
            by[c].append((-1 if k is None else k, role or "", text or ""))
    by = {c: [x[1:] for x in sorted(v)] for c, v in by.items() if any(x[1] == "assistant" for x in v)}
    order = sorted(by, key=lambda c: (hashlib.md5(f"41:{c}".encode()).hexdigest(), c))
    ren = lambda x: "".join(f"<|{r}|>\n{s}\n<|end|>\n" for r, s in x)
    parted = set()
    assert set(got) == set(by)
    for i, c in enumerate(order):
        other = by[order[(i + 1) % len(order)]]
        at = [k for k, x in enumerate(by[c]) if x[0] == "assistant"]
        k = at[int(int(hashlib.md5(f"41:at:{c}".encode()).hexdigest()[:8], 16) / 2**32 * len(at))]
        chosen, rejected = by[c][: at[-1] + 1], [*by[c][:k], [x for x in other if x[0] == "assistant"][-1]]
        n = next((j for j, (a, b) in enumerate(zip(chosen, rejected)) if a != b), min(len(chosen), len(rejected)))
        x = got[c]
        assert (x.prefix_turns, x.prompt, x.chosen, x.rejected, x.identical) == (n, ren(chosen[:n]), ren(chosen[n:]), ren(rejected[n:]), chosen == rejected)
        parted.add((n < len(chosen) - 1, n))
    assert len(parted) > 6
    only = preference.preference_format(preference.swapped_replies(df.where("conv_id = 10 or conv_id = 2"))).collect()
    assert all(x.rejected == "" for x in only)
    assert preference.swapped_replies(df.where("conv_id > 99")).collect() == []


# 10 bit planes


@pytest.mark.parametrize("bits", [True, False])
def test_planes_round_trip(bits):
    r = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 1000):
        for top in (2, 50_000, 2**32 - 1):
            ids = r.integers(0, top, n).astype("<u4")
            assert (bitplane.unplanes(bitplane.planes(ids, bits), n, bits) == ids).all()


@pytest.mark.parametrize("bits", [True, False])
def test_bitplane_files(docs, empty, bits, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    manifest = bitplane.write_ids(docs, P.path("word_bpe_49k.json"), 2, f"file://{tmp_path}/ids", bits=bits, block=512)
    got = bitplane.read_ids(manifest).orderBy("start").collect()
    ids = [(i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t, *_ in table()]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [(r.doc_id, bytes(r.ids)) for r in got] == ids
    assert [r.start for r in got] == [sum(len(x) // 4 for _, x in ids[:k]) for k in range(len(ids))]
    none = bitplane.write_ids(empty, P.path("word_bpe_49k.json"), 2)
    assert none.count() == 0 and bitplane.read_ids(none).collect() == []


def test_bitplane_ids_of_other_types(docs, monkeypatch):
    monkeypatch.setattr(bitplane, "KNOWN_BYTES", 60_000)
    named = docs.select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    manifest = bitplane.write_ids(named, P.path("word_bpe_49k.json"), 2, files=6)
    got = bitplane.read_ids(manifest, "string").orderBy("start").collect()
    assert manifest.count() > 3 and [r.doc_id for r in got] == sorted((r.doc_id for r in named.collect()), key=lambda x: (x is not None, x or ""))
    dates = docs.select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int")).alias("doc_id"), "text")
    assert plain(bitplane.read_ids(bitplane.write_ids(dates, P.path("word_bpe_49k.json"), 2), "date").select("doc_id")) == plain(dates.select("doc_id"))


def test_broken_file_is_refused(tmp_path):
    (tmp_path / "x").write_bytes(b"BITPLANE" + bytes(40))
    with pytest.raises(ValueError, match="not a whole"):
        list(bitplane.read_file(f"file://{tmp_path}/x"))


def test_small_sources_are_spread(spark):
    """Sources of one row each don't all have the same fraction."""
    got = sharding.interleave(spark.createDataFrame([(i, "x", f"s{i}") for i in range(400)], "doc_id long, text string, source string"), 8).collect()
    assert len({r.fraction for r in got}) > 390 and Counter(r.shard for r in got) == Counter({k: 50 for k in range(8)})


def test_long_pre_tokens_are_not_kept(tik):
    b, enc = tik
    own = byte_bpe.ByteBPE(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, 100_000)
    texts = [text_of(1, 50), "x" * 5000 + " y", "ab" * 3000, "日本" * 2000, text_of(2, 30_000), "", None, "ab" * 3000]
    for _ in range(2):
        got = own.encode_all(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [enc.encode_ordinary(t or "") for t in texts]
        assert own.held <= 100_000 and all(len(p) <= byte_bpe.LONG for p in own.known)


def test_identified_takes_the_predicted_label(docs, empty):
    from priorlens.llm import stages

    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("lang")))
    out = stages.identified(wrong)
    samples = langid.learn(wrong)
    pred = {(r.doc_id, r.lang_pred) for r in langid.identify(wrong, samples).collect() if r.lang_pred != "und"}
    assert out.columns == docs.columns and {(r.doc_id, r.lang) for r in out.collect()} == pred
    assert stages.identified(empty).collect() == []


def test_encoded_stage(docs, empty, tmp_path, tik):
    """The rank follows the files; without files there is none."""
    from priorlens.llm import stages

    _, enc = tik
    path = P.path("byte_bpe_multi_50k.tiktoken")
    d = docs.withColumn("training_rank", F.lit(5))
    d.repartition(3).write.parquet(f"file:{tmp_path}/docs")
    back = docs.sparkSession.read.parquet(f"file:{tmp_path}/docs")
    out = stages.encoded(back, path, P.PATTERN).collect()
    assert sorted(r.training_rank for r in out) == list(range(len(table())))
    files = sorted((tmp_path / "docs").glob("*.parquet"))
    import pyarrow.parquet as pq

    order = [t for f in files for t in pq.read_table(f)["text"].to_pylist()]
    for r in out:
        ids = np.array(enc.encode_ordinary(order[r.training_rank] or ""), "<u4")
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and r.n_tokens == len(ids)
    assert {r.training_rank for r in stages.encoded(d, path, P.PATTERN).collect()} == {None}
    assert stages.encoded(empty, path, P.PATTERN).collect() == []


def test_pipeline_against_brute_force(spark, tik, tmp_path):
    """run() over written tables, step by step in plain Python."""
    import corpus_pipeline

    _, enc = tik
    rows = [(*r[:4], 1) for r in rows_of_pipeline()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"file:{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file:{tmp_path}").collect()
    docs = spark.read.parquet(f"file:{tmp_path}/documents.parquet")
    samples = langid.learn(docs)
    pred = langid.Parser(samples).predict([r[1] for r in rows])[0]
    left = [(r[0], r[1], p, r[3]) for r, p in zip(rows, pred, strict=True) if p != "und"]
    assert {r[1] for r in rows} - {r[1] for r in left}
    judged = quality.divergence_rules(spark.createDataFrame(left, "doc_id long, text string, lang string, source string"), base_words=1)
    kept = {r.doc_id for r in judged.where("kept").collect()}
    repeats = {i for i, t, *_ in left if 100 * brute_base(t)[4] > 50 * len(WORD.findall(t))}
    assert repeats and not kept & repeats and {i for i, t, *_ in left if 0 < len(WORD.findall(t)) <= 20} - repeats <= kept
    left = [r for r in left if r[0] in kept]
    found = {i: sets_of(t) for i, t, *_ in left}
    seen = sorted(found)
    group = {i: i for i in seen}
    for a in seen:
        for b in seen:
            both = len(found[a] & found[b])
            if a < b and 100 * both >= 80 * (len(found[a]) + len(found[b]) - both):
                lo, hi = sorted((group[a], group[b]))
                group = {k: lo if v == hi else v for k, v in group.items()}
    left = [r for r in left if group[r[0]] == r[0]]
    assert len(left) < len(seen)
    mix = mixing.curriculum(spark.createDataFrame(left, "doc_id long, text string, lang string, source string")).collect()
    copies = sorted((p, r.doc_id) for r in mix for p in r.positions)
    of = {i: t for i, t, *_ in left}
    got = sorted((r.training_rank, r.doc_id, r.n_tokens, r.ids_sha256) for r in out)
    assert [x[0] for x in got] == list(range(len(copies))) and [x[1] for x in got] == [i for _, i in copies]
    for _, i, n, digest in got:
        ids = np.array(enc.encode_ordinary(of[i]), "<u4")
        assert (n, digest) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())


def rows_of_pipeline():
    r = random.Random(4)
    out = []
    for k in range(90):
        words = text_of(k, 80 + k).split()
        out.append((len(out), " ".join(words), "en" if k % 5 else None, f"s{k % 4}"))
        if k % 9 == 0:
            words[r.randrange(10, 60)] = "edited"
            out.append((len(out), " ".join(words), "en", f"s{(k + 1) % 4}"))
        if k % 10 == 0:
            out.append((len(out), text_of(k, 20), "en", "s1"))
            out.append((len(out), "a b c " * 80, "en", "s1"))
            out.append((len(out), "1234 5678 " * 40, "en", None))
    return out + [(len(out), None, "en", "s1"), (len(out) + 1, "", None, None)]


def test_stage_filters_keep_columns(docs):
    from priorlens.llm import stages

    d = docs.select("doc_id", "text", "lang", "source", F.col("n_words").alias("n_chars"), "key", "_h")
    fit = stages.fit(d)
    assert fit.columns == d.columns
    judged = quality.divergence_rules(d, base_words=stages.SHORTEST)
    assert fit.count() == judged.where("kept").count()
    one = stages.distinct_texts(d)
    of = brute_components([(i, t) for i, t, *_ in table()])
    want = {(i, t) for i, t, *_ in table() if i == of(i, t)}
    got = [(r.doc_id, r.text) for r in one.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and one.columns == d.columns
    mix = stages.mixed(d)
    assert mix.columns == d.columns
    copies = Counter()
    for r in mixing.curriculum(d, with_hash=True).collect():
        copies[r.doc_id, r.text_hash] += r.copies
    got = Counter((r.doc_id, r.h) for r in mix.withColumn("h", F.xxhash64("text")).collect())
    assert got == Counter({k: v for k, v in copies.items() if v})
