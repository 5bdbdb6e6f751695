"""The dealt operators' own parts against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palaver.llm import jaccard, language, mixing, packing, pii, simhash, token_counts, topk, toxicity, url_filter
from palaver.llm.common import tokenizer_path


# -- 1: fingerprints

def test_fingerprint_is_the_majority_of_term_hashes(spark):
    texts = [(1, "one two three four five six two three four five six"), (2, "Short text"), (3, "... !"), (4, "a " * 300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", simhash.words_of(F.col("text")).alias("w"))
              .select("doc_id", simhash.term_hashes("w").alias("h")).collect()}
    for r in simhash.fingerprints(docs, buckets=2).collect():
        hs = [h % 2 ** 64 for h in hashes[r.doc_id]]
        want = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))
        assert r.fp % 2 ** 64 == want
    assert len(hashes[1]) == 7 and len(hashes[2]) == 1 and hashes[3] == []


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_next_document_over_range_borders(spark, buckets):
    rng = random.Random(buckets)
    ids = [rng.randrange(-50, 2 ** 60) for _ in range(60)] + [7, 7, None, None]
    rows = [(i, f"text {n}") for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.beside_next(docs, buckets).where("extra = 0").collect()
    assert len(got) == len(rows)
    follow = {r.text: r.next_text for r in got}
    at, seen = max((i, t) for i, t in rows if i is not None)[1], []
    while at not in seen:
        seen.append(at)
        at = follow[at]
    assert len(seen) == len(rows) and at == seen[0]  # one ring through all rows
    order = [dict((t, i) for i, t in rows)[t] for t in seen]
    known = [i for i in order if i is not None]
    assert known == sorted(known, reverse=True) and order[len(known):] == [None, None]


@pytest.mark.parametrize("chunk", [2, 256])
def test_neighbours_equal_brute_force(spark, chunk):
    rng = random.Random(4)
    fps = {0, (1 << 64) - 1}
    while len(fps) < 60:
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(3):
            g = f
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r.fp: r.n_near for r in simhash.neighbours(
        spark.createDataFrame([(f,) for f in signed * 2], "fp long"), radius=3, chunk=chunk).collect()}
    for f in signed:
        want = sum(1 for g in signed if g != f and bin((f ^ g) % (1 << 64)).count("1") <= 3)
        assert got.get(f, 0) == want


@pytest.mark.parametrize("chunk", [3])
def test_links_and_classes_equal_brute_force(spark, chunk):
    rng = random.Random(6)
    fps = set()
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 4, 12])):  # chains, whose ends are far apart
            fps.add(f)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                f ^= 1 << b
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = {(f, g) for f, g in itertools.combinations(signed, 2) if bin((f ^ g) % (1 << 64)).count("1") <= 3}
    df = spark.createDataFrame([(f,) for f in signed * 2], "fp long")
    got = [tuple(r) for r in simhash.links(df, chunk=chunk).collect()]
    assert len(got) == len(want) and set(got) == want
    root = {f: f for f in signed}
    for f, g in want:
        low, high = sorted((root[f], root[g]))
        root = {x: low if r == high else r for x, r in root.items()}
    found = simhash.classes(simhash.stored(simhash.neighbours(df, chunk=chunk), "near"), chunk=chunk).collect()
    linked = {x for pair in want for x in pair}
    assert {r.fp: r.class_fp for r in found} == {f: root[f] for f in linked} and len(found) == len(linked)


def test_copies_are_counted_and_share_a_class(spark):
    base = " ".join(f"w{i}" for i in range(3000))
    rows = [(i, base) for i in range(20)] + [(50, base + " tail"), (60, "a text of its own"), (70, None), (71, "")]
    got = {r.doc_id: r for r in simhash.near_documents(
        spark.createDataFrame(rows, "doc_id long, text string"), radius=3).collect()}
    equal = int(got[50].fp == got[0].fp)
    assert [got[i].n_same for i in (0, 19, 50, 60, 70)] == [19 + equal, 19 + equal, 20 * equal, 0, 1]
    assert len({got[i].class_fp for i in (*range(20), 50)}) == 1 and got[60].class_fp == got[60].fp
    assert bin((got[0].fp ^ got[50].fp) % 2 ** 64).count("1") <= 3 and got[70].class_fp == got[71].class_fp


# -- 2: packing

@given(st.integers(1, 20_000))
def test_cuts_are_the_binary_digits(n):
    cut = packing.cuts(n, 2048)
    assert [s for s, _ in cut] == list(itertools.accumulate([0] + [c for _, c in cut[:-1]]))
    assert sum(c for _, c in cut) == n
    assert sum(1 for _, c in cut if c == 2048) == n // 2048
    assert all(c & (c - 1) == 0 for _, c in cut) and len(cut) == n // 2048 + bin(n % 2048).count("1")


def test_chunks_encode_like_the_tokenizer():
    from array import array

    from tokenizers import Tokenizer
    path = tokenizer_path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), packing.ChunkEncoder(path)
    texts = ["", "  ", "a\tb c", "it's We'LL don'T O'er _x_ 12_3 é ŉ", "<|endoftext|> x<|startoftext|>y", "a é́ ΣΑΣ İI",
             "日本語 text…—“q”", "x\r\ny\n\n z", "😀👍🏽a", "ªº²µ¼ ß ŒÆ ǅ ƻ", "LA!! SE!!\nQUE,!!"]
    want = [array("I", e.ids).tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want and enc.encode(texts) == want


# -- 3: URL filters

def glob_regex(glob):
    out = ""
    for piece in re.split(r"(\*\*|\*|\?)", glob):
        out += {"**": "(?s:.*)", "*": "[^/]*", "?": "(?s:.)"}.get(piece, re.escape(piece))
    return re.compile(out)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text("ab/*?é", max_size=30), min_size=1, max_size=12),
       st.lists(st.text("ab/é.x", max_size=20), min_size=1, max_size=8))
def test_automaton_equals_regular_expressions(globs, texts):
    fits = url_filter.GlobAutomaton(globs).fits(texts)
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert fits[i, j] == (glob_regex(g).fullmatch(t) is not None), (g, t)


def test_many_rules_take_several_words():
    globs = [f"*.host{i}.example/path{i}/**" for i in range(100)]
    a = url_filter.GlobAutomaton(globs)
    assert a.words > 30
    fits = a.fits([f".x.host{i}.example/path{i}/y" for i in range(100)])
    assert (fits == np.eye(100, dtype=bool)).all()


# -- 4: personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(s):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c))
               for i, c in enumerate(reversed(s))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            n = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == "card" and 12 <= len(n) <= 19 and plain_luhn(n)
                    or kind == "phone" and 9 <= len(n) <= 15):
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_python_matching(spark):
    rng = random.Random(11)
    parts = ["a@b.c", "x@y", "@", ".", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "000.01.1.255", " ", "-", "+", "(", ")",
             "4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "0", "7", "+49 30 1234567", "é", "😀",
             "\n", "m.n@o.p_q@r.st", "12345678901234567890", "+1 (212) 555-0100", "@mail.x.", "a%+-@-.-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    texts += ["1 " * 9000, "7" * 30_000, "a@" + "b." * 8000 + "c", "x" * 60_000, "1." * 20_000, "+1" * 9000, "a." * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    for r in docs.select("i", pii.base_spans(F.col("t")).alias("s")).collect():
        assert [(x.s, x.e, x.k) for x in r.s] == plain_spans(texts[r.i]), texts[r.i][:200]


def test_estimate_tells_good_labelers_from_bad():
    rng = random.Random(3)
    truth, counts = {}, {}
    for _ in range(4000):
        y = rng.random() < 0.6
        right = [0.95, 0.9, 0.55]
        p = tuple((1 if y else -1) if rng.random() < r else (-1 if y else 1) for r in right)
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(y)
    post = pii.estimate(counts)
    assert all(abs(post[p] - sum(t) / len(t)) < 0.15 for p, t in truth.items() if len(t) > 100)
    assert pii.estimate({}) == {}


def test_added_spans_and_what_stays_clean(spark):
    rows = [(1, "call +1 (212) 555-0100 4111111111111111 now"), (2, "write to jane.roe [at] mail [dot] org please"),
            (3, "serial 4111111111111112 and version 1.2.3.400"), (4, "nothing 2024-01-02 here 12:30")] \
        + [(10 + i, f"mail u{i}@mail.example.com, 8.8.{i}.1; 4111111111111111; +1 (212) 555-01{i:02d}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    got = {r.doc_id: r.spans for r in pii.find(docs, model).collect()}
    assert got[1] == "phone:5:22,card:23:39"
    assert got[2].startswith("email:9:")
    assert got[3] == "" and got[4] == ""
    text = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert text[1] == "call <phone> <card> now" and text[4] == rows[3][1]


# -- 5: language

def test_centroids_and_rejection(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = language.fit(docs, F.lit(True), per_language=8, clusters=2)
    assert set(model.languages) == {"de", "en"} and len(model.centroids) <= 4
    assert np.allclose((model.centroids ** 2).sum(axis=1), 1, atol=1e-4)
    assert model.predict("виктор быстро едет домой через лес")[2]
    assert not model.predict("many people walk to the house by the river")[2]
    assert model.predict(None) == model.predict("123") == ("und", 0.0, True)
    again = language.fit(docs, F.lit(True), per_language=8, clusters=2)
    assert again.languages == model.languages and np.allclose(again.centroids, model.centroids)


def test_junk_is_rejected_at_every_length(spark):
    rng = random.Random(21)
    syllables = {"aa": ["the", "an", "or", "in", "he", "er", "nd"], "bb": ["ich", "un", "sch", "ge", "ver", "te", "au"]}

    def prose(lang, n):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(n))

    rows = [(i, prose(lang, rng.choice([5, 20, 100, 400])), lang) for i in range(160) for lang in ("aa", "bb")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    letters = {"cyrillic": range(0x430, 0x450), "greek": range(0x3B1, 0x3CA), "arabic": range(0x627, 0x64B),
               "han": range(0x4E00, 0x5200), "kana": range(0x3042, 0x3094), "hangul": range(0xAC00, 0xB000),
               "latin": range(97, 123)}
    for name, codes in letters.items():
        for n in (10, 200, 2000):
            text = " ".join("".join(map(chr, rng.choices(codes, k=rng.randrange(2, 9)))) for _ in range(n))
            assert model.predict(text)[2], (name, n)
    for lang in syllables:
        for n in (3, 10, 200, 2000):
            kept = [model.predict(prose(lang, n)) for _ in range(20)]
            assert {p[0] for p in kept} == {lang} and sum(p[2] for p in kept) <= 1, (lang, n)


# -- 6: top-k

@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10 ** 6), st.integers(1, 40), st.integers(1, 30), st.sampled_from([3, 300, 2 ** 40]))
def test_search_block_equals_brute_force(seed, n, dims, span):
    rng = random.Random(seed)
    vecs = [[float(rng.randrange(-span, span)) for _ in range(rng.choice([dims, dims, max(0, dims - 2)]))] for _ in range(n)]
    ids = [rng.randrange(20) for _ in range(n)]
    q_ids, q_rows = [ids[0], 99], [vecs[0], [1.0] * dims]
    got = list(topk.search_block(q_ids, q_rows, ids, vecs, 3, 4))
    for q, v in zip(q_ids, q_rows):
        clip = lambda s: min(max(s, -topk.MOST), topk.MOST)
        want = sorted((-clip(sum(int(a) * int(b) for a, b in zip(v, w))), i) for i, w in zip(ids, vecs) if i != q)[:3]
        assert [(s, i) for x, i, s in got if x == q] == [(-s, i) for s, i in want]


def test_components_are_floored(spark):
    rows = [(1, [-1e-20, 0.3, -0.3, 1e300, -0.0, 0.99999])]
    got = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).first().v
    assert got == [-1.0, 76.0, -77.0, 256e300, 0.0, 255.0]


def test_blocks_cover_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(20)]) for i in range(200)] + [(1000 + i, [0.5] * 20) for i in range(80)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.where("id % 10 = 0"), 4, query_rows=7,
                                              candidate_rows=16, dim_block=6).collect())
    q = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for i in (i for i in q if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:4]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)


# -- 7: n-gram Jaccard join

def plain_shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    k = min(5, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


@pytest.mark.parametrize("chunk", [4, 1024])
def test_links_and_groups_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rng = random.Random(chunk)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += ["short one", "Short, one!", "other", "", None, "!!!", "!!!"]
    rows = list(enumerate(texts))
    sets = {i: plain_shingles(t) for i, t in rows}
    like = lambda a, b: sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    got = {r.doc_id: r for r in jaccard.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    root = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)
    raw = dict(rows)
    for a, b in itertools.combinations(sets, 2):
        if like(a, b) or (not sets[a] and raw[a] and raw[a] == raw[b]):
            links[a] += 1
            links[b] += 1
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    assert {i: got[i].n_links for i in sets} == links
    assert {i: got[i].class_id for i in sets} == root


def test_pruning_keeps_what_can_reach_the_threshold():
    need = jaccard.least_matches(0.8, 1e-4)
    assert len(need) == jaccard.HASHES // jaccard.STEP and need == sorted(need)
    assert all(m < 0.8 * n for m, n in zip(need, range(16, 129, 16)))


def test_minhash_estimates_jaccard():
    a = jaccard.shingles(jaccard.word_hashes(" ".join(f"w{i}" for i in range(1000))))
    b = jaccard.shingles(jaccard.word_hashes(" ".join(f"w{i}" for i in range(100, 1100))))
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((jaccard.minhash(a) == jaccard.minhash(b)).mean() - exact) < 0.13


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 130)] + [(200, 201)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[201] == 200


def test_keep_one_keeps_every_empty_text(spark):
    rows = [(1, "one two three"), (1, "one two three"), (2, "one two three"), (3, None), (3, None), (3, ""),
            (None, None), (None, None), (4, "!!"), (4, "!!")]
    got = [tuple(r) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([rows[0], *rows[3:9]], key=str)


# -- 8: mixing

def test_targets_reshare_the_excess():
    t = mixing.targets([10, 1000, 500], [3, 1, 2])
    assert t[0] == 20 and abs(sum(t) - 1.5 * 1510) < 1e-9 and abs(t[2] - 1000) < 1e-9
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [3, 1]) == [0, 0]


@settings(deadline=None, max_examples=40)
@given(st.integers(0, 10 ** 6))
def test_flow_is_cheapest_and_largest(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 4)
    keys = [k for r in range(1, n + 1) for k in itertools.combinations(range(n), r) if rng.random() < 0.7][:3]
    patterns = {k: rng.randrange(0, 4) for k in keys}
    quotas = [rng.randrange(0, 6) for _ in range(n)]
    got = mixing.route(patterns, quotas)
    best = None
    for take in itertools.product(*[range(2 * patterns[k] + 1) for k in keys]):
        # feasible if the words can be dealt to the sources (Hall's condition on sets of patterns)
        if all(sum(t for t, k in zip(take, keys) if set(k) <= set(s)) <= sum(quotas[i] for i in s)
               for r in range(1, n + 1) for s in itertools.combinations(range(n), r)):
            cost = sum(max(0, t - patterns[k]) for t, k in zip(take, keys))
            best = max(best or (-1, 0), (sum(take), -cost))
    if keys:
        cost = sum(max(0, got[k] - patterns[k]) for k in keys)
        assert (sum(got.values()), -cost) == best
    assert all(got[k] <= 2 * patterns[k] for k in keys)


def test_overlapping_sources_and_repeated_rows(spark):
    rows = [(i, "w " * (1 + i % 9), ["a"] if i % 3 else ["a", "b"]) for i in range(300)] + [(999, None, ["b"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    mixed = mixing.mix(docs, F.col("sources"), buckets=16).collect()
    assert len(mixed) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in mixed)
    total = sum(r["size"] for r in mixed)
    in_b = sum(r["size"] for r in mixed if "b" in r.sources)
    goal = mixing.targets([total, in_b], [3, 1])
    assert abs(sum(r.taken for r in mixed) - min(sum(map(round, goal)), 2 * total)) <= 1
    copies = {r.doc_id: r.copies for r in mixed}
    again = mixing.repeat_rows(docs, F.col("sources"), buckets=16).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in again} == {i: c for i, c in copies.items() if c}


# -- 9: token counts

def test_only_new_texts_are_encoded(spark, tmp_path):
    model, cache = tokenizer_path("piece_bpe_32k.model"), f"{tmp_path}/cache"
    first = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in token_counts.count_tokens(first, model, cache, limit=1).collect()) \
        == [(1, 7, 2, True), (2, 7, 2, True), (3, 0, 0, False)]
    assert spark.read.parquet(cache).count() == 2
    more = spark.createDataFrame([(1, "one two"), (4, "three"), (4, "three")], "doc_id long, text string")
    got = token_counts.count_tokens(more, model, cache)
    assert got.count() == 3 and spark.read.parquet(cache).count() == 3
    other = token_counts.count_tokens(more, tokenizer_path("byte_bpe_50k.json"), cache)
    assert other.count() == 3 and spark.read.parquet(cache).count() == 5


# -- 10: toxicity

def plain_kernel(s, t):
    total = 0.0
    for a in itertools.combinations(range(len(s)), toxicity.ORDER):
        for b in itertools.combinations(range(len(t)), toxicity.ORDER):
            if [s[i] for i in a] == [t[i] for i in b]:
                total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_equals_its_definition():
    words, marks = ["idiot", "i.diot", "clown", "abcab", "idi"], ["idiot", "clowns", "aaaa"]
    space = toxicity.Subsequences("".join(marks))
    got = toxicity.kernel(words, marks, space)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            norm = math.sqrt(plain_kernel(w, w) * plain_kernel(m, m))
            assert got[i, j] == pytest.approx(plain_kernel(w, m) / norm if norm else 0, abs=1e-5)


def test_finds_insults_also_when_hidden(spark):
    rng = random.Random(8)
    syllables = ["the", "an", "or", "in", "he", "er", "nd", "on", "th", "es", "re", "ti", "ha", "to"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    insults = ["idiot", "moron", "clown", "scumbag"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = [word() for _ in range(rng.randrange(5, 80))]
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(insults))
        rows.append((i, " ".join(text) + "."))
        labels.append((i, int(toxic)))
    hidden = ["th or i.d-iot he", "an in mo*ron re", "er c l o w n nd", "th Idiot! he", "er on scum-bag"]
    rows += [(1000 + i, t) for i, t in enumerate(hidden)] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, y in labels if i % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(y) for i, y in held) >= 0.97 * len(held)
    assert sum(got[1000 + i] >= 0.5 for i in range(len(hidden))) >= 4
    assert got[2000] == got[2001] == 0.0


def plain_features(word):
    """Every subsequence's weight, for words of any length."""
    out = {}
    for first in range(len(word)):
        for rest in itertools.combinations(range(first + 1, min(len(word), first + toxicity.REACH)), toxicity.ORDER - 1):
            u = "".join(word[i] for i in (first, *rest))
            out[u] = out.get(u, 0) + toxicity.DECAY ** (rest[-1] - first + 1)
    return out


HARD_WORDS = ["idiot", "^bad", "abc", "ab", "banana" * 9, "i----d----i----o----t" * 2, "привет", "^прив-ет", "x" * 60,
              "".join(chr(0x4E00 + 7 * i) for i in range(40)), "^" + "ha" * 25 + "idiot", "abcdefghijklmnopqrstuvwxyz"]


@pytest.mark.parametrize("letters", ["", "".join(chr(0x4E00 + i) for i in range(300))])
def test_decision_is_the_sum_over_landmarks(letters):
    marks = ["idiot", "^bad", "привет", "banana", "".join(chr(0x4E00 + 7 * i) for i in range(12)), "aaaaaaa", "z" * 30]
    a = np.array([0.5, -1.25, 2.0, 0.75, 1.5, -0.5, 0.25])
    space = toxicity.Subsequences("".join(marks) + letters)
    table = toxicity.landmark_weights(marks, a, space)
    model = toxicity.Model(toxicity.space_letters(marks + [letters]), table, 0.125)
    got = model.decide(HARD_WORDS)
    for word, value in zip(HARD_WORDS, got):
        f, want = plain_features(word), 0.125
        norm = math.sqrt(sum(x * x for x in f.values()))
        for m, weight in zip(marks, a):
            g = plain_features(m)
            want += weight * sum(f.get(u, 0) * x for u, x in g.items()) / math.sqrt(sum(x * x for x in g.values())) / norm if norm else 0
        assert value == pytest.approx(want, abs=1e-9)
    # what is sent has one number per weighted subsequence, whatever the alphabet
    assert len(table.ids) <= len(marks) * math.comb(30, toxicity.ORDER)
    assert (table.dense is None) == bool(letters)


def test_insults_of_any_length_script_and_stretch():
    insults = ["idiot", "ass", "дурак", "βλάκας"]
    clean = ["".join(p) for p in itertools.product(["the", "an", "or", "in", "дом", "мир", "και"], repeat=2)] + ["class", "assist", "мука"]
    bags = [{w for w in toxicity.words_of(insults[i % 4])} | set(toxicity.words_of(clean[i % len(clean)])) for i in range(80)]
    counts = {w: 20 for c in clean for w in toxicity.words_of(c)}
    model = toxicity.learn_words(bags, counts, 400)
    best = lambda chunk: float(max(model.decide(toxicity.words_of(chunk))))
    hidden = ["idiot", "ass", "дурак", "βλάκας", "i" + "." * 12 + "d" + "-" * 12 + "i" + "*" * 12 + "o" + "_" * 12 + "t", "д.у.р.а.к"]
    assert min(map(best, hidden)) > max(best(c) for c in clean)


def test_labels_are_sampled_by_smallest_hash(spark):
    labels = spark.range(5000).selectExpr("id AS doc_id", "cast(id % 10 = 0 AS int) AS toxic")
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    docs = docs.unionAll(docs.filter("doc_id < 50"))  # repeated ids
    got = toxicity.sample_labelled(docs, labels, F.lit(True), 30).collect()
    order = [(r.doc_id, r.toxic) for r in labels.withColumn(
        "h", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40))).orderBy("h").collect()]
    want = [(t, f"text {i}") for y in (0, 1) for i, t in [r for r in order if r[1] == y][:30]]
    assert sorted((r.toxic, r.text) for r in got) == sorted(want)
