"""License scan, divergence audit and vector codes against brute force, and their queries on hard rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks.compare import _rows, type_differences
from palaver.llm import divergence, license_rules, license_scan, vector_codes
from palaver.llm.oracle import ORACLE
from palaver.llm.queries import QUERIES
from tests.llm.conftest import sample_documents

DOCS = sample_documents()
RULES = license_rules.rules()
SCANNER = license_scan.Scanner(RULES)


# -- 11: license scan

def brute_scan(text):
    """All rules tried, suppression by comparing all detections."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    line = " ".join(words)
    found = []
    for i, r in enumerate(RULES):
        shape = rf"(?=({r.pattern})(?!\S))" if r.base else rf"({r.pattern})(?!\S)"
        for m in re.finditer(r"(?<!\S)" + shape, line):
            s = line[:m.start(1)].count(" ")
            found.append((s, s + m.group(1).count(" ") + 1, i))
    rank = lambda d: (-RULES[d[2]].priority, d[0] - d[1], d[2], d[0])
    kept = []
    for d in sorted((d for d in found if not RULES[d[2]].base), key=rank):
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    return len(words), sorted(kept + [d for d in found if RULES[d[2]].base])


LICENCES = [
    ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc-4.0"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
    ("Released under the MIT License.", {"mit"}),
    ("All rights reserved.", {"reserved"}),
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
    ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
    ("GPLv3 or later", {"gpl-3.0-or-later"}),
    ("Creative Commons Attribution-ShareAlike 3.0 Unported License", {"cc-by-sa-3.0"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", {"mit"}),
    ("GNU Lesser General Public License v2.1", {"lgpl-2.1", "gpl"}),
    ("Er geht mit der Arbeit nach Hause, Copyright-frei ist es nicht", {"copyright"}),
    ("the cat sat", set()),
    ("", set()),
]


@pytest.mark.parametrize("text, labels", LICENCES)
def test_licence_labels(text, labels):
    n, found = SCANNER.scan(text)
    assert {RULES[i].label for *_, i in found} == labels


def test_rules_are_many_and_named_once():
    assert len(RULES) >= 300 and len({r.name for r in RULES}) == len(RULES)
    assert all(0 < r.weight < 1 for r in RULES)


PIECES = [t for t, _ in LICENCES] + ["general public license", "cc by cc by nc", "MIT license MIT LICENSE", "Apache 2.0",
                                     "© 2020", "bsd", "license file", "ÄÖ ü", "version 2", "3", "under the", "public domain"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=9), st.sampled_from([" ", ". ", "\n", "-"]))
def test_scan_equals_all_rules_and_all_pairs(pieces, between):
    text = between.join(pieces)
    n, found = SCANNER.scan(text)
    assert (n, sorted(found)) == brute_scan(text)


def test_scan_of_a_very_long_text_is_whole():
    text = "word " * 200_000 + "GNU General Public License version 2 " * 3000 + "cc by"
    n, found = SCANNER.scan(text)
    assert n == 200_000 + 18_000 + 2 and found[-1][:2] == (n - 2, n)
    assert sum(RULES[i].base for *_, i in found) == 3001


def test_op11(spark, tiny):
    got = QUERIES["op11_license_scans"](spark, tiny).collect()
    want = []
    for i, text, *_ in DOCS:
        n, found = brute_scan(text or "")
        base = [s for s, _, r in found if RULES[r].base]
        labels = [",".join(sorted({RULES[r].label for *_, r in found if RULES[r].base or not only})) for only in (True, False)]
        want.append((str(i), n, len(base), min(base, default=None), max(base, default=None), *labels))
    assert sorted(map(str, want)) == sorted(
        str((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)) for r in got)
    assert all(0 <= r.score <= 1 and (r.score == 0) == (r.labels == "") for r in got)


def test_scan_with_own_rules(spark):
    own = [license_rules.Rule("a", "in-house", "acme", r"acme licen[cs]e", 2, 0.5),
           license_rules.Rule("b", "mention", "acme", r"acme", 1, 0.25)]
    docs = spark.createDataFrame([("x", "ACME license, acme"), (None, None)], "doc_id string, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs, own).collect()}
    assert [(d.rule, d.start, d.end) for d in got["x"].found] == [("a", 0, 2), ("b", 2, 3)]
    assert got["x"].score == pytest.approx(1 - 0.5 * 0.75) and got[None].n_words == 0 and got[None].score == 0


# -- 12: divergence

@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=80), min_size=1, max_size=300))
def test_perfect_hash_is_minimal_and_verified(keys):
    keys = sorted(keys)
    stored = [divergence.stored_key(k) for k in keys]
    moves, owner = divergence.perfect_hash(stored)
    assert sorted(owner.tolist()) == list(range(len(keys)))
    shards = divergence.Shards([("en", 0, moves.tolist(), [stored[i] for i in owner])], 1)
    assert [int(owner[s]) for s in shards.find("en", keys)] == list(range(len(keys)))
    strangers = [k + b"?" for k in keys if k + b"?" not in keys]
    assert (shards.find("en", strangers) == -1).all() and (shards.find("de", keys) == -1).all()


def test_perfect_hash_of_a_large_shard():
    keys = [f"term{i}".encode() for i in range(20_000)]
    moves, owner = divergence.perfect_hash(keys)
    assert sorted(owner.tolist()) == list(range(len(keys)))


def test_scaled_is_exact_beyond_64_bits():
    counts, total = np.array([0, 7, 10 ** 15]), np.array([10 ** 16 + 3])
    assert divergence.scaled(counts, total).tolist() == [1 + 10 ** 9 * (c + 1) // (10 ** 16 + 3) for c in counts.tolist()]


def brute_audit(rows, least=3, most=200):
    rows = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        seen = Counter(t for own, _, ts in rows if own == lang for t in set(ts))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = {}
        for own, source, ts in rows:
            if own == lang:
                counts.setdefault(source, Counter()).update(t for t in ts if seen[t] >= least)
        share = lambda c: {t: 1 + 10 ** 9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [("term", t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part in (sorted(pairs, key=lambda x: (-x[2], x[1].encode())), sorted(terms, key=lambda x: (-x[2], x[1].encode()))[:most]):
                out += [(lang, s, *x, r) for r, x in enumerate(part, 1)]
    return sorted(out)


def audit_rows(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_op12(spark, tiny):
    assert audit_rows(QUERIES["op12_source_divergence"](spark, tiny)) == brute_audit(DOCS)


@pytest.mark.parametrize("wave_bytes, most, cells", [(300, 200, 1 << 20), (2000, 3, 1), (1 << 20, 5, 1 << 20)])
def test_audit_in_waves_and_shards(spark, monkeypatch, wave_bytes, most, cells):
    rng = random.Random(wave_bytes)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)] + ["ß" * 100, "é", "ſ", "İ"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) + rng.choice(["", " UPPER Case", " 1a2b"]),
             rng.choice(["en", "de", None, "xx"]) if i else "lonely", rng.choice(["a", "b", "ä", None, ""])) for i in range(300)]
    monkeypatch.setattr(divergence, "MATRIX_CELLS", cells)  # 64 terms a shard at the least
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    got = audit_rows(divergence.audit(docs, least=3, most=most, wave_bytes=wave_bytes))
    assert got == brute_audit(rows, most=most)


def test_groups_without_kept_terms(spark):
    rows = [(1, None, "en", "a"), (2, "one two", "en", "b"), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert audit_rows(divergence.audit(docs)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


# -- 13: vector codes

def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    cut = lambda v: [tuple((v + [0] * (parts * width))[p * width:(p + 1) * width]) for p in range(parts)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[cut(v)[p] for _, v, _ in order[:entries]] for p in range(parts)]
    pick = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for _, v, _ in kept:
                members.setdefault(pick(cut(v)[p], book)[1], []).append(cut(v)[p])
            books[p] = [tuple(sum(c) // len(members[j]) for c in zip(*members[j])) if j in members else e
                        for j, e in enumerate(book)]
    out = []
    for i, v, label in kept:
        best = [pick(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), label))
    sums = Counter()
    for _, _, e, label in out:
        sums[label] += e
    text = ",".join(str(c) for book in books for e in book for c in e)
    return [(str(i), c, e, sums[label], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, label in out]


def test_op13(spark, tiny):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    got = [(str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256)
           for r in QUERIES["op13_vector_codes"](spark, tiny).collect()]
    assert sorted(got) == sorted(brute_codes(rows)) and len(got) == 123


@pytest.mark.parametrize("entries, block, scale", [(8, 16, 1.0), (200, 4096, 50000.0), (3, 5, 0.01)])
def test_codes_equal_brute_force(spark, monkeypatch, entries, block, scale):
    rng = np.random.default_rng(entries)
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rows = [(int(rng.integers(0, 80)) if i % 9 else None, [float(np.float32(x)) for x in rng.normal(0, scale, 10)],
             f"l{i % 3}" if i % 4 else None) for i in range(120)]
    rows += rows[:20]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(3)
    coded, books = vector_codes.compress(vector_codes.quantised(frame), entries=entries)
    got = [(str(r.id), r.code, r.error, r.label_error, vector_codes.digest(books))
           for r in vector_codes.with_label_error(coded).collect()]
    assert sorted(got) == sorted(brute_codes(rows, entries=entries))


def test_extreme_components_are_clipped(spark):
    rows = [(1, [1e30, -1e30], 1), (2, [0.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert vector_codes.quantised(frame).first().v == [1 << 28, -(1 << 28)]
    assert vector_codes.compress(vector_codes.quantised(frame))[0].count() == 2


# -- SQL

@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_vector_codes"])
def test_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df, rel = QUERIES[name](spark, "/root/testdata/sf0.001"), con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns) and not type_differences(df.schema, rel.columns, rel.types)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())


# -- 8: routes over many patterns

def test_route_of_many_patterns_is_quick_and_feasible():
    import time

    from palaver.llm import mixing
    rng = random.Random(3)
    patterns = {(s,): rng.randrange(1, 500) for s in range(3000)}
    while len(patterns) < 50_000:
        patterns[tuple(sorted(rng.sample(range(3000), rng.randrange(1, 5))))] = rng.randrange(1, 500)
    quotas = [rng.randrange(0, 20_000) for _ in range(3000)]
    began = time.time()
    taken = mixing.route(patterns, quotas, 2)
    assert time.time() - began < 30
    assert all(0 <= taken[k] <= 2 * w for k, w in patterns.items())
    # each pattern's words fit into its sources, and nothing that could still flow is left
    assert sum(taken.values()) <= sum(quotas)
    assert all(taken[(s,)] <= quotas[s] for s in range(3000))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sets(st.integers(0, 3), min_size=1, max_size=4).map(lambda x: tuple(sorted(x))),
                       st.integers(0, 5), max_size=6), st.lists(st.integers(0, 9), min_size=4, max_size=4))
def test_route_is_a_largest_flow_of_least_repetition(patterns, quotas):
    from palaver.llm import mixing
    taken = mixing.route(patterns, quotas, 2)

    def largest(repeats):
        """Largest flow as the smallest cut over sets of sources kept with the start."""
        return min(sum(quotas[s] for s in cut) + sum(repeats * w for k, w in patterns.items() if not set(k) <= set(cut))
                   for n in range(5) for cut in itertools.combinations(range(4), n))

    assert sum(taken.values()) == largest(2)
    assert sum(min(taken[k], w) for k, w in patterns.items()) == largest(1)  # first uses before repeated ones


# -- 2: tokenizers with other rules

@pytest.mark.parametrize("name, fast", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_packing_follows_the_tokenizers_rules(spark, name, fast):
    import zlib
    from struct import pack

    from tokenizers import Tokenizer

    from palaver.llm import packing
    from palaver.llm.common import tokenizer_path
    tok = Tokenizer.from_file(tokenizer_path(name))
    assert packing.ChunkEncoder(tokenizer_path(name)).by_words == fast
    texts = [t for _, t, *_ in DOCS] + ["It's  A Test\n\tof  white   space", " lead and trail ", "ÄÖÜ ſtraße 12,5", "日本語 テキスト", "a\u0301 e\u0301"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.pack(docs, tokenizer_path(name)).collect())
    want = []
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, a, n, zlib.crc32(pack(f"<{n}I", *ids[a:a + n]))) for a, n in packing.cuts(len(ids), 2048)]
    assert got == sorted(want)
