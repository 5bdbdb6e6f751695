"""Every dealt query over a table of hard rows, and over empty tables."""

import hashlib
import re

import pytest

import corpus_pipeline
from palaver.llm.common import tokenizer_path
from palaver.llm.queries import QUERIES
from tests.llm.conftest import sample_documents

DOCS = sample_documents()


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, nothing, name):
    run = corpus_pipeline.run if name == "pipeline" else QUERIES[name]
    assert run(spark, nothing).count() == 0


def rows(spark, tiny, name):
    return QUERIES[name](spark, tiny).collect()


def test_op1(spark, tiny):
    got = rows(spark, tiny, "op1_document_fingerprints")
    order = sorted(((i, t or "") for i, t, *_ in DOCS), key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for j, (i, t) in enumerate(order):
        nxt, k = order[(j + 1) % len(order)][1], len(t) // 3
        want.append((str(i), len(t), hashlib.sha256((t[:len(t) - k] + nxt[:k]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    fp = {str(r.doc_id): r.fingerprint for r in got}
    assert fp["100"] == fp["102"] and fp["103"] == fp["104"]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 16 for r in got)


def test_op2(spark, tiny):
    import zlib
    from struct import pack

    from tokenizers import Tokenizer
    got = rows(spark, tiny, "op2_packing")
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 for r in got)
    by_length = sorted((r.sequence_id, r.length) for r in got)
    assert [b for _, b in by_length] == sorted((b for _, b in by_length), reverse=True)
    want = []
    for i, t, *_ in DOCS:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        while at < len(ids):
            n = min(2048, 1 << ((len(ids) - at).bit_length() - 1))
            want.append((str(i), at, n, zlib.crc32(pack(f"<{n}I", *ids[at:at + n])), len(ids)))
            at += n
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)


def test_op3(spark, tiny):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows(spark, tiny, "op3_url_filters")}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/EN/x", "net/", "block")
    assert got[2] == ("example.com", "/de/", "example.com/de/", "block")
    assert got[3][2:] == ("org/fr/", "allow") and got[4][2:] == ("net/", "block")
    assert got[5] == ("foo.net", "", None, "allow")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow")
    assert got[9][2] is None and got[10][2] is None and got[11][2] is None
    assert got[12][2:] == ("net/", "block")


def test_op4(spark, tiny):
    got = {(r.doc_id, r.n_card): r for r in rows(spark, tiny, "op4_pii")}
    r = got[108, 1]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    t = dict((d[0], d[1]) for d in DOCS)[108]
    spots = [("email", "a.b@c.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (212) 555-0100")]
    listed = ",".join(f"{k}:{t.index(s)}:{t.index(s) + len(s)}" for k, s in spots)
    assert r.spans == listed and r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    empty = got[103, 0]
    assert empty.spans == "" and empty.base_sha256 == hashlib.sha256(b"").hexdigest()
    joined = got[109, 0]  # the two numbers run into each other for the base patterns
    assert (joined.n_card, joined.n_phone) == (0, 0) and joined.spans == "phone:3:20,card:21:37"


def test_op5(spark, tiny):
    got = rows(spark, tiny, "op5_language_id")
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(DOCS)
    assert by_id[103].lang_pred == by_id[104].lang_pred == by_id[105].lang_pred == "und"
    assert all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for r in got)
    assert sum(by_id[d[0]].lang_pred == d[2] for d in DOCS[:24]) >= 23


def test_op6(spark, tiny):
    import math
    got = [tuple(r) for r in rows(spark, tiny, "op6_exact_topk")]
    vecs = [(i, [math.floor(256 * (float((i * j) % 7) / 16)) for j in range(5)]) for i in range(120)]
    vecs += [(250, [128, 64]), (250, [128, 64]), (300, [])]
    want = []
    for q, v in {i: v for i, v in vecs if i % 50 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vecs if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(got) == sorted(want)


def test_op7(spark, tiny):
    got = {r.doc_id: (r.class_id, r.n_links) for r in rows(spark, tiny, "op7_ngram_jaccard_join")}
    assert got[100] == got[101] == got[102] == (100, 2)
    assert got[103] == (103, 0) and got[104] == (104, 0) and got[105] == (105, 0)
    assert got[106] == (106, 1)  # the row repeated whole is its copy


def test_op8(spark, tiny):
    got = rows(spark, tiny, "op8_mixing")
    size = {str(d[0]): len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in DOCS}
    assert all(r["size"] == size[str(r.doc_id)] and 0 <= r.taken <= 2 * r["size"] for r in got)
    source = {str(d[0]): d[3] for d in DOCS}
    taken, target = {}, {}
    for r in got:
        s = source[str(r.doc_id)]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
    assert set(target) == {"s0", "s1", "s2", None}
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    key = lambda x: sorted((str(r.doc_id), r.taken) for r in x)
    assert key(rows(spark, tiny, "op8_mixing")) == key(got)


def test_op9(spark, tiny):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = sorted((str(i), len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in DOCS)
    got = rows(spark, tiny, "op9_token_counts")
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_op10(spark, tiny):
    got = rows(spark, tiny, "op10_toxicity")
    assert len(got) == len(DOCS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.score for r in got if r.doc_id in (103, 104)} == {0.0}


def test_pipeline(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tiny)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    ids = [sorted(str(r.doc_id) for r in rows_) for rows_ in kept]
    assert not {"103", "104", "105"} & set(ids[0]) and "None" in ids[0] and ids[0].count("106") == 2
    assert "100" in ids[1] and not {"101", "102"} & set(ids[1]) and ids[1].count("106") == 1
    assert ids[2] == ids[1]
    text = {str(r.doc_id): r.text for r in kept[2]}
    assert text["108"] == "mail <email> or <ip> or <card> or <phone>" and text["109"] == "at <phone> <card>"
    assert set(ids[3]) <= set(ids[2]) and all(ids[3].count(i) <= 2 * ids[2].count(i) for i in ids[3])
    whole = {}
    for r in kept[4]:
        whole[str(r.doc_id)] = whole.get(str(r.doc_id), 0) + r.length
    assert set(whole) == set(ids[3])
