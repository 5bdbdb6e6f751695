"""Phrase automaton: against a plain search, lists in several passes, hard texts."""

import random

import regex

from palaver.operators import phrases as ph

SCHEMA = "job_id long, text string, language string"


def _plain(rows, terms):
    """Every term tried at every word."""
    out = set()
    for job, text, lang in rows:
        ws = regex.findall(r"\p{L}+", (text or "").lower())
        for t in terms:
            p = regex.findall(r"\p{L}+", t.phrase.lower())
            if p and (t.language is None or t.language == lang):
                out |= {(job, t.category, " ".join(p), i) for i in range(len(ws)) if ws[i:i + len(p)] == p}
    return out


def _hits(spark, rows, terms):
    found = ph.phrase_hits(ph.find_phrases(spark.createDataFrame(rows, SCHEMA), terms)).collect()
    got = [(r["transcript_id"], r["category"], r["phrase"], r["first_word"]) for r in found]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_a_plain_search(spark, monkeypatch):
    rnd = random.Random(11)
    vocab = ["a", "aa", "b", "ab", "ba", "É", "straße", "no"]
    rows = [(i, rnd.choice([" ", ", ", "-1-", "\n"]).join(rnd.choices(vocab, k=rnd.randrange(0, 40))),
             rnd.choice(["en", "fr", None])) for i in range(120)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "12 34 !!", None), (203, "a " * 200_000 + "no b", "fr")]
    terms = [ph.Term(rnd.choice("XY"), " ".join(rnd.choices(vocab, k=rnd.randrange(1, 4))), rnd.choice([None, "en", "fr"]))
             for _ in range(60)] + [ph.Term("X", "A-b!"), ph.Term("X", "a b"), ph.Term("X", "..."), ph.Term("X", "")]
    terms = [t for t in terms if t.phrase not in ("a", "a a", "a a a")] + [ph.Term("Z", "a no b", "fr")]
    want = _plain(rows, terms)
    assert _hits(spark, rows, terms) == want
    monkeypatch.setattr(ph, "LIST_BYTES", 40)  # many passes
    assert len(ph._passes(terms)) > 5
    assert _hits(spark, rows[:60], terms) == {h for h in want if h[0] < 60}


def test_verdicts_and_empty_lists(spark):
    rows = [(1, "You SON of\na Bitch", "en"), (2, "ta gueule", "fr"), (3, "ta gueule", "en"), (4, "mail me a@b.org", None),
            (5, "vermin, go to hell", "en"), (6, None, None), (7, "gas the", None)]
    found = ph.find_phrases(spark.createDataFrame(rows, SCHEMA))
    got = {r["transcript_id"]: r["reject_reason"] for r in ph.phrase_verdict(found).collect()}
    assert got == {1: "PROFANITY", 2: "PROFANITY", 3: None, 4: "PII", 5: "PROFANITY", 6: None, 7: None}
    assert _hits(spark, rows, []) == set()
    assert ph.find_phrases(spark.createDataFrame([], SCHEMA)).count() == 0
