"""Personal data by weak supervision, in DataFrame functions only.

*Base* spans (e-mail, IP address, card, phone) come from fixed patterns and
their checks; they always stay. The method adds spans that the patterns miss
(numbers that run into their neighbours, addresses spelled with ``[at]``):

1. candidates: tighter patterns with their own borders;
2. five labelers vote on each candidate (1 personal, -1 not, 0 no opinion):
   the base pattern and its check on the candidate alone (``regex``), a checksum
   or range (``check``), lists of card prefixes, country codes, address ranges
   and mail domains (``gazetteer``), cue words before it (``context``), and the
   characters next to it (``edge``);
3. votes are counted by pattern over all documents, at most 3^5 rows per kind,
   and expectation-maximisation estimates per kind how often each labeler votes
   what on personal and on other candidates;
4. a logistic span classifier learns the estimated probabilities from the
   votes and the kind, and accepts candidates at one half or more.

An accepted candidate is added unless it touches a base span or an accepted
candidate before it. Spans are found inside the row, so no text is shuffled.

Defined results: a null text is empty; without spans the lists are empty (the
digest is that of the empty string); repeated rows repeat; without candidates
nothing is added.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import whole_text

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "check", "gazetteer", "context", "edge")
SPAN = "array<struct<s:int,e:int,k:int,hit:string>>"

# Patterns of the base spans; possessive quantifiers and borders keep the matcher linear and
# free of recursion without changing what matches.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
CANDIDATE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@| ?[\[(][aA][tT][\])] ?)[A-Za-z0-9-]{1,63}"
             r"(?:(?:\.| ?[\[(][dD][oO][tT][\])] ?)[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9])(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}(?:\1[0-9]{4}[0-9]{0,3}|[0-9]{0,3})"
            r"|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
             r"|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
}
# What a text needs to hold for a pattern to be tried at all.
GATE = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"),
    "phone": lambda t: t.contains("+"),
}
CANDIDATE_GATE = {
    "email": lambda t: t.contains("@") | t.rlike(r"[\[(][aA][tT][\])]"),
    "ip": GATE["ip"],
    "card": GATE["card"],
    "phone": lambda t: t.rlike(r"[0-9]{3}.{0,2}[0-9]{3}.[0-9]{4}|\+[0-9]"),
}

# Gazetteers and cues of the labelers.
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[0-8]|6[0245])"
COUNTRY_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
MAIL_DOMAIN = r"(?i)(?:mail|example|outlook|yahoo|proton|icloud|gmx|web)[a-z0-9-]*(?:\.| ?[\[(]dot[\])] ?)"
PERSONAL_CUE = (r"(?i)(?:e-?mail|contact|call|phone|tel|mobile|fax|write|reach|card|visa|credit|konto|karte|telefon|"
                r"appel|carte|correo|tarjeta|llam|kontakt)\p{L}*\P{L}{0,12}$")
OTHER_CUE = r"(?i)(?:version|release|isbn|serial|build|commit|hash|token|key|sha|order|invoice|id)\P{L}{0,6}$"


def spans(text: Column, kind: str, pattern: str, gate: Column) -> Column:
    """Matches of ``pattern`` in order, with code point positions (end exclusive)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    k = F.lit(KINDS.index(kind))

    def step(acc: Column, x: Column) -> Column:
        s = acc["pos"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        one = F.struct(s.alias("s"), e.alias("e"), k.alias("k"), x["hit"].alias("hit"))
        return F.when(x["hit"].isNull(), acc).otherwise(
            F.struct(e.alias("pos"), F.concat(acc["spans"], F.array(one)).alias("spans")))

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("spans"))
    return F.when(gate, F.aggregate(pairs, zero, step, lambda acc: acc["spans"])) \
        .otherwise(F.array().cast(SPAN))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The check digit of a digit string of at most 19 digits holds."""
    n = F.length(number)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.when(n.between(1, 19), total % 10 == 0).otherwise(False)


def octets(hit: Column) -> Column:
    """All parts of an address are at most 255."""
    plain = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p.cast("int")).otherwise(256) <= 255))


def passes(kind: str, hit: Column) -> Column:
    """The check that a base match has to pass."""
    n = F.length(digits(hit))
    return {"email": F.lit(True), "ip": octets(hit), "phone": n.between(9, 15),
            "card": F.when(n.between(12, 19), luhn(digits(hit))).otherwise(False)}[kind]


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    def sound(kind: str) -> Column:
        return F.filter(spans(text, kind, BASE[kind], GATE[kind](text)), lambda x: passes(kind, x["hit"]))

    return by_start(F.concat(*[sound(k) for k in KINDS]))


def by_start(found: Column) -> Column:
    keyed = F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"),
                                                  x["hit"].alias("hit")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"),
                                                               x["k"].alias("k"), x["hit"].alias("hit")))


def vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), -1).otherwise(0)


def votes(text: Column, kind: str, x: Column) -> Column:
    """The labelers' votes on one candidate of ``kind``."""
    hit, number = x["hit"], digits(x["hit"])
    n = F.length(number)
    whole = F.regexp_extract(hit, BASE[kind], 0) == hit
    valid = {"email": hit.rlike(r"[A-Za-z]{2,24}$"), "ip": octets(hit), "card": luhn(number),
             "phone": n.between(10, 15)}[kind]
    first = F.when(F.length(F.element_at(F.split(hit, r"\."), 1)) <= 3,
                   F.element_at(F.split(hit, r"\."), 1).cast("int")) if kind == "ip" else F.lit(0)
    listed = {"email": vote(hit.rlike(MAIL_DOMAIN), F.lit(False)), "ip": vote(first.between(1, 223) & (first != 127),
                                                                              F.lit(True)),
              "card": vote(number.rlike(CARD_PREFIX), F.lit(True)),
              "phone": vote(hit.rlike(COUNTRY_CODE), hit.startswith("+"))}[kind]
    at = F.greatest(x["s"] - 40, F.lit(0))
    before = F.substring(text, at + 1, x["s"] - at)
    after = F.substring(text, x["e"] + 1, F.lit(1))
    ballot = {
        "regex": vote(whole & passes(kind, hit), F.lit(True)),
        "check": vote(valid, F.lit(True)),
        "gazetteer": listed,
        "context": vote(before.rlike(PERSONAL_CUE), before.rlike(OTHER_CUE)),
        "edge": vote(~before.rlike(r"[\p{L}0-9_=/\"'#-]$") & ~after.rlike(r"^[\p{L}0-9_=/@]"), F.lit(True)),
    }
    return F.struct(*[ballot[name].alias(name) for name in LABELERS])


def candidates(text: Column) -> Column:
    """array<struct<s, e, k, hit, v: struct of votes>> of all kinds."""
    def judged(kind: str) -> Column:
        found = spans(text, kind, CANDIDATE[kind], CANDIDATE_GATE[kind](text))
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"),
                                                     x["hit"].alias("hit"), votes(text, kind, x).alias("v")))
    return F.concat(*[judged(k) for k in KINDS])


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 100, prior: float = 4.0) -> dict[tuple[int, ...], float]:
    """Probability of "personal" per vote pattern, by expectation-maximisation.

    Two classes; labeler j votes value v on class c with probability
    r[j][c][v], independently. Dirichlet pseudo-counts say that a labeler is right
    more often than wrong, which also tells the classes apart.
    """
    if not counts:
        return {}
    n = len(next(iter(counts)))
    pseudo = {1: {1: prior, 0: prior / 2, -1: prior / 4}, 0: {1: prior / 4, 0: prior / 2, -1: prior}}
    post = {p: 1 / (1 + math.exp(-sum(p))) for p in counts}
    for _ in range(rounds):
        total = {c: prior for c in (0, 1)}
        r = [{c: dict(pseudo[c]) for c in (0, 1)} for _ in range(n)]
        for p, m in counts.items():
            for c in (0, 1):
                w = m * (post[p] if c else 1 - post[p])
                total[c] += w
                for j, v in enumerate(p):
                    r[j][c][v] += w
        new = {}
        for p in counts:
            log = {c: math.log(total[c]) + sum(math.log(r[j][c][v] / sum(r[j][c].values())) for j, v in enumerate(p))
                   for c in (0, 1)}
            new[p] = 1 / (1 + math.exp(max(-700.0, min(700.0, log[0] - log[1]))))
        moved = max(abs(new[p] - post[p]) for p in counts)
        post = new
        if moved < 1e-9:
            break
    return post


@dataclass(frozen=True)
class Classifier:
    """Logistic span classifier: a weight per labeler and one per kind."""
    labelers: tuple[float, ...]
    kinds: tuple[float, ...]

    def accepts(self, x: Column) -> Column:
        z = F.element_at(F.array(*[F.lit(float(b)) for b in self.kinds]), x["k"] + 1)
        for name, w in zip(LABELERS, self.labelers):
            z = z + F.lit(float(w)) * x["v"][name]
        return z >= 0


def train(rows: dict[tuple[int, tuple[int, ...]], tuple[int, float]], rounds: int = 400) -> Classifier:
    """Fit to (kind, votes) -> (count, probability); gradient steps with a small ridge."""
    n, kinds = len(LABELERS), len(KINDS)
    w = [1.0] * n + [0.0] * kinds
    per_kind = defaultdict(int)
    for (k, _), (m, _) in rows.items():
        per_kind[k] += m
    for _ in range(rounds):
        grad = [0.002 * x for x in w]
        for (k, votes_), (m, p) in rows.items():
            z = w[n + k] + sum(a * b for a, b in zip(w, votes_))
            miss = (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - p) * (m / per_kind[k]) ** 0.5
            for j, v in enumerate(votes_):
                grad[j] += miss * v
            grad[n + k] += miss
        w = [a - 0.2 * g for a, g in zip(w, grad)]
    return Classifier(tuple(w[:n]), tuple(w[n:]))


def fit(docs: DataFrame) -> Classifier:
    """Learn from the candidates of all rows of ``docs`` (text)."""
    x = docs.select(whole_text().alias("t")).select(F.explode(candidates(F.col("t"))).alias("x"))
    counted = x.groupBy("x.k", *[F.col(f"x.v.{name}").alias(name) for name in LABELERS]) \
        .agg(F.count(F.lit(1)).alias("n")).collect()  # at most 4 * 3^5 rows
    by_kind: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for r in sorted(counted, key=lambda r: tuple(r)):
        by_kind[r["k"]][tuple(r[name] for name in LABELERS)] = r["n"]
    rows = {}
    for k, counts in by_kind.items():
        post = estimate(counts)
        rows |= {(k, p): (m, post[p]) for p, m in counts.items()}
    return train(rows)


def added_spans(judged: Column, base: Column, model: Classifier) -> Column:
    """Accepted candidates that touch no base span and no accepted one before them."""
    free = F.filter(judged, lambda x: model.accepts(x)
                    & ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    plain = by_start(F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"),
                                                          x["hit"].alias("hit"))))
    zero = F.struct(F.lit(0).alias("upto"), F.array().cast(SPAN).alias("spans"))
    return F.aggregate(
        plain, zero, lambda acc, x: F.when(x["s"] < acc["upto"], acc).otherwise(
            F.struct(x["e"].alias("upto"), F.concat(acc["spans"], F.array(x)).alias("spans"))),
        lambda acc: acc["spans"])


def with_spans(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with columns ``__t`` (whole text), ``__base`` and ``__all`` spans by start."""
    return (docs.withColumn("__t", whole_text())
            .withColumn("__base", base_spans(F.col("__t")))
            .withColumn("__judged", candidates(F.col("__t")))
            .withColumn("__all", F.when(F.size("__judged") == 0, F.col("__base")).otherwise(
                by_start(F.concat("__base", added_spans(F.col("__judged"), F.col("__base"), model)))))
            .drop("__judged"))


def listed(found: Column) -> Column:
    """kind:start:end by start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans per row."""
    found = with_spans(docs.select("doc_id", "text"), model)

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("__base", lambda x: x["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    n = [of_kind(k) for k in KINDS]
    return found.select("doc_id", *n, F.sha2(listed(F.col("__base")), 256).alias("base_sha256"),
                        listed(F.col("__all")).alias("spans"))


def redact(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind, as ``<email>``; other rows stay as they are."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("__t"), acc["pos"] + 1, x["s"] - acc["pos"])
        return F.when(x["s"] < acc["pos"], F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), acc["out"].alias("out"))) \
            .otherwise(F.struct(x["e"].alias("pos"), F.concat(
                acc["out"], F.array(gap, F.element_at(names, x["k"] + 1))).alias("out")))

    text = F.aggregate(F.col("__all"), zero, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(F.col("__t"), acc["pos"] + 1, F.length(F.col("__t")))))
    return with_spans(docs, model) \
        .withColumn("text", F.when(F.size("__all") > 0, text).otherwise(F.col("text"))).drop("__t", "__base", "__all")
