"""SimHash fingerprints and Hamming search, in DataFrame functions only.

The terms of a text are its runs of ``WORDS`` words (lower-case runs of letters
and digits; a shorter text is one run). Every occurrence of a term adds one vote
per bit of the term's hash, so a term weighs as often as it occurs; a bit
of the 64-bit fingerprint is set where more than half of the votes are for it.

``neighbours`` finds, for every fingerprint, how many others lie within a
Hamming radius. The bits are cut into ``blocks``; two fingerprints that differ
in at most ``radius`` bits agree in ``blocks - radius`` whole blocks, so one
table per choice of that many blocks, keyed by their bits, holds every pair. A
large bucket is cut into chunks that meet pairwise, and a task returns counts
per fingerprint, never pairs. A pair is counted in the first table it shares.
``links`` returns the pairs themselves. ``classes`` puts fingerprints joined by a
chain of links into one class, again without pairs: every class is joined to the
smallest class within reach of each member until none is in reach.

Defined results: a null text is empty; a text without words has fingerprint 0
(and an empty term list, whose votes are nowhere in the majority); equal texts
have equal fingerprints; rows repeated whole count as documents of their own.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import stored, whole_text
from palaver.llm.jaccard import components

WORDS = 5
BITS = 64
NOT_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def term_hashes(words: str) -> Column:
    """Hash of each term occurrence, in order.

    ``words`` names a column: an expression in its place would be evaluated
    again for every term.
    """
    w, n = F.col(words), F.size(words)
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - WORDS + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, WORDS))))


def vote_sums() -> list[Column]:
    """Aggregates over rows of one term hash ``h`` each: votes per bit, and all votes."""
    return [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(BITS)] \
        + [F.count("h").alias("votes")]


def majority() -> Column:
    """The fingerprint of a row of vote sums, as a long."""
    out = F.lit(0).cast("long")
    for i in range(BITS):
        bit = 1 << i if i < BITS - 1 else -(1 << i)
        out = out.bitwiseOR(F.when(2 * F.col(f"b{i}") > F.col("votes"), F.lit(bit).cast("long"))
                            .otherwise(F.lit(0).cast("long")))
    return out


def shown(fingerprint: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), BITS // 4, "0"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def head_ids(docs: DataFrame, buckets: int) -> list[int]:
    """Largest id of each of about ``buckets`` ranges of equally many rows, ascending."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).filter("id is not null")
    shares = [(i + 1) / buckets for i in range(buckets)]
    cut = ids.agg(F.percentile_approx("id", shares, max(10_000, 10 * buckets)).alias("c")).first()["c"]
    if not cut:
        return []
    # quantiles come back through doubles: take the largest id really in each range
    heads = ids.groupBy(place(F.col("id"), sorted(set(cut))).alias("b")).agg(F.max("id").alias("m")).collect()
    return sorted(r["m"] for r in heads)


def place(id_: Column, heads: list[int]) -> Column:
    """Number of heads below the id, by bisection (ids over the last head: that number)."""
    array = F.split(F.lit(",".join(map(str, heads))), ",").cast("array<bigint>")
    steps = max(1, math.ceil(math.log2(len(heads) + 1)))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.when(mid < len(heads), F.get(array, mid) < id_).otherwise(False)
        done = acc["lo"] >= acc["hi"]
        return F.struct(F.when(~done & below, mid + 1).otherwise(acc["lo"]).alias("lo"),
                        F.when(~done & ~below, mid).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(heads)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), start, halve, lambda acc: acc["lo"])


def beside_next(docs: DataFrame, buckets: int) -> DataFrame:
    """b, rn, extra, doc_id, text, next_text: each row with the next by descending id.

    After the last comes the first; null ids come last; equal ids are ordered by
    the hash of the text. Rows are dealt into ranges of ids; the first row of a
    range is its largest id, so it is known beforehand and also sent to the range
    above it (the very first row to the lowest range), marked ``extra``.
    """
    heads = head_ids(docs, buckets)
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("th", F.xxhash64("text"))
    own = F.struct(F.lit(0).alias("extra"), F.lit(0).alias("b"))
    if heads:
        id_ = F.col("doc_id").cast("long")
        at = F.coalesce(place(id_, heads), F.lit(0)).cast("int")
        rows = rows.withColumn("at", at).withColumn(
            "is_head", F.coalesce(F.get(F.split(F.lit(",".join(map(str, heads))), ",").cast("array<bigint>"),
                                        F.col("at")) == id_, F.lit(False)))
        own = F.struct(F.lit(0).alias("extra"), F.col("at").alias("b"))
        again = F.struct(F.lit(1).alias("extra"), ((F.col("at") + 1) % len(heads)).cast("int").alias("b"))
        dealt = rows.withColumn("to", F.explode(F.when(F.col("is_head"), F.array(own, again)).otherwise(F.array(own))))
    else:  # no id at all: the order is that of the text hashes, and the first follows the last
        again = F.struct(F.lit(1).alias("extra"), F.lit(0).alias("b"))
        dealt = rows.withColumn("to", F.explode(F.array(own, again)))
    w = Window.partitionBy("b").orderBy("extra", F.desc_nulls_last("doc_id"), "th")
    return (dealt.select("doc_id", "text", "th", F.col("to.extra").alias("extra"), F.col("to.b").alias("b"))
            .withColumn("rn", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w)).drop("th"))


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp (fingerprints as longs).

    The edited text has its last third replaced by the beginning of the next
    row's text. One shuffle carries the texts; fingerprints and neighbours
    follow in the same partitions.
    """
    spark = docs.sparkSession
    buckets = buckets or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    k = F.floor(F.col("n_chars") / 3).cast("int")
    rows = (beside_next(docs, buckets).withColumn("n_chars", F.length("text").cast("long"))
            .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - k),
                                           F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), k))))
    versions = rows.select("b", "rn", "extra", "doc_id", "n_chars", F.explode(F.array(
        F.struct(F.lit(0).alias("version"), F.col("text").alias("t"), F.lit("").alias("sha")),
        F.struct(F.lit(1).alias("version"), F.when(F.col("extra") == 0, F.col("edited")).otherwise("").alias("t"),
                 F.sha2("edited", 256).alias("sha")))).alias("v"))
    key = ["b", "rn", "version", "extra", "doc_id", "n_chars", "sha"]
    worded = versions.select("b", "rn", "v.version", "extra", "doc_id", "n_chars", "v.sha",
                             words_of(F.col("v.t")).alias("words"))
    terms = worded.select(*key, F.explode_outer(term_hashes("words")).alias("h"))
    voted = terms.groupBy(*key).agg(*vote_sums()).select(*key, majority().alias("fp"))
    w = Window.partitionBy("b").orderBy("rn", "version")
    return (voted.withColumn("edited_fp", F.lead("fp", 1).over(w)).withColumn("edited_sha256", F.lead("sha", 1).over(w))
            .withColumn("next_fp", F.lead("fp", 2).over(w)).filter("version = 0 and extra = 0")
            .select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"))


def block_masks(blocks: int) -> list[int]:
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def tables_of(radius: int, blocks: int) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(blocks), blocks - radius))


def met(fps: DataFrame, radius: int, blocks: int, chunk: int) -> DataFrame:
    """t, members, others: chunks of the fingerprints (fp, root) that share a table's key, each with each.

    Keys whose rows all have one root are left out. A fingerprint must not repeat.
    """
    masks = block_masks(blocks)
    keys = [F.struct(F.lit(t).alias("t"),
                     F.col("fp").bitwiseAND(F.lit(signed(sum(masks[i] for i in c))).cast("long")).alias("key"))
            for t, c in enumerate(tables_of(radius, blocks))]
    rows = fps.select("fp", "root", F.explode(F.array(*keys)).alias("k")).select("fp", "root", "k.t", "k.key")
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")) \
        .filter("lo < hi").select("t", "key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    lists = stored(rows.join(sizes, ["t", "key"])
                   .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
                   .groupBy("t", "key", "c").agg(F.collect_list(F.struct("fp", "root")).alias("members")), "block-lists")
    return lists.join(lists.select("t", "key", F.col("members").alias("others")), ["t", "key"])


def first_shared(x: Column, radius: int, blocks: int) -> Column:
    """No table before this one holds the pair with difference ``x``."""
    masks, tests = block_masks(blocks), None
    for t, c in enumerate(tables_of(radius, blocks)):
        # a block before the table's last one, outside it, would give an earlier table
        earlier = [i for i in range(c[-1]) if i not in c]
        ok = F.lit(True)
        for i in earlier:
            ok = ok & (x.bitwiseAND(F.lit(signed(masks[i])).cast("long")) != 0)
        tests = F.when(F.col("t") == t, ok) if tests is None else tests.when(F.col("t") == t, ok)
    return tests


def near_others(a: Column, radius: int, blocks: int) -> Column:
    """The fingerprints of ``others`` within ``radius`` of ``a``, where this table is the pair's first."""
    other = F.transform("others", lambda b: b["fp"])
    return F.filter(other, lambda b: (a != b) & (F.bit_count(a.bitwiseXOR(b)) <= radius)
                    & first_shared(a.bitwiseXOR(b), radius, blocks))


def apart(fps: DataFrame) -> DataFrame:
    """The distinct fingerprints, each a class of its own."""
    return fps.select("fp").distinct().withColumn("root", F.col("fp"))


def neighbours(fps: DataFrame, radius: int = 3, blocks: int = 6, chunk: int = 256) -> DataFrame:
    """fp, n_near: how many other fingerprints of ``fps`` (fp) lie within ``radius``; only those with any.

    Also ``least``, the smallest of them.
    """
    found = F.transform("members", lambda a: F.struct(a["fp"].alias("fp"),
                                                      near_others(a["fp"], radius, blocks).alias("near")))
    each = met(apart(fps), radius, blocks, chunk).select(F.explode(
        F.transform(found, lambda x: F.struct(x["fp"].alias("fp"), F.size(x["near"]).alias("n"),
                                              F.array_min(x["near"]).alias("least")))).alias("x"))
    return each.select("x.fp", "x.n", "x.least").filter("n > 0") \
        .groupBy("fp").agg(F.sum("n").alias("n_near"), F.min("least").alias("least"))


def links(fps: DataFrame, radius: int = 3, blocks: int = 6, chunk: int = 256) -> DataFrame:
    """a, b: every two different fingerprints of ``fps`` (fp) within ``radius``, once, a < b; as many rows as pairs."""
    pairs = F.flatten(F.transform("members", lambda a: F.transform(
        F.filter(near_others(a["fp"], radius, blocks), lambda b: a["fp"] < b),
        lambda b: F.struct(a["fp"].alias("a"), b.alias("b")))))
    return met(apart(fps), radius, blocks, chunk).select(F.explode(pairs).alias("x")).select("x.a", "x.b")


def classes(near: DataFrame, radius: int = 3, blocks: int = 6, chunk: int = 256) -> DataFrame:
    """fp, n_near, class_fp (smallest fingerprint of its class) for the rows of ``neighbours``.

    Each round joins every class to another one at least, where any is in reach, so the number of
    classes that still grow halves.
    """
    roots = components(near, "fp", "least").select(F.col("node").alias("fp"), "root")
    while True:
        roots = stored(roots, "near-classes")
        in_reach = F.transform("members", lambda a: F.struct(a["root"].alias("root"), F.array_min(F.transform(
            F.filter("others", lambda b: (a["root"] != b["root"]) & (F.bit_count(a["fp"].bitwiseXOR(b["fp"])) <= radius)),
            lambda b: b["root"])).alias("other")))
        edges = stored(met(roots, radius, blocks, chunk).select(F.explode(in_reach).alias("x"))
                       .select("x.root", "x.other").filter("other is not null")
                       .groupBy("root").agg(F.min("other").alias("other")), "near-edges")
        if not edges.take(1):
            return near.join(roots, "fp").select("fp", "n_near", F.col("root").alias("class_fp"))
        joined = components(edges, "root", "other").select(F.col("node").alias("root"), F.col("root").alias("new"))
        roots = roots.join(joined, "root", "left").select("fp", F.coalesce("new", "root").alias("root"))


def near_documents(docs: DataFrame, radius: int = 3) -> DataFrame:
    """``fingerprints`` with n_same, n_near and class_fp.

    ``n_same`` is the number of other documents with the row's fingerprint, ``n_near`` that of other
    fingerprints within ``radius``; the documents with one ``class_fp`` are a class.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    near = classes(stored(neighbours(rows.select("fp"), radius), "near-fingerprints"), radius)
    same = rows.groupBy("fp").agg((F.count(F.lit(1)) - 1).alias("n_same")).filter("n_same > 0")
    found = stored(same.join(near, "fp", "full"), "found-fingerprints")
    return rows.join(found, "fp", "left").withColumn("n_same", F.coalesce("n_same", F.lit(0))) \
        .withColumn("n_near", F.coalesce("n_near", F.lit(0))).withColumn("class_fp", F.coalesce("class_fp", "fp"))
