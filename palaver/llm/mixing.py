"""Mixing sources to target weights by min-cost flow.

A document belongs to one or more sources. Documents are aggregated by
membership pattern, so the flow network has one node per pattern and one per
source, not per document. Arcs:

* start -> pattern, one per repetition: capacity is the pattern's words, the
  cost of the r-th repetition grows with r (convex), so words are repeated
  only where first uses run out;
* pattern -> each of its sources;
* source -> end, capacity is the source's target in words.

A cheapest largest flow says how many words of each pattern the mix takes.
Documents of a pattern are then selected in seeded order (a hash of id, size
and seed): all of them floor(taken / words) times, and one more time from the
front of the order until the words are met, the last one in part. The order is
summed in two steps, first per hash bucket and then inside the one bucket where
the words run out, so a source with a third of all documents is never sorted
in one task.

Defined results: size is the number of runs outside ASCII white space, null
text has 0; the null source is a source, last in order; documents of size 0
take 0 words; repeated rows are documents of their own; an empty table gives
an empty mix.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BROADCAST_PATTERNS = 200_000  # plans of more patterns are joined by shuffling


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words per source: by weight, none above ``most`` times its size, the excess reshared."""
    out = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        given = {i: left * weights[i] / total for i in open_}
        above = [i for i in open_ if given[i] > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = given[i]
            break
        for i in above:
            out[i] = most * sizes[i]
            left -= out[i]
            open_.discard(i)
    return out


def route(patterns: dict[tuple[int, ...], int], quotas: Sequence[int], repeats: int = 2) -> dict[tuple[int, ...], int]:
    """Words taken of each pattern by the cheapest largest flow.

    ``patterns`` maps the sources of a pattern to its words. A path from start to
    end pays for one arc only, that of the repetition it begins with, so paths
    come in order of repetitions: all of the first, then all of the second.
    Within one repetition the flow grows by blocking flows: sources by their
    distance to a source with room, then each pattern sends what it has left
    along falling distances. A pattern of one source needs no search beyond it.
    """
    names = sorted(patterns)
    room = list(quotas)
    sent: list[dict[int, int]] = [{} for _ in names]  # flow of a pattern into each of its sources
    users: list[dict[int, None]] = [{} for _ in quotas]  # shared patterns with flow into a source
    touching: list[list[int]] = [[] for _ in quotas]  # shared patterns that could use a source
    for i, name in enumerate(names):
        if len(name) > 1:
            for s in name:
                touching[s].append(i)
    taken = [0] * len(names)

    def push(i: int, s: int, amount: int) -> None:
        sent[i][s] = sent[i].get(s, 0) + amount
        if sent[i][s]:
            users[s][i] = None
        else:
            sent[i].pop(s)
            users[s].pop(i, None)

    for _ in range(repeats):
        left = {i: patterns[name] for i, name in enumerate(names) if name and patterns[name]}
        while left:
            # distance of a source to one with room, by handing over flow of patterns that use it
            far, layer = {s: 0 for s, r in enumerate(room) if r > 0}, [s for s, r in enumerate(room) if r > 0]
            while layer:
                nxt = []
                for s in layer:
                    for i in touching[s]:
                        for t in sent[i]:
                            if t not in far:
                                far[t] = far[s] + 1
                                nxt.append(t)
                layer = nxt
            moved = False
            dead: set[int] = set()  # sources that lead nowhere in this phase
            at: dict[int, Iterator[tuple[int, int]]] = {}

            def onward(s: int) -> Iterator[tuple[int, int]]:
                return iter([(i, t) for i in users[s] for t in names[i] if far.get(t, -1) == far[s] - 1])

            def drain(first: int, most: int) -> int:
                """Words up to ``most`` that find room from a source on (one path)."""
                path, s = [], first
                while True:
                    if far[s] == 0 and room[s] > 0:
                        amount = min([most, room[s], *(sent[i].get(a, 0) for a, i, _ in path)])
                        if amount:
                            for a, i, b in path:
                                push(i, a, -amount)
                                push(i, b, amount)
                            room[s] -= amount
                            return amount
                    step = None
                    if far[s] > 0:
                        for i, t in at.setdefault(s, onward(s)):
                            if t not in dead and sent[i].get(s, 0):
                                step = (i, t)
                                at[s] = itertools.chain([step], at[s])  # it may carry more
                                break
                    if step is None:
                        dead.add(s)
                        if not path:
                            return 0
                        s = path.pop()[0]
                        continue
                    path.append((s, step[0], step[1]))
                    s = step[1]

            for i in list(left):
                # nearest room first; a source of another distance than the nearest waits for its phase
                near = min((far[s] for s in names[i] if s in far), default=None)
                if near is None:
                    del left[i]  # nothing that is full now gets room again
                    continue
                for s in names[i]:
                    while left.get(i) and far.get(s) == near and s not in dead:
                        amount = drain(s, left[i])
                        if not amount:
                            break
                        push(i, s, amount)
                        taken[i] += amount
                        left[i] -= amount
                        moved = True
                    if not left.get(i):
                        left.pop(i, None)
                        break
            if not moved:
                break
    return {name: taken[i] for i, name in enumerate(names)}


def select(rows: DataFrame, plan: DataFrame, buckets: int, sized: DataFrame | None = None,
           small: bool = True) -> DataFrame:
    """Adds ``taken`` and ``copies`` to rows (pattern, doc_id, size, h, and others).

    ``sized``: the same rows without the others, to sum over.

    ``plan``: pattern, rounds (whole repetitions) and rest (words beyond them);
    ``small``: at most ``BROADCAST_PATTERNS`` rows, so that what has one row per pattern
    is broadcast and rows with their texts are not shuffled.
    ``copies`` counts whole documents: the one taken in part counts from half on.
    """
    sized = rows if sized is None else sized
    bucket = F.pmod(F.col("h"), F.lit(buckets))
    per = sized.groupBy("pattern", bucket.alias("b")).agg(F.sum("size").alias("words"))
    run = Window.partitionBy("pattern").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    cut = (per.withColumn("upto", F.sum("words").over(run)).join(plan, "pattern")
           .filter(F.col("upto") <= F.col("rest"))
           .groupBy("pattern").agg(F.max("b").alias("last"), F.max("upto").alias("used")))
    # buckets up to `last` fit whole; the next one that has words is filled row by row
    state = (plan.join(cut, "pattern", "left").withColumn("last", F.coalesce("last", F.lit(-1)))
             .withColumn("left", F.col("rest") - F.coalesce("used", F.lit(0))).drop("used"))
    sent = F.broadcast if small else (lambda df: df)
    nxt = (per.filter("words > 0").join(sent(state.select("pattern", "last")), "pattern")
           .filter(F.col("b") > F.col("last")).groupBy("pattern").agg(F.min("b").alias("open")))
    state = sent(state.join(nxt, "pattern", "left"))
    marked = rows.withColumn("b", bucket).join(state, "pattern")
    inside = F.coalesce(F.col("b") == F.col("open"), F.lit(False))
    order = Window.partitionBy("pattern").orderBy("h", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    partial = (marked.filter(inside)
               .withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
               .withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("left") - F.col("before")))))
    rest = (marked.filter(~inside).withColumn("before", F.lit(0).cast("long"))
            .withColumn("extra", F.when(F.col("b") <= F.col("last"), F.col("size")).otherwise(0)))
    out = rest.unionByName(partial)
    taken = F.col("rounds") * F.col("size") + F.col("extra")
    full = F.when(F.col("size") == 0, F.col("b") <= F.col("last")).otherwise(2 * F.col("extra") >= F.col("size"))
    return out.withColumn("taken", taken.cast("long")) \
        .withColumn("copies", (F.col("rounds") + F.when(full, 1).otherwise(0)).cast("int"))


def _keyed(docs: DataFrame, memberships: Column, seed: int, *others: Column | str) -> DataFrame:
    """doc_id, size, pattern and seeded order h per row."""
    return (docs.select("doc_id", *others, word_count().alias("size"),
                        F.array_sort(F.array_distinct(memberships)).alias("pattern"))
            .withColumn("h", F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("size"), F.lit(seed)), 1)))


def planned(sized: DataFrame, weights: Sequence[float], share: float, repeats: int) -> tuple[DataFrame, bool]:
    """(pattern, rounds, rest, source_size, target: the flow of each membership pattern; whether that is small).

    The flow runs on the driver, which holds about 1 KB per pattern (not per
    document): 1,000,000 patterns need 1 GB there.
    """
    rows = sized.groupBy("pattern").agg(F.sum("size").alias("words")).collect()
    # code point order of UTF-8 strings is the order of their bytes; null last
    names = sorted({s for r in rows for s in r["pattern"]},
                   key=lambda s: (s is None, b"" if s is None else s.encode("utf-8")))
    index = {s: i for i, s in enumerate(names)}
    key_of = {tuple(sorted(index[s] for s in r["pattern"])): r for r in rows}
    words = {k: r["words"] for k, r in key_of.items()}
    sizes = [sum(w for k, w in words.items() if i in k) for i in range(len(names))]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, float(repeats))
    flows = route(words, [round(t) for t in goal], repeats)

    def plan_row(k: tuple[int, ...]) -> tuple:
        rounds = min(repeats, flows[k] // words[k]) if words[k] else 0
        first = (sizes[k[0]], float(goal[k[0]])) if k else (0, 0.0)
        return (key_of[k]["pattern"], rounds, flows[k] - rounds * words[k], *first)

    plan = sized.sparkSession.createDataFrame(
        [plan_row(k) for k in sorted(words)],
        "pattern array<string>, rounds long, rest long, source_size long, target double")
    small = len(words) <= BROADCAST_PATTERNS
    return (F.broadcast(plan), True) if small else (stored(plan, "mix-plan"), False)


def mix(docs: DataFrame, memberships: Column, weights: Sequence[float] = WEIGHTS, share: float = 1.5,
        repeats: int = 2, seed: int = 17, buckets: int = 4096) -> DataFrame:
    """doc_id, size, sources, source_size, target, taken, copies per document.

    ``memberships`` is the array of a document's sources. ``source_size`` and
    ``target`` are those of its first source.
    """
    sized = stored(_keyed(docs, memberships, seed), "sized")
    plan, small = planned(sized, weights, share, repeats)
    chosen = select(sized, plan.select("pattern", "rounds", "rest"), buckets, small=small)
    return (chosen.join(plan.select("pattern", "source_size", "target"), "pattern")
            .select("doc_id", "size", F.col("pattern").alias("sources"), "source_size", "target", "taken", "copies"))


def repeat_rows(docs: DataFrame, memberships: Column, weights: Sequence[float] = WEIGHTS, share: float = 1.5,
                repeats: int = 2, seed: int = 17, buckets: int = 4096) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as its ``copies``."""
    sized = stored(_keyed(docs, memberships, seed), "sized")
    plan, small = planned(sized, weights, share, repeats)
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    chosen = select(_keyed(docs, memberships, seed, whole), plan.select("pattern", "rounds", "rest"), buckets, sized, small)
    return chosen.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))) \
        .select("row.*")
