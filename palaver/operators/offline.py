"""Offline model operators (M1-M4): summary, topics, key points, type.

They stand in for the hosted model with plain corpus statistics, produce
the shapes the model is asked for, and pass the metadata checks E1-E4.

Plans: what depends on one document only (sentence scores, term counts, cue
words) is computed inside its row, in one Arrow pass or by array functions, so
M1, M3 and M4 shuffle nothing. M2 shuffles (document, word, count) rows for the
document frequencies and the best words per document; the corpus size is a
scalar subquery, not a join.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver import schemas as S
from palaver.functions.text import SENTENCE_PATTERN, WORD_PATTERN, strip, words
from palaver.plans.ordering import top_k_per_group
from palaver.plans.staging import stored
from palaver.session import ship_package

# Cue words per conversation type (enum order; ties go to
# the earlier type, no hit gives CASUAL).
TYPE_CUES = {
    "EDUCATIONAL": ["lesson", "lecture", "learn", "learning", "student", "students", "teacher",
                    "course", "study", "homework", "exam", "professor", "explain", "theory",
                    "equation", "chapter", "school", "university"],
    "FORMAL": ["hereby", "pursuant", "regarding", "sincerely", "committee", "agenda",
               "chairperson", "resolution", "motion", "ceremony", "official", "respectfully"],
    "COMEDY": ["joke", "jokes", "funny", "laugh", "laughter", "hilarious", "comedy",
               "comedian", "punchline", "haha", "prank"],
    "PROFESSIONAL": ["meeting", "project", "client", "clients", "revenue", "sales", "quarter",
                     "budget", "deadline", "strategy", "manager", "stakeholder", "roadmap",
                     "marketing"],
    "CASUAL": ["hey", "cool", "yeah", "dude", "awesome", "weekend", "lunch", "chill",
               "party", "movie"],
    "INTERVIEW": ["interview", "candidate", "position", "resume", "experience", "hiring",
                  "applicant", "qualifications", "salary", "recruiter"],
}


PICK = "struct<pos:long,rank:long,n_words:long,kept:long,running_words:long,score:double,sentence:string,summary:string>"
_BATCH = 256
LATIN_1_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
OTHER_THAN_LATIN_1 = re.compile("[^\x00-\xff]")


def best_sentences(text: str, k: int, k_summary: int, max_tokens: int) -> list[dict]:
    """The ``k`` best sentences of one text, by round(score, 9) desc, then position.

    score = mean in-document frequency of a sentence's words / words in the
    document. The first ``k_summary`` also carry ``summary``, the sentence as far
    as it fits ``max_tokens`` words in rank order: the one that crosses the limit
    is cut after its last word that fits, those after it have none.
    """
    import regex
    found = regex.findall(SENTENCE_PATTERN, text)
    terms = [regex.findall(WORD_PATTERN, s.lower()) for s in found]
    tf = Counter(w for ws in terms for w in ws)
    total = tf.total()
    scored = [(sum(tf[w] for w in ws) / len(ws) / total, pos) for pos, ws in enumerate(terms) if ws]
    scored.sort(key=lambda x: (-math.floor(x[0] * 1e9 + 0.5), x[1]))
    out, used = [], 0
    for rank, (score, pos) in enumerate(scored[:k], start=1):
        n = len(terms[pos])
        fits = min(n, max_tokens - used) if rank <= k_summary else 0
        used += fits
        cut = found[pos]
        if fits < n:
            ends = [m.end() for m in regex.finditer(WORD_PATTERN, cut)]
            cut = cut[:ends[fits - 1]] if fits else None
        out.append({"pos": pos, "rank": rank, "n_words": n, "kept": fits, "running_words": used, "score": score,
                    "sentence": found[pos], "summary": cut})
    return out


def sentence_picks(docs: DataFrame, k: int, k_summary: int, max_tokens: int = S.MAX_SUMMARY_TOKENS,
                   id_col: str = "job_id", text_col: str = "text") -> DataFrame:
    """(id, picks): one row per document, the best sentences in rank order; no shuffle."""
    ship_package(docs.sparkSession)
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, picks array<{PICK}>"

    def run(batches):
        import pyarrow as pa
        kind = pa.list_(pa.struct([("pos", pa.int64()), ("rank", pa.int64()), ("n_words", pa.int64()),
                                   ("kept", pa.int64()), ("running_words", pa.int64()), ("score", pa.float64()),
                                   ("sentence", pa.string()), ("summary", pa.string())]))
        for b in batches:
            for lo in range(0, b.num_rows, _BATCH):
                part = b.slice(lo, _BATCH)
                picks = [best_sentences(t or "", k, k_summary, max_tokens) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(picks, kind)], names=["id", "picks"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def extractive_summary(docs: DataFrame, k: int = 3, max_tokens: int = S.MAX_SUMMARY_TOKENS,
                       id_col: str = "job_id", text_col: str = "text") -> DataFrame:
    """M1 (exploded): chosen sentences, the text cut at ``max_tokens`` words.

    Every document with a word has at least one; ``n_words`` counts the words kept.
    """
    p = sentence_picks(docs, k, k, max_tokens, id_col, text_col).select("id", F.explode("picks").alias("p"))
    return p.where(F.col("p.summary").isNotNull()).select(
        F.col("id").alias(id_col), "p.pos", "p.rank",
        F.col("p.kept").alias("n_words"), "p.running_words", "p.score",
        F.col("p.summary").alias("sentence"))


def _summary(picks: Column) -> Column:
    """Chosen sentences in position order, trimmed, of a ``picks`` array."""
    kept = F.filter(picks, lambda p: p["summary"].isNotNull())
    placed = F.array_sort(F.transform(kept, lambda p: F.struct(p["pos"].alias("pos"), p["summary"].alias("s"))))
    return F.array_join(F.transform(placed, lambda p: strip(p["s"])), " ")


def summary_text(docs: DataFrame, k: int = 3, max_tokens: int = S.MAX_SUMMARY_TOKENS, id_col: str = "job_id",
                 text_col: str = "text") -> DataFrame:
    """M1 (one row per document with a word): chosen sentences in position order, trimmed."""
    return sentence_picks(docs, k, k, max_tokens, id_col, text_col).where(F.size("picks") > 0) \
        .select(F.col("id").alias(id_col), _summary(F.col("picks")).alias("summary_text"))


def key_points(docs: DataFrame, k: int = 5, id_col: str = "job_id", text_col: str = "text") -> DataFrame:
    """M3 (exploded): the ``k`` best sentences in rank order, trimmed."""
    return (sentence_picks(docs, k, 0, 0, id_col, text_col).select("id", F.explode("picks").alias("p"))
            .select(F.col("id").alias(id_col), "p.rank", strip(F.col("p.sentence")).alias("key_point")))


def term_counts(docs: DataFrame, min_letters: int = 1, id_col: str = "job_id", text_col: str = "text") -> DataFrame:
    """(id, word, f): words of ``min_letters`` or more per document; counted inside the row."""
    ship_package(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        import regex
        pattern = regex.compile(WORD_PATTERN)
        # a text of Latin-1 characters alone has no other letters than these
        plain = re.compile(f"[{LATIN_1_LETTERS}]{{{max(min_letters, 1)},}}")

        def found(text: str) -> list[str]:
            if OTHER_THAN_LATIN_1.search(text):
                return [w for w in pattern.findall(text) if len(w) >= min_letters]
            return plain.findall(text)

        for b in batches:
            for lo in range(0, b.num_rows, _BATCH):
                part = b.slice(lo, _BATCH)
                counts = [Counter(found((t or "").lower())) for t in part.column(1).to_pylist()]
                at = pa.array([i for i, c in enumerate(counts) for _ in c], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), pa.array([w for c in counts for w in c], pa.string()),
                     pa.array([n for c in counts for n in c.values()], pa.int64())], names=["id", "word", "f"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"id {docs.schema[id_col].dataType.simpleString()}, word string, f long")


def topics(docs: DataFrame, k: int = 5, min_letters: int = 4, id_col: str = "job_id",
           text_col: str = "text") -> DataFrame:
    """M2 (exploded): ``k`` topic words per document with a confidence in [0, 1].

    score = f * ln((1 + N) / (1 + df)); confidence = score / best score of
    the document, 0 when the best score is 0. The rows are (document, word,
    count); a word found in most documents is a hot key of the join, which the
    skew join of AQE splits.
    """
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    f = stored(term_counts(docs, min_letters, id_col, text_col), "term-counts")  # read twice, counted once
    df_ = f.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # never let the planner broadcast these rows; of the two sides only that of the different words is
    # held, by partition, and the many rows need no sort
    scored = f.join(df_.hint("shuffle_hash"), "word").select(
        "id", "word", (F.col("f") * F.log((F.lit(1) + n_docs) / (F.lit(1) + F.col("df")))).alias("score"))
    # a column of its own: the sort would round anew in every comparison
    rounded = scored.withColumn("_by", F.round("score", 9))
    top = top_k_per_group(rounded, ["id"], [F.col("_by").desc(), F.col("word")], k, name="rank").drop("_by")
    best = F.max("score").over(Window.partitionBy("id"))
    return top.select(F.col("id").alias(id_col), "rank", "word", "score",
                      F.when(best > 0, F.col("score") / best).otherwise(F.lit(0.0)).alias("confidence"))


def conversation_type(docs: DataFrame, cues: dict[str, list[str]] = TYPE_CUES,
                      id_col: str = "job_id", text_col: str = "text") -> DataFrame:
    """M4: type with the most cue-word hits (ties in enum order, none gives CASUAL).

    A projection: the cue words among a row's words, counted per type.
    """
    all_cues = sorted({w for c in cues.values() for w in c})
    hits = docs.select(F.col(id_col), F.coalesce(words(F.col(text_col)), F.array().cast("array<string>")).alias("_w")) \
        .select(id_col, F.filter("_w", lambda w: w.isin(*all_cues)).alias("_w"))

    def counted(position: int, kind: str) -> Column:
        n = F.size(F.filter("_w", lambda w: w.isin(*cues[kind])))
        # the most hits first, then the earlier type
        return F.struct(n.cast("long").alias("hits"), F.lit(-position).alias("place"), F.lit(kind).alias("kind"))

    best = F.array_max(F.array(*[counted(i, t) for i, t in enumerate(S.CONVERSATION_TYPES)]))
    return hits.select(id_col, best.alias("_b")).select(
        id_col, F.col("_b.hits").alias("hits"),
        F.when(F.col("_b.hits") > 0, F.col("_b.kind")).otherwise(F.lit("CASUAL")).alias("conversation_type"))


def metadata_reply(docs: DataFrame, picks: DataFrame, id_col: str = "job_id", text_col: str = "text",
                   n_topics: int = 5, n_points: int = 5) -> DataFrame:
    """A metadata reply (JSON text) per document built from M2-M4, as a model would send.

    ``picks``: ``sentence_picks`` of the documents with at least ``n_points``.
    """
    t = (topics(docs, n_topics, id_col=id_col, text_col=text_col)
         .groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "word", "confidence"))).alias("_t")))
    points = F.transform(F.filter("picks", lambda p: p["rank"] <= n_points), lambda p: strip(p["sentence"]))
    kp = picks.select(F.col("id").alias(id_col), points.alias("_k"))
    ct = conversation_type(docs, id_col=id_col, text_col=text_col)
    j = ct.join(t, id_col, "left").join(kp, id_col, "left")
    body = F.struct(
        F.col("conversation_type"),
        F.coalesce(F.transform("_t", lambda x: F.struct(x["word"].alias("name"),
                                                        x["confidence"].alias("confidence_score"))),
                   F.array().cast("array<struct<name:string,confidence_score:double>>")).alias("topics"),
        F.coalesce("_k", F.array().cast("array<string>")).alias("key_points"))
    return j.select(F.col(id_col).alias("transcript_id"), F.to_json(body).alias("raw"))


def summary_of(picks: DataFrame) -> DataFrame:
    """(transcript_id, raw): the summary text of each row of ``sentence_picks``, '' without a word."""
    return picks.select(F.col("id").alias("transcript_id"), _summary(F.col("picks")).alias("raw"))
