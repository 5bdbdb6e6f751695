"""Model calls (P3, P8): batch completion through a client the caller supplies.

The engine ships no network client. ``client_factory()`` is called once per
partition and returns ``client(system_prompt, user_content, max_tokens,
temperature) -> {"choices": [...], "prompt_tokens": n, "completion_tokens":
n, "model": name}``; a failed call raises ``CompletionError(kind, text)``
(kinds: timeout, rate_limit, connection, api_error, client_error, other).

A retried task calls the model again, so results are stored. A store has

* ``requests/run=R/chunk=c``: a run's requests, written once, by chunk, before
  the first call, the only time that their texts are shuffled; a chunk's job
  reads its own folder and nothing else, the callers sharing its files;
* ``results/run=R/chunk=c``: what the calls of a chunk gave;
* ``log``: one row when a run's requests are complete (``begun``, with its
  chunks) and one when a chunk's results are (``done``, the commit mark).

Readers see only marked chunks, so a chunk that a lost driver left half done is
written anew, and a restart finds what is open in the log without a look at
requests or results. Outcomes are keyed by ``request_id``; ids that have a final
outcome are not asked again, those that failed for a passing reason (``RETRY``) are
asked by the next run as a further attempt. ``compact`` folds the finished runs
of a store into one. A store has one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.functions import errors as E
from palaver.functions.replies import clean_reply, join_choices
from palaver.plans.staging import stored
from palaver.session import ship_package

RETRY = ("timeout", "rate_limit", "connection")
FILES_PER_CALLER = 4  # of a chunk, so that its callers get about equal shares without a shuffle

RESULT = T.StructType([
    T.StructField("request_id", T.StringType(), False),
    T.StructField("job_id", T.StringType(), False),
    T.StructField("task", T.StringType(), False),
    T.StructField("expect_json", T.BooleanType(), False),
    T.StructField("model", T.StringType(), True),
    T.StructField("choices", T.ArrayType(T.StringType()), True),
    T.StructField("prompt_tokens", T.LongType(), True),
    T.StructField("completion_tokens", T.LongType(), True),
    T.StructField("total_tokens", T.LongType(), True),
    T.StructField("error_kind", T.StringType(), True),
    T.StructField("error_text", T.StringType(), True),
    T.StructField("attempt", T.LongType(), False),
])


class CompletionError(Exception):
    def __init__(self, kind: str, text: str = ""):
        super().__init__(text)
        self.kind = kind
        self.text = text


def _runner(client_factory: Callable[[], Callable]):
    cols = [f.name for f in RESULT.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                row = {"request_id": r.request_id, "job_id": r.job_id, "task": r.task,
                       "expect_json": bool(r.expect_json), "model": None, "choices": None,
                       "prompt_tokens": None, "completion_tokens": None, "total_tokens": None,
                       "error_kind": None, "error_text": None, "attempt": int(r.attempt)}
                try:
                    resp = client(r.system_prompt, r.user_content, int(r.max_tokens), float(r.temperature))
                    p, c = int(resp.get("prompt_tokens", 0)), int(resp.get("completion_tokens", 0))
                    choices = resp.get("choices", [])
                    if any(x is None for x in choices):
                        raise TypeError("a choice has no content")
                    row.update(model=resp.get("model"), choices=[str(x) for x in choices],
                               prompt_tokens=p, completion_tokens=c, total_tokens=p + c)
                except CompletionError as e:
                    row.update(error_kind=e.kind, error_text=e.text)
                except Exception as e:  # any other failure is a row outcome too
                    row.update(error_kind="other", error_text=str(e))
                out.append(row)
            yield pd.DataFrame(out, columns=cols)
    return run


LOG = "run string, kind string, chunk int, chunks array<int>, replaces array<string>"


def _log(spark: SparkSession, store: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(f"{store}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def _mark(spark: SparkSession, store: str, run: str, kind: str, chunk: int | None = None,
          chunks: list[int] | None = None, replaces: list[str] | None = None) -> None:
    spark.createDataFrame([(run, kind, chunk, chunks, replaces)], LOG).coalesce(1).write.mode("append").parquet(f"{store}/log")


def open_chunks(spark: SparkSession, store: str) -> list[tuple[str, int]]:
    """(run, chunk) of begun runs without a commit mark; reads the log alone."""
    log = _log(spark, store)
    begun = log.where("kind = 'begun'").select("run", F.explode("chunks").alias("chunk"))
    rows = begun.join(log.where("kind = 'done'").select("run", "chunk"), ["run", "chunk"], "left_anti")
    return sorted((r["run"], r["chunk"]) for r in rows.collect())


def chunk_requests(spark: SparkSession, store: str, run: str, chunk: int) -> DataFrame:
    """The requests of one chunk: a scan of its own folder."""
    return spark.read.parquet(f"{store}/requests/run={run}/chunk={chunk}")


def outcomes(spark: SparkSession, store: str) -> DataFrame:
    """The last attempt of every request in the committed chunks of a store."""
    log = _log(spark, store)
    replaced = log.select(F.explode("replaces").alias("run"))
    done = log.where("kind = 'done'").join(replaced, "run", "left_anti").select("run", "chunk").distinct()
    schema = T.StructType([*RESULT.fields, T.StructField("run", T.StringType()), T.StructField("chunk", T.IntegerType())])
    try:
        rows = spark.read.schema(schema).parquet(f"{store}/results")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    w = Window.partitionBy("request_id").orderBy(F.col("attempt").desc())
    return (rows.join(done, ["run", "chunk"], "left_semi").drop("run", "chunk")
            .withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r"))


def _answer(spark: SparkSession, store: str, run: str, chunk: int, client_factory, concurrency: int) -> None:
    (chunk_requests(spark, store, run, chunk).coalesce(concurrency)
     .mapInPandas(_runner(client_factory), RESULT)
     .write.mode("overwrite").parquet(f"{store}/results/run={run}/chunk={chunk}"))
    _mark(spark, store, run, "done", chunk)


def complete(requests: DataFrame, client_factory: Callable[[], Callable], store: str,
             concurrency: int = 8, rows_per_task: int = 10_000, retry: tuple[str, ...] = RETRY,
             job_ids: DataFrame | None = None) -> DataFrame:
    """Results for ``requests`` (P2 rows), calling the client only where needed.

    ``job_ids`` (column ``job_id``) names the jobs to ask for; without it all are. A caller that
    filters ``requests`` by a join instead has their texts shuffled by that join as well.

    At most ``concurrency`` callers at a time, each with about ``rows_per_task``
    requests per chunk; every chunk is committed before the next begins. Chunks
    that an earlier call left open are finished first.
    """
    spark = requests.sparkSession
    ship_package(spark)
    for run, chunk in open_chunks(spark, store):
        _answer(spark, store, run, chunk, client_factory, concurrency)
    ids = requests.select("request_id", "job_id")
    if job_ids is not None:  # an inner join: the optimizer would put a semi join below the hashes of the texts
        ids = ids.join(job_ids.select("job_id").distinct(), "job_id")
    ids = stored(ids.select("request_id").distinct(), "request-ids")
    before = outcomes(spark, store).select("request_id", "error_kind", F.col("attempt").alias("_before"))
    todo = stored(ids.join(before, "request_id", "left")
                  .where(F.col("_before").isNull() | F.col("error_kind").isin(*retry))
                  .select("request_id", (F.coalesce("_before", F.lit(0)) + 1).alias("attempt")), "requests-to-send")
    n = todo.count()
    if n:
        run, chunks = uuid.uuid4().hex, -(-n // (concurrency * rows_per_task))
        path = f"{store}/requests/run={run}"
        # a task of the shuffle writes one file of one chunk; the join and the choice among equal ids need no
        # further shuffle, as both sides have its partitions (a join raises fewer than the session's number to that)
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        files = max(concurrency * FILES_PER_CALLER, -(-least // chunks))
        n_tasks = chunks * files
        place = F.pmod(F.hash("request_id"), F.lit(n_tasks))
        (requests.repartition(n_tasks, "request_id").hint("merge")
         .join(todo.repartition(n_tasks, "request_id"), "request_id").dropDuplicates(["request_id"])
         .withColumn("chunk", F.floor(place / files).cast("int"))
         .write.partitionBy("chunk").option("compression", "zstd").parquet(path))  # texts: a third less than by default
        there = sorted(r["chunk"] for r in spark.read.parquet(path).select("chunk").distinct().collect())
        _mark(spark, store, run, "begun", chunks=there)
        for chunk in there:
            _answer(spark, store, run, chunk, client_factory, concurrency)
    return outcomes(spark, store).join(ids, "request_id", "left_semi")


def compact(spark: SparkSession, store: str) -> list[str]:
    """Fold the finished runs of a store into one; the runs that are no longer read are returned.

    The new run counts from its commit mark on, which names the runs it
    replaces, so a reader sees the old ones or the new one. Folders of the
    returned runs may be deleted once no reader holds an older plan.
    """
    open_runs = {run for run, _ in open_chunks(spark, store)}
    if open_runs:
        raise ValueError("finish the open runs before compacting: " + ", ".join(sorted(open_runs)))
    log = _log(spark, store)
    live = sorted(r["run"] for r in log.where("kind = 'done'").select("run").distinct()
                  .join(log.select(F.explode("replaces").alias("run")), "run", "left_anti").collect())
    if not live:
        return []
    run = uuid.uuid4().hex
    outcomes(spark, store).write.parquet(f"{store}/results/run={run}/chunk=0")
    _mark(spark, store, run, "done", 0, replaces=live)
    return live


def replies(results: DataFrame) -> DataFrame:
    """P4 + P5 + P7 over stored results: cleaned reply text or the error class."""
    failed = F.col("error_kind").isNotNull()
    return results.select(
        "request_id", "job_id", "task", "expect_json", "model",
        F.when(~failed, clean_reply(join_choices(F.col("choices")))).alias("raw"),
        E.client_error_class(F.col("error_kind"), F.col("error_text")).alias("error_class"),
        E.client_error_message(F.col("error_kind"), F.col("error_text")).alias("message"))


def usage_report(results: DataFrame) -> DataFrame:
    """Calls, failures and token sums per task and model."""
    return (results.groupBy("task", "model")
            .agg(F.count(F.lit(1)).alias("n_calls"),
                 F.count_if(F.col("error_kind").isNotNull()).alias("n_failed"),
                 F.sum("prompt_tokens").alias("prompt_tokens"),
                 F.sum("completion_tokens").alias("completion_tokens"),
                 F.sum("total_tokens").alias("total_tokens")))
