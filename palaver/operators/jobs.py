"""Job table (J1-J13): creation, state rules, transitions, order, sweep.

The job table is a DataFrame with the columns of ``schemas.JOB`` (plus an
optional ``has_transcript`` flag; transcripts live in their own table).
Every operator is set based: a batch of requests is joined to the table
once instead of touching one job at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver import schemas as S
from palaver.plans.ordering import global_row_number
from palaver.plans.staging import stored


def _enum(status: Column) -> Column:
    """The service prints its enums as ``JobStatus.X``."""
    return F.concat(F.lit("JobStatus."), status)


def job_id_for(*parts: Column) -> Column:
    """Repeatable job id: SHA-256 of the submission's identifying parts."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


# -- J1 ---------------------------------------------------------------------

def create_pending(submissions: DataFrame, now: Column, id_cols: list[str],
                   url_col: str = "url", priority_col: str = "priority") -> DataFrame:
    """New PENDING jobs; priority defaults to MEDIUM."""
    return submissions.select(
        job_id_for(*[F.col(c) for c in id_cols], F.col(url_col)).alias("job_id"),
        F.col(url_col).alias("url"),
        F.lit("PENDING").alias("status"),
        F.coalesce(F.col(priority_col), F.lit("MEDIUM")).alias("priority"),
        now.alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"),
        F.lit(None).cast("string").alias("error_message"))


# -- J2 ---------------------------------------------------------------------

def state_violations(jobs: DataFrame) -> DataFrame:
    """One row per broken rule: (job_id, rule, message). Empty message = none."""
    has_msg = F.coalesce(F.col("error_message") != "", F.lit(False))
    has_t = F.coalesce(F.col("has_transcript"), F.lit(False))
    st = F.col("status")
    rules = [
        (1, (st == "COMPLETED") & ~has_t, "Completed jobs must have a transcript"),
        (2, (st == "FAILED") & ~has_msg, "Failed jobs must have an error message"),
        (3, has_t & (st != "COMPLETED"), "Transcript can only be present for completed jobs"),
        (4, has_msg & (st != "FAILED"), "Error message can only be present for failed jobs"),
    ]
    found = F.filter(
        F.array(*[F.when(cond, F.struct(F.lit(n).alias("rule"), F.lit(m).alias("message")))
                  for n, cond, m in rules]),
        lambda x: x.isNotNull())
    return (jobs.select("job_id", F.explode(found).alias("v"))
            .select("job_id", "v.rule", "v.message"))


# -- J3 ---------------------------------------------------------------------

def _transition(jobs: DataFrame, requests: DataFrame, legal_from: list[str], verb: str,
                new_status: str, now: Column, extra_check: Column | None = None,
                extra_message: str | None = None, set_started: bool = False,
                set_completed: bool = False, message_col: str | None = None) -> DataFrame:
    """All jobs, with the requested legal ones moved.

    Adds ``rejected_class`` and ``rejected_message`` for requested jobs that
    could not move; unrequested rows pass through unchanged. A job requested
    more than once is moved once, as the first request by its values asks; the
    repeats and ids without a job are in ``request_misses``.
    """
    extra = ([F.min(message_col).alias("_msg")] if message_col else []) \
        + ([F.max("has_transcript").alias("_has_t")] if "has_transcript" in requests.columns else [])
    req = requests.groupBy("job_id").agg(F.lit(True).alias("_req"), *extra)
    j = jobs.join(req, "job_id", "left")
    requested = F.coalesce(F.col("_req"), F.lit(False))
    state_ok = F.col("status").isin(*legal_from)
    extra_ok = extra_check if extra_check is not None else F.lit(True)
    move = requested & state_ok & extra_ok
    rejected_msg = (F.when(requested & ~state_ok,
                           F.concat(F.lit(f"Cannot mark job as {verb} from state "), _enum(F.col("status"))))
                    .when(requested & ~extra_ok, F.lit(extra_message)))
    rejected_cls = (F.when(requested & ~state_ok, F.lit("InvalidJobStateError"))
                    .when(requested & ~extra_ok, F.lit("ValueError")))
    cols = {
        "status": F.when(move, F.lit(new_status)).otherwise(F.col("status")),
        "started_at": F.when(move, now).otherwise(F.col("started_at")) if set_started else F.col("started_at"),
        "completed_at": (F.when(move, now).otherwise(F.col("completed_at"))
                         if set_completed else F.col("completed_at")),
        "error_message": (F.when(move, F.col("_msg")).otherwise(F.col("error_message"))
                          if message_col else F.col("error_message")),
    }
    if "_has_t" in j.columns:
        cols["has_transcript"] = F.when(move, F.lit(True)).otherwise(
            F.col("has_transcript") if "has_transcript" in jobs.columns else F.lit(False))
    keep = [c for c in jobs.columns if c not in cols]
    return j.select(*keep, *[v.alias(k) for k, v in cols.items()],
                    rejected_cls.alias("rejected_class"), rejected_msg.alias("rejected_message"))


def request_misses(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that move no job: unknown ids, and each repeat of an id.

    A repeat would find the job already moved, so it is an illegal step.
    """
    n = requests.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    known = n.join(jobs.select("job_id", F.lit(True).alias("_known")), "job_id", "left")
    unknown = F.col("_known").isNull()
    return (known.select("job_id", "n", unknown.alias("unknown"))
            .where(F.col("unknown") | (F.col("n") > 1))
            .select("job_id", F.when(F.col("unknown"), F.col("n")).otherwise(F.col("n") - 1).alias("n_requests"),
                    F.when(F.col("unknown"), "JobNotFoundError").otherwise("InvalidJobStateError").alias("error_class"),
                    F.when(F.col("unknown"), F.concat(F.lit("Job "), F.col("job_id"), F.lit(" not found")))
                     .otherwise(F.lit("Job was already moved by the same batch")).alias("message")))


def mark_processing(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    return _transition(jobs, ids, ["PENDING"], "processing", "PROCESSING", now, set_started=True)


def mark_completed(jobs: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """``requests``: job_id, has_transcript (a completion needs a transcript)."""
    return _transition(jobs, requests, ["PROCESSING"], "completed", "COMPLETED", now,
                       extra_check=F.coalesce(F.col("_has_t"), F.lit(False)),
                       extra_message="Must provide transcript when completing job",
                       set_completed=True)


def mark_failed(jobs: DataFrame, requests: DataFrame, now: Column,
                message_col: str = "error_message") -> DataFrame:
    """``requests``: job_id, error_message (must be non-empty)."""
    r = requests.select("job_id", F.col(message_col).alias("_m_in"))
    return _transition(jobs, r.withColumnRenamed("_m_in", "message"), ["PENDING", "PROCESSING"],
                       "failed", "FAILED", now,
                       extra_check=F.coalesce(F.col("_msg") != "", F.lit(False)),
                       extra_message="Must provide error message when failing job",
                       set_completed=True, message_col="message")


# -- J4 ---------------------------------------------------------------------

def fold_transitions(events: DataFrame) -> DataFrame:
    """Final state per job from an ordered event log (kind: start/complete/fail).

    Step 1 is the first ``start`` or ``fail``; after a ``start``, step 2 is
    the first later ``complete`` or ``fail``; every other row is illegal and
    ignored. Closed form: two partial aggregates and one join, no Python.
    The aggregates are ``min``/``min_by`` over fixed-width values (a kind
    code, the timestamp), so they plan as hash aggregates, not sorts.
    """
    code = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "complete", 2) \
        .when(F.col("kind") == "fail", 3)
    ev = events.select("job_id", "seq", "ts", code.alias("k"))
    o1 = F.when(F.col("k").isin(1, 3), F.col("seq"))
    first = (ev.groupBy("job_id")
             .agg(F.count(F.lit(1)).alias("n_events"), F.min(o1).alias("s1_seq"),
                  F.min_by("k", o1).alias("s1_k"), F.min_by("ts", o1).alias("s1_ts")))
    started = first.where(F.col("s1_k") == 1).select("job_id", "s1_seq")
    second = (ev.where(F.col("k").isin(2, 3))
              .join(started, "job_id")
              .where(F.col("seq") > F.col("s1_seq"))
              .groupBy("job_id")
              .agg(F.min("seq").alias("s2_seq"), F.min_by("k", "seq").alias("s2_k"),
                   F.min_by("ts", "seq").alias("s2_ts")))
    f = first.join(second, "job_id", "left")
    k1, k2 = F.col("s1_k"), F.col("s2_k")
    status = (F.when(F.col("s1_seq").isNull(), "PENDING").when(k1 == 3, "FAILED")
              .when(F.col("s2_seq").isNull(), "PROCESSING").when(k2 == 2, "COMPLETED")
              .otherwise("FAILED"))
    n_legal = F.col("s1_seq").isNotNull().cast("long") + F.col("s2_seq").isNotNull().cast("long")
    return f.select(
        "job_id", status.alias("status"),
        F.when(k1 == 1, F.col("s1_ts")).alias("started_at"),
        F.when(k1 == 3, F.col("s1_ts")).otherwise(F.col("s2_ts")).alias("completed_at"),
        "n_events", (F.col("n_events") - n_legal).alias("n_illegal"))


# -- J5 / J6 ----------------------------------------------------------------

def priority_rank(priority: Column, order: str = "documented") -> Column:
    """HIGH 1, MEDIUM 2, LOW 3; ``order='enum'`` gives the definition order."""
    names = (["HIGH", "MEDIUM", "LOW"] if order == "documented" else S.JOB_PRIORITIES)
    expr = F.when(F.lit(False), F.lit(None))
    for i, n in enumerate(names, start=1):
        expr = expr.when(priority == n, F.lit(i))
    return expr


def dispatch_order(jobs: DataFrame, order: str = "documented") -> DataFrame:
    """Position of every PENDING job in dispatch order (rank, created_at, job_id).

    Numbered with a range-partitioned sort plus per-partition offsets, so no
    single task holds the whole queue.
    """
    pending = jobs.where(F.col("status") == "PENDING").withColumn(
        "_rank", priority_rank(F.col("priority"), order))
    return global_row_number(pending, [F.col("_rank"), F.col("created_at"), F.col("job_id")],
                             "dispatch_pos").drop("_rank")


def claim_next(jobs: DataFrame, n: int, now: Column, order: str = "documented") -> DataFrame:
    """First ``n`` PENDING jobs in dispatch order, moved to PROCESSING.

    ``orderBy().limit(n)`` plans as TakeOrderedAndProject: a top-n per
    partition, then a merge of at most n rows per partition.
    """
    rank = priority_rank(F.col("priority"), order)
    top = (jobs.where(F.col("status") == "PENDING")
           .withColumn("_rank", rank)
           .orderBy("_rank", "created_at", "job_id").limit(n))
    return top.select(
        *[c for c in jobs.columns if c not in ("status", "started_at")],
        F.lit("PROCESSING").alias("status"), now.alias("started_at"),
        # at most n rows remain, so this window's single partition is bounded
        F.row_number().over(Window.orderBy("_rank", "created_at", "job_id"))
         .cast("long").alias("claim_pos"))


# -- J7 / J8 / J11 ----------------------------------------------------------

def get_jobs(jobs: DataFrame, ids: DataFrame, id_col: str = "job_id") -> DataFrame:
    """Lookup of requested ids; misses carry ``JobNotFoundError``."""
    req = ids.select(F.col(id_col).alias("requested_id")).distinct()
    j = req.join(jobs, req.requested_id == jobs.job_id, "left")
    found = F.col("job_id").isNotNull()
    return j.select(
        "requested_id", found.alias("found"),
        *[F.col(c) for c in jobs.columns if c != "job_id"],
        F.when(~found, F.lit("JobNotFoundError")).alias("error_class"),
        F.when(~found, F.concat(F.lit("Job "), F.col("requested_id"), F.lit(" not found"))).alias("message"))


def list_jobs(jobs: DataFrame, status: str | None = None) -> DataFrame:
    return jobs if status is None else jobs.where(F.col("status") == status)


def fail_system_error(jobs: DataFrame, ids: DataFrame, message: str, now: Column,
                      id_col: str = "job_id") -> DataFrame:
    """Per requested id: moved to FAILED with 'System error: ..', or why not.

    ``error_class`` keeps the root class (JobNotFoundError or
    InvalidJobStateError); ``message`` is the service's wrapped text.
    """
    req = ids.select(F.col(id_col).alias("requested_id")).distinct()
    j = req.join(jobs.select("job_id", "status"), req.requested_id == F.col("job_id"), "left")
    found = F.col("job_id").isNotNull()
    legal = found & F.col("status").isin("PENDING", "PROCESSING")
    text = S.MSG_SYSTEM_ERROR_PREFIX + message
    return j.select(
        "requested_id",
        F.when(legal, F.lit("FAILED")).otherwise(F.col("status")).alias("status"),
        F.when(legal, F.lit(text)).alias("error_message"),
        F.when(legal, now).alias("completed_at"),
        F.when(~found, F.lit("JobNotFoundError")).when(~legal, F.lit("InvalidJobStateError"))
         .alias("error_class"),
        # the service wraps both failures: JobError("Failed to update job: ..")
        F.concat(F.lit("Failed to update job: "),
                 F.when(~found, F.concat(F.lit("Job "), F.col("requested_id"), F.lit(" not found")))
                 .when(~legal, F.concat(F.lit("Cannot mark job as failed from state "),
                                        _enum(F.col("status"))))).alias("message"))


# -- J9 / J10 ---------------------------------------------------------------

def _sweep_flags(now: Column, timeout_minutes: int, retention_hours: int):
    st = F.col("status")
    stale = (st.isin("COMPLETED", "FAILED") & F.col("completed_at").isNotNull()
             & (F.col("completed_at") < F.timestamp_add("HOUR", F.lit(-retention_hours), now)))
    timed_out = ((st == "PROCESSING") & F.col("started_at").isNotNull()
                 & (F.col("started_at") < F.timestamp_add("MINUTE", F.lit(-timeout_minutes), now)))
    return F.coalesce(stale, F.lit(False)), F.coalesce(timed_out, F.lit(False))


def sweep(jobs: DataFrame, now: Column, timeout_minutes: int = S.JOB_TIMEOUT_MINUTES,
          retention_hours: int = S.RETENTION_HOURS) -> DataFrame:
    """Drop finished jobs older than the retention; fail stuck PROCESSING jobs.

    Strictly older (``now - t > limit``); rows without the time stay.
    """
    stale, timed_out = _sweep_flags(now, timeout_minutes, retention_hours)
    kept = jobs.where(~stale)
    return kept.select(
        *[F.when(timed_out, F.lit("FAILED")).otherwise(F.col(c)).alias(c) if c == "status"
          else F.when(timed_out, now).otherwise(F.col(c)).alias(c) if c == "completed_at"
          else F.when(timed_out, F.lit(S.MSG_TIMED_OUT)).otherwise(F.col(c)).alias(c)
          if c == "error_message" else F.col(c)
          for c in jobs.columns])


def sweep_stats(jobs: DataFrame, now: Column, timeout_minutes: int = S.JOB_TIMEOUT_MINUTES,
                retention_hours: int = S.RETENTION_HOURS, by: list[str] | None = None) -> DataFrame:
    """One row of counters (one per value of ``by``); a single partial aggregate over the table."""
    stale, timed_out = _sweep_flags(now, timeout_minutes, retention_hours)
    st = F.col("status")
    return jobs.groupBy(*by or []).agg(
        F.count(F.lit(1)).alias("initial_job_count"),
        F.count_if(~stale).alias("final_job_count"),
        F.count_if(stale & (st == "COMPLETED")).alias("stale_completed_removed"),
        F.count_if(stale & (st == "FAILED")).alias("stale_failed_removed"),
        F.count_if(timed_out).alias("processing_timed_out"))


# -- J12 / J13 --------------------------------------------------------------

def classify_errors(errors: DataFrame, taxonomy: DataFrame, class_col: str = "error_class",
                    causes_col: str | None = None) -> DataFrame:
    """Class, parent and status code per error row; unknown classes give 500.

    ``taxonomy`` has a fixed 20 rows, so it is broadcast. With ``causes_col``
    (an array of messages) the root cause is its last entry.
    """
    e = errors.where(F.col(class_col).isNotNull())
    if causes_col:
        e = e.withColumn("root_cause", F.try_element_at(F.col(causes_col), F.lit(-1)))
    t = taxonomy.withColumnRenamed("error_class", "_cls")
    j = e.join(F.broadcast(t), e[class_col] == t["_cls"], "left")
    return j.select(*e.columns, "parent_class",
                    F.coalesce(F.col("status_code"), F.lit(500)).alias("status_code"))


def root_causes(errors: DataFrame) -> DataFrame:
    """Error rows (error_id, error_class, cause_id) with the end of their chain of causes.

    Adds ``root_id``, ``root_class`` and ``depth`` (links to the root). Chains of any
    depth take a number of joins that grows with its logarithm: every round
    each link reaches as far again. A cause that is not in the table ends its
    chain before it; a chain that runs into a circle has no root (nulls).
    ``error_id`` is unique.
    """
    base = stored(errors.select("error_id", "error_class", "cause_id"), "errors")
    known = base.select(F.col("error_id").alias("_id"))
    links = stored(base.join(known, base["cause_id"] == known["_id"], "left")
                   .select("error_id", F.col("_id").alias("up"), F.when(F.col("_id").isNotNull(), 1).otherwise(0).cast("long").alias("depth")),
                   "error-links")
    left, rounds = None, 0
    while True:
        far = links.where("up is not null").select(F.col("error_id").alias("_id"), F.col("up").alias("_up"),
                                                   F.col("depth").alias("_depth"))
        # `up` moves on to its own `up`; at a root it stays
        longer = links.join(far, links["up"] == far["_id"], "left")
        moving = longer.where("_up is not null").count()
        # after log2(rows) rounds only links on the way into a circle still move
        if moving == 0 or (left is not None and rounds > left):
            break
        if left is None:
            left = max(1, base.count()).bit_length()
        links = stored(longer.select("error_id", F.coalesce("_up", "up").alias("up"),
                                     (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")), "error-links")
        rounds += 1
    ends = links.join(links.where("up is null").select(F.col("error_id").alias("_end")), F.col("up") == F.col("_end"), "left")
    is_root = F.col("up").isNull()
    found = ends.select("error_id", F.when(is_root, F.col("error_id")).otherwise(F.col("_end")).alias("root_id"), "depth")
    roots = base.select(F.col("error_id").alias("_id"), F.col("error_class").alias("root_class"))
    return (base.join(found, "error_id").join(roots, F.col("root_id") == F.col("_id"), "left")
            .select("error_id", "error_class", "cause_id", "root_id", "root_class",
                    F.when(F.col("root_id").isNotNull(), F.col("depth")).alias("depth")))


def error_ancestors(taxonomy: DataFrame) -> DataFrame:
    """(error_class, ancestor, level) of the class-parent table, every class its own ancestor at level 0."""
    return taxonomy.sparkSession.sql("""
        WITH RECURSIVE up (error_class, ancestor, level, path) AS (
          SELECT error_class, error_class, 0, array(error_class) FROM {taxonomy}
          UNION ALL
          SELECT u.error_class, t.parent_class, u.level + 1, array_append(u.path, t.parent_class)
          FROM up u JOIN {taxonomy} t ON t.error_class = u.ancestor
          WHERE t.parent_class IS NOT NULL AND NOT array_contains(u.path, t.parent_class))
        SELECT error_class, ancestor, level FROM up""", taxonomy=taxonomy)


def error_rollup(caused: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Per class: rows of the class itself, rows it is the root of, and both with all classes below it.

    ``caused`` is as from ``root_causes``. Classes without a row and classes that
    the taxonomy does not know (no parent, status code 500) are reported too.
    """
    own = caused.where("error_class is not null").groupBy("error_class").agg(F.count(F.lit(1)).alias("n"))
    rooted = caused.where("root_class is not null").groupBy(F.col("root_class").alias("error_class")) \
        .agg(F.count(F.lit(1)).alias("n_root"), F.max("depth").alias("deepest"))
    counts = own.join(rooted, "error_class", "full")
    counts = counts.select("error_class", F.coalesce("n", F.lit(0)).alias("n"),
                           F.coalesce("n_root", F.lit(0)).alias("n_root"), "deepest")
    lines = counts.join(F.broadcast(error_ancestors(taxonomy)), "error_class", "left") \
        .select(F.coalesce("ancestor", "error_class").alias("of"), "n", "n_root")
    below = lines.groupBy("of").agg(F.sum("n").alias("n_below"), F.sum("n_root").alias("n_root_below"))
    t = F.broadcast(taxonomy)
    classes = taxonomy.select("error_class").unionByName(counts.select("error_class")).distinct()
    return (classes.join(counts, "error_class", "left").join(below, classes["error_class"] == below["of"], "left")
            .join(t, "error_class", "left")
            .select("error_class", "parent_class", F.coalesce("status_code", F.lit(500)).alias("status_code"),
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_root", "n_below", "n_root_below")], "deepest"))


def error_counts(classified: DataFrame, class_col: str = "error_class") -> DataFrame:
    return (classified.groupBy(class_col, "parent_class", "status_code")
            .agg(F.count(F.lit(1)).alias("n")))


def status_overview(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n"))
