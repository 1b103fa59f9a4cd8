"""The ingest job ledger as a fold over events.

An event is (job_id, seq, kind, n, final).  The states of a job are few and its counters
are sums, but a status guards what later events may do, so the fold is sequential per
job.  Its events are ordered in an array and folded by one native aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIVE = ("planning", "running", "completed_with_errors")


def _state(**changes) -> Column:
    fields = ("status", "total_titles", "processed_titles", "error_count", "processed_nodes", "dropped")
    return F.struct(*[changes[f].alias(f) for f in fields])


def step(s: Column, e: Column) -> Column:
    """State after an event. Guards read the state before it."""
    live = s["status"].isin(*LIVE)
    kind, n = e["kind"], e["n"]
    planned = (kind == "planned") & (s["status"] == "planning")
    titles, error = (kind == "titles") & live, (kind == "error") & live
    nodes, failed = kind == "nodes", kind == "plan_failed"
    abort = (kind == "abort") & s["status"].isin("planning", "running")
    terminal = F.when(s["error_count"] > 0, "completed_with_errors").otherwise("completed")
    status = (
        F.when(planned & (n == 0), "completed").when(planned & (s["processed_titles"] >= n), terminal).when(planned, "running")
        .when(titles & (s["status"] != "planning") & (s["processed_titles"] + n >= s["total_titles"]), terminal)
        .when(error & e["final"], "failed").when(failed, "failed").when(abort, "aborted").otherwise(s["status"])
    )
    return _state(
        status=status,
        total_titles=F.when(planned, n).otherwise(s["total_titles"]),
        processed_titles=F.when(titles, s["processed_titles"] + n).otherwise(s["processed_titles"]),
        error_count=F.when(error | failed, s["error_count"] + 1).otherwise(s["error_count"]),
        processed_nodes=F.when(nodes, s["processed_nodes"] + n).otherwise(s["processed_nodes"]),
        dropped=F.when(planned | titles | error | nodes | failed | abort, s["dropped"]).otherwise(s["dropped"] + 1),
    )


def initial() -> Column:
    zero = F.lit(0).cast("long")
    return _state(status=F.lit("planning"), total_titles=zero, processed_titles=zero, error_count=zero, processed_nodes=zero, dropped=zero)


def fold_jobs(events: DataFrame) -> DataFrame:
    """job_id, status, total_titles, processed_titles, error_count, processed_nodes, dropped (events whose guard failed)."""
    return _folded(events).select("job_id", "status", "total_titles", "processed_titles", "error_count", "processed_nodes", "dropped")


def _folded(events: DataFrame) -> DataFrame:
    """fold_jobs, with ended_at and ended_as: the event after which the job was no longer live, and its status then."""
    n = F.coalesce(F.col("n").cast("long"), F.lit(0).cast("long"))
    e = F.struct("seq", "kind", n.alias("n"), F.coalesce("final", F.lit(False)).alias("final"))
    nodes = F.col("kind") == "nodes"
    listed = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.when(~nodes, e))).alias("es"), F.sum(F.when(nodes, n).otherwise(0)).alias("__nodes"))
    seq = events.select("seq").schema[0].dataType

    def follow(acc: Column, x: Column) -> Column:
        after = step(acc["s"], x)
        over = acc["at"].isNull() & ~after["status"].isin(*LIVE)
        return F.struct(after.alias("s"), F.when(over, x["seq"]).otherwise(acc["at"]).alias("at"), F.when(over, after["status"]).otherwise(acc["as"]).alias("as"))

    folded = listed.select("job_id", "__nodes", F.aggregate("es", F.struct(initial().alias("s"), F.lit(None).cast(seq).alias("at"), F.lit(None).cast("string").alias("as")), follow).alias("x"))
    state = folded.select("job_id", "x.s.*", F.col("x.at").alias("ended_at"), F.col("x.as").alias("ended_as"), "__nodes")
    return state.withColumn("processed_nodes", F.col("processed_nodes") + F.col("__nodes")).drop("__nodes")


def fold_units(units: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, unit_id, status, total_nodes, processed_nodes, error of the units of jobs.

    units: events (job_id, unit_id, seq, kind, n, status, error) of the kinds ``created``, ``running`` (of n nodes),
    ``nodes`` and ``done`` (with a status and perhaps an error, cut to 1000 characters); jobs: events as in
    fold_jobs.  ``running`` and ``done`` count while the job is live.  An abort of the job takes its pending and
    running units along; they keep an error that they have.  Units that weren't created are left out.
    Only sums and latest values by unit are taken, so a job of very many units is no group.
    """
    job = _folded(jobs).select("job_id", "ended_at", (F.col("ended_as") == "aborted").alias("aborted"))
    u = units.join(job, "job_id", "left")
    live = F.col("ended_at").isNull() | (F.col("seq") <= F.col("ended_at"))
    kind, n = F.col("kind"), F.coalesce(F.col("n").cast("long"), F.lit(0).cast("long"))
    running, done = live & (kind == "running"), live & (kind == "done")
    last = u.groupBy("job_id", "unit_id").agg(
        F.max(kind == "created").alias("created"),
        F.max_by(F.when(done, F.col("status")).otherwise("running"), F.when(running | done, F.col("seq"))).alias("status"),
        F.max_by(F.substring("error", 1, 1000), F.when(done, F.col("seq"))).alias("error"),
        F.coalesce(F.max_by(n, F.when(running, F.col("seq"))), F.lit(0)).cast("long").alias("total_nodes"),
        F.sum(F.when(kind == "nodes", n).otherwise(0)).alias("processed_nodes"),
        F.max(F.coalesce("aborted", F.lit(False))).alias("aborted"),
    )
    status = F.coalesce("status", F.lit("pending"))
    stopped = F.col("aborted") & status.isin("pending", "running")
    return last.where("created").select(
        "job_id", "unit_id", F.when(stopped, "aborted").otherwise(status).alias("status"), "total_nodes", "processed_nodes", F.when(stopped, F.coalesce("error", F.lit("job aborted"))).otherwise(F.col("error")).alias("error")
    )


def job_totals(units: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, units, running_total (nodes told by units that started while the job was live)."""
    job = _folded(jobs).select("job_id", "ended_at")
    live = F.col("ended_at").isNull() | (F.col("seq") <= F.col("ended_at"))
    started = live & (F.col("kind") == "running")
    return units.join(job, "job_id", "left").groupBy("job_id").agg(F.countDistinct(F.when(F.col("kind") == "created", F.col("unit_id"))).alias("units"), F.sum(F.when(started, F.coalesce(F.col("n").cast("long"), F.lit(0))).otherwise(0)).alias("running_total"))
