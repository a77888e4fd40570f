"""The registry of runs: an append-only log of changes, and the latest state of each run.

Events: (run_id, event_seq, created_at and any other RUN column); null means "not changed by this event".
The state of a run takes each column's last value that isn't null, by event_seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIVE = ("queued", "running", "delivering")
#: What may follow each status.
TRANSITIONS = {
    "queued": ("running", "failed"),
    "running": ("awaiting_approval", "failed"),
    "awaiting_approval": ("delivering", "rejected"),
    "delivering": ("delivered", "failed"),
}


def latest(events: DataFrame) -> DataFrame:
    """One row for each run with its current columns, and ``created_seq``, its first event."""
    columns = [c for c in events.columns if c not in ("run_id", "event_seq")]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("event_seq"))).alias(c) for c in columns]
    return events.groupBy("run_id").agg(*last, F.min("event_seq").alias("created_seq"))


def get_run(events: DataFrame, run_id: str) -> DataFrame:
    return latest(events.filter(F.col("run_id") == run_id))


def list_runs(events: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs, at most 200 at once."""
    return latest(events).orderBy(F.desc("created_seq")).limit(min(max(limit, 1), 200))


def active_runs(events: DataFrame) -> DataFrame:
    return latest(events).filter(F.col("status").isin(*ACTIVE))


def active_run(events: DataFrame) -> DataFrame:
    """The newest run that is queued, running or delivering, if any."""
    return active_runs(events).orderBy(F.desc("created_seq")).limit(1)


def reset_stuck(events: DataFrame) -> DataFrame:
    """The events that set each run in flight to failed; runs awaiting approval are spared."""
    top = events.agg(F.coalesce(F.max("event_seq"), F.lit(0)).alias("top"))
    stuck = active_runs(events).select("run_id", F.col("status").alias("was"))
    return stuck.crossJoin(F.broadcast(top)).select("run_id", (F.col("top") + 1).alias("event_seq"), "was", F.lit("failed").alias("status"))


def invalid_changes(events: DataFrame) -> DataFrame:
    """(run_id, event_seq, was, status): changes of status that the life of a run doesn't allow."""
    from pyspark.sql import Window

    s = events.filter("status is not null").select("run_id", "event_seq", "status", F.lag("status").over(Window.partitionBy("run_id").orderBy("event_seq")).alias("was"))
    allowed = F.lit(False)
    for was, following in TRANSITIONS.items():
        allowed = allowed | ((F.col("was") == was) & F.col("status").isin(*following))
    return s.filter(F.col("was").isNotNull() & (F.col("was") != F.col("status")) & ~allowed).select("run_id", "event_seq", "was", "status")


def report_key(runs: DataFrame) -> DataFrame:
    """Runs (product, week_start, week_end) with the key of their report: the head of a SHA-256."""
    return runs.withColumn("report_key", F.substring(F.sha2(F.concat_ws("_", "product", "week_start", "week_end"), 256), 1, 12))


def slug(name):
    """A file name from a product's: lower case, anything but letters, digits, dashes and underscores replaced; "report" if empty."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_-]", "_"), F.lit("_")), F.lit("")), F.lit("report"))
