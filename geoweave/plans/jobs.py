"""A table of jobs and of what must come before what, kept in files, so that a run can be resumed.

jobs: (job, kind, file, state); edges: (before, after). Jobs are stages of files, so both tables are small; the work of a job is
a Spark job of any size.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.operators.storage import cut
from geoweave.plans.config import STAGES


class State(Enum):
    RUNNABLE = "RUNNABLE"
    RUNNING = "RUNNING"
    FINISHED = "FINISHED"
    FAILED = "FAILED"


JOBS, EDGES = "job long, kind string, file string, state string", "before long, after long"


def plan(spark: SparkSession, tiles: list[str], neighbours: list[tuple[str, str]], last: str = STAGES[-1]) -> tuple[DataFrame, DataFrame]:
    """Jobs of a workflow over tiles: FILTER for each, NEIGHBOURS after the FILTER jobs of the tile and those beside it, then one job
    for each stage up to the last one."""
    stages = STAGES[1 : STAGES.index(last) + 1]
    jobs, edges, at = [], [], {}
    for kind in stages:
        files = tiles if kind in ("FILTER", "NEIGHBOURS") else [""]
        for f in files:
            at[kind, f] = len(jobs) + 1
            jobs.append((at[kind, f], kind, f, State.RUNNABLE.value))
    for a, b in [(t, t) for t in tiles] + neighbours:
        if ("NEIGHBOURS", b) in at:
            edges.append((at["FILTER", a], at["NEIGHBOURS", b]))
    alone = [k for k in stages if k not in ("FILTER", "NEIGHBOURS")]
    for before, after in zip([None, *alone], alone):
        edges += [(at[before or "NEIGHBOURS", f], at[after, ""]) for f in ([""] if before else tiles)]
    return spark.createDataFrame(jobs, JOBS), spark.createDataFrame(edges, EDGES)


def count_by_state(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count("*").alias("n"))


def next_id(jobs: DataFrame) -> DataFrame:
    """One row: the least number above all ids; 1 for no jobs."""
    return jobs.agg((F.coalesce(F.max("job"), F.lit(0)) + 1).alias("job"))


def resume(jobs: DataFrame) -> DataFrame:
    """Jobs that were running or failed can run again."""
    again = F.col("state").isin(State.RUNNING.value, State.FAILED.value)
    return jobs.withColumn("state", F.when(again, State.RUNNABLE.value).otherwise(F.col("state")))


def ready(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """Runnable jobs all of whose predecessors are finished."""
    blocked = edges.join(jobs.where(F.col("state") != State.FINISHED.value).select(F.col("job").alias("before")), "before").select(F.col("after").alias("job"))
    return jobs.where(F.col("state") == State.RUNNABLE.value).join(blocked.distinct(), "job", "left_anti")


def schedule(jobs: DataFrame, edges: DataFrame, work: Callable[[str, str], None], listen: Callable[[DataFrame], None] = lambda _: None) -> DataFrame:
    """Run ready jobs, round by round, until none is left; each round is written down. A job that fails stops what comes after it."""
    jobs = cut(resume(jobs), "jobs")
    while todo := ready(jobs, edges).orderBy("job").collect():
        states = []
        for r in todo:
            try:
                work(r.kind, r.file)
                states.append((r.job, State.FINISHED.value))
            except Exception:  # noqa: BLE001  whatever a job raises, the others go on
                states.append((r.job, State.FAILED.value))
        new = jobs.sparkSession.createDataFrame(states, "job long, now string")
        jobs = cut(jobs.join(F.broadcast(new), "job", "left").withColumn("state", F.coalesce("now", "state")).drop("now"), "jobs")
        listen(jobs)
    return jobs
