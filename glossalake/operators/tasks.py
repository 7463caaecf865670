"""Task queues, files and metrics: counts, positions, retries, expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from glossalake.operators.numbering import numbered

STATUSES = ("waiting", "processing", "completed", "failed", "canceled")
MAX_RETRIES, MAX_ACTIVE = 3, 10
TYPE_RANK = {"HIGH": 0, "IO": 1, "CPU": 2, "LOW": 3}


def status_counts(tasks: DataFrame, active: str | None = None) -> DataFrame:
    """One row: a count for each status and the total. ``active`` names a flag that counts as processing in place of the status."""
    count = {s: F.count_if(F.col("status") == s) for s in STATUSES}
    if active:
        count["processing"] = F.count_if(F.col(active))
    return tasks.agg(*(c.alias(s) for s, c in count.items()), F.count("*").alias("total"))


def status_histogram(tasks: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """A row for each status, 0 where there is none."""
    every = tasks.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return every.join(tasks.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def queue_positions(tasks: DataFrame, pool: str = "queue") -> DataFrame:
    """Place among the waiting of a queue by creation (1-based; 0 for the others). Only the waiting are numbered, hour by hour."""
    waits = F.coalesce(F.col("status") == "waiting", F.lit(False))
    placed = numbered(tasks.where(waits), [pool], ["created_at", "task_id"], F.date_trunc("hour", F.col("created_at").cast("timestamp")), "position")
    return placed.unionByName(tasks.where(~waits).withColumn("position", F.lit(0).cast("bigint")))


def fifo_positions(tasks: DataFrame) -> DataFrame:
    """Place among all waiting tasks by creation (1-based; null for the others), as a single queue has it."""
    waits = F.coalesce(F.col("status") == "waiting", F.lit(False))
    placed = numbered(tasks.where(waits), [], ["created_at", "task_id"], F.date_trunc("hour", F.col("created_at").cast("timestamp")), "position")
    return placed.unionByName(tasks.where(~waits).withColumn("position", F.lit(None).cast("bigint")))


#: Parts that a key's rows are dealt into before the best of each part meet.
SALTS = 32


def top_rows(df: DataFrame, keys: list[str], order: list[Column], most: int, place: str = "place", salts: int = SALTS) -> DataFrame:
    """The first ``most`` rows of each key by order, with their 1-based place, in two phases: those of each of ``salts`` parts of a key, then those of what is left, at most salts x most rows a key.

    The order should be whole: of rows that tie, any come first.
    """
    salt = F.pmod(F.xxhash64(*(o for o in df.columns if df.schema[o].dataType.simpleString().partition("<")[0] != "map")), F.lit(salts))
    part = df.withColumn("__salt", salt)
    some = part.withColumn(place, F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order))).where(F.col(place) <= most).drop("__salt")
    return some.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= most)


def next_tasks(tasks: DataFrame, pool: str = "queue", most: int = MAX_ACTIVE) -> DataFrame:
    """Waiting tasks that find a free slot in their queue: by priority, then arrival. No more than ``most`` of a queue can, so only its first ones are placed."""
    active = tasks.groupBy(pool).agg(F.count_if(F.col("status") == "processing").alias("active"))
    waiting = top_rows(tasks.where(F.col("status") == "waiting"), [pool], [F.col(c) for c in ("priority", "created_at", "task_id")], most)
    return waiting.join(active, pool).where(F.col("place") <= F.greatest(F.lit(most) - F.col("active"), F.lit(0))).drop("active")


def scheduled(tasks: DataFrame) -> DataFrame:
    """All tasks in the order of a pool: type, priority, arrival."""
    return ranked(tasks).orderBy("type_rank", "priority", "created_at", "task_id")


def ranked(tasks: DataFrame) -> DataFrame:
    rank = F.lit(len(TYPE_RANK))
    for name, k in TYPE_RANK.items():
        rank = F.when(F.col("task_type") == name, k).otherwise(rank)
    return tasks.withColumn("type_rank", rank)


def scheduled_places(tasks: DataFrame) -> DataFrame:
    """All tasks with their 1-based place in the order of ``scheduled``: rows are numbered within a type, priority and day, and the counts before these are added. Only those counts (their bound: types x priorities x days) meet in one task."""
    block = F.struct("type_rank", "priority", F.to_date("created_at"))
    return numbered(ranked(tasks), [], ["created_at", "task_id"], block, "place").select(*tasks.columns, "place")


def latest_per(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key by order, without a window: partial results merge before the shuffle."""
    rest = [c for c in columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def last_rows(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The last ``most`` rows of each key, numbered from the last (``from_last``)."""
    return top_rows(df, [key], [F.desc(c) for c in order], most, "from_last")


def fold_events(events: DataFrame) -> DataFrame:
    """Latest state of each task from its events (task_id, seq, status): retries so far, and failed ones that wait again while retries are left."""
    state = events.groupBy("task_id").agg(F.max_by("status", "seq").alias("last"), F.count_if(F.col("status") == "failed").alias("failures"), F.min("seq").alias("first"))
    retries = F.least("failures", F.lit(MAX_RETRIES))
    status = F.when((F.col("last") == "failed") & (F.col("failures") <= MAX_RETRIES), "waiting").otherwise(F.col("last"))
    return state.select("task_id", status.alias("status"), retries.cast("int").alias("retry_count"))


#: Seconds of arrivals that one task looks through for the beginnings of busy periods.
PERIOD_BLOCK = 3600


def busy_periods(requests: DataFrame, pool: str = "queue", block: Column | None = None) -> DataFrame:
    """requests with ``period``: how many times, up to each of them, its queue had surely run empty.

    A request that starts at or after the greatest end of all earlier ones finds nothing open, whichever of those were
    admitted, and so begins a period that depends on none before it. That greatest end is a prefix maximum: over rows
    within a block of the order, and over one row a block beyond. ``block`` must rise with created_at. Requests that
    have no end stay open, so that no period begins after them.
    """
    never = F.lit(float("inf"))
    end = F.coalesce(F.col("finished_at").cast("double"), never)
    rows = requests.withColumns({"__block": block if block is not None else F.floor(F.col("created_at") / PERIOD_BLOCK), "__end": end})
    order = ["created_at", "task_id"]
    earlier = Window.partitionBy(pool, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(pool, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(pool).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)

    def of_blocks(df: DataFrame, value: Column, name: str) -> DataFrame:
        """One row a block: value over the blocks before it."""
        sums = df.groupBy(pool, "__block").agg(value.alias("__v"))
        over = F.max("__v") if name == "__most" else F.sum("__v")
        return sums.select(F.col(pool).alias("__pool"), F.col("__block").alias("__b"), over.over(before).alias(name))

    def met(df: DataFrame, blocks: DataFrame) -> DataFrame:
        return df.join(blocks, F.col(pool).eqNullSafe(F.col("__pool")) & F.col("__block").eqNullSafe(F.col("__b"))).drop("__pool", "__b")

    most = F.greatest(F.col("__most"), F.max("__end").over(earlier))  # greatest passes over nulls
    opened = met(rows, of_blocks(rows, F.max("__end"), "__most")).withColumn("__opens", F.when(most.isNull() | (F.col("created_at") >= most), 1).otherwise(0))
    counted = met(opened, of_blocks(opened, F.sum("__opens"), "__count"))
    period = F.coalesce("__count", F.lit(0)) + F.sum("__opens").over(inside)
    return counted.select(*requests.columns, period.cast("bigint").alias("period"))


def admissions(requests: DataFrame, pool: str = "queue", most: int = MAX_ACTIVE, block: Column | None = None) -> DataFrame:
    """Whether each request is admitted: not while ``most`` earlier admitted ones of its queue are unfinished.

    Requests have created_at, finished_at (seconds; null: it never finishes) and task_id. Each busy period is read through
    in order of time, one batch after another, with at most ``most`` open tasks in memory; the periods of a queue lie in
    many tasks. A queue that never runs empty is one period.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_until = None, []
        for batch in batches:
            out = []
            ends = batch["finished_at"].astype(float).fillna(float("inf"))
            for name, period, start, end in zip(batch[pool], batch["period"], batch["created_at"], ends, strict=True):
                if (name, period) != now:
                    now, open_until = (name, period), []
                open_until = [t for t in open_until if t > start]
                out.append(len(open_until) < most)
                if out[-1]:
                    open_until.append(end)
            yield batch.drop(columns="period").assign(admitted=out)

    ordered = busy_periods(requests, pool, block).repartition(pool, "period").sortWithinPartitions(pool, "period", "created_at", "task_id")
    return ordered.mapInPandas(run, StructType([*requests.schema, StructField("admitted", BooleanType())]))


def queue_summary(counts: DataFrame, most: int = MAX_ACTIVE) -> DataFrame:
    """available_slots, queue_full and system_status from waiting and processing counts."""
    busy = F.col("processing") + F.col("waiting")
    full = busy >= most
    state = F.when(full, "busy").otherwise("normal")
    return counts.withColumns({"available_slots": F.greatest(F.lit(most) - F.col("processing"), F.lit(0)), "queue_full": full, "system_status": state})


def expired(as_of: Column, days: int = 7, statuses: tuple[str, ...] = ("completed", "failed")) -> Column:
    return (F.col("upload_time") < as_of - F.make_dt_interval(F.lit(days))) & F.col("status").isin(*statuses)


def cleanup(files: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Expired files: each goes; only those that exist count as a success."""
    gone = files.where(expired(as_of, days))
    return gone.withColumns({"deleted": F.lit(True), "counted": F.coalesce("exists", F.lit(False))})


def cleanup_totals(cleaned: DataFrame) -> DataFrame:
    """One row over all users: users, files that went with success, and those that failed."""
    return cleaned.agg(F.countDistinct("user_id").alias("users"), F.count_if("counted").alias("succeeded"), F.count_if(~F.col("counted")).alias("failed"))


def history(records: DataFrame, user_id: int) -> DataFrame:
    """A user's completed files, the latest first."""
    return records.where((F.col("user_id") == user_id) & (F.col("status") == "completed")).orderBy(F.desc("upload_time"), F.desc("id"))


def within_quota(used: Column, size: Column, quota: Column) -> Column:
    return used + size <= quota


def state_transition(df: DataFrame, action: str) -> DataFrame:
    """approve, reject, disable and enable: the next status where the present one allows it; ``changed`` tells."""
    allowed = {"approve": ("pending", "approved"), "reject": ("pending", "rejected"), "disable": ("approved", "disabled"), "enable": ("disabled", "approved")}
    before, after = allowed[action]
    ok = F.coalesce(F.col("status") == before, F.lit(False))
    return df.withColumn("changed", ok).withColumn("status", F.when(ok, after).otherwise(F.col("status")))


def visible_completions(tasks: DataFrame, as_of: Column, seconds: int = 300) -> DataFrame:
    """Tasks in the state completed whose end is no longer ago than a few minutes."""
    return tasks.where((F.col("status") == "completed") & (F.timestamp_diff("SECOND", F.col("completed_at"), as_of) <= seconds))


def with_record(tasks: DataFrame, records: DataFrame) -> DataFrame:
    """Tasks with the upload record of their user, folder and file name (both taken from the path); record_id is null without one."""
    path = F.col("file_path")
    keyed = tasks.withColumns({"__dir": F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "__name": F.regexp_extract(path, r"([^/]*)$", 1)})
    r = records.select(F.col("id").alias("record_id"), F.col("user_id").alias("__user"), F.col("file_path").alias("__folder"), F.col("stored_filename").alias("__stored"))
    met = keyed.join(r, (keyed["user_id"] == r["__user"]) & (keyed["__dir"] == r["__folder"]) & (keyed["__name"] == r["__stored"]), "left")
    return met.drop("__dir", "__name", "__user", "__folder", "__stored")


def user_files(records: DataFrame, user_id: int, kind: str, status: str | None = None) -> DataFrame:
    """A user's files below a folder named after their kind."""
    out = records.where((F.col("user_id") == user_id) & F.col("file_path").like(f"%/{kind}/%"))
    return out.where(F.col("status") == status) if status else out


def client_filter(files: DataFrame, user: str | None = None, day: str | None = None, name: str | None = None) -> DataFrame:
    """By user, UTC day of upload and a part of the file name in either case; what isn't given doesn't filter."""
    out = files.where(F.col("username") == user) if user else files
    out = out.where(F.to_date("upload_time") == F.lit(day).cast("date")) if day else out
    return out.where(F.contains(F.lower("filename"), F.lit(name.lower()))) if name else out


def client_statistics(calls: DataFrame, key: str) -> DataFrame:
    """Calls, average time and share of successes by key."""
    return calls.groupBy(key).agg(F.count("*").alias("calls"), F.avg("seconds").alias("average_time"), (F.count_if("ok") * 100.0 / F.count("*")).alias("success_rate"))
