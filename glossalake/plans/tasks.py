"""Task-queue and file queries over orders and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossalake.functions import values as V
from glossalake.functions.values import failing, pages
from glossalake.operators import glossary as G
from glossalake.operators import tasks as K
from glossalake.plans.base import read, registry

QUERIES, ORACLES, query = registry()
_STATUS = "CASE event_id % 5 WHEN 0 THEN 'waiting' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'canceled' END"
_TASKS = f"(SELECT event_id AS task_id, user_id, user_id % 20 AS queue, {_STATUS} AS status, ts AS created_at, CAST(event_id % 3 AS INTEGER) AS priority, CASE event_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'CPU' WHEN 2 THEN 'IO' ELSE 'HIGH' END AS task_type, value FROM events)"


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    pick = lambda n, *names: F.get(F.array(*map(F.lit, names)), (k % n).cast("int"))
    return read(spark, d, "events").select(k.alias("task_id"), "user_id", (F.col("user_id") % 20).alias("queue"), pick(5, *K.STATUSES).alias("status"), F.col("ts").alias("created_at"), (k % 3).cast("int").alias("priority"), pick(4, "LOW", "CPU", "IO", "HIGH").alias("task_type"), "value")


@query(f"SELECT {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in K.STATUSES)}, count(*) AS total FROM {_TASKS}")
def task_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return K.status_counts(_tasks(spark, d))


@query(f"SELECT {', '.join(f"count(*) FILTER (WHERE {'task_id % 7 = 0' if s == 'processing' else f"status = '{s}'"}) AS {s}" for s in K.STATUSES)}, count(*) AS total FROM {_TASKS}")
def task_status_counts_active(spark: SparkSession, d: str) -> DataFrame:
    """processing is what really runs, whatever the status says."""
    return K.status_counts(_tasks(spark, d).withColumn("active", F.col("task_id") % 7 == 0), active="active")


@query(f"SELECT s.status, count(t.task_id) AS n FROM (SELECT unnest(['waiting', 'processing', 'completed', 'failed', 'canceled']) AS status) s LEFT JOIN (SELECT * FROM {_TASKS} WHERE status <> 'failed') t USING (status) GROUP BY s.status")
def task_status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return K.status_histogram(_tasks(spark, d).where("status <> 'failed'"))


@query(f"SELECT task_id, CASE WHEN status = 'waiting' THEN row_number() OVER (PARTITION BY queue, status ORDER BY created_at, task_id) ELSE 0 END AS position FROM {_TASKS}")
def queue_positions(spark: SparkSession, d: str) -> DataFrame:
    return K.queue_positions(_tasks(spark, d)).select("task_id", F.col("position").cast("bigint").alias("position"))


@query(f"SELECT task_id, CASE WHEN status = 'waiting' THEN row_number() OVER (PARTITION BY status ORDER BY created_at, task_id) END AS position FROM {_TASKS}")
def fifo_positions(spark: SparkSession, d: str) -> DataFrame:
    return K.fifo_positions(_tasks(spark, d)).select("task_id", "position")


@query(f"SELECT user_id, max_by(task_id, (created_at, task_id)) AS task_id, max_by(status, (created_at, task_id)) AS status FROM {_TASKS} GROUP BY user_id")
def latest_task_per_user(spark: SparkSession, d: str) -> DataFrame:
    return K.latest_per(_tasks(spark, d), "user_id", ["created_at", "task_id"], ["user_id", "task_id", "status"])


@query(f"SELECT queue, task_id FROM {_TASKS} QUALIFY row_number() OVER (PARTITION BY queue ORDER BY created_at DESC, task_id DESC) <= 50")
def last_logs_per_queue(spark: SparkSession, d: str) -> DataFrame:
    return K.last_rows(_tasks(spark, d), "queue", ["created_at", "task_id"], 50).select("queue", "task_id")


@query("SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 30")
def metric_buffer(spark: SparkSession, d: str) -> DataFrame:
    return K.last_rows(read(spark, d, "events"), "event_type", ["ts", "event_id"], 30).select("event_type", "event_id", "value")


_FILES = "(SELECT event_id AS id, user_id, ts AS upload_time, CASE WHEN event_id % 3 = 0 THEN 'completed' WHEN event_id % 3 = 1 THEN 'failed' ELSE 'pending' END AS status, event_id % 2 = 0 AS present, CAST(value * 1000 AS BIGINT) AS size FROM events)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return read(spark, d, "events").select(k.alias("id"), "user_id", F.col("ts").alias("upload_time"), F.when(k % 3 == 0, "completed").when(k % 3 == 1, "failed").otherwise("pending").alias("status"), (k % 2 == 0).alias("exists"), (F.col("value") * 1000).alias("size"))


@query(f"SELECT user_id, count(*) AS deleted, count(*) FILTER (WHERE present) AS counted FROM {_FILES} WHERE upload_time < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND status IN ('completed', 'failed') GROUP BY user_id")
def expired_files(spark: SparkSession, d: str) -> DataFrame:
    gone = K.cleanup(_files(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return gone.groupBy("user_id").agg(F.count_if("deleted").alias("deleted"), F.count_if("counted").alias("counted"))


@query(f"SELECT count(DISTINCT user_id) AS users, count(*) FILTER (WHERE present) AS succeeded, count(*) FILTER (WHERE NOT present) AS failed FROM {_FILES} WHERE upload_time < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND status IN ('completed', 'failed')")
def cleanup_totals(spark: SparkSession, d: str) -> DataFrame:
    return K.cleanup_totals(K.cleanup(_files(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")))


@query("SELECT user_id, sum(value) AS used, CASE WHEN 500 > 0 THEN round_even(sum(value) * 100.0::DOUBLE / 500.0, 2) ELSE 0 END AS share, sum(value) + 10 <= 500 AS fits FROM events GROUP BY user_id")
def storage_quota(spark: SparkSession, d: str) -> DataFrame:
    from glossalake.functions.values import share

    used = read(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("used"))
    return used.select("user_id", "used", share(F.col("used"), F.lit(500.0), 2).alias("share"), K.within_quota(F.col("used"), F.lit(10), F.lit(500)).alias("fits"))


# a fold over each queue in order of time: who is still at work, and who was let in
@query(f"""WITH r AS (SELECT queue, task_id, CAST(floor(epoch(created_at)) AS BIGINT) AS s FROM {_TASKS}), none AS (SELECT {{'id': 0::BIGINT, 's': 0::BIGINT, 'e': 0::BIGINT, 'live': []::BIGINT[], 'let': []::BOOLEAN[]}} AS z),
q AS (SELECT queue, list({{'id': task_id, 's': s, 'e': s + 3600 * (1 + task_id % 30), 'live': []::BIGINT[], 'let': []::BOOLEAN[]}} ORDER BY s, task_id) AS l FROM r GROUP BY queue),
f AS (SELECT queue, list_transform(l, lambda x: x.id) AS ids, list_reduce(list_prepend(z, l), lambda a, x: {{'id': x.id, 's': x.s, 'e': x.e,
'live': CASE WHEN len(list_filter(a.live, lambda t: t > x.s)) < 10 THEN list_append(list_filter(a.live, lambda t: t > x.s), x.e) ELSE list_filter(a.live, lambda t: t > x.s) END, 'let': list_append(a.let, len(list_filter(a.live, lambda t: t > x.s)) < 10)}}) AS w FROM q, none)
SELECT queue, unnest(ids) AS task_id, unnest(w.let) AS admitted FROM f""")
def task_admissions(spark: SparkSession, d: str) -> DataFrame:
    t = _tasks(spark, d)
    start = F.unix_timestamp(F.col("created_at").cast("timestamp")).alias("created_at")
    r = t.select("queue", "task_id", start, (start + F.lit(3600) * (1 + F.col("task_id") % 30)).alias("finished_at"))
    return K.admissions(r).select("queue", "task_id", "admitted")


_STATES = "(SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'disabled' ELSE 'rejected' END AS status FROM events)"
_ACTIONS = {"approve": ("pending", "approved"), "reject": ("pending", "rejected"), "disable": ("approved", "disabled"), "enable": ("disabled", "approved")}


@query(" UNION ALL ".join(f"SELECT '{action}' AS action, CASE WHEN status = '{a}' THEN '{b}' ELSE status END AS status, status = '{a}' AS changed, count(*) AS n FROM {_STATES} GROUP BY ALL" for action, (a, b) in _ACTIONS.items()))
def registration_states(spark: SparkSession, d: str) -> DataFrame:
    """All four actions on accounts of all four states."""
    k = F.col("event_id") % 4
    t = read(spark, d, "events").select(F.when(k == 0, "pending").when(k == 1, "approved").when(k == 2, "disabled").otherwise("rejected").alias("status"))
    done = [K.state_transition(t, action).select(F.lit(action).alias("action"), "status", "changed") for action in _ACTIONS]
    return reduce(DataFrame.unionByName, done).groupBy("action", "status", "changed").agg(F.count("*").alias("n"))


@query(f"SELECT status, changed, count(*) AS n FROM (SELECT CASE WHEN status = 'waiting' THEN 'approved' ELSE status END AS status, status = 'waiting' AS changed FROM {_TASKS}) GROUP BY ALL")
def registrations_approved(spark: SparkSession, d: str) -> DataFrame:
    t = _tasks(spark, d).withColumn("status", F.when(F.col("status") == "waiting", "pending").otherwise(F.col("status")))
    return K.state_transition(t, "approve").groupBy("status", "changed").agg(F.count("*").alias("n"))


@query(f"SELECT task_id FROM {_TASKS} WHERE status = 'completed' AND date_diff('second', created_at, TIMESTAMP '2024-01-15 12:00:00') <= 300")
def recent_completions(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp")
    t = _tasks(spark, d).withColumn("completed_at", F.date_trunc("second", F.col("created_at").cast("timestamp")))
    return K.visible_completions(t, as_of).select("task_id")


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def events_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour")["start"].alias("hour")).agg(F.count("*").alias("n"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return read(spark, d, "events").select(
        k.alias("id"), "user_id", F.format_string("f%d.pptx", k).alias("stored_filename"), F.concat(F.lit("/up/"), F.when(k % 2 == 0, "ppt").otherwise("pdf"), F.lit("/u"), F.col("user_id").cast("string")).alias("file_path"),
        F.when(k % 3 == 0, "completed").otherwise("pending").alias("status"), F.col("ts").alias("upload_time"), F.col("event_type").alias("username"), F.format_string("Deck%d.PPTX", k).alias("filename"),
    )


@query("SELECT event_id AS id FROM events WHERE user_id = 3 AND event_id % 2 = 0 AND event_id % 3 = 0")
def user_files(spark: SparkSession, d: str) -> DataFrame:
    return K.user_files(_records(spark, d), 3, "ppt", "completed").select("id")


@query("SELECT event_id AS id FROM events WHERE user_id = 3 AND event_id % 3 = 0")
def completed_history(spark: SparkSession, d: str) -> DataFrame:
    return K.history(_records(spark, d), 3).select("id")


@query("SELECT user_id, max_by(event_type, event_id) AS username FROM events WHERE user_id <> 0 AND event_id % 11 <> 0 GROUP BY user_id")
def file_users(spark: SparkSession, d: str) -> DataFrame:
    """Of a user's several names the last one; one file in eleven has none."""
    files = _records(spark, d).withColumn("username", F.when(F.col("id") % 11 != 0, F.col("username")))
    return G.file_users(files, "id")


@query("SELECT event_id, CAST(greatest(date_diff('second', ts, TIMESTAMP '2024-01-16'), 0) AS BIGINT) AS idle, date_diff('second', ts, TIMESTAMP '2024-01-16') > 1800 AS unused, value * 60 > 1800 AS long FROM (SELECT event_id, date_trunc('second', ts) AS ts, value FROM events)")
def idle_times(spark: SparkSession, d: str) -> DataFrame:
    ts, as_of = F.date_trunc("second", F.col("ts").cast("timestamp")), F.lit("2024-01-16 00:00:00").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(ts) + F.round(F.col("value") * 60_000_000).cast("bigint"))
    return read(spark, d, "events").select("event_id", V.idle_seconds(ts, as_of).alias("idle"), V.is_idle(ts, as_of).alias("unused"), V.ran_long(ts, end).alias("long"))


@query("SELECT event_id AS id FROM events WHERE event_type = 'click' AND CAST(ts AS DATE) = DATE '2024-01-05' AND contains('deck' || event_id || '.pptx', 'k1')")
def files_filtered(spark: SparkSession, d: str) -> DataFrame:
    return K.client_filter(_records(spark, d), "click", "2024-01-05", "K1").select("id")


@query("SELECT event_type, count(*) AS calls, avg(value) AS average_time, count(*) FILTER (WHERE event_id % 4 <> 0) * 100.0::DOUBLE / count(*) AS success_rate FROM events GROUP BY event_type")
def client_statistics(spark: SparkSession, d: str) -> DataFrame:
    calls = read(spark, d, "events").select("event_type", F.col("value").alias("seconds"), (F.col("event_id") % 4 != 0).alias("ok"))
    return K.client_statistics(calls, "event_type")


@query("SELECT event_id, event_id % 2 = 0 AND event_id % 3 = 0 AS healthy, list_concat(CASE WHEN event_id % 2 = 0 THEN [] ELSE ['scheduler'] END, CASE WHEN event_id % 3 = 0 THEN [] ELSE ['workers'] END) AS problems FROM events")
def pool_health(spark: SparkSession, d: str) -> DataFrame:
    healthy, problems = failing(scheduler=F.col("event_id") % 2 == 0, workers=F.col("event_id") % 3 == 0)
    return read(spark, d, "events").select("event_id", healthy.alias("healthy"), problems.alias("problems"))


@query("SELECT user_id, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, greatest(least(3, CAST(ceil(count(*) / 20.0) AS BIGINT)), 1) AS page FROM events GROUP BY user_id")
def clamped_pages(spark: SparkSession, d: str) -> DataFrame:
    from glossalake.functions.values import clamped

    n = read(spark, d, "events").groupBy("user_id").agg(pages(F.count("*"), 20).alias("pages"))
    return n.select("user_id", "pages", clamped(F.lit(3), F.col("pages")).cast("bigint").alias("page"))


_POOLS = f"(SELECT task_id, user_id AS queue, CASE WHEN task_id % 10 = 6 THEN 'completed' ELSE status END AS status, created_at, priority FROM {_TASKS})"


def _pools(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a task; a user is a queue and one task in ten is processing, so that free and full queues occur at any size."""
    status = F.when(F.col("task_id") % 10 == 6, "completed").otherwise(F.col("status"))
    return _tasks(spark, d).withColumns({"queue": F.col("user_id"), "status": status})


@query(f"""WITH a AS (SELECT queue, count(*) FILTER (WHERE status = 'processing') AS active FROM {_POOLS} GROUP BY queue)
SELECT task_id FROM (SELECT w.*, row_number() OVER (PARTITION BY w.queue ORDER BY priority, created_at, task_id) AS k FROM {_POOLS} w WHERE status = 'waiting') JOIN a USING (queue) WHERE k <= greatest(10 - active, 0)""")
def next_tasks(spark: SparkSession, d: str) -> DataFrame:
    return K.next_tasks(_pools(spark, d)).select("task_id")


@query(f"SELECT task_id, row_number() OVER (ORDER BY CASE task_type WHEN 'HIGH' THEN 0 WHEN 'IO' THEN 1 WHEN 'CPU' THEN 2 ELSE 3 END, priority, created_at, task_id) AS place FROM {_TASKS}")
def scheduled_tasks(spark: SparkSession, d: str) -> DataFrame:
    return K.scheduled_places(_tasks(spark, d)).select("task_id", F.col("place").cast("bigint").alias("place"))


@query("""SELECT task_id, CASE WHEN last = 'failed' AND failures <= 3 THEN 'waiting' ELSE last END AS status, CAST(least(failures, 3) AS INTEGER) AS retry_count
FROM (SELECT task_id, max_by(s, event_id) AS last, count(*) FILTER (WHERE s = 'failed') AS failures FROM (SELECT event_id // 10 AS task_id, event_id, CASE WHEN event_id * 37 % 101 < 35 THEN 'failed' ELSE 'processing' END AS s FROM events) GROUP BY task_id)""")
def task_retries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    status = F.when(k * 37 % 101 < 35, "failed").otherwise("processing")
    return K.fold_events(read(spark, d, "events").select(F.floor(k / 10).alias("task_id"), k.alias("seq"), status.alias("status")))


@query(f"SELECT queue, greatest(10 - p, 0) AS available_slots, p + w >= 10 AS queue_full, CASE WHEN p + w >= 10 THEN 'busy' ELSE 'normal' END AS system_status FROM (SELECT queue, count(*) FILTER (WHERE status = 'processing') AS p, count(*) FILTER (WHERE status = 'waiting') AS w FROM {_POOLS} GROUP BY queue)")
def queue_summaries(spark: SparkSession, d: str) -> DataFrame:
    n = _pools(spark, d).groupBy("queue").agg(F.count_if(F.col("status") == "processing").alias("processing"), F.count_if(F.col("status") == "waiting").alias("waiting"))
    return K.queue_summary(n).select("queue", "available_slots", "queue_full", "system_status")


@query("SELECT event_id AS task_id, CASE WHEN event_id % 4 <> 3 THEN event_id END AS record_id FROM events")
def task_records(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    name = F.when(F.col("id") % 4 == 3, "other.pptx").otherwise(F.col("stored_filename"))
    tasks = r.select(F.col("id").alias("task_id"), "user_id", F.concat_ws("/", "file_path", name).alias("file_path"))
    return K.with_record(tasks, r).select("task_id", "record_id")
