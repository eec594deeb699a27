"""The versioned catalog: states, history, selection, synchronisation, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions import dates, text
from strataform.operators import catalog as C
from strataform.operators import recovery as R
from strataform.sources import changelog
from strataform.streaming import ingest

from .common import registry, table

QUERIES, ORACLE, query = registry()

_LOG = """WITH log AS (SELECT (date_diff('day', DATE '2024-01-01', ts::DATE) + 1)::BIGINT AS version, event_id AS seq, 'u' || user_id AS path,
  CASE WHEN event_type = 'error' THEN 0 ELSE strftime(ts, '%Y%m%d%H%M%S')::BIGINT END AS date, value AS attr FROM events)"""
_LAST = "(SELECT *, row_number() OVER (PARTITION BY path ORDER BY version DESC, seq DESC) AS o FROM log WHERE version <= {v})"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.from_events(table(spark, sf_dir, "events"))


@query(f"{_LOG} SELECT path, version, seq, date, attr FROM {_LAST.format(v=100000)} WHERE o = 1 AND date <> 0")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest_state(_log(spark, sf_dir))


@query(f"{_LOG} SELECT path, version, seq, date, attr FROM {_LAST.format(v=15)} WHERE o = 1 AND date <> 0")
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.time_travel(_log(spark, sf_dir), 15)


_STOP = "t AS (SELECT version, MAX(strftime(ts, '%Y%m%d%H%M%S')::BIGINT) AS committed_at FROM (SELECT (date_diff('day', DATE '2024-01-01', ts::DATE) + 1)::BIGINT AS version, ts FROM events) GROUP BY version)"


@query(f"{_LOG}, {_STOP} SELECT path, version, seq, date, attr FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY version DESC, seq DESC) AS o FROM log WHERE version < COALESCE((SELECT MIN(version) FROM t WHERE committed_at > 20240110235959), 1000000)) WHERE o = 1 AND date <> 0")
def until_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state before the first transaction after the tenth; a transaction's date is its last event's."""
    _, bound = dates.until("20240110")
    e = table(spark, sf_dir, "events")
    log = changelog.from_events(e)
    day = F.datediff("ts", F.lit("2024-01-01").cast("date")) + 1
    at = e.groupBy(day.cast("long").alias("version")).agg(F.max(dates.decimal_time(F.col("ts"))).alias("committed_at"))
    return C.time_travel(log, C.versions_until(at, bound))


@query(f"{_LOG} SELECT version, count_if(date <> 0)::BIGINT AS updates, count_if(date = 0)::BIGINT AS deletes, MAX(date) AS lastdate, MIN(seq) AS first_seq FROM log GROUP BY version")
def version_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.version_stats(_log(spark, sf_dir))


@query(f"{_LOG} SELECT printf('%04d', version) || '/' || path AS key, version, path, date FROM (SELECT *, row_number() OVER (PARTITION BY version, path ORDER BY seq DESC) AS o FROM log) WHERE o = 1")
def all_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.all_versions(_log(spark, sf_dir))


@query(f"{_LOG} SELECT * FROM log WHERE version < 20")
def committed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 20 has no commit: it and what follows are not seen."""
    log = _log(spark, sf_dir)
    commits = log.select("version", (F.col("version") != 20).alias("committed")).distinct()
    return changelog.committed(log, commits)


_STATES = f"""{_LOG}, a AS (SELECT path, date FROM {_LAST.format(v=10)} WHERE o = 1 AND date <> 0), b AS (SELECT path, date FROM {_LAST.format(v=20)} WHERE o = 1 AND date <> 0)"""
_SYNC = _STATES + """, s AS (SELECT COALESCE(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.date = b.date THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path)"""


@query(f"{_SYNC} SELECT * FROM s")
def diff_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return C.sync(C.time_travel(log, 10), C.time_travel(log, 20), ["date"])


@query(f"{_STATES}, p AS (SELECT b.path, CASE WHEN a.path IS NULL THEN 'extract' WHEN a.date = b.date THEN '=' ELSE '?' END AS action FROM b LEFT JOIN a ON a.path = b.path) SELECT * FROM p")
def extract_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restoring version 20 over what version 10 left on disk."""
    log = _log(spark, sf_dir)
    return C.extract_plan(C.time_travel(log, 20), C.time_travel(log, 10), ["date"])


@query(f"{_LOG}, a AS (SELECT path FROM {_LAST.format(v=10)} WHERE o = 1 AND date <> 0), b AS (SELECT path FROM {_LAST.format(v=20)} WHERE o = 1 AND date <> 0) SELECT path FROM a EXCEPT SELECT path FROM b")
def deleted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return C.time_travel(log, 10).select("path").join(C.time_travel(log, 20), "path", "left_anti")


@query("SELECT doc_id, (l.doc_id IS NOT NULL) AS archived FROM (SELECT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def external_vs_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("archived", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").withColumn("archived", F.coalesce("archived", F.lit(False)))


_ADJUST = "SELECT event_type, event_id, u, MAX(d - i) OVER (PARTITION BY event_type ORDER BY user_id, event_id ROWS UNBOUNDED PRECEDING) + i AS adjusted FROM (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS d, epoch(date_trunc('second', ts))::BIGINT AS u, row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS i FROM events)"


@query(_ADJUST)
def monotonic_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", F.unix_timestamp("ts").alias("u"))
    return C.monotonic_dates(e, "event_type", ["user_id", "event_id"], "u").select("event_type", "event_id", "u", "adjusted")


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S')::BIGINT AS decimal_time, epoch(date_trunc('second', ts))::BIGINT AS unix_time FROM events")
def date_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select("event_id", dates.decimal_time(F.col("ts")).alias("decimal_time"))
    return d.withColumn("unix_time", dates.unix_time(F.col("decimal_time")))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))).alias("path"), F.octet_length("text").alias("size"))


_PATHS = "WITH f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.' || lang AS path, strlen(text) AS size FROM documents)"


@query(_PATHS + " SELECT path FROM f WHERE (regexp_full_match(path, 'src1.*/en(/.*)?', 's') OR regexp_full_match(path, 'src./fr/.*(/.*)?', 's')) AND NOT regexp_full_match(path, 'src1/.*', 's')")
def glob_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(text.selected(F.col("path"), ["src1*/en", "src?/fr/*"], without=["src1/"])).select("path")


@query(_PATHS + " SELECT path, CASE WHEN regexp_full_match(path, 'src1(/.*)?', 's') THEN 'first/' || path WHEN regexp_full_match(path, 'src./en(/.*)?', 's') THEN 'second/english/' || path ELSE path END AS renamed, 'out/' || path AS prefixed FROM f")
def rename_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, sf_dir).select("path", text.rename(p, [("src1", "first"), ("src?/en", "second/english/")]).alias("renamed"), text.rename(p, prefix="out/").alias("prefixed"))


@query(_PATHS + ", g AS (SELECT path, regexp_extract(path, '[^.]*$') AS ext, LEAST(size // 16384, 16777215) AS bucket FROM f) SELECT path, ext, bucket, row_number() OVER (PARTITION BY ext ORDER BY bucket DESC, path) AS rank FROM g")
def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cluster_order(_paths(spark, sf_dir)).select("path", "ext", "bucket", "rank")


@query("SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN role || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS carried FROM conversations")
def carry_forward_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat("role", F.col("turn").cast("string"))).alias("name"))
    return C.carry_forward(rows, "conv_id", "turn", "name").select("conv_id", "turn", "carried")


_BLOCKS = "WITH b AS (SELECT d.doc_id, d.source, strlen(d.text) AS size, COALESCE(l.toxic, 0) = 0 AS good FROM documents d LEFT JOIN (SELECT doc_id, MAX(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)), s AS (SELECT *, CASE WHEN NOT good THEN 'corrupted' WHEN NOT COALESCE(lag(good) OVER (PARTITION BY source ORDER BY doc_id), true) THEN 'recovered' ELSE 'ok' END AS status FROM b)"


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").alias("size")).join(bad, "doc_id", "left")
    return R.resync(docs.withColumn("good", F.coalesce("toxic", F.lit(0)) == 0), "source", "doc_id", "good")


@query(f"{_BLOCKS} SELECT doc_id, source, status FROM s")
def resync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir).select("doc_id", "source", "status")


@query(f"{_BLOCKS} SELECT source, COUNT(*) AS blocks, count_if(status = 'ok')::BIGINT AS ok, count_if(status = 'corrupted')::BIGINT AS corrupted, count_if(status = 'recovered')::BIGINT AS recovered, COALESCE(SUM(CASE WHEN status <> 'corrupted' THEN size END), 0)::BIGINT AS bytes FROM s GROUP BY source")
def recovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.report(_status(spark, sf_dir), "source", "size")


@query(f"{_BLOCKS} SELECT source, to_json({{'blocks': COUNT(*), 'ok': count_if(status = 'ok')::BIGINT, 'corrupted': count_if(status = 'corrupted')::BIGINT, 'recovered': count_if(status = 'recovered')::BIGINT}})::VARCHAR AS report FROM s GROUP BY source")
def recovery_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.report(_status(spark, sf_dir), "source", "size")
    return out.select("source", F.to_json(F.struct("blocks", "ok", "corrupted", "recovered")).alias("report"))


@query(
    "WITH p AS (SELECT doc_id, string_split(text, ' the ') AS p FROM documents) SELECT doc_id, (n - 1)::INT AS n, (list_sum(list_transform(p[1:n], lambda x: length(x))) + 5 * (n - 1))::INT AS \"offset\" FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS n FROM p)"
)
def marker_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.marker_offsets(table(spark, sf_dir, "documents"), "doc_id", "text", " the ")


@query("SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, COUNT(*) AS n, round(SUM(value), 2) AS total FROM events GROUP BY ALL")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.window_counts(table(spark, sf_dir, "events"))


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), h AS (SELECT user_id, ts, SUM(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, floor(epoch(MIN(ts)))::BIGINT AS start, floor(epoch(MAX(ts)) + 1800)::BIGINT AS \"end\", COUNT(*) AS n FROM h GROUP BY user_id, k"
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(table(spark, sf_dir, "events"))


@query("SELECT event_type, user_id % 10 AS bucket, COUNT(*) AS n, GROUPING(event_type)::BIGINT AS all_types FROM events GROUP BY CUBE (event_type, user_id % 10)")
def event_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 10)
    return e.cube("event_type", "bucket").agg(F.count("*").alias("n"), F.grouping("event_type").cast("long").alias("all_types"))
