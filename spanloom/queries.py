"""Every operator as a query over the driver's tables, with DuckDB SQL beside it.

``events`` stand for spans and assignments: a user's day is a trace, an event type a theme, ``view`` the
residual, a week the window. Queries run over whole tables; a limit stands only where it is the feature.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import privacy, text
from .functions import vectors as V
from .functions import rules
from .functions.providers import HashEmbedder, embed_column, estimate_cost
from .operators import cluster, registry, stats, store, traces
from .session import ship
from .sources import spans
from .streaming import staging

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- the tables as traces, assignments and themes

_STATE = {"signup": "new", "error": "regressed", "click": "active", "purchase": "resolved"}


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("trace_id"), F.concat(F.lit("agent-"), (F.col("user_id") % 3).cast("string")).alias("agent_id"), F.lit("kind").alias("facet"), F.when(F.col("event_type") != "view", F.concat("event_type", F.lit("-"), (F.col("user_id") % 3).cast("string"))).alias("theme_id"), F.col("value").alias("similarity"), F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("window")
    )


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assignments(spark, sf_dir).where("theme_id is not null")
    own = a.groupBy("agent_id", "facet", F.col("theme_id").alias("id")).agg(F.count("*").cast("int").alias("member_count"), F.min("window").alias("first_window"), F.max("window").alias("last_seen_window"))
    kind = F.split("id", "-")[0]
    state = F.lit("muted")
    for name, value in _STATE.items():
        state = F.when(kind == name, value).otherwise(state)
    return own.withColumn("label", F.concat(F.lit("traces of "), kind)).withColumn("state", state)


_A = """a AS (SELECT CAST(event_id AS VARCHAR) AS trace_id, 'agent-' || CAST(user_id % 3 AS VARCHAR) AS agent_id, 'kind' AS facet,
  CASE WHEN event_type <> 'view' THEN event_type || '-' || CAST(user_id % 3 AS VARCHAR) END AS theme_id, value AS similarity,
  strftime(date_trunc('week', ts), '%Y-%m-%d') AS "window" FROM events)"""
_T = """t AS (SELECT agent_id, facet, theme_id AS id, count(*) AS member_count, min("window") AS first_window, max("window") AS last_seen_window,
  'traces of ' || split_part(theme_id, '-', 1) AS label, CASE split_part(theme_id, '-', 1) WHEN 'signup' THEN 'new' WHEN 'error' THEN 'regressed'
  WHEN 'click' THEN 'active' WHEN 'purchase' THEN 'resolved' ELSE 'muted' END AS state
  FROM a WHERE theme_id IS NOT NULL GROUP BY agent_id, facet, theme_id)"""
_W = """w AS (SELECT agent_id, facet, "window", count(*) AS total, count(*) FILTER (WHERE theme_id IS NULL) AS residual FROM a GROUP BY agent_id, facet, "window")"""
_G = """g AS (SELECT k.agent_id, k.facet, k.theme_id, w."window", coalesce(c.n, 0) AS n, w.total, coalesce(c.n, 0) / CAST(w.total AS DOUBLE) AS share
  FROM (SELECT DISTINCT agent_id, facet, theme_id FROM a WHERE theme_id IS NOT NULL) k JOIN w ON k.agent_id = w.agent_id AND k.facet = w.facet
  LEFT JOIN (SELECT agent_id, facet, "window", theme_id, count(*) AS n FROM a GROUP BY agent_id, facet, "window", theme_id) c
  ON c.agent_id = k.agent_id AND c.facet = k.facet AND c.theme_id = k.theme_id AND c."window" = w."window")"""
_P = """r AS (SELECT agent_id, facet, "window", row_number() OVER (PARTITION BY agent_id, facet ORDER BY "window" DESC) AS place FROM w),
  p AS (SELECT x.agent_id, x.facet, y."window" AS from_window, x."window" AS to_window FROM r x JOIN r y ON x.agent_id = y.agent_id AND x.facet = y.facet WHERE x.place = 1 AND y.place = 2)"""
_PA = """p AS (SELECT x.agent_id, x.facet, x."window" AS from_window, y."window" AS to_window FROM w x JOIN w y ON x.agent_id = y.agent_id AND x.facet = y.facet AND x."window" <> y."window")"""
_D = """d0 AS (SELECT g.agent_id, g.facet, p.from_window, p.to_window, g.theme_id, max(CASE WHEN g."window" = p.from_window THEN n END) AS from_count,
  max(CASE WHEN g."window" = p.to_window THEN n END) AS to_count, max(CASE WHEN g."window" = p.from_window THEN share END) AS from_share,
  max(CASE WHEN g."window" = p.to_window THEN share END) AS to_share, coalesce(stddev_samp(CASE WHEN g."window" <> p.to_window THEN share END), 0) AS deviation
  FROM g JOIN p ON g.agent_id = p.agent_id AND g.facet = p.facet GROUP BY g.agent_id, g.facet, p.from_window, p.to_window, g.theme_id),
  d1 AS (SELECT d0.*, t.label, t.state, to_share - from_share AS delta, abs(to_share - from_share) > greatest(2.0 * deviation, 0.01) AS exceeded
  FROM d0 JOIN t ON t.id = d0.theme_id AND t.agent_id = d0.agent_id WHERE t.state <> 'muted' AND from_count + to_count > 0),
  d AS (SELECT *, CASE WHEN exceeded AND delta > 0 AND state IN ('regressed', 'resolved') THEN 'regression' WHEN exceeded AND delta > 0 AND from_count = 0 THEN 'new'
  WHEN exceeded THEN 'notable' ELSE 'info' END AS severity FROM d1)"""
_D_OUT = """agent_id, facet, from_window, to_window, theme_id, label, state, from_count, to_count, round(from_share, 6) AS from_share, round(to_share, 6) AS to_share,
  round(delta, 6) AS delta, CASE WHEN deviation > 0 THEN round(abs(delta) / deviation, 4) ELSE 0.0 END AS sigmas, severity"""


def _with(*parts: str, select: str) -> str:
    return f"WITH {', '.join(parts)} {select}"


def _findings(found: DataFrame) -> DataFrame:
    r = lambda c, n=6: F.round(c, n).alias(c)
    return found.select("agent_id", "facet", "from_window", "to_window", "theme_id", "label", "state", "from_count", "to_count", r("from_share"), r("to_share"), r("delta"), r("sigmas", 4), "severity")


@query(_with(_A, _T, _W, _G, _P, _D, select=f"SELECT {_D_OUT} FROM d"))
def delta_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: what changed between each agent's last two windows."""
    a = stats.counted(assignments(spark, sf_dir))
    return _findings(stats.deltas(a, themes(spark, sf_dir), stats.latest_pair(a)))


@query(_with(_A, _T, _W, _G, _PA, _D, select=f"SELECT {_D_OUT} FROM d"))
def delta_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = stats.counted(assignments(spark, sf_dir))
    return _findings(stats.deltas(a, themes(spark, sf_dir), stats.all_pairs(a)))


@query(_with(_A, _T, _W, _G, _PA, _D, select="SELECT agent_id, facet, from_window, to_window, theme_id, round(to_share, 6) AS to_share, round(delta, 6) AS delta, severity, to_share >= 0.2 AS failed FROM d WHERE severity IN ('regression', 'new')"))
def check_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = stats.counted(assignments(spark, sf_dir))
    found = stats.check(stats.deltas(a, themes(spark, sf_dir), stats.all_pairs(a)), min_share=0.2)
    return found.select("agent_id", "facet", "from_window", "to_window", "theme_id", F.round("to_share", 6).alias("to_share"), F.round("delta", 6).alias("delta"), "severity", "failed")


@query(_with(_A, _W, _P, select="""SELECT p.agent_id, p.facet, p.from_window, p.to_window, f.total AS from_total, t.total AS to_total,
  round(f.residual / CAST(f.total AS DOUBLE), 6) AS from_residual_share, round(t.residual / CAST(t.total AS DOUBLE), 6) AS to_residual_share
  FROM p JOIN w f ON f.agent_id = p.agent_id AND f.facet = p.facet AND f."window" = p.from_window JOIN w t ON t.agent_id = p.agent_id AND t.facet = p.facet AND t."window" = p.to_window"""))
def delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assignments(spark, sf_dir)
    return stats.delta_summary(a, stats.latest_pair(a)).select("agent_id", "facet", "from_window", "to_window", "from_total", "to_total", F.round("from_residual_share", 6).alias("from_residual_share"), F.round("to_residual_share", 6).alias("to_residual_share"))


@query(_with(_A, select="""SELECT agent_id, facet, "window", theme_id, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY agent_id, facet, "window") AS BIGINT) AS total FROM a GROUP BY agent_id, facet, "window", theme_id"""))
def theme_counts_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts_by_window(assignments(spark, sf_dir))


@query(_with(_A, _W, select="""SELECT agent_id, facet, "window", total, residual, round(residual / CAST(total AS DOUBLE), 6) AS share FROM w"""))
def residual_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.residual_share(assignments(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(_with(_A, _W, _G, select="""SELECT agent_id, facet, theme_id, "window", n, total, round(share, 6) AS share FROM g"""))
def theme_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.theme_series(assignments(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("""WITH a AS (SELECT 'orders' AS agent_id, o_orderpriority AS facet, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS theme_id, strftime(o_orderdate, '%Y-%m') AS "window" FROM orders), """ + _W + ", " + _G + """ SELECT agent_id, facet, theme_id, "window", n, total, round(share, 6) AS share FROM g""")
def order_status_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same series over another fact table: order states by month and priority."""
    o = read(spark, sf_dir, "orders")
    a = o.select(F.lit("orders").alias("agent_id"), F.col("o_orderpriority").alias("facet"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("theme_id"), F.date_format("o_orderdate", "yyyy-MM").alias("window"))
    return stats.theme_series(a).withColumn("share", F.round("share", 6))


@query(_with(_A, _W, select='SELECT agent_id, facet, "window", total, residual FROM w'))
def windows_for_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.windows(assignments(spark, sf_dir))


@query(_with(_A, _W, _P, select="SELECT * FROM p"))
def latest_window_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latest_pair(assignments(spark, sf_dir))


@query(_with(_A, _T, _W, _G, _P, """h AS (SELECT *, lag(share) OVER (PARTITION BY agent_id, facet, theme_id ORDER BY "window") AS previous_share, max(share) OVER (PARTITION BY agent_id, facet, theme_id) AS top,
  min(share) OVER (PARTITION BY agent_id, facet, theme_id) AS low, max("window") OVER (PARTITION BY agent_id, facet) AS latest FROM g)""",
  """s AS (SELECT theme_id, agent_id, string_agg(CASE WHEN top <= 0 THEN '▁' WHEN top = low THEN '▄' ELSE substr('▁▂▃▄▅▆▇█', CAST(floor(share / top * 7 + 0.5) AS INTEGER) + 1, 1) END, '' ORDER BY "window") AS spark FROM h GROUP BY theme_id, agent_id)""",
  select="""SELECT t.agent_id, t.facet, t.id AS theme_id, t.label, t.state, t.member_count, h."window", h.n, round(h.share, 6) AS share, round(h.previous_share, 6) AS previous_share,
  round(h.share - h.previous_share, 6) AS delta, s.spark, t.first_window = h."window" AND h.n > 0 AS is_new_here
  FROM t JOIN h ON h.theme_id = t.id AND h.agent_id = t.agent_id AND h."window" = h.latest JOIN s ON s.theme_id = t.id AND s.agent_id = t.agent_id"""))
def facet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.facet_report(stats.counted(assignments(spark, sf_dir)), themes(spark, sf_dir))
    r = lambda c: F.round(c, 6).alias(c)
    return found.select("agent_id", "facet", "theme_id", "label", "state", "member_count", "window", "n", r("share"), r("previous_share"), r("delta"), "spark", "is_new_here")


@query(_with(_A, _T, _W, _P, """l AS (SELECT agent_id, facet, "window" FROM r WHERE place = 1)""", select="""SELECT t.agent_id, t.facet, t.id AS theme_id, 'regressed' AS event, l."window",
  (SELECT count(*) FROM a WHERE a.theme_id = t.id AND a.agent_id = t.agent_id AND a."window" = l."window") AS n FROM t JOIN l ON l.agent_id = t.agent_id AND l.facet = t.facet
  WHERE t.state = 'regressed' AND t.last_seen_window = l."window" AND t.agent_id <> 'agent-1'"""))
def pending_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a log that holds agent-1's alert of this window already."""
    a = assignments(spark, sf_dir)
    log = stats.latest_windows(a, 1).where("agent_id = 'agent-1'").select("agent_id", F.lit("error-1").alias("theme_id"), F.lit("regressed").alias("event"), "window")
    return stats.pending_alerts(a, themes(spark, sf_dir), log).select("agent_id", "facet", "theme_id", "event", "window", "n")


@query("WITH " + _A + ", " + _T + """, s AS (SELECT * FROM a WHERE NOT (coalesce(theme_id, '') IN ('signup-0', 'click-1', 'error-2', 'purchase-0') AND "window" >= '2024-01-15')),
  recent AS (SELECT agent_id, facet, "window", dense_rank() OVER (PARTITION BY agent_id, facet ORDER BY "window" DESC) AS place, count(*) OVER (PARTITION BY agent_id, facet) AS windows FROM (SELECT DISTINCT agent_id, facet, "window" FROM s)),
  lively AS (SELECT DISTINCT s.theme_id FROM s JOIN recent r ON r.agent_id = s.agent_id AND r.facet = s.facet AND r."window" = s."window" WHERE r.place <= 2 AND s.theme_id IS NOT NULL)
  SELECT id FROM t WHERE state NOT IN ('resolved', 'muted') AND EXISTS (SELECT 1 FROM recent r WHERE r.agent_id = t.agent_id AND r.facet = t.facet AND r.windows > 2) AND NOT EXISTS (SELECT 1 FROM lively l WHERE l.theme_id = t.id)""")
def auto_resolve_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open themes without a trace in the last two windows; the fixture silences four themes from the third week on."""
    a = assignments(spark, sf_dir)
    quiet = F.coalesce(F.col("theme_id").isin("signup-0", "click-1", "error-2", "purchase-0"), F.lit(False)) & (F.col("window") >= "2024-01-15")
    return stats.empty_windows(a.where(~quiet), themes(spark, sf_dir), 2)


@query(_with(_A, _W, _P, select="""SELECT w.agent_id, w.facet, w."window", round(w.residual / CAST(w.total AS DOUBLE), 6) AS residual_share, w.residual / CAST(w.total AS DOUBLE) > 0.08 AS needed FROM w JOIN r ON r.agent_id = w.agent_id AND r.facet = w.facet AND r."window" = w."window" WHERE r.place = 1"""))
def needs_rediscovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.needs_rediscovery(assignments(spark, sf_dir)).withColumn("residual_share", F.round("residual_share", 6))


@query(_with(_A, _T, select="SELECT id, state AS from_state, CASE WHEN state = 'resolved' THEN 'regressed' WHEN state = 'new' AND member_count + 3 >= 100 THEN 'active' ELSE state END AS to_state FROM t"))
def lifecycle_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each theme after three more members, with activation at one hundred."""
    return themes(spark, sf_dir).select("id", F.col("state").alias("from_state"), registry.next_state_column(F.col("state"), F.col("member_count") + 3, F.lit(3), 100).alias("to_state"))


@query(_with(_A, "x AS (SELECT theme_id, trace_id, similarity, row_number() OVER (PARTITION BY theme_id ORDER BY similarity DESC, trace_id) AS place FROM a WHERE theme_id IS NOT NULL)", select="SELECT theme_id, place, trace_id, round(similarity, 6) AS similarity FROM x WHERE place <= 5"))
def exemplars_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.exemplars(assignments(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6)).withColumn("place", F.col("place").cast("long"))


# ---------------------------------------------------------------- events as spans


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span for each event: a user's day is a trace, the event type its tool."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.date_format("ts", "yyyy-MM-dd")
    attrs = F.map_from_arrays(F.array(F.lit("gen_ai.operation.name"), F.lit("gen_ai.tool.name"), F.lit("gen_ai.tool.output"), F.lit("service.name")), F.array(F.lit("execute_tool"), F.col("event_type"), F.col("props"), F.concat(F.lit("agent-"), (F.col("user_id") % 3).cast("string"))))
    start = F.unix_millis("ts").cast("double")
    status = F.when(F.col("event_type") == "error", F.struct(F.lit("ERROR").alias("code"), F.lit(None).cast("int").alias("code_num"), F.lit(None).cast("string").alias("message")))
    return e.select(F.concat_ws("/", F.col("user_id").cast("string"), day).alias("trace_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("span_id"), F.col("event_type").alias("name"), start.alias("start_ms"), (start + F.round(F.col("value") * 100)).alias("end_ms"), attrs.alias("attributes"), F.array().cast("array<struct<name:string,attributes:map<string,string>>>").alias("events"), status.alias("status"))


@query("""WITH s AS (SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS id, 'agent-' || CAST(user_id % 3 AS VARCHAR) AS agent_id, event_type, props, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(round(value * 100) AS BIGINT) AS end_ms, lpad(CAST(event_id AS VARCHAR), 12, '0') AS span_id FROM events),
  o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start_ms, span_id) AS place FROM s),
  f AS (SELECT id, event_type, min(place) AS first_at FROM o GROUP BY id, event_type)
  SELECT o.id, min(agent_id) AS agent_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS span_count, max(end_ms) - min(start_ms) AS duration_ms, bool_or(event_type = 'error') AS has_error,
  (SELECT string_agg(f.event_type, ',' ORDER BY first_at) FROM f WHERE f.id = o.id) AS tools,
  string_agg('## execute_tool (' || CAST(end_ms - start_ms AS VARCHAR) || 'ms)' || chr(10) || 'tool: ' || event_type || chr(10) || 'tool result: ' || props || CASE WHEN event_type = 'error' THEN chr(10) || 'status: error' ELSE '' END, chr(10) ORDER BY place) AS text
  FROM o GROUP BY o.id""")
def trace_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    t = traces.assemble(event_spans(spark, sf_dir))
    return t.select("id", "agent_id", F.unix_millis("started_at").alias("start_ms"), F.unix_millis("ended_at").alias("end_ms"), F.col("meta.span_count").cast("long").alias("span_count"), F.col("meta.duration_ms").cast("long").alias("duration_ms"), F.col("meta.has_error").alias("has_error"), F.array_join("meta.tools", ",").alias("tools"), "text")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), event_type) AS first_of FROM events""")
def span_json_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    attrs = F.from_json("props", "map<string,string>")
    span = F.struct(attrs.alias("attributes"))
    return e.select("event_id", F.try_element_at(attrs, F.lit("k")).alias("k"), F.coalesce(traces.first_by_priority(F.array(span), ("missing", "k")), "event_type").alias("first_of"))


@query("""SELECT event_id, coalesce(nullif(CASE WHEN user_id % 2 = 0 THEN 'v1.' || CAST(user_id % 5 AS VARCHAR) ELSE '' END, ''), strftime(ts, '%Y-%m-%d')) AS "window" FROM events""")
def window_of_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    version = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("v1."), (F.col("user_id") % 5).cast("string"))).otherwise("")
    return e.select("event_id", traces.window_of(version, F.col("ts")).alias("window"))


_PEND = "n AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, ts AS received_at, event_id FROM events)"


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("trace_id"), F.col("ts").alias("received_at"), "event_id")


@query(_with(_PEND, select="SELECT trace_id, max(received_at) AS last_at, count(*) AS spans FROM n GROUP BY trace_id HAVING max(received_at) <= TIMESTAMP '2024-01-30 00:00:00' ORDER BY trace_id LIMIT 1000"))
def settled_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.settled_traces(pending(spark, sf_dir), F.lit("2024-01-30 00:00:00").cast("timestamp"), 1000)


@query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM events),
  n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s) SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first_at, max(ts) AS last_at, count(*) AS spans FROM n GROUP BY user_id, session""")
def session_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions closed by twelve quiet hours: the batch form of quiet-period assembly."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), F.col("ts").alias("received_at"))
    found = staging.quiet_periods(rows, "12 hours", F.count("*").alias("spans")).withColumnRenamed("trace_id", "user_id")
    return found.withColumn("session", F.row_number().over(Window.partitionBy("user_id").orderBy("first_at")).cast("long"))


@query("""WITH b AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) SELECT user_id, event_id, event_type FROM b WHERE r = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100)""")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    table = e.where("event_type = 'signup' and value > 100").select("user_id").distinct()
    return traces.insert_or_ignore(table, e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""WITH b AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_type, event_id, value FROM b WHERE r = 1""")
def insert_or_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return traces.latest_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) ELSE substr(sha256(props || event_type), 1, 32) END AS span_key FROM events""")
def span_dedupe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", traces.dedupe_key(F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")), F.concat("props", "event_type")).alias("span_key"))


def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each event, in one of three span shapes, and some that are none: (line_no, value).

    Events are dealt to tasks anew, as a table of a million rows may be one row group, and so one task. A line is unfolded from a list of one, below
    which no filter on it is moved: whatever reads it does so after the events have been dealt.
    """
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", F.col("ts").cast("timestamp").alias("ts")).repartition("event_id")
    n, ms = F.col("event_id"), F.unix_millis("ts")
    quoted = lambda x: F.to_json(F.struct(x.alias("v")))
    k = F.get_json_object("props", "$.k")
    flat = F.format_string('{"trace_id":"u%s","span_id":"s%s","name":"%s","start_time":%s,"end_time":"%s","attributes":{"k":%s,"kind":"%s","none":null},"status":{"code":%s}}', "user_id", n, "event_type", ms, F.date_format(F.timestamp_millis(ms + 1500), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), k, "event_type", F.when(F.col("event_type") == "error", F.lit("2")).otherwise('"OK"'))
    wire = '{"traceId":"u%s","spanId":"s%s","startTimeUnixNano":"%s000000","endTimeUnixNano":%s000000,"attributes":[{"key":"k","value":{"intValue":"%s"}},{"key":"kind","value":{"stringValue":"%s"}},{"key":"list","value":{"arrayValue":{"values":[{"boolValue":true},{"doubleValue":2.5}]}}}]}'
    camel = F.format_string(wire, "user_id", n, ms, ms + 1500, k, "event_type")
    envelope = F.format_string('{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc"}},{"key":"k","value":{"intValue":9}}]},"scopeSpans":[{"spans":[%s]}]}]}', camel)
    bad = F.when(n % 50 == 7, "not json").when(n % 50 == 8, '{"name":"no trace"}').when(n % 50 == 9, " ").when(n % 50 == 10, "[1]")
    return e.select(n.alias("line_no"), F.explode(F.array(F.coalesce(bad, F.when(n % 3 == 0, flat).when(n % 3 == 1, camel).otherwise(envelope)))).alias("value"))


@query("""WITH e AS (SELECT event_id AS n, event_id % 50 AS odd, event_id % 3 AS shape, epoch_us(ts) // 1000 AS ms, * FROM events WHERE event_id % 50 <> 9), g AS (SELECT *, odd IN (7, 8, 10) AS bad FROM e)
  SELECT n AS line_no, CASE WHEN NOT bad THEN 'u' || user_id END AS trace_id, CASE WHEN NOT bad THEN 's' || event_id END AS span_id, CASE WHEN NOT bad AND shape = 0 THEN event_type END AS name, CASE WHEN NOT bad THEN CAST(ms AS DOUBLE) END AS start_ms, CASE WHEN NOT bad THEN CAST(ms + 1500 AS DOUBLE) END AS end_ms,
  CASE WHEN NOT bad THEN json_extract_string(props, '$.k') END AS k, CASE WHEN NOT bad THEN event_type END AS kind, CASE WHEN NOT bad AND shape <> 0 THEN '[true,2.5]' END AS list, CASE WHEN NOT bad AND shape = 2 THEN 'svc' END AS service,
  CASE WHEN bad OR shape <> 0 THEN NULL WHEN event_type = 'error' THEN '2' ELSE 'OK' END AS code, CASE WHEN NOT bad AND shape = 0 AND event_type = 'error' THEN 2 END AS code_num, CASE odd WHEN 7 THEN 'line ' || n || ': invalid JSON' WHEN 8 THEN 'line ' || n || ': span has no trace id' WHEN 10 THEN 'line ' || n || ': not a JSON object' END AS error FROM g""")
def span_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three shapes, and of none, as normalized spans and rejected lines."""
    found = spans.parse_lines(span_lines(spark, sf_dir))
    attr = lambda name: F.try_element_at("attributes", F.lit(name))
    return found.select("line_no", "trace_id", "span_id", "name", F.round("start_ms", 1).alias("start_ms"), F.round("end_ms", 1).alias("end_ms"), attr("k").alias("k"), attr("kind").alias("kind"), attr("list").alias("list"), attr("service.name").alias("service"), F.col("status.code").alias("code"), F.col("status.code_num").alias("code_num"), "error")


# ---------------------------------------------------------------- conversations as traces and summaries


def conversation_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each conversation: ordered ``role: text`` lines."""
    c = read(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", r"\s+", " "))
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    line = lambda x: F.concat(x["role"], F.lit(": "), x["text"])
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600)
    return whole.select(F.lpad(F.col("conv_id").cast("string"), 8, "0").alias("id"), F.concat(F.lit("agent-"), (F.col("conv_id") % 2).cast("string")).alias("agent_id"), F.lit(None).cast("string").alias("version"), at.alias("started_at"), F.array_join(F.transform("x", line), "\n").alias("text"))


def conversation_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two facets for even conversations, one for others; every third lacks a vector."""
    t = conversation_traces(spark, sf_dir).withColumn("n", F.col("id").cast("long"))
    facet = F.explode(F.when(F.col("n") % 2 == 0, F.array(F.lit("goal"), F.lit("outcome"))).otherwise(F.array(F.lit("goal"))))
    vector = F.when(F.col("n") % 3 != 0, F.array(F.lit(1.0), F.lit(0.0)))
    return t.select(F.col("id").alias("trace_id"), facet.alias("facet"), text.key_phrase(text.extract_input(F.col("text")), "unclear").alias("summary"), vector.alias("embedding"))


def conversation_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = conversation_summaries(spark, sf_dir)
    n = F.col("trace_id").cast("long")
    return s.where(n % 5 != 0).select("trace_id", F.concat(F.lit("agent-"), (n % 2).cast("string")).alias("agent_id"), "facet", F.when(n % 4 != 1, F.lit("T-1")).alias("theme_id"), (n % 10 / 10).alias("similarity"), F.lit("w").alias("window"))


_CT = r"""ct AS (SELECT lpad(CAST(conv_id AS VARCHAR), 8, '0') AS id, conv_id AS n, 'agent-' || CAST(conv_id % 2 AS VARCHAR) AS agent_id, TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL 1 HOUR AS started_at,
  string_agg(role || ': ' || regexp_replace(text, '\s+', ' ', 'g'), chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id)"""
_CS = """cs AS (SELECT id AS trace_id, n, agent_id, 'goal' AS facet, n % 3 <> 0 AS embedded FROM ct UNION ALL SELECT id, n, agent_id, 'outcome', n % 3 <> 0 FROM ct WHERE n % 2 = 0)"""
_CA = """ca AS (SELECT trace_id, n, agent_id, facet, CASE WHEN n % 4 <> 1 THEN 'T-1' END AS theme_id, (n % 10) / 10.0 AS similarity FROM cs WHERE n % 5 <> 0)"""


@query(_with(_CT, select="SELECT id, agent_id, text FROM ct"))
def trace_text_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_traces(spark, sf_dir).select("id", "agent_id", "text")


@query(_with(_CT, _CS, select="SELECT ct.id, ct.agent_id FROM ct LEFT JOIN (SELECT trace_id, count(*) AS have FROM cs GROUP BY trace_id) h ON h.trace_id = ct.id WHERE coalesce(have, 0) < 2 AND started_at >= TIMESTAMP '2024-01-02 00:00:00'"))
def traces_needing_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = datetime(2024, 1, 2, tzinfo=timezone.utc)
    return store.needing_summaries(conversation_traces(spark, sf_dir), conversation_summaries(spark, sf_dir), ["goal", "outcome"], since=since).select("id", "agent_id")


@query(_with(_CT, select="SELECT id FROM ct WHERE (started_at, id) > (TIMESTAMP '2024-01-01 10:00:00', '00000010') ORDER BY started_at, id LIMIT 50"))
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(conversation_traces(spark, sf_dir), 50, (datetime(2024, 1, 1, 10, tzinfo=timezone.utc), "00000010")).select("id")


@query(_with(_CT, _CS, select="SELECT count(*) AS traces, CAST(coalesce(sum(least(length(text), 2000)), 0) AS BIGINT) AS chars FROM ct LEFT JOIN (SELECT trace_id, count(*) AS have FROM cs GROUP BY trace_id) h ON h.trace_id = ct.id WHERE coalesce(have, 0) < 2"))
def pending_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = store.needing_summaries(conversation_traces(spark, sf_dir), conversation_summaries(spark, sf_dir), ["goal", "outcome"])
    return store.pending_stats(waiting, 2000)


@query(_with(_CT, _CS, _CA, select="SELECT ct.agent_id, count(*) AS uncovered FROM ct LEFT JOIN (SELECT trace_id, count(DISTINCT facet) AS k FROM ca GROUP BY trace_id) c ON c.trace_id = ct.id WHERE coalesce(k, 0) < 2 GROUP BY ct.agent_id"))
def uncovered_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.uncovered(conversation_traces(spark, sf_dir), conversation_assignments(spark, sf_dir), 2)


@query(_with(_CT, select="SELECT id, agent_id FROM ct WHERE agent_id = 'agent-1' AND started_at >= TIMESTAMP '2024-01-02 00:00:00' ORDER BY started_at, id LIMIT 40"))
def list_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.list_traces(conversation_traces(spark, sf_dir), "agent-1", datetime(2024, 1, 2, tzinfo=timezone.utc), 40).select("id", "agent_id")


@query(_with(_CT, select="SELECT DISTINCT agent_id FROM ct"))
def distinct_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.distinct_agents(conversation_traces(spark, sf_dir))


@query(_with(_CT, _CS, _CA, select="SELECT facet, count(*) AS summaries, count(*) FILTER (WHERE trace_id IN (SELECT trace_id FROM ca WHERE theme_id = 'T-1')) AS themed FROM cs GROUP BY facet"))
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct facets, with counts of their summaries, and of those of traces that have a theme."""
    s, a = conversation_summaries(spark, sf_dir), conversation_assignments(spark, sf_dir)
    themed = s.join(store.get(a, theme_id="T-1").select("trace_id").distinct(), "trace_id", "left_semi")
    parts = [store.counts(s, facet=f).select(F.lit(f).alias("facet"), F.col("n").alias("summaries")).crossJoin(store.counts(themed, facet=f).withColumnRenamed("n", "themed")) for f in ("goal", "outcome")]  # single rows
    return store.distinct_facets(s).join(parts[0].unionByName(parts[1]), "facet")


@query(_with(_CT, _CS, _CA, select="SELECT cs.trace_id, cs.facet, cs.agent_id, strftime(ct.started_at, '%Y-%m-%d') AS \"window\" FROM cs JOIN ct ON ct.id = cs.trace_id LEFT JOIN ca ON ca.trace_id = cs.trace_id AND ca.facet = cs.facet WHERE cs.embedded AND ca.theme_id IS NULL"))
def unassigned_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = store.unassigned_pool(conversation_summaries(spark, sf_dir), conversation_traces(spark, sf_dir), conversation_assignments(spark, sf_dir))
    return pool.select("trace_id", "facet", "agent_id", "window")


@query(_with(_CT, _CS, select="SELECT trace_id, facet FROM cs WHERE NOT embedded"))
def lacking_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.lacking_embeddings(conversation_summaries(spark, sf_dir)).select("trace_id", "facet")


_INPUT = r"""i0 AS (SELECT id, n, agent_id, text, trim(regexp_extract(text, '(?:^|\n)(?:user|input): ([^\n]*\S[^\n]*)', 1), ' ') AS found FROM ct),
  i AS (SELECT id, n, agent_id, CASE WHEN found <> '' THEN substr(found, 1, 4000) ELSE trim(substr(text, 1, 4000), ' ') END AS input FROM i0)"""


@query(_with(_CT, _CS, _CA, _INPUT, "e AS (SELECT facet, trace_id, row_number() OVER (PARTITION BY theme_id ORDER BY similarity DESC, trace_id, facet) AS place FROM ca WHERE theme_id IS NOT NULL)", select="SELECT 'T-1' AS theme_id, e.facet, e.place, e.trace_id AS source_trace_id, i.input FROM e JOIN i ON i.id = e.trace_id WHERE place <= 10"))
def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = store.traces_for_theme(conversation_traces(spark, sf_dir), conversation_assignments(spark, sf_dir).dropDuplicates(["trace_id", "facet"]), 10)
    return top.select("theme_id", "facet", F.col("place").cast("long").alias("place"), F.col("id").alias("source_trace_id"), text.extract_input(F.col("text")).alias("input"))


@query(_with(_CT, _INPUT, select="SELECT id, input FROM i"))
def extract_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_traces(spark, sf_dir).select("id", text.extract_input(F.col("text")).alias("input"))


@query(r"""WITH k AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS flat FROM documents) SELECT doc_id, CASE WHEN flat = '' THEN 'unclear' WHEN length(flat) > 90 THEN substr(flat, 1, 87) || '...' ELSE flat END AS phrase FROM k""")
def key_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.key_phrase(F.col("text"), "unclear").alias("phrase"))


@query("""SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 250) || chr(10) || '...[trace truncated]...' || chr(10) || right(text, 250) ELSE text END AS clipped FROM documents""")
def clip_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.clip(F.col("text"), 500).alias("clipped"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS seen FROM documents GROUP BY source, lang), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, seen) AS p FROM c) SELECT source, lang AS label FROM r WHERE p = 1""")
def stub_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    members = d.select(F.lit("a").alias("agent_id"), F.lit("lang").alias("facet"), F.col("source").alias("cluster"), F.col("lang").alias("summary"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("trace_id"))
    return registry.stub_labels(members).select(F.col("cluster").alias("source"), "label")


def told_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day as rendered text: requests, steps, tools, errors, waits and answers by event type."""
    k = F.get_json_object("props", "$.k").cast("int")
    say = lambda head, x, tail="": F.concat(F.lit(head), x.cast("string"), F.lit(tail))
    kind = F.col("event_type")
    line = F.when(kind == "signup", say("input: join ", k)).when(kind == "click", say("tool: t", k % 3, " args: {}")).when(kind == "error", say("ERROR: code ", k % 4)).when(kind == "purchase", say("output: bought ", k)).when(k % 7 == 0, say("page ", k, " timed out")).otherwise(say("## page (", k, "ms)"))
    e = read(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("id"), F.struct("ts", "event_id", line.alias("line")).alias("x"))
    return e.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS place FROM events),
  v AS (SELECT id, place, k, CASE WHEN kind = 'signup' THEN 'ask' WHEN kind = 'click' THEN 'tool' WHEN kind = 'error' THEN 'error' WHEN kind = 'purchase' THEN 'answer' WHEN k % 7 = 0 THEN 'stall' ELSE 'step' END AS kind,
    CASE WHEN kind = 'signup' THEN 'join ' || k WHEN kind = 'click' THEN 't' || (k % 3) WHEN kind = 'error' THEN 'code ' || (k % 4) WHEN kind = 'purchase' THEN 'bought ' || k ELSE 'page ' || k || ' timed out' END AS what FROM e),
  bad AS (SELECT id, min(place) AS place FROM v WHERE kind IN ('error', 'stall') GROUP BY id),
  f AS (SELECT v.id, count(*) FILTER (WHERE kind = 'step') AS steps, coalesce(max(k) FILTER (WHERE kind = 'step'), 0) AS slowest, arg_min(what, v.place) FILTER (WHERE kind = 'ask') AS goal, arg_max(kind || ': ' || what, v.place) FILTER (WHERE kind IN ('answer', 'error', 'stall')) AS outcome,
    count(*) FILTER (WHERE kind = 'answer') AS good, count(*) FILTER (WHERE kind IN ('error', 'stall')) AS wrong, max(what) FILTER (WHERE v.place = bad.place) AS onset, arg_max(what, v.place) FILTER (WHERE kind = 'tool' AND v.place < bad.place) AS tool FROM v LEFT JOIN bad ON bad.id = v.id GROUP BY v.id),
  told AS (SELECT id, kind, what || CASE WHEN count(*) > 1 THEN ' (recurs)' ELSE '' END AS what, min(place) AS place FROM v WHERE kind IN ('tool', 'error', 'stall') GROUP BY id, kind, v.what),
  kinds AS (SELECT id, kind, kind || ': ' || string_agg(what, ', ' ORDER BY place) AS what FROM told GROUP BY id, kind),
  tally AS (SELECT id, string_agg(what, '; ' ORDER BY CASE kind WHEN 'tool' THEN 1 WHEN 'error' THEN 2 ELSE 3 END) AS behavior FROM kinds GROUP BY id)
  SELECT f.id, steps, slowest, coalesce(goal, 'nothing to tell') AS goal, coalesce(outcome, 'nothing to tell') AS outcome, coalesce(behavior, 'nothing to tell') AS behavior, CASE WHEN wrong = 0 THEN 'calm' WHEN good > wrong THEN 'mixed' ELSE 'troubled' END AS sentiment,
    coalesce(onset || ' after ' || coalesce(tool, 'no tool'), 'nothing to tell') AS failure_stage FROM f LEFT JOIN tally t ON t.id = f.id""")
def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each day's text, and one line for each of several facets, by rules."""
    told = told_days(spark, sf_dir).select("id", rules.events(F.col("text")).alias("e"), rules.summaries(F.col("text"), ["goal", "outcome", "behavior", "sentiment", "failure-stage"]).alias("m"))
    steps = F.size(F.filter("e", lambda x: x["kind"] == "step")).cast("long")
    return told.select("id", steps.alias("steps"), rules.slowest(F.col("e")).alias("slowest"), *[F.col("m")[f].alias(f.replace("-", "_")) for f in ("goal", "outcome", "behavior", "sentiment", "failure-stage")])


@query("""WITH t AS (SELECT conv_id, turn, md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS h FROM conversations),
  c AS (SELECT conv_id, turn, CAST('0x' || substr(h, 1, 7) AS BIGINT) % 64 AS pos, sum(CASE WHEN substr(h, 8, 1) >= '8' THEN 1.0 ELSE -1.0 END) AS x FROM t GROUP BY ALL), n AS (SELECT conv_id, turn, sqrt(sum(x * x)) AS size FROM c GROUP BY ALL)
  SELECT c.conv_id, c.turn, CAST(pos AS INTEGER) AS pos, round(CAST(x / size AS DOUBLE), 6) AS x FROM c JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn WHERE x <> 0""")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of every vector that isn't zero."""
    d = read(spark, sf_dir, "conversations")
    vector = embed_column(F.col("text"), HashEmbedder(64))
    return d.select("conv_id", "turn", F.posexplode(vector).alias("pos", "x")).where("x <> 0").withColumn("x", F.round("x", 6))


@query(_with(_CT, select="""SELECT count(*) AS traces, CAST(sum(least(length(text), 24000)) AS BIGINT) AS chars, count(*) * 120 AS output_tokens, count(*) * 100 AS embed_tokens FROM ct"""))
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .config import Config

    per = estimate_cost(1, 0, Config())
    return store.pending_stats(conversation_traces(spark, sf_dir)).select("traces", "chars", (F.col("traces") * per["output_tokens"]).alias("output_tokens"), (F.col("traces") * per["embed_tokens"]).alias("embed_tokens"))


# ---------------------------------------------------------------- vectors


def vector_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", V.as_double(F.col("embedding")).alias("vector"))


def vector_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = V.mean_vectors(vector_items(spark, sf_dir), ["label"], "vector")
    return means.select(F.concat(F.lit("T-"), F.col("label").cast("string")).alias("theme_id"), "centroid")


_V = "v AS (SELECT vec_id, label, dim, CAST(embedding[dim] AS DOUBLE) AS x FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS dim) k)"
_C = "c AS (SELECT 'T-' || CAST(label AS VARCHAR) AS theme_id, label, dim, avg(x) AS x FROM v GROUP BY label, dim)"
_S = """vn AS (SELECT vec_id, sqrt(sum(x * x)) AS size FROM v GROUP BY vec_id), cn AS (SELECT theme_id, sqrt(sum(x * x)) AS size FROM c GROUP BY theme_id),
  s AS (SELECT v.vec_id, c.theme_id, sum(v.x * c.x) / (max(vn.size) * max(cn.size)) AS similarity FROM v JOIN c ON v.dim = c.dim JOIN vn ON vn.vec_id = v.vec_id JOIN cn ON cn.theme_id = c.theme_id GROUP BY v.vec_id, c.theme_id),
  b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, theme_id) AS place FROM s)"""


@query(_with(_V, _C, select="SELECT theme_id, CAST(dim - 1 AS INTEGER) AS pos, round(x, 6) AS x FROM c"))
def centroid_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_themes(spark, sf_dir).select("theme_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(_with(_V, _C, _S, select="SELECT vec_id, theme_id, round(similarity, 6) AS similarity FROM b WHERE place = 1"))
def nearest_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = vector_items(spark, sf_dir).withColumnRenamed("vec_id", "item_id")
    return V.nearest(items, vector_themes(spark, sf_dir)).select(F.col("item_id").alias("vec_id"), "theme_id", F.round("similarity", 6).alias("similarity"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_items(spark, sf_dir).select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("trace_id"), F.lit("a").alias("agent_id"), F.lit("f").alias("facet"), F.col("vector").alias("embedding"), F.concat(F.lit("w"), (F.col("vec_id") % 4).cast("string")).alias("window"), F.col("label").cast("string").alias("summary"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = vector_themes(spark, sf_dir)
    n = F.substring("theme_id", 3, 9).cast("int")
    return t.select(F.col("theme_id").alias("id"), F.lit("a").alias("agent_id"), F.lit("f").alias("facet"), F.col("theme_id").alias("label"), F.lit("").alias("description"), F.when(n % 2 == 0, "new").otherwise("resolved").alias("state"), "centroid", (n + 5).alias("member_count"), F.array().cast("array<string>").alias("exemplar_trace_ids"), F.lit(NOW).alias("created_at"), F.lit(NOW).alias("updated_at"), F.lit("w1").alias("first_window"), F.lit("w1").alias("last_seen_window"), F.lit(None).cast("string").alias("note"))


@query(_with(_V, _C, _S, select="SELECT lpad(CAST(vec_id AS VARCHAR), 9, '0') AS trace_id, CASE WHEN similarity >= 0.25 THEN theme_id END AS theme_id, round(similarity, 6) AS similarity FROM b WHERE place = 1"))
def assign_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.assign_frozen(_pool(spark, sf_dir), _registry(spark, sf_dir), 0.25).select("trace_id", "theme_id", F.round("similarity", 6).alias("similarity"))


@query(_with(_V, _C, _S, "h AS (SELECT theme_id, count(*) AS added, min('w' || CAST(vec_id % 4 AS VARCHAR)) AS least FROM b WHERE place = 1 AND similarity >= 0.25 GROUP BY theme_id)",
  "z AS (SELECT b.theme_id, v.dim, sum(v.x) AS x FROM b JOIN v ON v.vec_id = b.vec_id WHERE place = 1 AND similarity >= 0.25 GROUP BY b.theme_id, v.dim)",
  "k AS (SELECT DISTINCT theme_id, label FROM c)", "u AS (SELECT c.theme_id, (c.x * (c.label + 5) + coalesce(z.x, 0)) / (c.label + 5 + coalesce(h.added, 0)) AS x FROM c LEFT JOIN z ON z.theme_id = c.theme_id AND z.dim = c.dim LEFT JOIN h ON h.theme_id = c.theme_id)",
  select="""SELECT k.theme_id AS id, CAST(k.label + 5 + coalesce(h.added, 0) AS INTEGER) AS member_count, CASE WHEN coalesce(h.added, 0) = 0 THEN CASE WHEN k.label % 2 = 0 THEN 'new' ELSE 'resolved' END WHEN k.label % 2 = 1 THEN 'regressed' WHEN k.label + 5 + h.added >= 10 THEN 'active' ELSE 'new' END AS state,
  least('w1', coalesce(h.least, 'w1')) AS first_window, round((SELECT sum(u.x) FROM u WHERE u.theme_id = k.theme_id), 6) AS centroid_sum FROM k LEFT JOIN h ON h.theme_id = k.theme_id"""))
def centroid_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool, themes_ = _pool(spark, sf_dir), _registry(spark, sf_dir)
    after = registry.fold_frozen(themes_, pool, registry.assign_frozen(pool, themes_, 0.25), NOW)
    return after.select("id", "member_count", "state", "first_window", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6).alias("centroid_sum"))


_PAIR = """vn AS (SELECT vec_id, sqrt(sum(x * x)) AS size FROM v GROUP BY vec_id), s AS (SELECT a.vec_id AS a, b.vec_id AS b, 1 - sum(a.x * b.x) / (max(m.size) * max(n.size)) AS distance
  FROM v a JOIN v b ON a.dim = b.dim AND a.vec_id < b.vec_id JOIN vn m ON m.vec_id = a.vec_id JOIN vn n ON n.vec_id = b.vec_id WHERE a.label = b.label GROUP BY a.vec_id, b.vec_id)"""


@query(_with(_V, _PAIR, select="SELECT a, b, round(distance, 6) AS distance FROM s WHERE distance <= 0.65"))
def edges_within_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = vector_items(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return cluster.edges(items.select("label", "id", "vector"), ["label"], 0.65).select("a", "b", F.round("distance", 6).alias("distance"))


_EDGES = "e AS (SELECT a, b FROM s WHERE distance <= 0.65 UNION ALL SELECT b, a FROM s WHERE distance <= 0.65)"


@query("WITH RECURSIVE " + ", ".join((_V, _PAIR, _EDGES, "reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r)")) + " SELECT m.label, reach.id, min(reach.r) AS root FROM reach JOIN embeddings m ON m.vec_id = reach.id GROUP BY m.label, reach.id")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = vector_items(spark, sf_dir).withColumnRenamed("vec_id", "id").select("label", "id", "vector")
    return cluster.components(items, cluster.edges(items, ["label"], 0.65).drop("distance"), ["label"])


# average linkage step by step: at each step every label merges its closest pair of groups, while there is one within the threshold
@query("WITH RECURSIVE " + ", ".join((_V, _PAIR, """d AS (SELECT a, b, distance FROM s UNION ALL SELECT b, a, distance FROM s),
  walk(step, label, id, grp) AS (SELECT 0, label, vec_id, vec_id FROM embeddings UNION ALL (
    WITH g AS (SELECT x.label, x.grp AS p, y.grp AS q, avg(d.distance) AS apart FROM walk x JOIN walk y ON x.label = y.label AND x.grp < y.grp JOIN d ON d.a = x.id AND d.b = y.id GROUP BY x.label, x.grp, y.grp),
    m AS (SELECT label, arg_min(p, (apart, p, q)) AS p, arg_min(q, (apart, p, q)) AS q FROM g WHERE apart <= 0.7 GROUP BY label)
    SELECT w.step + 1, w.label, w.id, CASE WHEN w.grp = m.q THEN m.p ELSE w.grp END FROM walk w JOIN m ON m.label = w.label)),
  final AS (SELECT label, id, arg_max(grp, step) AS grp FROM walk GROUP BY label, id)""")) + " SELECT label, id, CASE WHEN count(*) OVER (PARTITION BY label, grp) >= 2 THEN min(id) OVER (PARTITION BY label, grp) END AS cluster FROM final")
def upgma_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = vector_items(spark, sf_dir).withColumnRenamed("vec_id", "id").select("label", "id", "vector")
    return cluster.discover(items, ["label"], 0.7, 2)


# the order-dependent rule, item by item: one row holds all centroids and counts as they stand
@query("WITH RECURSIVE " + ", ".join((_V, _C, """i AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, lpad(CAST(vec_id AS VARCHAR), 9, '0') AS trace_id, 'w' || CAST(vec_id % 4 AS VARCHAR) AS w, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  k AS (SELECT theme_id, label, list(x ORDER BY dim) AS x FROM c GROUP BY theme_id, label),
  start AS (SELECT list(theme_id ORDER BY theme_id) AS names, list(x ORDER BY theme_id) AS means, list(label + 5 ORDER BY theme_id) AS sizes FROM k),
  walk AS (SELECT 0 AS n, names, means, [CAST(z AS DOUBLE) for z in sizes] AS sizes, CAST(NULL AS VARCHAR) AS trace_id, CAST(NULL AS VARCHAR) AS w, CAST(NULL AS VARCHAR) AS theme_id, CAST(NULL AS DOUBLE) AS similarity FROM start UNION ALL
    SELECT n, names, CASE WHEN best < 0.25 THEN means ELSE list_transform(means, lambda m, p: CASE WHEN p = place THEN list_transform(m, lambda y, q: (y * sizes[place] + v[q]) / (sizes[place] + 1)) ELSE m END) END,
      CASE WHEN best < 0.25 THEN sizes ELSE list_transform(sizes, lambda z, p: CASE WHEN p = place THEN z + 1 ELSE z END) END, trace_id, w, CASE WHEN best >= 0.25 THEN names[place] END, best
    FROM (SELECT *, list_max(sims) AS best, list_position(sims, list_max(sims)) AS place FROM (SELECT i.n, walk.names, walk.means, walk.sizes, i.trace_id, i.w, i.v, list_transform(walk.means, lambda m: list_cosine_similarity(m, i.v)) AS sims FROM walk JOIN i ON i.n = walk.n + 1)))""")) + ' SELECT trace_id, theme_id, round(similarity, 6) AS similarity, w AS "window" FROM walk WHERE n > 0')
def assign_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-dependent rule, scope by scope."""
    events = registry.assign_exact(_pool(spark, sf_dir), _registry(spark, sf_dir), NOW, 0.25)
    return registry.assignments_of(events).select("trace_id", "theme_id", F.round("similarity", 6).alias("similarity"), "window")


# ---------------------------------------------------------------- privacy


@query(r"""SELECT page_id, regexp_replace(url, '(?i)\b(https?://[^\s<>"''?]+)\?[^\s<>"'']*', '\1?<URL>', 'g') AS url FROM pages""")
def redact_url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", privacy.mask(F.col("url"), ("url",)).alias("url"))


_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"(?i)\b(?:{_OCTET}\.){{3}}{_OCTET}\b|\b(?:[0-9a-f]{{1,4}}:){{7}}[0-9a-f]{{1,4}}\b"
_CARD = r"\b\d(?:[ -]?\d){11,18}\b"


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '{_EMAIL}', '<EMAIL>', 'g'), '{_IP}', '<IP>', 'g') AS masked FROM documents")
def redact_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", privacy.mask(F.col("text"), ("email", "ip")).alias("masked"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_EMAIL}')) AS emails, len(regexp_extract_all(text, '{_IP}')) AS ips FROM documents")
def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", privacy.count(F.col("text"), "email").alias("emails"), privacy.count(F.col("text"), "ip").alias("ips"))


@query(rf"""WITH m AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '{_CARD}')), '[^0-9]', '', 'g') AS digits FROM documents),
  k AS (SELECT doc_id, digits, list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN (length(digits) - i) % 2 = 0 THEN CAST(substr(digits, i, 1) AS INTEGER) ELSE CAST(substr(digits, i, 1) AS INTEGER) * 2 - CASE WHEN CAST(substr(digits, i, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) AS total FROM m)
  SELECT doc_id, digits FROM k WHERE length(digits) BETWEEN 12 AND 19 AND total % 10 = 0""")
def luhn_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(privacy.matches(F.col("text"), "card")).alias("card"))
    return d.select("doc_id", F.regexp_replace("card", "[^0-9]", "").alias("digits"))


@query(f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS email FROM documents) SELECT DISTINCT email, '<EMAIL_' || substr(sha256('pepper:email:' || email), 1, 8) || '>' AS token FROM m""")
def pseudonym_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.explode(privacy.matches(F.col("text"), "email")).alias("email")).distinct()
    return d.select("email", privacy.global_token(F.col("email"), "email", "pepper").alias("token"))


@query(f"""WITH c AS (SELECT len(regexp_extract_all(text, '{_EMAIL}')) AS email, len(regexp_extract_all(text, '{_IP}')) AS ip FROM documents)
  SELECT 'email' AS rule, CAST(sum(email) AS BIGINT) AS total, count(*) FILTER (WHERE email > 0) AS texts FROM c UNION ALL SELECT 'ip', CAST(sum(ip) AS BIGINT), count(*) FILTER (WHERE ip > 0) FROM c""")
def redact_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = privacy.preview(read(spark, sf_dir, "documents"), gate=privacy.Gate(rules=("email", "ip")))
    return found.select("rule", F.col("total").cast("long").alias("total"), "texts")


_LUHN = """list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 0 THEN CAST(substr({d}, i, 1) AS INTEGER) ELSE CAST(substr({d}, i, 1) AS INTEGER) * 2 - CASE WHEN CAST(substr({d}, i, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_VALID = {"card": "length({d}) BETWEEN 12 AND 19 AND " + _LUHN, "phone": "length({d}) BETWEEN 9 AND 15"}


def _redaction_sql() -> str:
    """A step for each rule: find, number the values by first sight, and join the pieces between with their tokens."""
    steps = ["r0 AS (SELECT doc_id, text FROM documents)"]
    for n, (rule, label, pattern) in enumerate(privacy.PATTERNS, 1):
        valid = _VALID.get(rule, "true").replace("{d}", "regexp_replace(x, '[^0-9]', '', 'g')")
        value = "split_part(x, '?', 1) || '?' || " if rule == "url" else ""
        quoted = "'" + pattern.replace("'", "''") + "'"
        kept = "".join(f", c{i}" for i in range(1, n))
        steps.append(f"f{n} AS (SELECT doc_id, text{kept}, regexp_extract_all(text, {quoted}) AS m, regexp_split_to_array(text, {quoted}) AS parts FROM r{n - 1})")
        steps.append(f"v{n} AS (SELECT *, list_filter(m, lambda x: {valid}) AS own FROM f{n})")
        steps.append(f"d{n} AS (SELECT *, list_filter(own, lambda x, i: list_position(own, x) = i) AS known FROM v{n})")
        token = f"CASE WHEN list_position(known, x) IS NULL THEN x ELSE {value}'<{label}_' || list_position(known, x) || '>' END"
        steps.append(f"r{n} AS (SELECT doc_id{kept}, len(own) AS c{n}, CASE WHEN len(own) = 0 THEN text ELSE array_to_string(list_transform(parts, lambda part, i: part || coalesce(list_transform(m, lambda x: {token})[i], '')), '') END AS text FROM d{n})")
    last = len(privacy.PATTERNS)
    counts = ", ".join(f"CAST(c{n} AS INTEGER) AS {name}" for n, name in enumerate(privacy.RULE_NAMES, 1))
    return f"WITH {', '.join(steps)} SELECT doc_id, text, {counts}, CAST({' + '.join(f'c{n}' for n in range(1, last + 1))} AS INTEGER) AS total FROM r{last}"


@query(_redaction_sql())
def redact_trace_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole gate: numbered tokens within a row, all rules in order, with counts of each."""
    d = read(spark, sf_dir, "documents").select("doc_id", privacy.redact(F.col("text")).alias("r"))
    counts = [F.coalesce(F.try_element_at(F.col("r.counts"), F.lit(n)), F.lit(0)).alias(n) for n in privacy.RULE_NAMES]
    return d.select("doc_id", "r.text", *counts, F.col("r.total").alias("total"))
