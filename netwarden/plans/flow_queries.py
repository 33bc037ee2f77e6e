"""Flows, sessions, windows, splits and partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from netwarden.functions.ordered import micros
from netwarden.operators import flows, split
from netwarden.plans.registry import Tables, query
from netwarden.session import stored
from netwarden.session import scratch_folder

GAP = 6 * 3600.0

_KEYED = """
keyed AS (
  SELECT *, epoch_us(ts) AS t,
    least(coalesce("ip.src_host",'<NA>') || ':' || coalesce(CAST("tcp.srcport" AS VARCHAR),'<NA>'),
          coalesce("ip.dst_host",'<NA>') || ':' || coalesce(CAST("tcp.dstport" AS VARCHAR),'<NA>'))
    || '|' ||
    greatest(coalesce("ip.src_host",'<NA>') || ':' || coalesce(CAST("tcp.srcport" AS VARCHAR),'<NA>'),
          coalesce("ip.dst_host",'<NA>') || ':' || coalesce(CAST("tcp.dstport" AS VARCHAR),'<NA>'))
    || '|' || coalesce(CAST("ip.proto" AS VARCHAR),'<NA>') AS flow_key
  FROM traffic)"""
_SESSIONS = _KEYED + """,
gapped AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY flow_key ORDER BY ts, row_id) <= 21600000000 THEN 0 ELSE 1 END AS opens FROM keyed),
numbered AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY flow_key ORDER BY ts, row_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM gapped),
sessions AS (SELECT *, flow_key || '|session=' || session_no AS session_id FROM numbered)"""


def sessions(t: Tables):
    return flows.sessionize(t.traffic, inactivity_seconds=GAP)


@query("timestamp_parse", "", """
SELECT event_id, epoch_us(try_cast(raw AS TIMESTAMP)) AS parsed_us FROM (
  SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw FROM events)""")
def _(t: Tables):
    text = F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    parsed = flows.parse_timestamp(t.events.withColumn("raw", text), "raw")
    return parsed.select("event_id", micros("event_time").alias("parsed_us"))


@query("flow_key", "traffic", f"WITH {_KEYED} SELECT row_id, flow_key FROM keyed")
def _(t: Tables):
    return flows.add_flow_key(t.traffic).select("row_id", "flow_key")


@query("flow_key_hosts_only", "traffic", """
SELECT row_id, least("ip.src_host","ip.dst_host") || '|' || greatest("ip.src_host","ip.dst_host") || '|' || coalesce(CAST("ip.proto" AS VARCHAR),'<NA>') AS flow_key FROM traffic""")
def _(t: Tables):
    return flows.add_flow_key(t.traffic, ["ip.src_host", "ip.dst_host", "ip.proto"]).select("row_id", "flow_key")


@query("flow_key_plain_columns", "traffic", """
SELECT row_id, CAST("tcp.srcport" AS VARCHAR) || '|' || coalesce(CAST("ip.proto" AS VARCHAR),'<NA>') AS flow_key FROM traffic""")
def _(t: Tables):
    return flows.add_flow_key(t.traffic, ["tcp.srcport", "ip.proto"]).select("row_id", "flow_key")


@query("sessionize", "traffic", f"WITH {_SESSIONS} SELECT row_id, session_no, session_id FROM sessions")
def _(t: Tables):
    return sessions(t).select("row_id", "session_no", "session_id")


@query("sessionize_without_gap", "traffic", f"WITH {_KEYED} SELECT flow_key AS session_id, count(*) AS n_rows FROM keyed GROUP BY 1")
def _(t: Tables):
    whole = flows.sessionize(t.traffic, inactivity_seconds=None)
    return whole.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("session_stats", "traffic", f"""WITH {_SESSIONS}
SELECT flow_key, session_id, count(*) AS n_rows, min(t) AS first_us, max(t) AS last_us, max(t) - min(t) AS duration_us
FROM sessions GROUP BY 1, 2""")
def _(t: Tables):
    return flows.session_stats(sessions(t))


_WINDOWS = _SESSIONS + """,
framed AS (SELECT session_id, t, row_number() OVER s AS window_start, list(row_id) OVER f AS ids, last(label) OVER f AS label, last(t) OVER f AS end_us
  FROM sessions WINDOW s AS (PARTITION BY session_id ORDER BY ts, row_id), f AS (PARTITION BY session_id ORDER BY ts, row_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
windows AS (SELECT session_id, window_start, t AS start_us, end_us, label, 4 AS length, array_to_string(ids, ',') AS row_ids, ids FROM framed
  WHERE len(ids) = 4 AND (window_start - 1) % 2 = 0)"""


def windows(t: Tables):
    return flows.sliding_windows(sessions(t), "session_id", length=4, stride=2)


@query("session_windows", "traffic", f"WITH {_WINDOWS} SELECT session_id, window_start, start_us, end_us, label, length, row_ids FROM windows")
def _(t: Tables):
    return windows(t).select(
        "session_id", "window_start", micros("start_time").alias("start_us"), micros("end_time").alias("end_us"),
        "label", "length", F.array_join(F.transform("row_ids", lambda r: r.cast("string")), ",").alias("row_ids"),
    )


@query("array_windows", "", """
SELECT w_start, CAST(list_sum(vals) AS DOUBLE) AS total, label FROM (
  SELECT row_number() OVER (ORDER BY ts, event_id) AS w_start,
    list(event_id) OVER f AS vals, last(event_type) OVER f AS label
  FROM events WINDOW f AS (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
WHERE len(vals) = 8 AND (w_start - 1) % 5 = 0""")
def _(t: Tables):
    rows = t.events.select(F.lit("all").alias("series"), "ts", "event_id", "event_type")
    made = flows.sliding_windows(rows, "series", 8, 5, row_id="event_id", label="event_type")
    total = F.aggregate("row_ids", F.lit(0.0), lambda a, x: a + x)
    return made.select(F.col("window_start").alias("w_start"), total.alias("total"), "label")


@query("window_tensor", "traffic", f"""WITH {_WINDOWS},
cells AS (SELECT ids[1] AS window_id, label, unnest(ids) AS row_id, unnest(range(len(ids))) AS at FROM windows)
SELECT c.window_id, c.label, string_agg(CAST(CAST(round(tr.value * 100) AS BIGINT) AS VARCHAR) || ':' || CAST(c.row_id % 5 AS VARCHAR), ';' ORDER BY c.at) AS tensor
FROM cells c JOIN traffic tr USING (row_id) GROUP BY 1, 2""")
def _(t: Tables):
    encoded = t.traffic.select(
        "row_id", F.array(F.round(F.col("value") * 100), (F.col("row_id") % 5).cast("double")).alias("features")
    )
    tensor = flows.windows_to_tensor(windows(t), encoded)
    step = lambda v: F.array_join(F.transform(v, lambda x: x.cast("long").cast("string")), ":")
    return tensor.select("window_id", "label", F.array_join(F.transform("tensor", step), ";").alias("tensor"))


_AUDIT = f"""WITH {_KEYED},
per_flow AS (SELECT flow_key, count(*) AS n FROM keyed GROUP BY 1),
gaps AS (SELECT (t - lag(t) OVER (ORDER BY t, row_id)) / 1e3 AS gap_ms FROM keyed),
io AS (SELECT count(*) AS valid_rows, count(*) FILTER (t < before) = 0 AS input_order_ok FROM (SELECT t, lag(t) OVER (ORDER BY row_id) AS before FROM keyed)),
report AS (SELECT io.valid_rows, io.input_order_ok, (SELECT count(*) FROM keyed) AS rows,
  (SELECT count(*) FROM per_flow) AS unique_flows, (SELECT count(*) FROM per_flow WHERE n > 1) AS multi_row_flows,
  (SELECT max(n) FROM per_flow) AS max_rows_per_flow,
  (SELECT quantile_cont(CAST(n AS DOUBLE), 0.5) FROM per_flow) AS median_rows_per_flow,
  (SELECT quantile_cont(CAST(n AS DOUBLE), 0.95) FROM per_flow) AS p95_rows_per_flow,
  (SELECT round(quantile_cont(gap_ms, 0.5), 6) FROM gaps) AS median_gap_ms,
  (SELECT round(quantile_cont(gap_ms, 0.95), 6) FROM gaps) AS p95_gap_ms FROM io)"""


@query("temporal_audit", "traffic", _AUDIT + """
SELECT valid_rows, input_order_ok, rows, unique_flows, multi_row_flows, max_rows_per_flow,
  round(median_rows_per_flow, 6) AS median_rows_per_flow, round(p95_rows_per_flow, 6) AS p95_rows_per_flow, median_gap_ms, p95_gap_ms FROM report""")
def _(t: Tables):
    report = flows.temporal_audit(t.traffic)
    rounded = ["median_rows_per_flow", "p95_rows_per_flow", "median_gap_ms", "p95_gap_ms"]
    return report.select(
        *[F.round(c, 6).alias(c) if c in rounded else F.col(c).cast("long").alias(c) if c == "rows" else F.col(c) for c in report.columns]
    )


@query("window_recommendation", "traffic", _AUDIT + """
SELECT CASE WHEN median_rows_per_flow >= 8 THEN '8,16,32' WHEN median_rows_per_flow >= 4 THEN '4,8,16' ELSE '1' END AS candidate_lengths,
  CASE WHEN multi_row_flows = 0 THEN 'no flow has more than one row; keep single-row windows'
       WHEN NOT input_order_ok THEN 'input is not in time order; build windows inside flows'
       ELSE 'flows have several rows in time order; flow windows are sound' END AS warning FROM report""")
def _(t: Tables):
    return flows.window_recommendation(flows.temporal_audit(t.traffic))


_COUNTS = """
n AS (SELECT count(*) AS n FROM starts),
sizes AS (SELECT greatest(1, CAST(round_even(n * CAST(0.15 AS DOUBLE), 0) AS BIGINT)) AS k, n FROM n)"""


@query("split_chronological", "traffic", f"""WITH {_SESSIONS},
starts AS (SELECT session_id, min(t) AS s FROM sessions GROUP BY 1),{_COUNTS},
ranked AS (SELECT session_id, row_number() OVER (ORDER BY s, session_id) AS rn FROM starts)
SELECT row_id, CASE WHEN rn <= n - 2 * k THEN 'train' WHEN rn <= n - k THEN 'val' ELSE 'test' END AS split
FROM sessions JOIN ranked USING (session_id), sizes""")
def _(t: Tables):
    return split.session_split(sessions(t)).select("row_id", "split")


@query("split_random_sessions", "traffic", f"""WITH {_SESSIONS},
starts AS (SELECT session_id FROM sessions GROUP BY 1),{_COUNTS},
ranked AS (SELECT session_id, row_number() OVER (ORDER BY md5('7|' || session_id), session_id) AS rn FROM starts)
SELECT row_id, CASE WHEN rn <= k THEN 'test' WHEN rn <= 2 * k THEN 'val' ELSE 'train' END AS split
FROM sessions JOIN ranked USING (session_id), sizes""")
def _(t: Tables):
    return split.session_split(sessions(t), chronological=False, seed=7).select("row_id", "split")


@query("leakage_audit", "traffic", f"""WITH {_SESSIONS},
starts AS (SELECT session_id, min(t) AS s FROM sessions GROUP BY 1),{_COUNTS},
ranked AS (SELECT session_id, row_number() OVER (ORDER BY s, session_id) AS rn FROM starts),
placed AS (SELECT session_id, t, CASE WHEN rn <= n - 2 * k THEN 'train' WHEN rn <= n - k THEN 'val' ELSE 'test' END AS split FROM sessions JOIN ranked USING (session_id), sizes),
marks AS (SELECT session_id, max(CAST(split = 'train' AS INT)) AS train, max(CAST(split = 'val' AS INT)) AS val, max(CAST(split = 'test' AS INT)) AS test FROM placed GROUP BY 1),
o AS (SELECT CAST(sum(train * val) AS BIGINT) AS train_val_overlap, CAST(sum(train * test) AS BIGINT) AS train_test_overlap, CAST(sum(val * test) AS BIGINT) AS val_test_overlap,
  CAST(sum(train) AS BIGINT) AS train_sessions, CAST(sum(val) AS BIGINT) AS val_sessions, CAST(sum(test) AS BIGINT) AS test_sessions FROM marks),
b AS (SELECT max(t) FILTER (split = 'train') AS train_end, min(t) FILTER (split = 'val') AS val_start, max(t) FILTER (split = 'val') AS val_end, min(t) FILTER (split = 'test') AS test_start FROM placed)
SELECT *, train_end <= val_start AND val_end <= test_start AS chronology_ok,
  train_val_overlap + train_test_overlap + val_test_overlap = 0 AND train_end <= val_start AND val_end <= test_start AS leakage_free FROM o, b""")
def _(t: Tables):
    return split.leakage_audit(split.session_split(sessions(t)))


@query("split_stratified", "", """WITH ranked AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42|' || c_custkey), c_custkey) AS rn,
   count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
sized AS (SELECT *, round_even(n * CAST(0.15 AS DOUBLE), 0) AS n_test FROM ranked),
final AS (SELECT *, round_even((n - n_test) * (CAST(0.15 AS DOUBLE) / (1 - CAST(0.15 AS DOUBLE))), 0) AS n_val FROM sized)
SELECT c_custkey, c_mktsegment, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_val THEN 'val' ELSE 'train' END AS split FROM final""")
def _(t: Tables):
    rows = t.customer.select("c_custkey", "c_mktsegment")
    return split.stratified_split(rows, "c_mktsegment", "c_custkey")


@query("heldout_rows", "", """WITH ranked AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42|' || c_custkey), c_custkey) AS rn,
   count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_custkey, c_mktsegment FROM ranked WHERE rn <= round_even(n * CAST(0.15 AS DOUBLE), 0)""")
def _(t: Tables):
    rows = t.customer.select("c_custkey", "c_mktsegment")
    # What an earlier run wrote is read back and held against the split as it comes out now.
    kept = stored(split.stratified_split(rows, "c_mktsegment", "c_custkey"), "heldout")
    repeated = split.stratified_split(rows, "c_mktsegment", "c_custkey")
    return split.heldout_rows(kept, repeated, ["c_custkey", "c_mktsegment"])


@query("partition_iid", "", """
SELECT c_custkey, CAST(ntile(7) OVER (ORDER BY md5('42|' || c_custkey), c_custkey) - 1 AS INTEGER) AS client_id FROM customer""")
def _(t: Tables):
    return split.iid_partition(t.customer.select("c_custkey"), "c_custkey", 7)


@query("partition_dirichlet")
def _(t: Tables):
    rows = t.customer.select("c_custkey", "c_mktsegment")
    return split.dirichlet_partition(rows, "c_mktsegment", "c_custkey", clients=5, alpha=0.5, min_samples=5)


@query("partition_dirichlet_totals", "", "SELECT c_mktsegment, count(*) AS samples, count(DISTINCT c_custkey) AS distinct_rows FROM customer GROUP BY 1")
def _(t: Tables):
    rows = t.customer.select("c_custkey", "c_mktsegment")
    parts = split.dirichlet_partition(rows, "c_mktsegment", "c_custkey", clients=5, alpha=0.5, min_samples=5)
    return parts.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("samples"), F.countDistinct("c_custkey").alias("distinct_rows")
    )


@query("partition_manifest", "", """
SELECT client_id, c_mktsegment, count(*) AS samples FROM (
  SELECT c_mktsegment, CAST(ntile(7) OVER (ORDER BY md5('42|' || c_custkey), c_custkey) - 1 AS INTEGER) AS client_id FROM customer) GROUP BY 1, 2""")
def _(t: Tables):
    parts = split.iid_partition(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", 7)
    return split.partition_manifest(parts, "c_mktsegment")


@query("saved_partitions", "", """
WITH parts AS (SELECT c_custkey, c_mktsegment, CAST(ntile(7) OVER (ORDER BY md5('42|' || c_custkey), c_custkey) - 1 AS INTEGER) AS client_id FROM customer)
SELECT client_id, c_mktsegment, count(*) AS samples, min(c_custkey) AS first_key, max(c_custkey) AS last_key FROM parts GROUP BY 1, 2""")
def _(t: Tables):
    """Partitions written by client and read back, beside their manifest."""
    folder = scratch_folder(t.spark, "partitions")
    split.save_partitions(split.iid_partition(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", 7), folder, "c_mktsegment")
    keys = ["client_id", "c_mktsegment"]
    stored = t.spark.read.parquet(f"{folder}/rows").groupBy(*keys).agg(F.min("c_custkey").alias("first_key"), F.max("c_custkey").alias("last_key"))
    manifest = t.spark.read.schema("client_id int, c_mktsegment string, samples long").json(f"{folder}/manifest")
    return manifest.join(stored, keys).select(*keys, "samples", "first_key", "last_key")


@query("sample_per_client", "", """
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('5|' || o_orderkey), o_orderkey) AS rn FROM orders) WHERE rn <= 4""")
def _(t: Tables):
    return split.sample_per_client(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 4, seed=5)


@query("split_head_tail", "", """
SELECT o_custkey, o_orderkey, CASE WHEN rn <= greatest(1, floor(n * CAST(0.8 AS DOUBLE))) THEN 'train' ELSE 'val' END AS split FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)""")
def _(t: Tables):
    return split.head_tail_split(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("sample_sorted", "", """
SELECT event_id, event_type FROM (SELECT event_id, event_type FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 200)""")
def _(t: Tables):
    return split.sample_sorted(t.events.select("event_id", "event_type"), "event_id", 200)
