"""Profiles, cleaning, replay offsets and feature encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from netwarden.operators import clean, features, profile, split
from netwarden.plans.registry import Tables, query


def traffic(t: Tables):
    """Traffic rows under the column names a capture export would have."""
    return t.events.select(
        F.col("event_id").alias("frame.number"), F.col("ts").alias("frame.time"), F.col("user_id").alias("device_id"),
        F.col("value").alias("pkt_size"), F.col("props").alias("payload"),
        (F.col("event_type") != "click").cast("int").alias("Attack_label"), F.col("event_type").alias("Attack_type"),
    )


@query("feature_projection", "", "SELECT event_id AS \"frame.number\", value AS pkt_size, props AS payload FROM events")
def _(t: Tables):
    df = traffic(t)
    roles = profile.column_roles(df.columns)
    kept = profile.feature_columns(df.columns, roles["label"], roles["attack_type"], profile.target_column(df), ["frame.time"], [r"device_id$"])
    return clean.prune(df, kept)


@query("target_distribution", "", "SELECT 'Attack_type' AS target, event_type AS value, count(*) AS n FROM events GROUP BY 2")
def _(t: Tables):
    target = profile.target_column(traffic(t))
    return profile.value_distribution(traffic(t), target).select(F.lit(target).alias("target"), "value", "n")


@query("shape_report", "", "SELECT count(*) AS rows, unnest([0, 1, 2, 3, 4, 5]) AS position, unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS column, unnest(['bigint', 'timestamp_ntz', 'bigint', 'string', 'double', 'string']) AS type FROM events")
def _(t: Tables):
    return profile.shape_report(t.events)


def gappy(t: Tables):
    return t.events.select(
        "event_id", F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 10 < 7, F.col("event_type")).alias("event_type"), "value",
    )


_GAPPY = "gappy AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 10 < 7 THEN event_type END AS event_type, value FROM events)"


@query("missing_fraction", "", f"WITH {_GAPPY} " + " UNION ALL ".join(f"SELECT '{c}' AS column, round(avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END), 6) AS missing FROM gappy" for c in ("event_id", "user_id", "event_type", "value")))
def _(t: Tables):
    return profile.missing_fraction(gappy(t)).withColumn("missing", F.round("missing", 6))


@query("duplicate_rows", "", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, value FROM events)) AS duplicates FROM events")
def _(t: Tables):
    return profile.duplicate_rows(t.events.select("user_id", "event_type", "value"))


@query("distinct_counts", "", f"WITH {_GAPPY} " + " UNION ALL ".join(f'SELECT \'{c}\' AS column, count(DISTINCT {c}) + CAST(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS "distinct" FROM gappy' for c in ("event_id", "user_id", "event_type", "value")))
def _(t: Tables):
    return profile.distinct_counts(gappy(t))


@query("value_distribution", "", f"WITH {_GAPPY} SELECT user_id AS value, count(*) AS n FROM gappy GROUP BY 1 ORDER BY n DESC, value NULLS FIRST LIMIT 100")
def _(t: Tables):
    return profile.value_distribution(gappy(t), "user_id")


@query("feature_coverage", "", "SELECT round(5 / 7e0, 6) AS coverage FROM events LIMIT 1")
def _(t: Tables):
    mapped = clean.map_external(external(t), ["ip.src_host", "ip.dst_host", "tcp.srcport", "frame.time", "ip.proto", "mqtt.topic", "flow.duration"])
    return profile.feature_coverage(mapped).withColumn("coverage", F.round("coverage", 6))


_LEVELS = range(0, 1000, 40)


@query("column_coverage", "", f"SELECT round(({' + '.join(f'CAST(coalesce(max(value) > {k}, false) AS INTEGER)' for k in _LEVELS)}) / {len(_LEVELS)}e0, 6) AS coverage FROM events")
def _(t: Tables):
    """Columns that hold a value only above some level: how many have any depends on the data."""
    columns = t.events.select(*[F.when(F.col("value") > k, F.col("value")).alias(f"above_{k}") for k in _LEVELS])
    return profile.feature_coverage(columns).withColumn("coverage", F.round("coverage", 6))


@query("numeric_coercion", "", "SELECT event_id, CAST(value AS DOUBLE) AS as_number, CASE WHEN event_id % 50 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS mixed FROM events")
def _(t: Tables):
    raw = t.events.select(
        "event_id", F.col("value").cast("string").alias("as_number"),
        F.when(F.col("event_id") % 50 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("mixed"),
    )
    return clean.coerce_numeric(raw)


@query("infinity_to_null", "", "SELECT event_id, CASE WHEN event_id % 9 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events")
def _(t: Tables):
    v = F.when(F.col("event_id") % 9 == 0, float("inf")).when(F.col("event_id") % 11 == 0, float("nan")).otherwise(F.col("value"))
    return clean.drop_infinities(t.events.select("event_id", v.alias("value")))


@query("column_pruning", "", "SELECT event_id, value FROM events")
def _(t: Tables):
    return clean.prune(t.events, ["event_id", "value"])


@query("record_cap", "", "SELECT event_id FROM events ORDER BY event_id LIMIT 500")
def _(t: Tables):
    return clean.first_rows(t.events.select("event_id"), "event_id", 500)


@query("row_subset", "", "SELECT event_id, event_type FROM events WHERE event_id IN (SELECT doc_id * 3 FROM labels)")
def _(t: Tables):
    wanted = t.labels.select((F.col("doc_id") * 3).alias("event_id"))
    return clean.keep_rows(t.events.select("event_id", "event_type"), wanted, "event_id")


@query("scenario_steps", "", """SELECT 1 AS step_no, 'normal' AS step, row_no, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS row_no FROM events WHERE event_type = 'click') WHERE row_no <= 300
 UNION ALL SELECT 2, 'attack', row_number() OVER (ORDER BY event_id), event_id FROM events WHERE event_type = 'error'""")
def _(t: Tables):
    e = t.events.select("event_id", "event_type")
    steps = [("normal", e.filter("event_type = 'click'"), "event_id", 300), ("attack", e.filter("event_type = 'error'"), "event_id", None)]
    return clean.compose_steps(steps).select("step_no", "step", "row_no", "event_id")


def captures(t: Tables):
    from netwarden.functions.ordered import micros, order_blocks, with_rank

    e = t.events.select("event_id", "event_type", (F.col("user_id") % 3).alias("capture"), micros("ts").alias("ts_us"))
    numbered = lambda df: with_rank(df, ["capture"], ["event_id"], order_blocks(df, "event_id"), "row_no")
    packets = numbered(e.filter("event_type <> 'error'").withColumn("ts_us", F.col("ts_us") - F.col("event_id") % 7 * 1200000000))
    return numbered(e).select("capture", "row_no", "event_id"), packets.select("capture", "row_no", "ts_us")


@query("replay_offsets", "", """WITH e AS (SELECT event_id, event_type, user_id % 3 AS capture, epoch_us(ts) AS ts_us FROM events),
records AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY event_id) AS row_no FROM e),
packets AS (SELECT capture, ts_us - event_id % 7 * 1200000000 AS ts_us, row_number() OVER (PARTITION BY capture ORDER BY event_id) AS row_no FROM e WHERE event_type <> 'error'),
waits AS (SELECT r.capture, r.row_no, r.event_id, coalesce(greatest(0, p.ts_us - lag(p.ts_us) OVER (PARTITION BY r.capture ORDER BY r.row_no)), 0) AS wait_us FROM records r JOIN packets p USING (capture, row_no))
SELECT capture, row_no, event_id, CAST(wait_us AS BIGINT) AS wait_us, round(sum(wait_us) OVER (PARTITION BY capture ORDER BY row_no) / 1e6, 6) AS due_seconds FROM waits""")
def _(t: Tables):
    records, packets = captures(t)
    out = clean.pair_with_packets(records, packets, speed=1.0)
    return out.select("capture", "row_no", "event_id", "wait_us", F.round("due_seconds", 6).alias("due_seconds"))


def external(t: Tables):
    """A connection log under external column names."""
    return t.events.select(
        "event_id", F.concat(F.lit("10.0.0."), (F.col("user_id") % 200).cast("string")).alias("id.orig_h"),
        F.lit("10.9.9.9").alias("id.resp_h"), (1024 + F.col("user_id") % 100).alias("id.orig_p"),
        F.element_at(F.array(F.lit("TCP"), F.lit("udp"), F.lit("icmp"), F.lit("gre")), (F.col("event_id") % 4 + 1).cast("int")).alias("proto"),
        (F.col("event_id") * 60.5 + 1700000000).alias("ts"),
    )


@query("external_mapping", "", """SELECT '10.0.0.' || user_id % 200 AS src, 1024 + user_id % 100 AS sport, CASE event_id % 4 WHEN 0 THEN 6 WHEN 1 THEN 17 WHEN 2 THEN 1 END AS proto_number, CAST(event_id * 60500000 + 1700000000000000 AS BIGINT) AS time_us, CAST(NULL AS VARCHAR) AS topic FROM events""")
def _(t: Tables):
    m = clean.map_external(external(t), ["ip.src_host", "tcp.srcport", "ip.proto", "frame.time", "mqtt.topic"])
    return m.select(
        F.col("`ip.src_host`").alias("src"), F.col("`tcp.srcport`").alias("sport"), F.col("`ip.proto`").alias("proto_number"),
        F.unix_micros("`frame.time`").alias("time_us"), F.col("`mqtt.topic`").cast("string").alias("topic"),
    )


@query("csv_flattening", "", """SELECT o_orderkey, '["' || o_orderstatus || '","' || o_orderpriority || '"]' AS tags, '{"customer":' || o_custkey || ',"status":"' || o_orderstatus || '"}' AS origin FROM orders""")
def _(t: Tables):
    nested = t.orders.select(
        "o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("tags"),
        F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status")).alias("origin"),
    )
    return clean.flatten_for_csv(nested)


# --- features ----------------------------------------------------------------------------------

def typed(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_orderkey") % 13 != 0, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_orderkey") % 17 == 0, float("inf")).otherwise(F.col("l_discount")).alias("discount"),
        F.lit(3.0).alias("flat"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_returnflag")).alias("flag"),
        F.concat(F.lit("s"), (F.col("l_partkey") % 90).cast("string")).alias("supplier"), "l_linestatus",
    )


COLUMNS = ["quantity", "discount", "flat", "flag", "supplier"]
_TYPED = """typed AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 13 <> 0 THEN l_quantity END AS quantity, CASE WHEN l_orderkey % 17 <> 0 THEN l_discount END AS discount, 3e0 AS flat,
 CASE WHEN l_partkey % 7 <> 0 THEN l_returnflag END AS flag, 's' || l_partkey % 90 AS supplier, l_linestatus FROM lineitem),
medians AS (SELECT median(quantity) AS mq, median(discount) AS md FROM typed),
filled AS (SELECT t.*, coalesce(quantity, mq) AS q, coalesce(discount, md) AS d FROM typed t, medians),
moments AS (SELECT avg(q) AS aq, stddev_pop(q) AS sq, avg(d) AS ad, stddev_pop(d) AS sd FROM filled),
ranks AS (SELECT 'flag' AS column, flag AS value, n + CASE WHEN row_number() OVER (ORDER BY n DESC, flag) = 1 THEN (SELECT count(*) FROM typed WHERE flag IS NULL) ELSE 0 END AS n FROM (SELECT flag, count(*) AS n FROM typed WHERE flag IS NOT NULL GROUP BY 1)
  UNION ALL SELECT 'supplier', supplier, count(*) FROM typed GROUP BY 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM ranks)"""


@query("numeric_stats", "", f"""WITH {_TYPED} SELECT 'quantity' AS column, round(mq, 8) AS median, round(aq, 8) AS mean, round(sq, 8) AS scale FROM medians, moments UNION ALL SELECT 'discount', round(md, 8), round(ad, 8), round(sd, 8) FROM medians, moments UNION ALL SELECT 'flat', 3e0, 3e0, 1e0""")
def _(t: Tables):
    stats = features.numeric_stats(typed(t), ["quantity", "discount", "flat"])
    return stats.select("column", *[F.round(c, 8).alias(c) for c in ("median", "mean", "scale")])


@query("category_ranks", "", f'WITH {_TYPED} SELECT "column", value, n, rank FROM ranked WHERE rank <= 65')
def _(t: Tables):
    return features.category_ranks(typed(t), ["flag", "supplier"]).select("column", "value", "n", "rank")


@query("feature_encoding", "", f"""WITH {_TYPED}, fill AS (SELECT value AS f FROM ranked WHERE "column" = 'flag' AND rank = 1)
SELECT l_orderkey, l_linenumber, round((q - aq) / sq, 6) AS quantity_z, round((d - ad) / sd, 6) AS discount_z, coalesce(flag, f) AS flag_value, CASE WHEN supplier IN (SELECT value FROM ranked WHERE "column" = 'supplier' AND rank <= 63) THEN 0e0 ELSE 1e0 END AS pooled, 5e0 - 3e0 AS ones, 3 + 3 + 63 + 1 AS width FROM filled, moments, fill""")
def _(t: Tables):
    df = typed(t)
    model = features.fit_features(df, COLUMNS)
    x = features.encode(df, model, features.pooled_values(df, model))
    v = F.col("features")
    total = F.aggregate(F.slice(v, 4, F.size(v)), F.lit(0.0), lambda a, b: a + b)
    flags = F.array(*[F.lit(c) for c in model.categorical["flag"]["categories"]])
    return x.select(
        "l_orderkey", "l_linenumber", F.round(v[0], 6).alias("quantity_z"), F.round(v[1], 6).alias("discount_z"),
        F.element_at(flags, F.array_position(F.slice(v, 4, 3), F.lit(1.0)).cast("int")).alias("flag_value"),
        F.element_at(v, -1).alias("pooled"), total.alias("ones"), F.size(v).alias("width"),
    )


@query("label_encoding", "", "SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS y FROM events")
def _(t: Tables):
    classes = features.label_classes(t.events, "event_type")
    return features.encode_label(t.events, "event_type", classes).select("event_id", "y")


@query("class_weights", "", "SELECT event_type, count(*) AS n, round((SELECT count(*) FROM events) / ((SELECT count(DISTINCT event_type) FROM events) * count(*)), 6) AS weight FROM events GROUP BY 1")
def _(t: Tables):
    return features.class_weights(t.events, "event_type").withColumn("weight", F.round("weight", 6))


@query("client_class_weights", "", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n, round(sum(n) OVER w / (count(*) OVER w * n), 6) AS weight FROM c WINDOW w AS (PARTITION BY user_id)""")
def _(t: Tables):
    return features.class_weights(t.events, "event_type", "user_id").withColumn("weight", F.round("weight", 6))
