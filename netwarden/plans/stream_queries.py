"""File sources, trained detector and streaming jobs, run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netwarden import fixtures
from netwarden.functions.ordered import micros
from netwarden.operators import detector, features, metrics, split
from netwarden.operators.alerts import is_emitted
from netwarden.plans.audit_queries import _page_hinkley, _REPUTATION, _chain_sql, _ema_sql, _text_sql, entry_text, rounded
from netwarden.plans.registry import Tables, query
from netwarden.session import checkpointed, scratch_folder
from netwarden.sources import files, pcap, streams
from netwarden.streaming import jobs, statistics


def stream(t: Tables, name: str):
    """A domain table as a stream of its source table's files."""
    if name not in fixtures.TABLES:
        return jobs.table_stream(t.spark, t.sf_dir, name)
    source, condition, columns = fixtures.TABLES[name]
    df = stream(t, source)
    return (df.filter(condition) if condition else df).selectExpr(*columns)


def finish(t: Tables, name: str, df, closing=None):
    return jobs.run_available(df, scratch_folder(t.spark, name), closing=closing)


def ended(t: Tables, name: str):
    """A domain table as a stream that ends, with its end."""
    closing = jobs.Closing(stream(t, name), scratch_folder(t.spark, "end"))
    return closing.stream, closing


# --- files -------------------------------------------------------------------------------------

@query("csv_replay", "", "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type FROM events")
def _(t: Tables):
    folder = scratch_folder(t.spark, "csv")
    t.events.select("event_id", "user_id", "event_type").write.option("header", True).csv(folder)
    return files.replay_csv(t.spark, folder)


@query("csv_load", "", "SELECT CAST(event_id AS DOUBLE) AS event_id, event_type, value FROM events")
def _(t: Tables):
    folder = scratch_folder(t.spark, "csv")
    t.events.select("event_id", "event_type", "value").write.option("header", True).csv(folder)
    return files.read_csv(t.spark, folder)


@query("zeek_log", "", "SELECT CAST(event_id AS VARCHAR) AS uid, '10.0.0.' || user_id % 200 AS \"id.orig_h\", CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS service FROM events")
def _(t: Tables):
    folder = scratch_folder(t.spark, "zeek")
    rows = t.events.select(F.concat_ws(
        "\t", F.col("event_id").cast("string"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 200).cast("string")),
        F.when(F.col("event_id") % 3 == 0, "-").otherwise(F.col("event_type")),
    ).alias("value"))
    head = t.spark.createDataFrame([("#separator \\x09",), ("#fields\tuid\tid.orig_h\tservice",)], "value string")
    head.coalesce(1).write.text(folder)
    rows.write.mode("append").text(folder)
    return files.read_zeek(t.spark, folder)


def captures(t: Tables):
    """Capture files with a hundred packets each; odd files are big-endian, all end cut off."""
    big = lambda c: F.to_binary(F.lpad(F.hex(c), 8, "0"), F.lit("hex"))
    little = lambda c: F.to_binary(F.concat(*[F.substring(F.lpad(F.hex(c), 8, "0"), i, 2) for i in (7, 5, 3, 1)]), F.lit("hex"))
    t_us = micros("ts")
    words = [F.floor(t_us / 1000000), t_us % 1000000, F.lit(4), F.lit(60)]
    odd = F.floor(F.col("event_id") / 100) % 2 == 1
    packet = F.when(odd, F.concat(*[big(w) for w in words])).otherwise(F.concat(*[little(w) for w in words]))
    payload = F.to_binary(F.lit("deadbeef"), F.lit("hex"))
    grouped = t.events.select(
        F.floor(F.col("event_id") / 100).alias("file_no"), "event_id", F.concat(packet, payload).alias("packet")
    ).groupBy("file_no").agg(F.array_sort(F.collect_list(F.struct("event_id", "packet"))).alias("packets"))
    head = lambda magic: F.to_binary(F.lit(magic + "00" * 20), F.lit("hex"))
    body = F.aggregate("packets", F.to_binary(F.lit(""), F.lit("hex")), lambda a, p: F.concat(a, p["packet"]))
    header = F.when(F.col("file_no") % 2 == 1, head("a1b2c3d4")).otherwise(head("d4c3b2a1"))
    return grouped.select(
        F.concat(F.lit("capture-"), F.col("file_no").cast("string")).alias("path"),
        F.concat(header, body, F.to_binary(F.lit("0102"), F.lit("hex"))).alias("content"),
    )


def capture_packets(t: Tables):
    folder = scratch_folder(t.spark, "captures")
    pcap.write_captures(captures(t), folder)
    packets = pcap.read_packets(t.spark, folder, range_bytes=1500)
    return packets.withColumn("path", F.substring_index("path", "/", -1))


@query("packet_timestamps", "", "SELECT 'capture-' || event_id // 100 AS path, row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) AS packet_no, epoch_us(ts) AS ts_us FROM events")
def _(t: Tables):
    """Read from files, in ranges that cut through records."""
    return pcap.numbered(capture_packets(t))


@query("packet_counts", "", "SELECT 'capture-' || event_id // 100 AS path, count(*) AS packets FROM events GROUP BY 1")
def _(t: Tables):
    return pcap.packet_counts(capture_packets(t))


@query("message_records", "", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def _(t: Tables):
    """A topic read by a query that is stopped halfway and resumed after the topic has grown."""
    topic, out = scratch_folder(t.spark, "topic"), scratch_folder(t.spark, "messages")
    line = F.to_json(F.struct("event_id", "event_type"))
    lines = t.events.select("event_id", F.when(F.col("event_id") % 5 == 0, "{broken").when(F.col("event_id") % 7 == 0, "  ").otherwise(line).alias("value"))
    for half in (0, 1):
        lines.filter(F.col("event_id") % 2 == half).select("value").repartition(3).write.mode("append").text(topic)
        records = streams.message_records(t.spark, topic, ["event_id", "event_type"], bytes_per_trigger=1 << 20, range_bytes=1 << 16, progress=f"{out}/progress.json")
        run = records.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").start()
        try:
            run.processAllAvailable()
        finally:
            run.stop()
    return t.spark.read.schema(records.schema).parquet(f"{out}/rows")


@query("json_records", "", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def _(t: Tables):
    line = F.to_json(F.struct("event_id", "event_type"))
    lines = t.events.select(F.when(F.col("event_id") % 5 == 0, "{broken").when(F.col("event_id") % 7 == 0, "  ").otherwise(line).alias("value"))
    return streams.parse_records(lines, ["event_id", "event_type"])


@query("log_append_and_read", "analyst_labels", "SELECT label_id, audit_sequence, label, analyst_id, rationale, epoch_us(ts) AS at_us FROM analyst_labels")
def _(t: Tables):
    folder = scratch_folder(t.spark, "labels")
    rows = t.analyst_labels.withColumn("timestamp", F.col("ts").cast("timestamp")).drop("ts", "position")
    files.append_log(rows.filter("audit_sequence % 2 = 0"), folder)
    files.append_log(rows.filter("audit_sequence % 2 = 1"), folder)
    read = files.read_log(t.spark, "labels", folder)
    return read.select("label_id", "audit_sequence", "label", "analyst_id", "rationale", F.unix_micros("timestamp").alias("at_us"))


@query("prepared_dataset", "", """WITH ranked AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id), event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events),
sized AS (SELECT *, round_even(n * CAST(0.15 AS DOUBLE), 0) AS n_test FROM ranked),
final AS (SELECT *, round_even((n - n_test) * (CAST(0.15 AS DOUBLE) / (1 - CAST(0.15 AS DOUBLE))), 0) AS n_val FROM sized)
SELECT event_id, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_val THEN 'val' ELSE 'train' END AS split, dense_rank() OVER (ORDER BY event_type) - 1 AS y, 11 AS width, 1e0 AS devices FROM final""")
def _(t: Tables):
    rows, model = prepared(t)
    folder = scratch_folder(t.spark, "prepared")
    files.save_prepared(features.encode(rows, model).select("event_id", "split", "y", "features"), model, folder)
    stored, loaded = files.load_prepared(t.spark, folder)
    if loaded != model:
        raise ValueError("the stored encoding differs from the fitted one")
    devices = F.aggregate(F.slice("features", 3, 9), F.lit(0.0), lambda a, b: a + b)
    return stored.select("event_id", "split", "y", F.size("features").alias("width"), devices.alias("devices"))


@query("release_check")
def _(t: Tables):
    folder = scratch_folder(t.spark, "release")
    t.events.repartition("event_id").write.parquet(f"{folder}/data")
    digests = files.file_digests(t.spark, f"{folder}/data")
    files.write_manifest(digests, f"{folder}/manifest", "certified")
    checked = files.verify_release(digests, files.read_manifest(t.spark, f"{folder}/manifest"))
    return checked.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "ok", "reasons")


@query("experiment_results", "matrix_runs", """SELECT mode, attack, round(fraction * 100, 6) AS fraction, round(macro_f1, 9) AS macro_f1, CAST(run_id AS VARCHAR) AS seed, 1 AS seed_count, false AS is_summary FROM matrix_runs
UNION ALL SELECT mode, attack, 0e0, round(avg(macro_f1), 9), 'repeated-summary', count(*), true FROM matrix_runs GROUP BY mode, attack""")
def _(t: Tables):
    """Reports of single runs, a hundred to a report, and reports of summaries, read as one table."""
    folder = scratch_folder(t.spark, "results")
    item = F.struct(
        "mode", "attack", F.col("fraction").alias("malicious_fraction_requested"), F.col("run_id").alias("training_seed"),
        F.struct("macro_f1", "accuracy").alias("metrics"),
    )
    reports = t.matrix_runs.groupBy(F.floor(F.col("run_id") / 100).alias("report")).agg(F.collect_list(item).alias("results"))
    cells = t.matrix_runs.groupBy("mode", "attack").agg(F.struct(F.count(F.lit(1)).alias("n_seeds"), F.avg("macro_f1").alias("mean")).alias("macro_f1"))
    summary = F.struct("mode", "attack", F.struct("macro_f1").alias("metrics"))
    reports.select(F.to_json(F.struct(F.lit(1).alias("seed"), "results"))).write.text(folder)
    cells.select(F.to_json(F.struct(F.array(summary).alias("summaries")))).write.mode("append").text(folder)
    return files.load_results(t.spark, folder, one_per_file=False).select(
        "mode", "attack", F.round("fraction", 6).alias("fraction"), F.round("macro_f1", 9).alias("macro_f1"), "seed", "seed_count", "is_summary"
    )


# --- detector ----------------------------------------------------------------------------------

FEATURES = ["value", "hour", "device"]


def records(events):
    return events.select(
        "event_id", "ts", "value", F.hour("ts").cast("double").alias("hour"), F.concat(F.lit("d"), (F.col("user_id") % 9).cast("string")).alias("device"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_id"), F.concat(F.lit("svc"), (F.col("user_id") % 7).cast("string")).alias("target_asset"),
        "event_type",
    )


def prepared(t: Tables):
    """Stratified rows with label index, and the encoding fitted on the training part."""
    # Every fitting step reads the split again, so it is materialized once.
    rows = checkpointed(split.stratified_split(records(t.events), "event_type", "event_id"))
    model = features.fit_features(rows.filter("split = 'train'"), FEATURES, "event_type")
    return features.encode_label(rows, "event_type", model.classes), model


def trained(t: Tables):
    rows, model = prepared(t)
    encoded = checkpointed(features.encode(rows, model).select("event_id", "split", "y", "features"))
    classifier, _ = detector.train_detector(encoded.filter("split = 'train'"), encoded.filter("split = 'val'"), strengths=(0.0, 0.1))
    return encoded, model, classifier


@query("detector_training")
def _(t: Tables):
    encoded, model, classifier = trained(t)
    scored = detector.predict(encoded.filter("split = 'test'"), classifier).withColumn("truth", F.col("y").cast("double"))
    return metrics.summary_metrics(scored, "truth", "class_index")


@query("detector_prediction")
def _(t: Tables):
    encoded, model, classifier = trained(t)
    scored = detector.predict(encoded, classifier)
    return scored.select("event_id", detector.class_name(F.col("class_index"), model.classes).alias("attack_type"), "confidence")


@query("stream_alerting")
def _(t: Tables):
    _, model, classifier = trained(t)
    live = records(jobs.table_stream(t.spark, t.sf_dir, "events"))
    return finish(t, "alerting", jobs.detect_alerts(live, model, classifier, 0.05, emit_normal=True)).select("event_id", "attack_type", "confidence")


@query("stream_batch_agreement", "", "SELECT (SELECT count(*) FROM events) AS alerts, 0 AS missing, 0 AS extra")
def _(t: Tables):
    """Alerts of the stream against those of the batch, from one trained detector."""
    _, model, classifier = trained(t)
    keys = ["event_id", "attack_type", "confidence"]
    make = lambda rows: jobs.detect_alerts(rows, model, classifier, 0.0, emit_normal=True)
    batch = checkpointed(make(records(t.events)).select(*keys))
    live = checkpointed(finish(t, "agreement", make(records(jobs.table_stream(t.spark, t.sf_dir, "events")))).select(*keys))
    side = lambda rows, name: rows.withColumn(name, F.lit(1))
    both = side(live, "__live").join(side(batch, "__batch"), keys, "full")
    return both.agg(F.count("__live").alias("alerts"), F.count_if(F.col("__live").isNull()).alias("missing"), F.count_if(F.col("__batch").isNull()).alias("extra"))


@query("stream_run_statistics", "alerts", """SELECT count(*) AS records_read, count(*) FILTER (attack_type <> 'Normal' AND confidence >= CAST(0.4 AS DOUBLE)) AS alerts_emitted,
count(*) FILTER (NOT (attack_type <> 'Normal' AND confidence >= CAST(0.4 AS DOUBLE))) AS alerts_suppressed, true AS timed FROM alerts""")
def _(t: Tables):
    """What a run over scored records told about itself, batch by batch, added up."""
    listener = statistics.RunStatistics()
    t.spark.streams.addListener(listener)
    try:
        scored = statistics.observed(stream(t, "alerts"), 0.4)
        folder = scratch_folder(t.spark, "statistics")
        run = scored.filter(is_emitted(0.4)).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
        listener.wait(run)
    finally:
        t.spark.streams.removeListener(listener)
    total = statistics.totals(listener.table(t.spark))
    timed = (F.col("records_per_second") > 0) & (F.col("processing_seconds") > 0) & (F.col("total_seconds") >= F.col("processing_seconds"))
    return total.select(*statistics.COUNTS, timed.alias("timed"))


# --- streams -----------------------------------------------------------------------------------

@query("stream_sessions", "traffic", """WITH keyed AS (SELECT epoch_us(ts) AS t, row_id, least("ip.src_host", "ip.dst_host") || '|' || greatest("ip.src_host", "ip.dst_host") AS flow_key FROM traffic),
gapped AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY flow_key ORDER BY t, row_id) <= 21600000000 THEN 0 ELSE 1 END AS opens FROM keyed),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY flow_key ORDER BY t, row_id ROWS UNBOUNDED PRECEDING) AS no FROM gapped)
SELECT flow_key, count(*) AS n_rows, min(t) AS first_us, max(t) AS last_us FROM numbered GROUP BY flow_key, no""")
def _(t: Tables):
    source, closing = ended(t, "traffic")
    live = jobs.live_sessions(source, gap="6 hours", columns=["ip.src_host", "ip.dst_host"])
    done = finish(t, "sessions", live, closing)
    return done.select("flow_key", "n_rows", F.unix_micros("first_time").alias("first_us"), F.unix_micros("last_time").alias("last_us"))


@query("stream_alert_counts", "alerts", """WITH w AS (SELECT attack_type, epoch_us(ts) // 3600000000 * 3600000000 AS window_us FROM alerts)
SELECT window_us, attack_type, count(*) AS n FROM w GROUP BY 1, 2""")
def _(t: Tables):
    source, closing = ended(t, "alerts")
    done = finish(t, "counts", jobs.alert_counts(source), closing)
    return done.select(F.unix_micros("window_start").alias("window_us"), "attack_type", "n")


@query("sliding_alert_counts", "alerts", """WITH w AS (SELECT attack_type, epoch_us(ts) // 300000000 * 300000000 - 300000000 * unnest(range(12)) AS window_us FROM alerts)
SELECT window_us, attack_type, count(*) AS n FROM w GROUP BY 1, 2""")
def _(t: Tables):
    counted = jobs.alert_counts(t.alerts, length="1 hour", slide="5 minutes")
    return counted.select(F.unix_micros("window_start").alias("window_us"), "attack_type", "n")


_WALK = """WITH RECURSIVE series AS (SELECT agent_id, nonce, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY agent_id, nonce ORDER BY ts, event_id) AS rn FROM sessions_used),
walk AS (SELECT agent_id, nonce, event_id, rn, t AS used, false AS replay FROM series WHERE rn = 1
  UNION ALL SELECT s.agent_id, s.nonce, s.event_id, s.rn, CASE WHEN s.t - w.used <= 86400000000 THEN w.used ELSE s.t END, s.t - w.used <= 86400000000 FROM walk w JOIN series s ON s.agent_id = w.agent_id AND s.nonce = w.nonce AND s.rn = w.rn + 1)
"""


@query("stream_fresh_uses", "sessions_used", _WALK + "SELECT event_id, agent_id, nonce FROM walk WHERE NOT replay")
def _(t: Tables):
    return finish(t, "fresh", jobs.fresh_uses(stream(t, "sessions_used"), seconds=86400)).select("event_id", "agent_id", "nonce")


@query("stream_replay_flags", "sessions_used", _WALK + "SELECT event_id, replay FROM walk")
def _(t: Tables):
    return finish(t, "replay", jobs.replay_flags(stream(t, "sessions_used"), seconds=86400)).select("event_id", "replay")


@query("stream_reputation", "audit", f"WITH {_REPUTATION} SELECT agent_id, interactions, violations, round(reputation, 6) AS reputation FROM reputation")
def _(t: Tables):
    done = finish(t, "reputation", jobs.running_reputation(stream(t, "audit")))
    last = done.groupBy("agent_id").agg(F.max_by(F.struct("interactions", "violations", "reputation"), "sequence").alias("r"))
    return rounded(last.select("agent_id", "r.*"), "reputation")


@query("stream_drift", "audit", f"""WITH RECURSIVE series AS (SELECT coalesce(agent_id, 'unknown') AS agent_id, sequence AS spot, trust_value AS x, row_number() OVER (PARTITION BY coalesce(agent_id, 'unknown') ORDER BY sequence) AS rn FROM audit WHERE trust_value IS NOT NULL), {_page_hinkley('series', 'agent_id')}
SELECT agent_id, spot AS sequence FROM ph WHERE alarm""")
def _(t: Tables):
    scored = stream(t, "audit").filter("trust_value IS NOT NULL").withColumn("agent_id", F.coalesce("agent_id", F.lit("unknown")))
    return finish(t, "drift", jobs.running_drift(scored, ["agent_id"], "sequence", "trust_value"))


@query("stream_trust", "audit", f"""WITH RECURSIVE series AS (SELECT agent_id AS key, sequence AS spot, behavioral_trust AS x, row_number() OVER (PARTITION BY agent_id ORDER BY sequence) AS rn FROM audit WHERE behavioral_trust IS NOT NULL AND agent_id IS NOT NULL), {_ema_sql('series')}
SELECT key AS agent_id, spot AS sequence, round(e, 6) AS trust FROM ema""")
def _(t: Tables):
    scored = stream(t, "audit").filter("behavioral_trust IS NOT NULL AND agent_id IS NOT NULL")
    done = finish(t, "trust", jobs.running_trust(scored, "agent_id", "sequence", "behavioral_trust"))
    return rounded(done.select("agent_id", "sequence", "trust"), "trust")


@query("stream_repeat_incidents", "alerts", """SELECT alert_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY coalesce(source_id, 'unknown-source') ORDER BY ts, alert_id) <= 21600000000, false) AS repeat FROM alerts""")
def _(t: Tables):
    source, closing = ended(t, "alerts")
    # The table is a file in no order; a watermark over all of its span lets no row be late.
    return finish(t, "repeat", jobs.repeat_incidents(source, minutes=360, watermark="1000 days"), closing).select("alert_id", "repeat")


_ENTRY = _text_sql("sequence", "epoch_us(ts)", "incident_id", "agent_id", "accepted", "trust_level", "terminal_stage")


@query("stream_chained_log", "audit", f"WITH RECURSIVE {_chain_sql('audit', 'log_id', 'sequence', _ENTRY)} SELECT chain AS log_id, ord AS sequence, position, entry_hash FROM chained")
def _(t: Tables):
    folder = scratch_folder(t.spark, "chain")
    entries = stream(t, "audit").withColumn("canonical", entry_text()).select("log_id", "sequence", "canonical")
    jobs.chained_sink(entries, folder, f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/entries").select("log_id", "sequence", "position", "entry_hash")
