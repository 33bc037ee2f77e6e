"""Trust boundary: stage checks, trust scoring and decisions over tables of plans."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from netwarden.constants import (
    ASSET_TARGETED, AUTONOMY, CAPABILITIES, EMA_ALPHA, LOW_RISK, PROTECTED_TARGETS, REJECT_BELOW_TRUST,
    SOURCE_TARGETED, TRUST_LEVELS, TRUST_THRESHOLDS, TRUST_WEIGHTS,
)
from netwarden.functions.ordered import Blocks, micros, order_blocks, with_ema, with_lag, with_rank, with_running_sum, with_trailing_sums
from netwarden.functions.text import canonicalize, canonicalize_nested, let, obfuscation, sanitize_decision
from netwarden.operators.alerts import expected_target
from netwarden.operators.retrieval import semantic_risk
from netwarden.session import checkpointed


def client_trust(
    rounds: DataFrame,
    client: str,
    order: str,
    score: str,
    alpha: float = EMA_ALPHA,
    reject_below: float = REJECT_BELOW_TRUST,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Smoothed trust per client, starting at 1 and moving only in rounds the client joins."""
    blocks = blocks or order_blocks(rounds, order)
    out = with_ema(rounds, [client], [order], blocks, score, alpha, 1.0, "trust")
    return out.withColumn("kept", F.col("trust") >= reject_below)


def nonce_replay(
    uses: DataFrame,
    agent: str = "agent_id",
    nonce: str = "nonce",
    ts: str = "ts",
    row_id: str = "event_id",
    window_seconds: float = 300.0,
    target_rows: int | None = None,
) -> DataFrame:
    """Flag a nonce used again within the window of its last *recorded* use.

    A replay is not recorded, so the window does not slide with it: a use is recorded when it is the first one beyond the
    window of a recorded use. A pause over the window always leads to a recorded use, so uses are judged in clusters without such a pause. In a
    cluster no longer than the window only the first is recorded; in a longer one the recorded uses are those that pointers reach (``reached``).
    """
    width = int(window_seconds * 1_000_000)
    keys, order = [agent, nonce], ["__t", row_id]
    rows = uses.select(agent, nonce, row_id, micros(ts).alias("__t"))
    blocks = order_blocks(rows, order, target_rows)
    lagged = with_lag(rows, keys, order, blocks, {"__before": "__t"})
    opens = F.coalesce(F.col("__t") - F.col("__before") > width, F.lit(True))
    clustered = with_running_sum(lagged.withColumn("__opens", opens), keys, order, blocks, {"__cluster": F.col("__opens").cast("long")})
    clustered = checkpointed(clustered.select(*keys, row_id, "__t", "__opens", "__cluster"))
    spans = clustered.groupBy(*keys, "__cluster").agg(F.min("__t").alias("__from"), F.max("__t").alias("__to"))
    long = clustered.join(spans.filter(F.col("__to") - F.col("__from") > width), [*keys, "__cluster"])
    recorded = reached(long, [*keys, "__cluster"], row_id, width, blocks, target_rows).select(*keys, row_id, F.lit(True).alias("__recorded"))
    judged = clustered.join(recorded, [*keys, row_id], "left")
    return judged.select(*keys, row_id, (~F.col("__opens") & F.col("__recorded").isNull()).alias("replay"))


def reached(rows: DataFrame, keys: list[str], row_id: str, width: int, blocks: Blocks, target_rows: int | None = None) -> DataFrame:
    """The rows of every key that lead to each other from the first, each to the first one more than ``width`` after it.

    A pointer is a row's position and that of the row it leads to. In every round what is reached goes on along the pointers, and each pointer
    is joined to the one where it ends, so it leads twice as far: a chain of n rows takes log2(n) rounds, whose joins are by key and position, so
    the rows of one key lie in all tasks.
    """
    ranked = with_rank(rows.select(*keys, row_id, "__t"), keys, ["__t", row_id], blocks, "__at")
    # The row that a row leads to follows all that are no later than its own time and the width.
    moments = F.array(F.struct(F.col("__t").alias("__when"), F.lit(0).alias("__asks")), F.struct((F.col("__t") + width).alias("__when"), F.lit(1).alias("__asks")))
    doubled = ranked.select(*keys, row_id, "__at", F.inline(moments)).withColumnRenamed("__when", "__t")
    moves = ["__t", "__asks", row_id]
    counted = with_running_sum(doubled, keys, moves, order_blocks(doubled, moves, target_rows, rows=2 * blocks.rows), {"__upto": (1 - F.col("__asks")).cast("long")})
    pointers = counted.filter("__asks = 1").select(*keys, row_id, "__at", (F.col("__upto") + 1).alias("__to"))
    places = checkpointed(pointers)
    ends = places.select(*keys, F.col("__at").alias("__to"))
    jumps = checkpointed(places.select(*keys, "__at", "__to").join(ends, [*keys, "__to"]))  # pointers behind the last row lead nowhere
    seen = places.filter("__at = 1").select(*keys, "__at")
    while not jumps.isEmpty():
        seen = checkpointed(seen.unionByName(seen.join(jumps, [*keys, "__at"]).select(*keys, F.col("__to").alias("__at"))))
        onward = jumps.select(*keys, F.col("__at").alias("__to"), F.col("__to").alias("__then"))
        jumps = checkpointed(jumps.join(onward, [*keys, "__to"]).select(*keys, "__at", F.col("__then").alias("__to")))
    return places.join(seen, [*keys, "__at"]).select(*keys, row_id)


# --- stage 1: preprocessing checks ---------------------------------------------------------

LIMITS = {
    "max_actions": 5,
    "max_text": 512,
    "max_number": 1_000_000.0,
    "max_age_seconds": 300,
    "actions_per_hour": 20,
}

ACTION = "struct<capability:string,target:string,parameters:map<string,struct<s:string,d:double,b:boolean>>>"


def session_reasons(as_of: Column, issued_at: Column, max_age: int = LIMITS["max_age_seconds"]) -> Column:
    """Expired or future sessions."""
    age = micros(as_of) - micros(issued_at)
    return F.array_compact(
        F.array(
            F.when(age > max_age * 1_000_000, "session expired"),
            F.when(age < 0, "session issued_at is in the future"),
        )
    )


def size_reasons(actions: Column, limit: int = LIMITS["max_actions"]) -> Column:
    n = F.size(actions)
    return F.array_compact(
        F.array(
            F.when(n == 0, "plan has no actions"),
            F.when(n > limit, F.concat(F.lit("too many actions: "), n.cast("string"), F.lit(f" > {limit}"))),
        )
    )


def normalize_actions(plans: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """Truncate and canonicalize targets and text parameters; collect ``action_reasons`` in order."""
    cut = lambda v: F.substring(v, 1, limits["max_text"])
    # Cell 0 of an action is its target, cell k+1 its k-th parameter.
    cells = F.transform(
        "actions", lambda a: F.array_prepend(F.transform(F.map_values(a["parameters"]), lambda v: cut(v["s"])), cut(a["target"]))
    )
    long = lambda v: F.length(v) > limits["max_text"]

    def reasons(action: Column, clean: Column) -> Column:
        about = F.concat(F.lit("action target for '"), action["capability"], F.lit("' "))
        on_target = F.array(F.when(long(action["target"]), F.concat(about, F.lit("exceeds max length"))), F.concat(about, obfuscation(clean[0])))
        names = F.map_keys(action["parameters"])

        def on_parameter(value: Column, k: Column) -> Column:
            label = F.concat(F.lit("parameter '"), F.element_at(names, k + 1), F.lit("' "))
            number = value["d"]
            broken = F.isnan(number) | (F.abs(number) == float("inf"))
            return F.array(
                F.when(long(value["s"]), F.concat(label, F.lit("exceeds max length"))),
                F.concat(label, obfuscation(F.element_at(clean, k + 2))),
                F.when(broken, F.concat(label, F.lit("is non-finite"))).when(
                    F.abs(number) > limits["max_number"], F.concat(label, F.lit("exceeds max magnitude"))
                ),
            )

        return F.flatten(F.array_prepend(F.transform(F.map_values(action["parameters"]), on_parameter), on_target))

    def rebuilt(action: Column, clean: Column) -> Column:
        names = F.map_keys(action["parameters"])
        values = F.transform(
            F.map_values(action["parameters"]),
            lambda v, k: F.struct(F.element_at(clean, k + 2).alias("s"), v["d"].alias("d"), v["b"].alias("b")),
        )
        return F.struct(
            action["capability"].alias("capability"), clean[0].alias("target"), F.map_from_arrays(names, values).alias("parameters")
        )

    # Bound, as the optimizer would put the whole expression of the cells wherever an action reads one.
    on_action = lambda cells: lambda a, i: let(F.element_at(cells, i + 1), lambda clean: reasons(a, clean))
    found = let(F.col("__cells"), lambda cells: F.flatten(F.transform("actions", on_action(cells))))
    return (
        plans.withColumn("__cells", canonicalize_nested(cells))
        .withColumn("action_reasons", F.array_compact(found))
        .withColumn("actions", let(F.col("__cells"), lambda cells: F.transform("actions", lambda a, i: let(F.element_at(cells, i + 1), lambda clean: rebuilt(a, clean)))))
        .drop("__cells")
    )


def with_quota(plans: DataFrame, key: str = "plan_id", ts: str = "as_of", limit: int = LIMITS["actions_per_hour"], seconds: int = 3600) -> DataFrame:
    """Actions of the agent in the last hour plus this plan's, against the hourly quota."""
    # Only four narrow columns meet by agent; the plans themselves stay spread by their key, whatever one agent's share is.
    asked = plans.select(key, "agent_id", ts, F.size("actions").cast("long").alias("__asked"))
    summed = with_trailing_sums(asked, ["agent_id"], ts, key, seconds, {"recent_actions": F.col("__asked")})
    counted = plans.join(summed.select(key, "recent_actions"), key)
    total = F.col("recent_actions") + F.size("actions")
    reason = F.concat(
        F.lit("hourly action quota exceeded ("), total.cast("string"), F.lit(f" > {limit}: "),
        F.col("recent_actions").cast("string"), F.lit(" in the last hour + "), F.size("actions").cast("string"), F.lit(" in this plan)"),
    )
    return counted.withColumn("quota_reasons", F.array_compact(F.array(F.when(total > limit, reason))))


def rationale_check(plans: DataFrame) -> DataFrame:
    """Canonicalize the rationale and say why it looks obfuscated, if it does."""
    clean = plans.withColumn("rationale", canonicalize(F.col("rationale")))
    return clean.withColumn(
        "rationale_reasons", F.array_compact(F.array(F.concat(F.lit("rationale "), let(F.col("rationale"), obfuscation))))
    )


def with_replay(plans: DataFrame, key: str = "plan_id", ts: str = "as_of", window_seconds: float = 300.0) -> DataFrame:
    """``replay``: whether the plan's agent has used its nonce before, inside the window; plans without one have no replay."""
    flags = nonce_replay(plans.filter(F.col("nonce").isNotNull()), ts=ts, row_id=key, window_seconds=window_seconds).select(key, "replay")
    return plans.join(flags, key, "left").withColumn("replay", F.coalesce("replay", F.lit(False)))


def preprocess_plans(plans: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """Stage 1: all checks, the normalized plan, ``stage1_reasons`` and ``stage1_ok``. Plans with a ``nonce`` are checked for replay."""
    if "nonce" in plans.columns and "replay" not in plans.columns:
        plans = with_replay(plans, window_seconds=limits.get("nonce_window_seconds", 300.0))
    # The quota needs the number of actions only, which normalizing leaves as it is; the costly text checks come behind its join, once for each plan.
    checked = rationale_check(normalize_actions(with_quota(plans, limit=limits["actions_per_hour"]), limits))
    replay = F.array_compact(F.array(F.when(F.col("replay"), "nonce replay detected"))) if "replay" in plans.columns else F.array().cast("array<string>")
    reasons = F.concat(
        replay,
        session_reasons(F.col("as_of"), F.col("issued_at"), limits["max_age_seconds"]),
        size_reasons(F.col("actions"), limits["max_actions"]),
        F.col("action_reasons"), F.col("quota_reasons"), F.col("rationale_reasons"),
    )
    return checked.withColumn("stage1_reasons", reasons).drop(
        "action_reasons", "quota_reasons", "rationale_reasons", "recent_actions"
    ).withColumn("stage1_ok", F.size("stage1_reasons") == 0)


# --- stage 2: deterministic controls --------------------------------------------------------

def control_reasons(incident_id: Column, rationale: Column, actions: Column, allowed: Column) -> Column:
    """Blank fields, unknown capabilities, capabilities this threat does not allow."""
    listing = F.array_join(allowed, ", ")

    def on_action(action: Column) -> Column:
        name = action["capability"]
        return F.when(~name.isin(CAPABILITIES), F.concat(F.lit("capability '"), name, F.lit("' not in tool whitelist"))).when(
            ~F.array_contains(allowed, name),
            F.concat(F.lit("capability '"), name, F.lit("' not authorized for this threat context (allowed: "), listing, F.lit(")")),
        )

    fields = F.array(
        F.when(F.trim(incident_id) == "", "incident_id is empty"), F.when(F.trim(rationale) == "", "rationale is empty")
    )
    return F.array_compact(F.concat(fields, F.transform(actions, on_action)))


# --- trust scores ---------------------------------------------------------------------------

def context_consistency(actions: Column, source: Column, asset: Column) -> Column:
    """Share of actions whose target agrees with the threat context; 0 without actions.

    Bound capabilities must name exactly the expected target; all others must name none.
    """
    def agrees(action: Column) -> Column:
        name, target = action["capability"], action["target"]
        bound = name.isin([*SOURCE_TARGETED, *ASSET_TARGETED])
        return F.when(bound, F.coalesce(target == expected_target(name, source, asset), F.lit(False))).otherwise(target.isNull())

    n = F.size(actions)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.filter(actions, agrees)) / n)


def behaviour_features(decisions: DataFrame, key: str, ts: str = "ts", seconds: int = 3600) -> DataFrame:
    """High-risk share, action count, and the agent's violation rate and event count in the last hour.

    Needs ``agent_id``, ``action_count``, ``high_risk_count`` and ``policy_violation``; only
    strictly earlier decisions count.
    """
    one = F.lit(1).cast("long")
    counted = with_trailing_sums(
        decisions, ["agent_id"], ts, key, seconds,
        {"recent_events": one, "__violations": F.when(F.col("policy_violation"), one).otherwise(F.lit(0).cast("long"))},
    )
    share = F.when(F.col("action_count") > 0, F.col("high_risk_count") / F.col("action_count")).otherwise(F.lit(0.0))
    rate = F.when(F.col("recent_events") > 0, F.col("__violations") / F.col("recent_events")).otherwise(F.lit(0.0))
    return counted.withColumn("high_risk_share", share).withColumn("violation_rate", rate).drop("__violations")


FEATURES = ["high_risk_share", "action_count", "violation_rate", "recent_events"]


def behaviour_population(history: DataFrame, key: str, ts: str = "ts", min_rows: int = 20) -> DataFrame | None:
    """Observed feature rows to refit the anomaly model on; None when there are too few."""
    population = behaviour_features(history, key, ts)
    return population if history.limit(min_rows).count() >= min_rows else None


def feature_attribution(features: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """Each feature divided by the row's absolute sum."""
    total = sum((F.abs(F.col(n)) for n in names), F.lit(0.0))
    scale = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return features.select("*", *[(F.col(n) / scale).alias(f"{n}_part") for n in names])


def trust_value(risk: Column, consistency: Column, behaviour: Column, weights=TRUST_WEIGHTS) -> Column:
    if abs(sum(weights) - 1.0) > 1e-6:
        raise ValueError("trust weights must sum to 1")
    ws, wc, wb = weights
    return F.lit(ws) * (1.0 - risk) + F.lit(wc) * consistency + F.lit(wb) * behaviour


def trust_level(value: Column, thresholds: dict = TRUST_THRESHOLDS) -> Column:
    return (
        F.when(value < thresholds["low"], "low").when(value < thresholds["medium"], "medium")
        .when(value < thresholds["high"], "high").when(value.isNotNull(), "verified")
    )


def autonomy_mode(level: Column) -> Column:
    mode = F.when(level == TRUST_LEVELS[0], AUTONOMY[TRUST_LEVELS[0]])
    for name in TRUST_LEVELS[1:]:
        mode = mode.when(level == name, AUTONOMY[name])
    return mode


def eligible_actions(actions: Column, mode: Column, allowed: Column) -> Column:
    """Capabilities that may run at this autonomy."""
    names = F.transform(actions, lambda a: a["capability"])
    fits = lambda c: c.isin(CAPABILITIES) & F.array_contains(allowed, c) & ((mode != "restricted_action") | c.isin(LOW_RISK))
    return F.when(
        mode.isin("read_only", "recommendation"), F.array().cast("array<string>")
    ).otherwise(F.filter(names, fits))


def execution_status(eligible: Column, succeeded: Column, mode: Column) -> Column:
    return (
        F.when(F.size(eligible) == 0, "not_attempted").when(F.size(succeeded) == 0, "failed")
        .when(F.size(succeeded) < F.size(eligible), "partially_executed")
        .when(mode == "production", "executed").otherwise("simulated")
    )


def evaluate_plans(plans: DataFrame, limits: dict = LIMITS, executor_mode: str = "simulate") -> DataFrame:
    """The whole decision per plan; scores stay null once a stage rejects.

    Needs plan, context and session columns: ``plan_id incident_id rationale actions
    allowed_playbooks source_id target_asset agent_id as_of issued_at behavioral_trust``, and
    either ``semantic_risk`` or ``template`` and ``attack_type`` to compute it from.
    """
    df = preprocess_plans(plans, limits).withColumn(
        "stage2_reasons",
        F.when(F.col("stage1_ok"), control_reasons(F.col("incident_id"), F.col("rationale"), F.col("actions"), F.col("allowed_playbooks"))),
    )
    passed = F.col("stage1_ok") & (F.size("stage2_reasons") == 0)
    risk = F.col("semantic_risk") if "semantic_risk" in plans.columns else semantic_risk(F.col("rationale"), F.col("template"), F.col("attack_type"))
    consistency = context_consistency(F.col("actions"), F.col("source_id"), F.col("target_asset"))
    df = (
        df.withColumn("__pass", passed)
        .withColumn("semantic_risk", F.when(F.col("__pass"), risk))
        .withColumn("context_consistency", F.when(F.col("__pass"), consistency))
        .withColumn("behavioral_trust", F.when(F.col("__pass"), F.col("behavioral_trust")))
    )
    df = df.withColumn(
        "trust_value", trust_value(F.col("semantic_risk"), F.col("context_consistency"), F.col("behavioral_trust"))
    ).withColumn("trust_level", trust_level(F.col("trust_value")))
    df = df.withColumn("autonomy_mode", autonomy_mode(F.col("trust_level")))
    eligible = F.when(
        F.col("__pass"), eligible_actions(F.col("actions"), F.col("autonomy_mode"), F.col("allowed_playbooks"))
    ).otherwise(F.array().cast("array<string>"))
    mode = F.lit(executor_mode)
    empty = F.array().cast("array<string>")
    stage = lambda name, reasons: F.struct(F.lit(name).alias("stage"), (F.size(reasons) == 0).alias("accepted"), reasons.alias("reasons"))
    stages = F.when(
        F.col("stage1_ok"), F.array(stage("preprocessing", F.col("stage1_reasons")), stage("deterministic_controls", F.coalesce("stage2_reasons", empty)))
    ).otherwise(F.array(stage("preprocessing", F.col("stage1_reasons"))))
    decided = (
        df.withColumn("executed_actions", eligible)
        .withColumn("execution_status", F.when(F.col("__pass"), execution_status(F.col("executed_actions"), F.col("executed_actions"), mode)).otherwise("not_attempted"))
        .withColumn("executor_mode", F.when(F.col("__pass"), mode))
        .withColumn("accepted", F.coalesce(F.col("__pass") & (F.col("autonomy_mode") != "read_only"), F.lit(False)))
        .withColumn(
            "terminal_stage",
            F.when(~F.col("stage1_ok"), "preprocessing").when(~F.col("__pass"), "deterministic_controls").otherwise("capability_enforcement"),
        )
        .withColumn("stage_results", stages)
        .drop("__pass")
    )
    return sanitize_decision(decided)


# --- protected networks ---------------------------------------------------------------------

def ipv4_range(text: Column) -> Column:
    """struct<lo, hi> of an IPv4 address or prefix, null when it is neither."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    pattern = rf"^{octet}\.{octet}\.{octet}\.{octet}(?:/(3[0-2]|[12]?[0-9]))?$"
    part = lambda i: F.regexp_extract(text, pattern, i).cast("long")
    address = part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)
    prefix = F.regexp_extract(text, pattern, 5)
    size = F.pow(F.lit(2.0), 32 - F.when(prefix == "", 32).otherwise(prefix.try_cast("int"))).cast("long")
    low = F.floor(address / size) * size
    return F.when(text.rlike(pattern), F.struct(low.cast("long").alias("lo"), (low + size - 1).cast("long").alias("hi")))


def protected_target(df: DataFrame, target: str, protected: list[str] = PROTECTED_TARGETS) -> DataFrame:
    """``valid_network`` and ``is_protected`` for a target column; the protected list is a short policy list."""
    v4 = [ipaddress.ip_network(p, strict=False) for p in protected if ":" not in p]
    v6 = [p for p in protected if ":" in p]
    bounds = [(int(n.network_address), int(n.broadcast_address)) for n in v4]

    @F.pandas_udf(T.BooleanType())
    def v6_overlap(texts: pd.Series) -> pd.Series:
        # IPv6 text has no built-in parser; IPv4 rows arrive as null and are skipped.
        networks = [ipaddress.ip_network(p, strict=False) for p in v6]

        def check(text):
            try:
                return None if text is None else any(ipaddress.ip_network(text, strict=False).overlaps(n) for n in networks)
            except (ValueError, TypeError):
                return None

        return texts.map(check).astype("boolean")

    df = df.withColumn("__range", ipv4_range(F.col(target))).withColumn(
        "__v6", v6_overlap(F.when(F.contains(F.col(target), F.lit(":")), F.col(target)))
    )
    hit = F.lit(False)
    for low, high in bounds:
        hit = hit | ((F.col("__range.lo") <= high) & (F.col("__range.hi") >= low))
    valid = F.col("__range").isNotNull() | F.col("__v6").isNotNull()
    return df.withColumn("valid_network", valid).withColumn(
        "is_protected", F.when(F.col("__range").isNotNull(), hit).otherwise(F.coalesce("__v6", F.lit(False)))
    ).drop("__range", "__v6")
