"""Schemas of the logs and records, as DDL."""

ALERT = "struct<attack_type:string,confidence:double,source_id:string,target_asset:string,protocol:string>"
CONTEXT = f"struct<alert:{ALERT},severity:string,priority:string,mitre_techniques:array<string>,allowed_playbooks:array<string>>"
PARAMETERS = "map<string,struct<s:string,d:double,b:boolean>>"
ACTION = f"struct<capability:string,target:string,parameters:{PARAMETERS}>"
PLAN = f"struct<incident_id:string,rationale:string,actions:array<{ACTION}>,confidence:double,engine:string>"
SESSION = "struct<agent_id:string,session_id:string,tenant_id:string,issued_at:timestamp,nonce:string>"
SCORES = "struct<semantic_risk:double,context_consistency:double,behavioral_trust:double,trust_value:double>"
STAGE = "struct<stage:string,accepted:boolean,reasons:array<string>>"
DECISION = (
    f"struct<incident_id:string,accepted:boolean,terminal_stage:string,trust_level:string,autonomy_mode:string,scores:{SCORES},"
    f"stage_results:array<{STAGE}>,executed_actions:array<string>,rationale:string,engine:string,executor_mode:string,execution_status:string>"
)

# Line schemas of the append-only logs.
LOGS = {
    "audit": (
        "sequence long, timestamp timestamp, incident_id string, agent_id string, entry_hash string, previous_hash string, "
        f"decision {DECISION}"
    ),
    "trust_log": (
        "round long, accepted array<string>, rejected_validation array<string>, rejected_detector array<string>, "
        "trust_scores map<string,double>, ood_scores map<string,double>, "
        "detection struct<cluster_method:string,n_clients:long,n_components:int,explained_variance_ratio:double,silhouette:double,"
        "benign_cluster_size:long,distance_fallback_used:boolean,degenerate:boolean,no_separation_evidence:boolean>"
    ),
    "labels": "label_id string, audit_sequence long, label string, analyst_id string, rationale string, timestamp timestamp, entry_hash string, previous_hash string",
    "feedback": (
        "incident_id string, agent_id string, semantic_risk double, consistency double, behavioral_trust double, "
        "expected_accepted boolean, label string, notes string"
    ),
    "history": "entity_id string, kind string, timestamp timestamp, payload map<string,string>",
}
