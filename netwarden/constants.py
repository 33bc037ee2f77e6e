"""Fixed values the results depend on: policy tables, word lists, patterns, thresholds."""

# Attack type -> (severity, priority, techniques, allowed playbooks).
THREAT_MAP = {
    "Normal": ("informational", "P4", [], ["observe", "log_event"]),
    "DDoS_UDP": ("critical", "P1", ["T1498.001", "T0814"], ["rate_limit", "block_source", "start_capture", "notify_soc"]),
    "DDoS_ICMP": ("critical", "P1", ["T1498.001", "T0814"], ["rate_limit", "block_source", "start_capture", "notify_soc"]),
    "DDoS_TCP": ("critical", "P1", ["T1498.001", "T0814"], ["rate_limit", "block_source", "start_capture", "notify_soc"]),
    "DDoS_HTTP": ("critical", "P1", ["T1499.002", "T0814"], ["rate_limit", "block_source", "start_capture", "notify_soc"]),
    "Ransomware": ("critical", "P1", ["T1486"], ["isolate_segment", "block_source", "start_capture", "notify_soc"]),
    "Backdoor": ("critical", "P1", ["T1059", "T0866"], ["isolate_segment", "block_source", "start_capture", "notify_soc"]),
    "MITM": ("high", "P1", ["T1557", "T0831"], ["isolate_segment", "rotate_session", "start_capture", "notify_soc"]),
    "Password": ("high", "P2", ["T1110"], ["rate_limit", "rotate_session", "increase_logging", "notify_soc"]),
    "SQL_injection": ("high", "P2", ["T1190"], ["block_source", "start_capture", "increase_logging", "create_ticket"]),
    "Uploading": ("high", "P2", ["T1105", "T1190"], ["isolate_segment", "start_capture", "increase_logging", "notify_soc"]),
    "XSS": ("medium", "P2", ["T1189", "T1190"], ["block_source", "increase_logging", "create_ticket"]),
    "Vulnerability_scanner": ("medium", "P2", ["T1595.002"], ["block_source", "increase_logging", "create_ticket"]),
    "Port_Scanning": ("medium", "P2", ["T1595.001"], ["block_source", "increase_logging", "create_ticket"]),
    "Fingerprinting": ("low", "P3", ["T1592", "T0855"], ["increase_logging", "log_event", "create_ticket"]),
}

# Capability whitelist.
LOW_RISK = ["observe", "log_event", "increase_logging", "create_ticket", "notify_soc", "start_capture"]
HIGH_RISK = ["rate_limit", "block_source", "isolate_segment", "rotate_session"]
CAPABILITIES = LOW_RISK + HIGH_RISK

# Role -> allowed capabilities.
ROLES = {
    "readonly": ["observe", "log_event"],
    "soc_analyst": LOW_RISK,
    "security_operator": LOW_RISK + ["rate_limit", "block_source"],
    "admin": CAPABILITIES,
}

# Capabilities whose target is the attacker, and the one whose target is the asset.
SOURCE_TARGETED = ["block_source", "rate_limit"]
ASSET_TARGETED = ["isolate_segment"]

# Networks no action may touch.
PROTECTED_TARGETS = ["127.0.0.1/32", "169.254.0.0/16", "::1/128"]

# Rationale text per severity.
RATIONALE = {
    "critical": "Critical severity {attack_type} detected from {source_id} targeting {target_asset}; executing {playbooks} per incident response policy to contain the threat immediately.",
    "high": "High severity {attack_type} detected from {source_id}; executing {playbooks} to contain and investigate.",
    "medium": "Medium severity {attack_type} detected; recommending {playbooks} for investigation and containment.",
    "low": "Low severity {attack_type} observed; recommending {playbooks} for monitoring.",
    "informational": "Informational event {attack_type} observed; logging for visibility, no containment action required.",
}

# Prose for each capability, used to widen the risk vocabulary.
CAPABILITY_PROSE = {
    "observe": "observing the activity",
    "log_event": "logging the event",
    "increase_logging": "increasing logging and monitoring",
    "create_ticket": "creating a ticket for follow-up",
    "notify_soc": "notifying the security operations center SOC team",
    "start_capture": "starting a packet capture",
    "rate_limit": "applying rate limiting",
    "block_source": "blocking the source",
    "isolate_segment": "isolating the network segment",
    "rotate_session": "rotating session credentials",
}

# Default knowledge snippets for retrieval (id, title, content).
KNOWLEDGE = [
    ("MITRE_T0814", "Denial of Service - Wireless / Network Flooding (T0814)", "DoS attacks in IIoT flood network channels or Modbus/MQTT brokers with illegitimate packets, causing high latency or dropped control signals. Remediation: rate-limiting, blocking source IP, and applying network microsegmentation."),
    ("MITRE_T0855", "Unauthorized Command Message / Command Injection (T0855)", "Adversaries send unauthorized control commands to PLCs or IIoT gateways (e.g., Modbus write single coil / register). Remediation: isolate affected gateway, revoke unauthorized session nonces, enforce strict action whitelisting."),
    ("MITRE_T0866", "Exploitation of Remote Services / Backdoor (T0866)", "Exploiting exposed services (SSH, web management interface, OPC-UA) to establish persistence or pivot inside OT network. Remediation: block source IP, terminate active sessions, trigger credential rotation."),
    ("MITRE_T0831", "Manipulation of Control / False Data Injection (T0831)", "Attackers tamper with sensor telemetry or process variables (FDI attack) to spoof operational status. Remediation: isolate telemetry source, enable deep packet inspection, alert SOC for manual process verification."),
    ("IIOT_PLAYBOOK_GUIDELINES", "IIoT Incident Response Principles", "High severity events require immediate containment (block_source or isolate_host). Medium severity events recommend targeted observation and rate limits (apply_qos_limit, alert_soc). Low/informational events require audit logging only."),
]

# Column-name candidates for each role, in order of preference.
LABEL_NAMES = ["attack_label", "label", "class", "target", "binary_label"]
ATTACK_TYPE_NAMES = ["attack_type", "attack", "category", "attack_category"]
TIME_NAMES = ["timestamp", "time", "frame.time", "ts"]
GROUP_NAMES = ["flow_id", "session_id", "device_id", "sensor", "source"]
LEAKAGE_NAMES = ["attack_label", "attack_type", "attack", "label", "class", "target"]
FLOW_COLUMNS = ["ip.src_host", "ip.dst_host", "tcp.srcport", "tcp.dstport", "udp.port", "udp.stream", "ip.proto"]

# Text patterns.
LEET_FROM, LEET_TO = "01345$7@!", "oieasstai"
HIDDEN_WORDS = [
    "ignore", "override", "bypass", "disregard", "admin", "root", "shutdown",
    "delete", "execute", "system", "disable", "unlock", "sudo",
]
BASE64_RUN = r"^[A-Za-z0-9+/]{16,}={0,2}$"
HEX_RUN = r"^(?:[0-9a-fA-F]{2}){8,}$"
PERCENT_CODE = r"%[0-9a-fA-F]{2}"
SAFE_ARGUMENT = r"^[a-zA-Z0-9_.:/\-]+$"
SENSITIVE = {
    "aws_access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "api_key": r"(?i)\bapi[_-]?key\s*[:=]\s*\S+",
    "password": r"(?i)\bpassword\s*[:=]\s*\S+",
    "jwt": r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b",
    "email": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "credit_card": r"\b(?:\d[ -]?){13,16}\b",
}
# Text every match of a pattern must contain (lower case); the card pattern needs 13 digits.
SENSITIVE_HINTS = {
    "aws_access_key": "akia",
    "api_key": "api",
    "password": "password",
    "jwt": "eyj",
    "email": "@",
}
CARD_DIGITS = r"(?:\p{Nd}[ -]?){13}"

# Trust thresholds, weights and modes.
TRUST_WEIGHTS = (0.4, 0.3, 0.3)
TRUST_THRESHOLDS = {"low": 0.40, "medium": 0.65, "high": 0.85}
TRUST_LEVELS = ["low", "medium", "high", "verified"]
AUTONOMY = {"low": "read_only", "medium": "recommendation", "high": "restricted_action", "verified": "autonomous_execution"}
SEMANTIC_LIMIT = 0.5
CONTEXT_LIMIT = 1.0
EMA_ALPHA = 0.3
REJECT_BELOW_TRUST = 0.35
MIN_SILHOUETTE = 0.15
FLAT_SCALE = 1e-12

# Candidate grids for the weight search.
WEIGHT_GRID = [(0.4, 0.3, 0.3), (0.5, 0.3, 0.2), (0.3, 0.4, 0.3), (0.33, 0.33, 0.34)]
THRESHOLD_GRID = [(0.40, 0.65, 0.85), (0.35, 0.60, 0.80), (0.45, 0.70, 0.90)]

DECISIONS = ["ALLOW", "BLOCK", "HUMAN_REVIEW"]

# Two-sided 95% Student-t quantiles for 1..30 degrees of freedom.
T_975 = [
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139,
    2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
    2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
]
T_975_LARGE = 1.959964

HASH_GENESIS = "0" * 64
