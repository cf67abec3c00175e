"""Node kinds, edge kinds and the order in which the graph builders write them.

A graph here is a simple directed graph: one row per node key and one row per (src, dst).
When two statements write the same pair, the later one decides the edge type, so every edge
kind has a place in a write sequence. Place and row number together form one ``long`` (see
``operators.writes``), which keeps the dedup a hash aggregation over a primitive.
"""

# Entity list name in a report record -> node kind.
ENTITY_FIELDS = {
    "ips": "ip",
    "domains": "domain",
    "hashes": "hash",
    "files": "file",
    "timestamps": "timestamp",
    "processes": "process",
    "ports": "port",
    "users": "user",
    "attack_stages": "attack_stage",
}

BASIC_KINDS = ["ip", "domain", "hash", "file", "timestamp"]
ALL_KINDS = list(ENTITY_FIELDS.values())

# Order in which nodes are first written while one report or alert is read.
NODE_SEQUENCE = [
    "report",
    "alert",
    "host",
    "timestamp",
    "rule",
    "ip",
    "domain",
    "hash",
    "file",
    "process",
    "port",
    "user",
    "attack_stage",
]

# Edge kind written for each mention of a kind in a report.
REPORT_EDGE = {
    "ip": "report_contains_ip",
    "domain": "report_contains_domain",
    "hash": "report_contains_hash",
    "file": "report_contains_file",
    "process": "report_contains_process",
    "port": "report_contains_port",
    "user": "report_contains_user",
    "attack_stage": "report_describes_attack_stage",
}

# Fixed values: (source kind, target kind, edge kind) written for entities of one report.
PAIR_EDGES = [
    ("ip", "domain", "ip_appears_with_domain"),
    ("ip", "hash", "ip_appears_with_hash"),
    ("ip", "file", "ip_appears_with_file"),
    ("ip", "port", "ip_uses_port"),
    ("ip", "ip", "ip_communicates_with_ip"),
    ("domain", "hash", "domain_appears_with_hash"),
    ("domain", "file", "domain_appears_with_file"),
    ("domain", "ip", "domain_resolves_to_ip"),
    ("hash", "file", "hash_appears_with_file"),
    ("process", "file", "process_accesses_file"),
    ("process", "ip", "process_connects_to_ip"),
    ("process", "port", "process_uses_port"),
    ("user", "process", "user_owns_process"),
    ("user", "file", "user_accesses_file"),
    ("attack_stage", "ip", "attack_stage_involves_ip"),
    ("attack_stage", "domain", "attack_stage_involves_domain"),
    ("attack_stage", "file", "attack_stage_involves_file"),
    ("attack_stage", "process", "attack_stage_involves_process"),
]

# The reduced report graph (five kinds) writes only the plain co-occurrences.
BASIC_PAIR_EDGES = [p for p in PAIR_EDGES if "_appears_with_" in p[2]]

# Write sequence. A tag after ":" tells two places of one edge kind apart.
WRITE_SEQUENCE = [
    # a report and what it names
    "timestamp_of_report",
    "report_contains_ip",
    "report_contains_domain",
    "report_contains_hash",
    "report_contains_file",
    "report_contains_process",
    "report_contains_port",
    "report_contains_user",
    "report_describes_attack_stage",
    "timestamp_of_attack_stage",
    # entities of one report
    "ip_appears_with_domain",
    "ip_appears_with_hash",
    "ip_appears_with_file",
    "ip_uses_port",
    "ip_communicates_with_ip",
    "domain_appears_with_hash",
    "domain_appears_with_file",
    "domain_resolves_to_ip",
    "hash_appears_with_file",
    "process_creates_process:early",
    "process_accesses_file",
    "process_connects_to_ip",
    "process_uses_port",
    "process_creates_process",
    "user_owns_process",
    "user_accesses_file",
    "attack_stage_follows",
    "attack_stage_involves_ip",
    "attack_stage_involves_domain",
    "attack_stage_involves_file",
    "attack_stage_involves_process",
    # one alert
    "alert_on_host",
    "alert_at_timestamp",
    "alert_triggered_by_rule",
    "host_has_ip",
    "alert_involves_ip",
    "rule_related_to_file",
    "alert_involves_file",
    "host_runs_process",
    "alert_involves_process",
    "process_accesses_file:alert",
    "process_connects_to_ip:alert",
    "ip_uses_port:alert",
    "process_uses_port:alert",
    "alert_involves_user",
    "user_owns_process:alert",
    "user_accesses_file:alert",
    "alert_related_to_attack_stage",
    "timestamp_of_attack_stage:alert",
    "attack_stage_involves_ip:alert",
    "attack_stage_involves_file:alert",
    "attack_stage_involves_process:alert",
    "attack_stage_follows:alert",
    # links between the two sides
    "report_related_to_alert",
    "shared_attack_stage:ip",
    "report_related_to_rule",
    "report_related_to_alert_by_time",
    "attack_stages_at_same_time",
    "report_related_to_alert_by_process",
    "shared_attack_stage:process",
    "report_related_to_alert_by_attack_stage",
]

# Kill-chain order of the stages; anything else comes last.
STAGE_ORDER = {
    "Reconnaissance": 1,
    "Exploitation": 2,
    "Privilege_Escalation": 3,
    "Lateral_Movement": 4,
    "Data_Exfiltration": 5,
}
UNKNOWN_STAGE_ORDER = 999

# Words that place a rule description in a stage; the first hit decides.
STAGE_WORDS = [
    ("Reconnaissance", ["reconnaissance", "scan", "discovery"]),
    ("Exploitation", ["exploit", "vulnerability", "cve"]),
    ("Lateral_Movement", ["lateral", "movement", "pivot"]),
    ("Privilege_Escalation", ["privilege", "escalation", "admin"]),
    ("Data_Exfiltration", ["data", "exfiltration", "transfer"]),
]
