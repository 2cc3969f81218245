"""Relations of the property graph, their enumerations, and defaults that change results."""

from __future__ import annotations

NODES = (
    "id string, kind string, name string, parent_id string, repo_id string, language string, path string,"
    " span_start int, span_end int, content_hash string, layer string, source string, commit_sha string, attrs string"
)
EDGES = "kind string, src_id string, dst_id string, precision string, layer string, attrs string"
CALLS = "src_id string, dst_id string, dispatch string, precision string, site_start int, site_end int"
CALL_SITES = (
    "src_id string, name string, receiver string, receiver_type string, argc int, line int, col int,"
    " enclosing_type string"
)
IMPORTS = "src_id string, target string, symbols array<string>, alias string"
TYPE_REFS = "src_id string, name string, role string, line int"
FIELD_USES = "src_id string, name string, receiver string, receiver_type string, access string, line int"
ENDPOINTS = "channel string, role string, src_id string, address string, line int, method string"
FLOWS = "id string, name string, entry_id string, kind string, steps int, truncated boolean"
FLOW_STEPS = "flow_id string, seq int, depth int, callable_id string, via string, site_line int, parent_seq int"
ANNOTATIONS = (
    "node_id string, key string, value string, layer string, source string, confidence double,"
    " evidence array<string>, evidence_hash string, stale boolean"
)
CHANGES = "commit_seq long, ts timestamp, status string, old_path string, path string"
TEST_RESULTS = "run string, name string, test_id string, status string, message string"
COVERED = "run string, test string, test_id string, node_id string, lines int"
RULES = (
    "id long, kind string, selector_from string, selector_to string, edge_kinds array<string>, severity string, status string"
)
FINDINGS = (
    "id string, change_id string, reviewer string, severity string, claim string, evidence array<string>,"
    " status string, resolution string"
)

RELATIONS = {
    "nodes": NODES,
    "edges": EDGES,
    "calls": CALLS,
    "flows": FLOWS,
    "flow_steps": FLOW_STEPS,
    "annotations": ANNOTATIONS,
    "changes": CHANGES,
    "test_results": TEST_RESULTS,
    "covered": COVERED,
    "rules": RULES,
    "findings": FINDINGS,
}

NODE_KINDS = ("repo", "module", "file", "type", "callable", "field", "entry_point", "external", "test", "system")
DEPENDENCY_KINDS = ("imports", "uses_type", "extends", "implements", "instantiates")
DATA_CHANNELS = ("file", "db", "format")
PRECISIONS = ("exact", "heuristic", "observed", "guess")
CHANGE_ACTIONS = ("behavior", "signature", "remove", "rename", "add")
BREAKING = ("signature", "remove", "rename")
#: Of several roles of one node the first counts.
ROLES = ("changed", "must_edit", "contract", "direct", "indirect", "note")
TEST_STATUSES = ("pass", "fail", "skip")

#: Defaults of the operators.
IMPACT_DEPTH = 6
TRACE_DEPTH = 12
ASSESS_DEPTH = 4
FLOW_DEPTH = 8
FLOW_STEPS_MOST = 300
BULK_FILES = 50
HISTORY_DAYS = 730
HISTORY_COMMITS = 1000
MIN_TOGETHER = 3
MIN_CONFIDENCE = 0.5
FOLDER_SHARE = 0.75
RESTART = 0.25
HUB_LINKS = 12
CLUSTER_UNITS = 12
CLUSTER_MODULARITY = 0.3
OUTLINE_PARTS = 12
FILE_FAN_OUT = 8
QUEUE_FAN_OUT = 60
DB_FAN_OUT = 400
SIMILAR = 0.45
