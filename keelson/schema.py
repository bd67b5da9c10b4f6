"""Tables of the model, enum orders and default prices."""

from __future__ import annotations

NODES = (
    "id long, name string, kind string, polarity string, container long, visibility string, effective_size long, re_export boolean, "
    "public_api boolean, advice_exempt boolean, display_name string, test_source boolean, owner long"
)
EDGES = "source long, target long, kind string, hardness string, confidence double"
CONTAINERS = "id long, name string, level string, parent long, synthetic boolean, label_keyed boolean"
AFFINITIES = "owner long, companion long, kind string"
FILE_FACTS = "file string, test_of string, entry boolean, start string"
SCOPE_LADDERS = "node long, declared string, needed string, spelling string"
EXPOSURES = "exposer long, exposed long, reach boolean"
ADVISORY_USES = "user long, used long, from_test boolean"
TEST_SUPPORT_ROOTS = "root string"
FINDINGS = "kind string, severity string, location array<string>, detail string"

TABLES = {
    "nodes": NODES, "edges": EDGES, "containers": CONTAINERS, "affinities": AFFINITIES, "file_facts": FILE_FACTS,
    "scope_ladders": SCOPE_LADDERS, "exposures": EXPOSURES, "advisory_uses": ADVISORY_USES, "test_support_roots": TEST_SUPPORT_ROOTS,
}

# Enum members in their order, and default prices, weights and limits.
NODE_KINDS = ("Symbol", "Type", "FileBody")
POLARITIES = ("Production", "TestCase", "TestSupport")
LEVELS = ("File", "Folder", "Domain", "Package", "PackageGroup")
EDGE_KINDS = ("ValueImport", "TypeReference", "Inheritance", "Call", "ReExport")
HARDNESS = ("Hard", "Soft")
FINDING_KINDS = ("Cycle", "Polarity", "Capacity", "Visibility", "TestOnly")
SEVERITIES = ("Violation", "Borderline")
KIND_WEIGHTS = {"ValueImport": 1.0, "Inheritance": 1.5, "Call": 1.0, "TypeReference": 0.3, "ReExport": 0.0}
SAME_FILE_SYMBOL, SAME_FILE_TYPE = 1.0, 3.0
HEIGHTS = {"File": 1, "Folder": 2, "Domain": 4, "Package": 8, "PackageGroup": 16}
CAPS = {"File": 600, "Folder": 20, "Domain": 16, "Package": 15, "PackageGroup": 12}
BORDERLINE = 1.1
ANCHORED = {"lambda": 0.1, "alpha": 0.3, "beta": 0.2, "mu": 1.0, "gamma": 4.0, "delta": 0.05, "epsilon": 0.05}
GREENFIELD = ANCHORED | {"beta": 0.0, "mu": 0.0}
EVIDENCE_WEIGHTS = {
    "unique_owner": 0.10, "role_affinity": 0.10, "source_cohesion": 0.25,
    "destination_cohesion": 0.25, "producer_evidence": 0.10, "architectural_reach": 0.20,
}
QUALIFY_WEIGHTED, QUALIFY_STRUCTURAL, QUALIFY_MARGIN = 0.60, 0.50, 0.15
EXACT_VERTICES = 300
EXACT_SECONDS = 60.0
MAX_REEXPORT_HOPS = 64
RESULT_SCHEMA_VERSION = 11
IR_SCHEMA_VERSIONS = (2, 3)
EPSILON = 1e-12
