"""Values that results depend on and that must be what they are: weights, word
lists, patterns, names. All in this module are fixed values."""

from __future__ import annotations

# Weights of severities in hotspots; any other severity weighs 1.
SEVERITY_WEIGHTS = {"critical": 10.0, "high": 6.0, "medium": 3.0, "low": 1.0, "info": 0.25}
# Penalties of the health score, and its scale a file.
SEVERITY_PENALTIES = {"critical": 25.0, "high": 10.0, "medium": 4.0, "low": 1.5}
TYPE_PENALTIES = {"duplicate_block": 0.8, "unused_code": 0.4, "quality_issue": 0.3}
PENALTY_PER_FILE = 15.0

# Similarity, ranking weight and least similarity of clone types.
CLONE_BASE = {"exact": 1.0, "hybrid": 0.95, "structural": 0.9, "semantic": 0.85}
CLONE_WEIGHT = {"exact": 1.0, "hybrid": 0.95, "structural": 0.9, "semantic": 0.8}
CLONE_THRESHOLD = {"exact": 0.95, "hybrid": 0.85, "structural": 0.85, "semantic": 0.75}
CLONE_CHANNELS = {"exact": "exact", "hybrid": "normalized,structural", "structural": "structural", "semantic": "normalized"}
# Kinds of blocks by how they raise feasibility.
BODY_BLOCKS = ("function_body", "method_body")
FLOW_BLOCKS = ("if", "for", "while", "try", "with", "if_block", "for_loop", "while_loop", "try_block", "with_block")

# Weights of the similarity channels.
CHANNEL_WEIGHTS = {"ast": 0.30, "token": 0.20, "signature": 0.15, "dependency": 0.15, "literal": 0.10, "name": 0.10}
# Pairs of opposite words, suffixes of variants, prefixes of predicates.
ANTONYMS = (
    ("enable", "disable"), ("start", "stop"), ("open", "close"), ("create", "delete"), ("add", "remove"), ("inc", "dec"), ("begin", "end"), ("enter", "exit"), ("connect", "disconnect"),
    ("lock", "unlock"), ("show", "hide"), ("on", "off"), ("get", "set"), ("import", "export"), ("load", "save"), ("push", "pop"), ("put", "take"), ("send", "receive"), ("encode", "decode"),
    ("compress", "decompress"), ("serialize", "deserialize"), ("pack", "unpack"),
)
VARIANTS = ("_no_signal", "_strict", "_unsafe", "_legacy", "_fast", "_slow", "_v2")
MODAL_PREFIXES = ("can_", "is_", "has_")
# Modules proposed for categories.
TARGET_MODULES = {"parsing": "unified/parsers.py", "validation": "unified/validators.py", "telemetry": "unified/telemetry.py", "persistence": "unified/storage.py", "orchestration": "unified/orchestration.py"}
# Parts of a cluster's benefit, and the order of plans.
RECOMMENDATION_BENEFIT = {"MERGE": 5.0, "EXTRACT_BASE": 3.0, "WRAP_ONLY": 1.0}
RISK_BENEFIT = {"LOW": 3.0, "MEDIUM": 1.0}
EFFORT_BENEFIT = {"XS": 5.0, "S": 4.0, "M": 2.0, "L": 1.0, "XL": 0.0}
RISK_ORDER = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}
EFFORT_ORDER = {"XS": 0, "S": 1, "M": 2, "L": 3, "XL": 4}

# Words in names that tell a symbol's category, in order; else business_logic.
NAME_CATEGORIES = {"validation": ("test", "check", "verify", "validate"), "transformation": ("transform", "convert", "parse"), "persistence": ("save", "load", "store", "db"), "access": ("get", "set", "is")}
# Words in names that tell a method's responsibility, in order (M9).
RESPONSIBILITIES = {
    "data": ("load", "save", "read", "write", "parse", "serialize", "deserialize"),
    "validation": ("validate", "check", "verify", "ensure", "assert"),
    "calculation": ("calculate", "compute", "process", "transform", "convert"),
    "communication": ("send", "receive", "request", "response", "notify"),
    "formatting": ("format", "render", "display", "print", "show"),
    "logging": ("log", "debug", "info", "warn", "error"),
    "configuration": ("config", "setting", "option", "parameter"),
    "caching": ("cache", "store", "retrieve", "invalidate"),
    "security": ("authenticate", "authorize", "encrypt", "decrypt", "hash"),
    "workflow": ("start", "stop", "pause", "resume", "execute", "run"),
}
# What speaks for a context of persistence, serialization or telemetry.
PERSISTENCE = {"imports": ("sqlite3", "psycopg2", "redis", "pymongo", "sqlalchemy"), "calls": ("execute", "commit", "rollback", "query", "insert", "update", "delete"), "literals": ("select", "insert", "update", "delete", "create table", "drop table")}
SERIALIZATION = {"imports": ("json", "yaml", "pickle", "xml", "csv", "msgpack"), "calls": ("dumps", "loads", "dump", "load", "encode", "decode"), "literals": ("json", "yaml", "xml", "csv")}
TELEMETRY_PARTS = ("logging.", "logger.", "getLogger", "basicConfig", ".debug", ".info", ".warning", ".error", ".exception", ".critical")
TELEMETRY_NAMES = ("debug", "info", "warning", "error", "exception", "critical", "log")
REGEX_SIGNS = ("[", "]", "\\b", "\\d", "\\w", "\\s", ".*", ".+", ".?", "^", "$", "|")
SQL_WORDS = ("select", "insert", "update", "delete", "from", "where")
URL_SCHEMES = ("http://", "https://", "ftp://")
LITERAL_DOMAINS = {
    "strategy": ("domain", "strategy"), "attack": ("domain", "attack"), "bypass": ("domain", "bypass"), "config": ("configuration", "settings"), "settings": ("configuration", "settings"),
    "cache": ("caching", "storage"), "session": ("session", "management"), "auth": ("security", "authentication"), "jwt": ("security", "token"), "bearer": ("security", "token"),
    "access_token": ("security", "token"), "refresh_token": ("security", "token"), "password": ("security", "credential"), "credential": ("security", "credential"),
    "database": ("persistence", "database"), "sql": ("persistence", "sql"), "query": ("persistence", "query"),
}
# Signs of dynamic use in sources, and of imports by name; how many count a file.
DYNAMIC_USES = (r"getattr\s*\(", r"hasattr\s*\(", r"setattr\s*\(", r"importlib\.", r"__import__\s*\(", r"eval\s*\(", r"exec\s*\(", r"globals\s*\(\)", r"locals\s*\(\)")
DYNAMIC_IMPORTS = (
    r"importlib\.import_module\s*\(\s*[\"']([^\"']*)[\"']", r"__import__\s*\(\s*[\"']([^\"']*)[\"']", r"importlib\.util\.spec_from_file_location\s*\(\s*[\"']([^\"']*)[\"']", r"importlib\.load\s*\(\s*[\"']([^\"']*)[\"']",
)
MOST_DYNAMIC_SIGNS = 50

# Kinds of decisions for clone strategies and for smells.
CLONE_DECISIONS = {"extract_method": "extract_method", "extract_function": "extract_method", "extract_class": "extract_class", "parameterize": "parameterize_duplicates", "template_method": "template_method_pattern"}
SMELL_DECISIONS = {"god_class": "decompose_god_class", "long_method": "extract_method", "high_complexity": "reduce_method_complexity", "srp_violation": "extract_class", "feature_envy": "reduce_coupling", "inappropriate_intimacy": "reduce_coupling"}
# Weights of the criteria of a decision.
CRITERIA = {"code_quality": 0.30, "performance": 0.20, "architecture": 0.25, "risk": 0.15, "effort": 0.10}

# Points of the pipeline at which hooks may be set (V3).
HOOK_POINTS = (
    "pre_project_analysis", "post_project_analysis", "pre_file_analysis", "post_file_analysis", "pre_refactoring", "post_refactoring", "pre_opportunity_detection", "post_opportunity_detection",
    "pre_knowledge_extraction", "post_knowledge_extraction", "pre_knowledge_query", "post_knowledge_query", "pre_validation", "post_validation", "pre_workflow", "post_workflow",
)
# Folders that the index leaves out, and those that file discovery leaves out.
INDEX_SKIPPED = (".git", ".hg", ".svn", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache")
DISCOVERY_SKIPPED = (".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__", "build", "dist", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox", "node_modules")
DISCOVERY_EXCLUDED = ("*.pyc", "*.pyo", "*.pyd", "*.so", "*.dll", "*.egg", ".*")

# Operations that categories, markers, side effects and names tell.
CATEGORY_OPERATIONS = {"validation": ("validate",), "transformation": ("transform",), "persistence": ("load", "save"), "computation": ("compute",)}
MARKER_OPERATIONS = {"validation": "validate", "data_access": "fetch", "business_logic": "process", "formatting": "format", "persistence": "store"}
EFFECT_OPERATIONS = {"file_io": ("read", "write"), "network": ("fetch", "send"), "state_modification": ("modify",)}
NAME_OPERATIONS = ((("transform", "convert"), "transform"), (("process",), "process"), (("save", "store"), "store"), (("load", "get", "fetch"), "fetch"), (("format",), "format"))
# Advice for matches by type and score (C17).
MERGE_ADVICE = {
    "structural": ("Extract common method - methods are nearly identical", "Partial merge - extract common parts into shared utility"),
    "functional": ("Create template method - same functionality with parameter differences", "Parameterize differences - extract common logic with parameters"),
    "behavioral": ("Unify behavior - methods have same responsibilities", "Create shared interface - methods have similar behavior patterns"),
    "hybrid": ("Full merge candidate - methods are highly similar across multiple dimensions", "Partial merge - extract common parts into shared utility"),
}
MERGE_REST = ("Consider refactoring - methods share significant similarities", "Monitor for patterns - methods have some similarities worth tracking")
# Weights of an analysis's components (M20); words of edge cases in tests.
COMPONENT_WEIGHTS = {
    "call_graph": 15.0, "external_callers": 15.0, "behavioral_contracts": 15.0, "dependency_interfaces": 15.0, "cohesion_matrix": 10.0, "test_discovery": 10.0, "characterization_tests": 10.0,
    "duplicate_fragments": 5.0, "git_patterns": 3.0, "impact_assessment": 2.0,
}
EDGE_WORDS = ("edge", "none", "null", "empty", "zero", "negative", "min", "max", "invalid")
# Words that normalising a source keeps.
SOURCE_WORDS = (
    "if", "else", "elif", "for", "while", "try", "except", "finally", "def", "class", "return", "yield", "import", "from", "as", "True", "False", "None", "and", "or", "not", "in", "is",
    "print", "len", "str", "int", "float", "list", "dict", "set", "STRING_LITERAL", "NUMBER_LITERAL",
)
