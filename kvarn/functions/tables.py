"""Word lists, tables and patterns whose content decides results. Kept together, in plain text."""

from __future__ import annotations

#: Lines that draw: box corners and edges, edges beside a bar, rows of digits.
DRAWING_EDGES = [r"[+|]\s*[-+]{2,}", r"[-+]{2,}\s*[+|]"]
DRAWING_CORNERS = [r"\+-", r"-\+", r"\.-"]
DRAWING_DIGITS = r"^[\d\s]{10,}$"

#: Import statements by language family: pattern and the group that names what is imported.
IMPORT_PATTERNS = {
    "js": [(r"import\s+(?:[\w*{}\s,]+\s+from\s+)?['\"]([^'\"]+)['\"]", 1), (r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 1),
           (r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 1)],
    "c": [(r"#\s*include\s+[<\"]([^>\"]+)[>\"]", 1)],
    "java": [(r"(?m)^\s*import\s+([\w.]+)\s*;", 1)],
    "go": [(r"(?s)import\s+\(\s*([^)]+)\s*\)", 1), (r"import\s+(\"[^\"]+\")", 1)],
    "rs": [(r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);", 1), (r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;", 1)],
}

METADATA_KEYS = """
source source_type domain repository relative_path extension file_size_kb last_modified chunk_strategy chunk_type
chunk_name chunk_index section subsection content_type concepts ingestion_date ingestion_version rfc_number rfc_title
section_number section_title contains_diagram diagram_type rally_id ticket_id mib_module oid_path page_title space
labels author parent_page page_url version release_date section_category artifact_type state priority iteration release
created_date closed_date tags customer_type product_version related_rally syntax max_access status object_type
source_platform source_url is_resolved has_resolution has_workaround severity quality_score doc_title object_name
context_window dependencies
""".split()

CONTENT_SIGNALS = {
    "edge_case": ["edge case", "workaround", "gotcha", "corner case", "fails when", "breaks when", "known issue",
                  "known bug", "unexpected", "pitfall"],
    "algorithm": ["algorithm", "how it works", "process", "steps", "flow", "procedure", "computes", "iterates", "pseudocode"],
    "rationale": ["the reason why", "that's why we", "rationale", "design decision", "trade-off", "tradeoff",
                  "motivation for", "we chose", "was chosen because", "instead of", "the thinking behind", "decided to"],
    "glossary": ["glossary", "definition", "terminology", "is defined as", "refers to"],
    "interaction": ["depends on", "feeds into", "consumed by", "upstream", "downstream", "triggered by", "interface", "contract"],
    "constraint": ["assumption", "constraint", "limitation", "prerequisite", "must be", "cannot", "restricted", "only works"],
    "bug_report": ["bug", "defect", "regression", "crash", "root cause", "steps to reproduce", "reproduc"],
    "workaround": ["workaround", "temporary fix", "mitigation", "until fixed"],
    "howto": ["how to", "tutorial", "step by step", "getting started", "example"],
    "api": ["api", "function signature", "parameters", "returns", "class reference"],
}

DEFAULT_REGISTRY = {
    "nms": {"vlan": "vlan", "snmp": "snmp_polling"},
    "occt": {"fillet": "fillet"},
    "spice": {"transient": "transient_analysis"},
    "kicad": {"footprint": "footprint"},
    "geda": {"netlist": "netlist"},
    "general": {},
}

MODEL_TOKEN_LIMITS = {"mxbai-embed-large": 512, "nomic-embed-text": 8192}
DEFAULT_TOKEN_LIMIT = 512
MODEL_BY_DIMENSION = {1024: "mxbai-embed-large", 768: "nomic-embed-text"}

SIZE_LIMIT_MB = {"code": 5, "domain_doc": 10, "theory": 20, "config": 2, "mib": 5, "ticket": 5, "rfc": 2,
                 "release_notes": 10, "community": 5, "wiki": 10, "default": 5}
CONFIG_EXTENSIONS = ".json .yaml .yml .toml .ini .cfg .conf .properties .xml".split()

IGNORED_FOLDERS = """
.git .svn .hg node_modules build dist target __pycache__ bin obj vendor .idea .vs .vscode .venv venv .tox .eggs
.mypy_cache .pytest_cache CMakeFiles Debug Release x64 x86
""".split()
IGNORED_EXTENSIONS = """
.exe .dll .so .o .a .lib .class .jar .zip .tar .gz .7z .rar .bz2 .xz .png .jpg .jpeg .gif .svg .ico .webp .bmp .pdf
.bin .wasm .lock .pyc .pyo .pdb .woff .woff2 .ttf .eot .map .mp3 .mp4 .avi .mov .wmv .db .sqlite .sqlite3
""".split()

MIB_CONCEPTS = {
    "BRIDGE-MIB": "stp,forwarding_table",
    "IF-MIB": "interface_management",
    "Q-BRIDGE-MIB": "vlan",
    "LLDP-MIB": "lldp",
}

DIAGRAM_LABELS = {
    "graph": "Mermaid Flowchart", "flowchart": "Mermaid Flowchart", "sequencediagram": "Mermaid Sequence Diagram",
    "classdiagram": "Mermaid Class Diagram", "statediagram": "Mermaid State Diagram", "erdiagram": "Mermaid ER Diagram",
    "gantt": "Mermaid Gantt Chart", "pie": "Mermaid Pie Chart", "journey": "Mermaid User Journey",
    "gitgraph": "Mermaid Git Graph", "mindmap": "Mermaid Mind Map", "timeline": "Mermaid Timeline",
    "sankey": "Mermaid Sankey Diagram", "xychart": "Mermaid XY Chart", "@startuml": "PlantUML Diagram",
    "@startmindmap": "PlantUML Mind Map", "@startgantt": "PlantUML Gantt",
}
BARE_DIAGRAM_STARTS = (
    r"(?m)^(?:graph\s+(?:TD|TB|BT|RL|LR)|sequenceDiagram|classDiagram|stateDiagram|erDiagram|gantt|pie|flowchart|journey"
    r"|gitGraph|mindmap|timeline|quadrantChart|sankey|xychart|block-beta|packet-beta|kanban|architecture-beta)\b"
)

COLLECTION_BY_MODE = {
    "code": "{domain}_code", "domain": "{domain}_domain", "rfc": "rfc", "rally": "{domain}_internal",
    "customer": "{domain}_customer", "mib": "{domain}_mib", "wiki": "{domain}_wiki",
    "release-notes": "{domain}_releases", "theory": "theory", "community": "community",
}
SOURCE_TYPE_BY_MODE = {
    "code": "code", "domain": "domain_doc", "rfc": "rfc", "rally": "rally", "customer": "customer", "mib": "mib",
    "wiki": "wiki", "release-notes": "release_notes", "theory": "theory", "community": "community",
}

LANGUAGE_TAGS = {
    ".py": "python", ".java": "java", ".js": "javascript", ".ts": "typescript", ".tsx": "tsx", ".jsx": "jsx",
    ".cs": "csharp", ".cpp": "cpp", ".c": "c", ".go": "go", ".rs": "rust", ".rb": "ruby", ".kt": "kotlin",
    ".scala": "scala", ".sql": "sql", ".sh": "bash", ".ps1": "powershell", ".yml": "yaml", ".yaml": "yaml",
    ".json": "json", ".xml": "xml", ".html": "html", ".md": "markdown", ".proto": "protobuf",
    ".properties": "properties",
}

#: (pattern, replacement), applied in this order.
REDACTIONS = [
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(/\d{1,2})?\b", "x.x.x.x"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[email]"),
    (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[phone]"),
    (r"\b([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", "[mac]"),
    (r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.){2,}[a-zA-Z]{2,}\b", "[hostname]"),
]

CODE_BOUNDARIES = {
    ".go": [r"^\s*func\s+", r"^\s*type\s+\w+\s+struct\b"],
    ".rs": [r"^\s*(?:pub\s+)?(?:unsafe\s+)?fn\s+", r"^\s*(?:pub\s+)?struct\s+", r"^\s*(?:pub\s+)?enum\s+",
            r"^\s*(?:pub\s+)?impl\b", r"^\s*(?:pub\s+)?trait\s+"],
    ".rb": [r"^\s*class\s+", r"^\s*module\s+", r"^\s*def\s+"],
    ".kt": [r"^\s*(?:public\s+|private\s+|internal\s+|protected\s+)?(?:open\s+|abstract\s+|sealed\s+)?fun\s+",
            r"^\s*class\s+", r"^\s*object\s+", r"^\s*interface\s+"],
    ".kts": [r"^\s*fun\s+", r"^\s*class\s+", r"^\s*object\s+"],
    ".swift": [r"^\s*func\s+", r"^\s*class\s+", r"^\s*struct\s+", r"^\s*enum\s+", r"^\s*protocol\s+"],
    ".scala": [r"^\s*def\s+", r"^\s*class\s+", r"^\s*object\s+", r"^\s*trait\s+"],
    ".php": [r"^\s*function\s+", r"^\s*class\s+"],
}

REWRITE_PREFIXES = ["Here is the rewritten query:", "Here is the query:", "Rewritten query:", "Search query:", "Query:", "Here is"]

BLOCKED_COMMANDS = [
    r"\brm\s+.*-[rf]{2,}.*\s+(/|~/|/home|/etc|/usr|/var|/boot)\b",
    r"\brm\s+.*-[rf]{2,}\s+/\s*$",
    r"\brm\s+.*-[rf]{2,}\s+/\s+\S",
    r"\bsudo\s+rm\b",
    r"\bmkfs\b",
    r"\bdd\s+if=",
    r":\(\)\s*\{\s*:\s*\|\s*:\s*&\s*\}\s*;",
    r">\s*/dev/sd[a-z]",
    r"\bchmod\s+-R\s+777\s+/\s*$",
    r"\b(shutdown|reboot|init\s+0|halt|poweroff)\b",
    r"\bkill\s+-9\s+1\b",
    r"\bcurl\s+[^\n|]+\|\s*(ba)?sh\b",
    r"\bwget\s+[^\n|]+\|\s*(ba)?sh\b",
    r"\bcurl\s+[^\n|]+\|\s*sudo\b",
    r"\bpython\s+[^\n|]+\|\s*(ba)?sh\b",
]

RFC_MARKERS = ["network working group", "internet engineering task force", "request for comments", "rfc ", "independent submission"]

RELEASE_DATE = r"(?i)(?:released?|published|date)[:.\s]+(\d{4}-\d{2}-\d{2}|\d{1,2}\s+\w+\s+\d{4}|\w+\s+\d{1,2},?\s+\d{4})"
VERSION_HEADING = r"(?m)^(#{1,3}\s*v?[\d.]+[^\n]*|Version\s+[\d.]+[^\n]*|#\s*[\d.]+[^\n]*)"
MIB_OBJECT = "OBJECT-TYPE|NOTIFICATION-TYPE|MODULE-IDENTITY|TEXTUAL-CONVENTION"

#: Object types of a MIB: the first rule whose pattern is found in the kind, the name or the whole definition decides.
MIB_TYPE_RULES = [
    ("kind", "^NOTIFICATION-TYPE$", "notification"),
    ("kind", "^MODULE-IDENTITY$", "identity"),
    ("kind", "^TEXTUAL-CONVENTION$", "textual_convention"),
    ("name", "(?i)^(?!.*TABLE).*ENTRY", "row"),
    ("name", "(?i)TABLE", "table"),
    ("block", "INDEX", "table"),
    ("block", "(?is)^(?=.*SEQUENCE)(?=.*OF)", "table"),
    ("block", "(?i)AUGMENTS|COLUMN", "column"),
]
MIB_OTHER_TYPE = "scalar"

#: Metadata of a ticket, and the fields that may hold it, the first filled one counts.
TICKET_FIELDS = {
    "chunk_name": ["Name", "title"],
    "rally_id": ["FormattedID", "id"],
    "artifact_type": ["_type", "artifact_type"],
    "state": ["State", "state"],
    "priority": ["Priority", "priority"],
    "severity": ["Severity", "severity"],
    "iteration": ["Iteration"],
    "release": ["Release"],
    "created_date": ["CreationDate", "created"],
    "closed_date": ["ClosedDate", "closed"],
    "tags": ["Tags", "tags"],
}
TICKET_TEXTS = {
    "description": ["Description", "description"],
    "resolution": ["Resolution", "resolution"],
    "discussion": ["Discussion", "discussion"],
}
CUSTOMER_FIELDS = {"ticket_id": ["ticket_id", "FormattedID"], "product_version": ["product_version"], "related_rally": ["related_rally"]}

#: Signs of a release section, its category and the content type that it stands for.
RELEASE_KINDS = [
    ("known issue", "Known Issues", "edge_case"),
    ("breaking", "Breaking Changes", "constraint"),
    ("bug fix", "Bug Fixes", "general"),
    ("new feature", "New Features", "general"),
]

#: Openings of the tags by which a reply asks for a tool or ends its task.
CONTROL_TAGS = ("<tool_call", "<task_complete")
