"""Typed constants of the gate, the rankings and the tiers; every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Prefixes of episode names. Two distinct tests exist: with and without the trailing dash.
CANONICAL_PREFIX, CAPSULE_PREFIX = "canonical-", "capsule-"


@dataclass(frozen=True)
class GateConfig:
    """Rules of the admission gate. Fixed values of the scoring table."""

    types: tuple[str, ...] = ("decision", "bugfix", "feature", "refactor", "discovery", "change", "security_alert", "security_note")
    least_narrative: int = 80
    substantive_narrative: int = 300
    least_facts_or_files: int = 1
    rejected_models: tuple[str, ...] = ("fallback", "template", "none")
    type_weight: dict[str, float] = field(default_factory=lambda: {"decision": 100, "bugfix": 90, "security_alert": 100, "security_note": 70, "feature": 80, "refactor": 60, "discovery": 20, "change": 15, "note": 5})
    thresholds: dict[str, float] = field(default_factory=lambda: {"cursor": 80, "claude": 60, "codex": 60})
    default_threshold: float = 60
    quotas: dict[str, int] = field(default_factory=lambda: {"cursor": 50})
    default_quota: int = 200
    skip_threshold: tuple[str, ...] = ("decision", "bugfix", "security_alert", "security_note")
    skip_quota: tuple[str, ...] = ("decision", "bugfix", "security_alert")
    noise_enabled: bool = False
    #: What names the system itself and its running; both are its owner's to give.
    noise_markers: tuple[str, ...] = ()
    noise_keywords: tuple[str, ...] = ()
    noise_hits: int = 2
    noise_penalty: float = 100
    noise_least_score: float = 120
    shadow: bool = False


#: Delivery weights by type, others weigh 1, and the three groups of types. Fixed values.
TIER_WEIGHTS = {"decision": 1.6, "security_note": 1.6, "security_alert": 1.6, "discovery": 1.0, "feature": 0.7, "refactor": 0.7, "bugfix": 0.6, "change": 0.6}
#: Weight of an item about the system's own running. Fixed value.
NOISE_WEIGHT = 0.2
KNOWLEDGE_TYPES = ("decision", "security_note", "security_alert")
OPERATIONAL_TYPES = ("bugfix", "change", "feature", "refactor")
DISCOVERY_TYPES = ("discovery",)
#: Search scoring. Fixed values.
EXACT_BONUS, EXTERNAL_PENALTY, STALE_PENALTY, VERIFIED_BONUS, USAGE_STEP, USAGE_CAP = 0.15, 0.12, 0.08, 0.08, 0.01, 10
FRESH_DAYS, FRESH_BONUS, OLD_DAYS, OLD_PENALTY = 30, 0.05, 365, 0.03
SCOPE_BONUS, SCOPE_PENALTY = 0.5, -0.3
#: BM25 constants of our own full-text definition.
K1, B = 1.2, 0.75
#: Names of edges. Fixed values.
CANONICAL_EDGES = ("caused_by", "fixed_by", "verified_by", "references", "modified", "depends_on", "supersedes", "derived_from", "occurred_in", "belongs_to", "extracted_from", "relates_to", "documented_in", "diagnosed_by", "implemented_as")
#: Legal edge names by (source kind, target kind); between two untyped entities every canonical edge is legal. Fixed values.
LEGAL_EDGES = {
    ("Issue", "Concept"): ("caused_by",),
    ("Issue", "Issue"): ("caused_by",),
    ("Issue", "Fix"): ("fixed_by",),
    ("Issue", "Capsule"): ("diagnosed_by",),
    ("Fix", "Observation"): ("verified_by",),
    ("Fix", "Capsule"): ("verified_by",),
    ("Fix", "Fix"): ("supersedes",),
    ("Capsule", "Fix"): ("implemented_as",),
    ("Capsule", "Session"): ("extracted_from",),
    ("Capsule", "Capsule"): ("relates_to",),
    ("Concept", "KnowledgeDoc"): ("documented_in",),
    ("Concept", "Observation"): ("derived_from",),
    ("Lesson", "Issue"): ("derived_from",),
    ("Tool", "Tool"): ("depends_on",),
    ("Tool", "Config"): ("depends_on",),
    ("Observation", "File"): ("references", "modified"),
    ("Observation", "Concept"): ("references",),
    ("Observation", "Session"): ("occurred_in",),
    ("Session", "Project"): ("belongs_to",),
    ("File", "Project"): ("belongs_to",),
    ("Entity", "Entity"): CANONICAL_EDGES,
}
#: Kinds by declared type, with confidence. Fixed values; kinds are stored verbatim.
TYPE_KIND = {"decision": ("决策", 0.85), "bugfix": ("事故", 0.82), "security_note": ("事故", 0.72), "feature": ("项目事实", 0.8), "refactor": ("项目事实", 0.8), "change": ("项目事实", 0.78), "discovery": ("项目事实", 0.7)}
CANONICAL_KIND = ("手册", 0.9)
UNCLASSIFIED = "unclassified"
#: Fixed word lists of the classifiers.
TIME_BOUND = "行情|快照|日报|晚报|早报|金价|黄金|大盘|收盘|盘前|盘后|阅读量|流量|investment-watch|gold-market|daily-extract|advisory"
COMMUNITY = ("小红书", "知乎", "微博", "b站", "bilibili", "reddit", "推特", "twitter", "xhs", "social-search")
CATALOG = "(?i)registry|catalog|inventory|注册表|清单|索引|目录"
CONCLUSION = "一句话|结论|洞察|关键认知|教训|原则|规律|为什么"
#: File buckets and session markers of the scenario rules. Fixed word lists.
EXTENSIONS = {
    "code": ("py", "go", "ts", "tsx", "js", "jsx", "java", "kt", "rs", "c", "cc", "cpp", "h", "hpp", "rb", "php", "swift", "scala", "sql", "sh", "vue", "m"),
    "doc": ("md", "markdown", "rst", "txt", "adoc"),
    "config": ("yaml", "yml", "toml", "ini", "conf", "cfg", "env", "properties"),
    "asset": ("png", "jpg", "jpeg", "gif", "svg", "pdf", "ico", "webp", "mp4"),
}
CONFIG_NAMES = r"(?i)\b(dockerfile|docker-compose\.yml|makefile)\b"
CODE_TYPES = ("feature", "bugfix", "refactor", "change")
OPS_MARKERS = ("告警", "incident", "故障", "部署", "deploy", "nacos", "容器", "restart", "重启", "回滚", "rollback", "sls", "日志查询")
RESEARCH_MARKERS = ("调研", "research", "对比", "评估", "方案", "文档", "search", "查阅")
#: Phrases of facts that tell of the document instead of the matter. Fixed values.
METADATA_PHRASES = ("documents that", "was extracted from", "belongs to the", "references the")
#: Path parts that name no project. Fixed word list.
SYSTEM_DIRS = ("tmp", "var", "etc", "usr", "lib", "bin", "opt", "root", "home", "Users", "mac", "private", "sbin", "dev", "boot", "sys", "proc", "Applications", "Library", "System", "Volumes", "Network", "Desktop", "Documents", "Downloads", "Pictures", "Movies", "Music")
#: Scenarios. Fixed values.
SCENARIOS = ("coding", "ops", "writing", "research", "planning", "unknown")
