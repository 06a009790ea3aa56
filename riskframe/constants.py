"""Fixed values and parameter presets.

Everything in the "fixed values" block must equal the behaviour being
reproduced (label maps, weights, tiers, keyword patterns, CWE groups, vendor
list). They are plain data: operators take them as arguments, these are only
the defaults.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour; do not edit casually)
# ---------------------------------------------------------------------------

# CVSS v3 code -> name maps, per metric key.
CVSS_CODE_MAPS = {
    "AV": {"N": "NETWORK", "A": "ADJACENT", "L": "LOCAL", "P": "PHYSICAL"},
    "AC": {"L": "LOW", "H": "HIGH"},
    "PR": {"N": "NONE", "L": "LOW", "H": "HIGH"},
    "UI": {"N": "NONE", "R": "REQUIRED"},
    "S": {"U": "UNCHANGED", "C": "CHANGED"},
    "C": {"N": "NONE", "L": "LOW", "H": "HIGH"},
    "I": {"N": "NONE", "L": "LOW", "H": "HIGH"},
    "A": {"N": "NONE", "L": "LOW", "H": "HIGH"},
}
# Output column for each metric key.
CVSS_FIELDS = {
    "AV": "attack_vector",
    "AC": "attack_complexity",
    "PR": "privileges_required",
    "UI": "user_interaction",
    "S": "scope",
    "C": "confidentiality_impact",
    "I": "integrity_impact",
    "A": "availability_impact",
}
# One-hot flags: (flag name, parsed field, value). has_cvss_v3 is separate.
CVSS_ONEHOT = [
    ("av_network", "attack_vector", "NETWORK"),
    ("av_adjacent", "attack_vector", "ADJACENT"),
    ("av_local", "attack_vector", "LOCAL"),
    ("av_physical", "attack_vector", "PHYSICAL"),
    ("ac_low", "attack_complexity", "LOW"),
    ("ac_high", "attack_complexity", "HIGH"),
    ("pr_none", "privileges_required", "NONE"),
    ("pr_low", "privileges_required", "LOW"),
    ("pr_high", "privileges_required", "HIGH"),
    ("ui_none", "user_interaction", "NONE"),
    ("ui_required", "user_interaction", "REQUIRED"),
    ("scope_changed", "scope", "CHANGED"),
    ("ci_none", "confidentiality_impact", "NONE"),
    ("ci_low", "confidentiality_impact", "LOW"),
    ("ci_high", "confidentiality_impact", "HIGH"),
    ("ii_none", "integrity_impact", "NONE"),
    ("ii_low", "integrity_impact", "LOW"),
    ("ii_high", "integrity_impact", "HIGH"),
    ("ai_none", "availability_impact", "NONE"),
    ("ai_low", "availability_impact", "LOW"),
    ("ai_high", "availability_impact", "HIGH"),
]

# Severity ordinals. Two scales exist: 0-4 with NONE, and 0-3 starting at LOW.
SEVERITY_0_4 = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
SEVERITY_0_3 = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
LABELS_ORDER = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

# Score -> severity cut-offs (score >= cut).
SCORE_SEVERITY_CUTS = [(9.0, "CRITICAL"), (7.0, "HIGH"), (4.0, "MEDIUM")]

# Risk score weights (sum 1.0) and severity-label -> normalised component.
RISK_WEIGHTS = {
    "cvss": 0.30,
    "kev": 0.25,
    "epss": 0.20,
    "asset_criticality": 0.15,
    "exposure": 0.07,
    "model_confidence": 0.03,
}
SEVERITY_NORM = {"NONE": 0.00, "LOW": 0.20, "MEDIUM": 0.50, "HIGH": 0.78, "CRITICAL": 1.00}
SEVERITY_NORM_UNKNOWN = 0.5

# Risk tier presets: list of (min score, tier), highest first.
RISK_TIER_PRESETS = {
    "code": [(90, "CRITICAL_RISK"), (70, "HIGH_RISK"), (40, "MEDIUM_RISK"), (0, "LOW_RISK")],
    "config": [(80, "CRITICAL_RISK"), (60, "HIGH_RISK"), (35, "MEDIUM_RISK"), (0, "LOW_RISK")],
    "docs": [(80, "CRITICAL_RISK"), (60, "HIGH_RISK"), (30, "MEDIUM_RISK"), (0, "LOW_RISK")],
}
# SLA hours per tier (config preset).
RISK_TIER_SLA_HOURS = {"CRITICAL_RISK": 24, "HIGH_RISK": 72, "MEDIUM_RISK": 336, "LOW_RISK": 720}

# Other weight presets.
RISK_WEIGHT_PRESETS = {
    "default": RISK_WEIGHTS,
    # config file: severity .35, exploitability subscore .25, kev .25, epss .15
    "four_factor": {"cvss": 0.35, "exploitability": 0.25, "kev": 0.25, "epss": 0.15},
    # five-factor contract (worked number 77.35)
    "five_factor": {"cvss": 0.30, "epss": 0.25, "kev": 0.25, "asset_criticality": 0.15, "exposure": 0.05},
}
# Largest exploitability subscore of the CVSS v3 formula (divides it to 0..1).
EXPLOITABILITY_MAX = 3.9
# Contextual multipliers (config preset).
ASSET_MULTIPLIERS = {"tier_1_mission_critical": 1.30, "tier_2_business_operational": 1.10,
                     "tier_3_internal_low": 0.80}
EXPOSURE_MULTIPLIERS = {"internet_facing": 1.25, "internal_network": 0.90, "air_gapped": 0.60}
# Exposure category -> score (dashboard).
EXPOSURE_SCORES = {"INTERNET_FACING": 1.0, "INTERNAL_RESTRICTED": 0.5}
EXPOSURE_SCORE_OTHER = 0.2

# Exploitation-forecast tiers (probability >= cut) and horizon flags.
EXPLOIT_TIERS = [(0.70, "IMMINENT_EXPLOITATION"), (0.40, "HIGH_EXPLOITATION_RISK"),
                 (0.15, "MODERATE_EXPLOITATION_RISK")]
EXPLOIT_TIER_OTHER = "LOW_EXPLOITATION_RISK"
EXPLOIT_FLAG_30D = 0.50
EXPLOIT_FLAG_90D = 0.35

# Keyword patterns over description text (case-insensitive, word-bounded).
KEYWORD_PATTERNS = {
    "has_rce_keyword": r"\b(remote.?code.?exec|rce|arbitrary.?code|command.?exec|code.?injection)\b",
    "has_sqli_keyword": r"\b(sql.?inject|sqli|database.?inject)\b",
    "has_xss_keyword": r"\b(cross.?site.?script|xss|stored.?xss|reflected.?xss)\b",
    "has_overflow_keyword": r"\b(buffer.?overflow|stack.?overflow|heap.?overflow|integer.?overflow|memory.?corrupt|use.?after.?free|double.?free)\b",
    "has_auth_bypass_keyword": r"\b(auth.?bypass|authentication.?bypass|bypass.?auth|unauthenticated|improper.?auth|session.?fixation)\b",
    "has_priv_esc_keyword": r"\b(privilege.?escal|priv.?esc|local.?priv|gain.?privilege|elevat.?privilege|root.?access)\b",
    "has_dos_keyword": r"\b(denial.?of.?service|dos|infinite.?loop|crash|hung|hang|resource.?exhaust)\b",
    "has_traversal_keyword": r"\b(path.?traversal|directory.?traversal|arbitrary.?file|file.?read)\b",
    "has_ssrf_keyword": r"\b(server.?side.?request.?forgery|ssrf)\b",
    "has_info_leak_keyword": r"\b(information.?disclosure|information.?leak|sensitive.?data|leak.?memory)\b",
}

# CWE groups.
CWE_GROUPS = {
    "is_memory_safety_cwe": ["CWE-119", "CWE-120", "CWE-121", "CWE-122", "CWE-125", "CWE-126",
                             "CWE-127", "CWE-415", "CWE-416", "CWE-787", "CWE-788", "CWE-824",
                             "CWE-476"],
    "is_injection_cwe": ["CWE-77", "CWE-78", "CWE-79", "CWE-89", "CWE-90", "CWE-91", "CWE-94",
                         "CWE-95", "CWE-96", "CWE-113", "CWE-917", "CWE-943"],
    "is_auth_cwe": ["CWE-287", "CWE-288", "CWE-290", "CWE-294", "CWE-295", "CWE-306", "CWE-307",
                    "CWE-384", "CWE-522", "CWE-798"],
    "is_config_cwe": ["CWE-16", "CWE-183", "CWE-185", "CWE-200", "CWE-209", "CWE-250", "CWE-276",
                      "CWE-732", "CWE-749"],
    "is_crypto_cwe": ["CWE-310", "CWE-311", "CWE-326", "CWE-327", "CWE-330", "CWE-338"],
    "is_privilege_cwe": ["CWE-264", "CWE-269", "CWE-272", "CWE-274", "CWE-732"],
}

# Vendors recognised by substring.
TOP_VENDORS = ["microsoft", "apple", "google", "cisco", "linux", "oracle", "apache", "adobe",
               "ibm", "vmware", "redhat", "mozilla"]

# Reference-URL words.
PATCH_WORDS = ["patch", "advisory", "commit", "update", "fix", "security"]
EXPLOIT_WORDS = ["exploit", "poc", "metasploit", "exploit-db", "packetstorm"]

# Temporal feature defaults and recency window.
TEMPORAL_DEFAULTS = {"days_since_published": 0, "quarter_published": 1, "year_published": 2024, "is_recent": 0}
RECENT_DAYS = 90

# Columns that must never be features (label / post-publication).
LEAKAGE_COLUMNS = ["cve_id", "severity_label", "severity_numeric", "base_severity", "base_score",
                   "cvss_score", "cvss_severity", "epss_score", "epss_percentile", "in_cisa_kev",
                   "feature_version"]

# Quality gate defaults (missing metric -> listed default).
GATE_THRESHOLDS = {
    "min_macro_f1": 0.70,
    "min_critical_recall": 0.85,
    "max_ece": 0.10,
    "max_latency_p99_ms": 500.0,
    "champion_improvement_margin": 0.01,
    "min_n_test_samples": 100,
}
GATE_MISSING_DEFAULTS = {"macro_f1": 0.0, "critical_recall": 0.0, "ece": 1.0,
                         "latency_p99_ms": 0.0, "n_test_samples": 0}
CHAMPION_METRICS = ["macro_f1", "weighted_f1", "critical_recall", "high_recall", "roc_auc", "ece",
                    "balanced_accuracy", "latency_p99_ms"]
LOWER_IS_BETTER = ["ece", "latency_p99_ms"]

# Drift defaults.
DRIFT_SIGNIFICANCE = 0.05
PSI_THRESHOLD = 0.2
DRIFT_SHARE_THRESHOLD = 0.25
CENTROID_COSINE_THRESHOLD = 0.15
PSI_ZERO_FILL = 0.0001
KS_MIN_ROWS = 10
PSI_KEY_ALERT = 0.20

# Keyword-rule baseline (class ids on the 0-3 scale) and its probabilities.
RULE_CRITICAL_FLAGS = ["has_rce_keyword", "has_overflow_keyword", "has_auth_bypass_keyword"]
RULE_HIGH_FLAGS = ["has_sqli_keyword", "has_priv_esc_keyword", "is_injection_cwe"]
RULE_MEDIUM_FLAGS = ["has_xss_keyword", "has_traversal_keyword", "has_info_leak_keyword"]
RULE_HIT_PROB = 0.85
RULE_MISS_PROB = 0.05

# Text-estimate of severity component (dashboard fallback).
TEXT_SEVERITY_WORDS = [(["remote code", "rce", "arbitrary code"], 1.0), (["sql", "bypass", "privilege"], 0.8)]
TEXT_SEVERITY_DEFAULT = 0.5

# Alerting.
LATENCY_P95_ALERT_MS = 200.0

# Placeholders treated as missing vendor / CWE for display.
VENDOR_PLACEHOLDERS = ["nan", "none", "n/a", "enterprise vendor"]
CWE_PLACEHOLDERS = ["nan", "none", "n/a"]
CWE_NOT_SPECIFIC = ["CWE-noinfo", "CWE-Other"]
DEFAULT_VENDOR = "Enterprise Vendor"
DEFAULT_CWE = "CWE-20"

# Point-lookup default row (unknown id).
LOOKUP_DEFAULTS = {"description": "Dynamic vulnerability record retrieved from platform sync.", "severity": "HIGH",
                   "cvss_score": 7.5, "cisa_kev": False, "epss_score": 0.35, "vendor": "N/A", "cwe": "CWE-99"}

# Fallback class probabilities (LOW, MEDIUM, HIGH, CRITICAL) without a trained model.
TEXT_FALLBACK_PROBS = [
    (["remote code", "rce", "arbitrary code", "buffer overflow"], [0.02, 0.08, 0.25, 0.65]),
    (["sql inject", "privilege escal", "unauthenticated"], [0.05, 0.15, 0.65, 0.15]),
    (["cross-site script", "xss", "traversal"], [0.10, 0.65, 0.20, 0.05]),
]
TEXT_FALLBACK_DEFAULT = [0.40, 0.40, 0.15, 0.05]
SCORE_FALLBACK_PROBS = {"exploited_or_above_0_8": [0.02, 0.08, 0.25, 0.65], "above_0_4": [0.05, 0.15, 0.65, 0.15],
                        "other": [0.25, 0.45, 0.25, 0.05]}

# Alert risk score: fixed asset 0.9, exposure 1.0, confidence 0.95; SLA text by score.
ALERT_ASSET, ALERT_EXPOSURE, ALERT_CONFIDENCE = 0.9, 1.0, 0.95
ALERT_SLA = [(80, "24 Hours (URGENT)"), (60, "72 Hours")]
ALERT_SLA_OTHER = "14 Days"


# The English stop words of Spark ML's StopWordsRemover, in its own order.
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is
are was were be been being have has had having do does did doing a an the and but if or because as until
while of at by for with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don should now
i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split())

# Record id format, severity labels and feature names that leak the label.
CVE_ID_REGEX = r"^CVE-\d{4}-\d{4,}$"
SEVERITY_VALUES = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL", ""]
FORBIDDEN_FEATURES = ["base_score", "base_severity", "exploitability_score", "impact_score",
                      "cvss_v2_score", "cvss_v2_severity", "severity_label"]
