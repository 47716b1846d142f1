"""Rule lists, patterns, routing and pricing tables. All are defaults that an operator's caller can replace."""

CATEGORIES = ("critical", "suspicious", "routine", "noise")
PRIORITY = ("critical", "suspicious", "noise", "routine")
DEFAULT_CATEGORY, DEFAULT_CONFIDENCE = "routine", 0.5

# (category, rule, confidence, patterns), in order of priority
RULES = [
    ("critical", "malware_indicators", 0.95, [r"\b(malware|ransomware|trojan|backdoor|virus|c2 beacon)\b", r"\b(command.?and.?control|c2)\b"]),
    ("critical", "brute_force", 0.9, [r"brute.?force", r"multiple.*failed.*(auth|login)"]),
    ("critical", "data_exfiltration", 0.9, [r"data exfiltration", r"exfiltrat(ion|ing)", r"\b(uploaded.*(gb|mb)\b)"]),
    ("critical", "privilege_escalation", 0.88, [r"privilege escalation", r"sudo.*failed", r"\broot access granted\b"]),
    ("suspicious", "failed_authentication", 0.75, [r"failed.*(login|auth)", r"authentication.*failed"]),
    ("suspicious", "access_denied", 0.7, [r"access.*denied", r"permission.*denied"]),
    ("suspicious", "suspicious_commands", 0.72, [r"\b(nc|netcat|powershell|curl|wget).*\b", r"\b(base64|chmod 777|/etc/shadow)\b"]),
    ("suspicious", "lateral_movement", 0.78, [r"pass.?the.?hash", r"remote service created"]),
    ("noise", "health_checks", 0.9, [r"health.?check", r"heartbeat", r"keep.?alive"]),
    ("noise", "debug_trace", 0.85, [r"^\s*(debug|trace)", r"verbose logging enabled"]),
    ("noise", "metrics", 0.8, [r"metrics scrape", r"prometheus"]),
    ("routine", "normal_operations", 0.6, [r"\b(success|completed|started|connected)\b", r"\bservice.*(ready|running)\b"]),
]

# (rule, framework, retention days, source patterns, message patterns)
COMPLIANCE_RULES = [
    ("pci_payment_systems", "pci_dss", 365, [r"^pci[-_]", r"^payment[-_]", r"^cardholder[-_]", r"^pos[-_]", r"^card[-_]processing"], [r"card[-_]?holder", r"pan[-_]?data", r"payment[-_]?transaction", r"credit[-_]?card", r"cvv|cvc|cvn"]),
    ("pci_network_security", "pci_dss", 365, [r"^pci[-_]?firewall", r"^pci[-_]?ids", r"^pci[-_]?waf", r"^cde[-_]"], []),
    ("hipaa_phi_systems", "hipaa", 2190, [r"^hipaa[-_]", r"^ehr[-_]", r"^emr[-_]", r"^patient[-_]", r"^phi[-_]", r"^medical[-_]", r"^healthcare[-_]"], [r"patient[-_]?id", r"medical[-_]?record", r"diagnosis", r"treatment[-_]?plan", r"phi[-_]?access", r"hipaa[-_]?audit"]),
    ("sox_financial_systems", "sox", 2555, [r"^financial[-_]", r"^accounting[-_]", r"^trading[-_]", r"^sox[-_]", r"^erp[-_]", r"^audit[-_]", r"^treasury[-_]"], [r"financial[-_]?transaction", r"journal[-_]?entry", r"general[-_]?ledger", r"audit[-_]?trail", r"fiscal[-_]?close"]),
    ("gdpr_personal_data", "gdpr", 365, [r"^gdpr[-_]", r"^eu[-_]?personal", r"^pii[-_]", r"^customer[-_]?data"], [r"personal[-_]?data", r"data[-_]?subject", r"consent[-_]?", r"right[-_]?to[-_]?(erasure|forget)"]),
]

# (category, patterns) of weak labels, in order of priority, and the confidence of a match
AUTO_LABELS = [
    ("critical", 0.8, [r"(malware|virus|trojan|ransomware)", r"(brute.?force|credential.?stuff)", r"(privilege.?escalat|root.?access)", r"(data.?exfil|unauthorized.?transfer)", r"(sql.?injection|xss|rce)", r"(c2.?beacon|command.?control)"]),
    ("suspicious", 0.7, [r"(failed.?login|auth.?fail|invalid.?password)", r"(access.?denied|permission.?denied|forbidden)", r"(port.?scan|network.?probe)", r"(unusual.?activity|anomal)", r"(error|exception|fail)"]),
    ("noise", 0.8, [r"(health.?check|heartbeat|keep.?alive)", r"(debug|trace|verbose)", r"(metric|telemetry|prometheus)", r"(cron|scheduled.?task|timer)", r"(ping|status.?ok|alive)"]),
    ("routine", 0.7, [r"(success|completed|started|finished)", r"(info|notice|log)", r"(session.?created|user.?login)", r"(config.?change|update)"]),
]

SEVERITY = {"critical": 10, "suspicious": 7, "routine": 3, "noise": 1}
TITLE_SEVERITY = (("critical", 10), ("high", 8), ("medium", 6), ("low", 4), ("info", 2))

# category -> (method, destinations, batch size)
ROUTES = {
    "critical": ("immediate", ["qradar", "cold_storage"], 1),
    "suspicious": ("queue", ["qradar", "cold_storage"], 100),
    "routine": ("queue", ["cold_storage"], 500),
    "noise": ("queue", ["summary", "cold_storage"], 1000),
}

MODEL_WEIGHTS = {"rule_based": 0.30, "text_model": 0.45, "anomaly": 0.25}

# (tier, greatest EPS, annual cost)
TIERS = [("basic", 5_000, 150_000), ("standard", 15_000, 450_000), ("enterprise", 50_000, 1_200_000), ("premium", 100_000, 2_500_000)]
INFRASTRUCTURE_COST = 12_000 + 24_000 + 8_000 + 6_000 + 10_000

# metric, window, sigma, least samples
SPC_PRESETS = [("error_rate", 60, 3.0, 30), ("eps", 300, 2.5, 60), ("failed_login_rate", 30, 3.0, 15), ("processing_latency_ms", 300, 2.0, 60), ("unique_ips_per_minute", 10, 3.0, 5)]
SPC_WARMUP = 10

# phase, least samples, greatest false-negative rate, least critical recall
PHASES = [("shadow", 10_000, 0.005, 0.995), ("pilot", 50_000, 0.002, 0.998), ("gradual", 100_000, 0.001, 0.999)]

CONFIDENCE_BOUNDS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]
LATENCY_BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]
