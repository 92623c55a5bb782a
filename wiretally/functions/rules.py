"""Rule dictionary, audit markers and ordered substring rules. Measurement only: none of these
feed a feature, a label of another dataset or a threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The eight named patterns of the rule baseline.
RULES = {
    "sqli": r"(union\s+select|\bor\s+1=1\b|'\s*or\s*'1'='1|information_schema|sleep\s*\(|waitfor\s+delay|--\s|;\s*drop\s+table)",
    "xss": r"(<script|onerror\s*=|onload\s*=|javascript:|<svg|<img[^>]+src|document\.cookie|alert\s*\()",
    "path_traversal": r"(\.\./|\.\.\\|%2e%2e%2f|/etc/passwd|/etc/shadow|win\.ini|boot\.ini|php://)",
    "cmd_injection": r"(;\s*(cat|ls|id|whoami|uname|nc|curl|wget)|\|\s*(id|sh|bash)|\$\(|`[^`]+`|&&\s*\w+)",
    "ssti": r"(\{\{.*?\}\}|\$\{.*?\}|<%=|#\{.*?\}|\{%.*?%\})",
    "ssrf": r"(169\.254\.169\.254|localhost|127\.0\.0\.1|metadata\.google|gopher://|dict://|file://|0\.0\.0\.0)",
    "nosql_injection": r"(\$ne\b|\$gt\b|\$where\b|\$regex\b|\$in\b|\$exists\b)",
    "scan": r"(/\.git|/\.env|/wp-admin|/phpinfo|/\.htpasswd|/actuator|/swagger|/\.aws)",
}

# Audit markers. Three dialects, one per place they are applied in.
INJECTION_MARKERS = (
    r"(union\s+select|\bor\s+1=1\b|'\s*or\s*'1'='1|<script|onerror\s*=|javascript:|"
    r"\.\./|%2e%2e%2f|/etc/passwd|;\s*(cat|ls|id|whoami)|\|\s*(id|whoami)|\$\(|`|"
    r"\{\{.*?\}\}|\$\{.*?\}|<%=|%27|%3cscript|\$ne\b|\$gt\b|\$where\b|169\.254\.169\.254|gopher://)")
ALERT_MARKERS = (
    r"(union\s+select|\bor\s+1=1\b|'\s*or\s*'1'='1|<script|onerror\s*=|javascript:|\.\./|"
    r"%2e%2e%2f|/etc/passwd|;\s*(cat|ls|id|whoami)|\|\s*(id|whoami)|\$\(|`|\{\{.*?\}\}|"
    r"\$\{.*?\}|<%=|%27|%3cscript|\$ne\b|\$gt\b|\$where\b|169\.254\.169\.254|gopher://|"
    r"/\.git|/\.env|/wp-admin|/phpinfo|etc%2fpasswd|passwd|cmd=|exec)")
DECODED_MARKERS = (
    r"(union|select\s|\bnull,null|sleep\s*\(|benchmark\(|waitfor|rlike|information_schema|"
    r"concat\(|char\(|\bor\s+1=1|'\s*or\s*'1'='1|<script|onerror|javascript:|\.\./|/etc/passwd|"
    r"\(\)\s*\{\s*:;\}|/bin/|\{\{|\$\{|<%=|;\s*(cat|ls|id|whoami)|\|\s*(id|whoami)|\$\(|`|%00|"
    r"169\.254\.169\.254|gopher://|/\.git|/\.env|wp-config|/phpinfo|cmd=|\bexec\b|passwd)")

# Unicode-aware matching in which "." stops at a line feed only.
_FLAGS = "(?iuUd)"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(_FLAGS + pattern)


def any_rule(decoded: Column) -> Column:
    """True when one or more of the named rules fires on the decoded request."""
    hit = F.lit(False)
    for pattern in RULES.values():
        hit = hit | matches(decoded, pattern)
    return hit


def rule_hits(decoded: Column) -> Column:
    """Names of the firing rules in dictionary order; null when none does."""
    fired = F.array_compact(F.array(*[
        F.when(matches(decoded, p), F.lit(name)) for name, p in RULES.items()]))
    # Named once, through a lambda: each pattern is matched once per row.
    return F.transform(F.array(fired), lambda names: F.when(F.size(names) > 0, names))[0]


def ordered_label(line: Column, rules: Sequence[tuple[str, Sequence[str]]],
                  default: str = "benign") -> Column:
    """Label of the first rule all of whose substrings occur in the lower-cased line. A ``%``
    in a substring is a wildcard of the rule file and is dropped."""
    low, chain = F.lower(line), None
    for label, substrings in rules:
        wanted = [s.replace("%", "").lower() for s in substrings if s.replace("%", "")]
        if not wanted:
            continue
        test = F.lit(True)
        for s in wanted:
            test = test & low.contains(s)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return F.lit(default) if chain is None else chain.otherwise(default)
