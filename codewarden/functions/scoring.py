"""Severity order, weights and scores (SQL expression text)."""

from __future__ import annotations

from codewarden.functions.sql import array, case, q

# Severity order, penalty weights per score, confidence bands and their advice.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
DRIFT_WEIGHTS = {"critical": 10.0, "high": 5.0, "medium": 3.0, "low": 1.0, "info": 0.5}
AUDIT_WEIGHTS = {"critical": 20, "high": 10, "medium": 5, "low": 2}
RULE_WEIGHTS = {"critical": 20, "high": 10, "medium": 5, "low": 2, "info": 1}
LIKELY_AI = 0.6
ADVICE = [
    (0.8, "This code appears to be AI-generated with high confidence. Consider adding human review "
          "comments and ensuring it follows organizational standards."),
    (0.6, "This code shows patterns consistent with AI generation. Review for adherence to coding "
          "standards and add appropriate documentation."),
    (0.4, "Some AI-typical patterns detected. Verify the code follows established patterns and "
          "conventions."),
]
NO_ADVICE = "No strong indicators of AI generation detected."


def severity_rank(severity: str) -> str:
    """4 for critical down to 0 for info and anything unknown."""
    return case([(f"{severity} = '{s}'", str(4 - i)) for i, s in enumerate(SEVERITIES[:-1])], "0")


def weight(severity: str, weights: dict) -> str:
    zero = "0.0D" if isinstance(next(iter(weights.values())), float) else "0"
    return case([(f"{severity} = '{s}'", q(w)) for s, w in weights.items()], zero)


def array_penalty(violations: str, weights: dict) -> str:
    """Summed weights of a violation array, in the row."""
    zero = "0.0D" if isinstance(next(iter(weights.values())), float) else "0"
    return f"aggregate({violations}, {zero}, (acc, v) -> acc + {weight('v.severity', weights)})"


def score(penalty: str) -> str:
    return f"greatest(0, 100 - least({penalty}, 100))"


def drift_score(violations: str) -> str:
    return f"cast({score(array_penalty(violations, DRIFT_WEIGHTS) + ' * 2')} AS double)"


def rule_score(violations: str) -> str:
    return score(array_penalty(violations, RULE_WEIGHTS))


def audit_score(violations: str) -> str:
    return score(array_penalty(violations, AUDIT_WEIGHTS))


def highest_severity(violations: str) -> str:
    top = f"aggregate({violations}, 0, (acc, v) -> greatest(acc, {severity_rank('v.severity')}))"
    return f"get({array(reversed(SEVERITIES))}, {top})"


def round_half_up(value: str) -> str:
    return f"floor({value} + 0.5D)"


def advice(confidence: str) -> str:
    return case([(f"{confidence} >= {q(b)}", q(text)) for b, text in ADVICE], q(NO_ADVICE))
