"""Scalar column functions: clipping, logistic family, text rules, label parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float | None, high: float | None) -> Column:
    if low is not None:
        x = F.greatest(x, F.lit(float(low)))
    if high is not None:
        x = F.least(x, F.lit(float(high)))
    return x


def sigmoid(logit: Column) -> Column:
    """Logistic function with the logit held inside +-30."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(logit, -30.0, 30.0)))


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce_with_logits(logit: Column, target: Column) -> Column:
    return softplus(logit) - logit * target


def positive_or_one(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.lit(1.0))


def implied_cost(performance: Column, reward: Column, alpha: float = 0.85) -> Column:
    """Normalised cost that explains a reward, never below zero."""
    return F.greatest(F.lit(0.0), (F.lit(alpha) * performance - reward) / F.lit(1.0 - alpha))


def fixed(x: Column, digits: int) -> Column:
    """The number as text with fixed digits, a tie decided by its exact binary value.

    ``format_string`` rounds the shortest decimal form instead, which differs at ties.  Rounding
    to nine digits first takes out the noise of summing in another order, so that a text made
    from means is the same on every run.
    """
    return F.replace(F.format_number(F.round(x, 9), digits), F.lit(","), F.lit(""))


def truncate_text(text: Column, max_chars: int, marker: str = "\n[truncated]") -> Column:
    """Cut a long text and mark it; trailing white space before the marker goes."""
    if max_chars <= 0:
        return text
    head = F.regexp_replace(F.substring(text, 1, max_chars), r"(?U)\s+$", "")
    return F.when(F.length(text) > max_chars, F.concat(head, F.lit(marker))).otherwise(text)


# Fixed value: the query family whose text is nothing but an opaque task id.
ID_ONLY_PATTERN = r"^ARC-AGI Task [0-9a-fA-F]+$"


def is_id_only(text: Column, pattern: str = ID_ONLY_PATTERN) -> Column:
    """Whether the stripped text is an id of the family and nothing else."""
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return stripped.rlike(pattern.removesuffix("$") + r"\z")


# The keys a model's JSON answer may carry its choice under, in order.
ANSWER_KEYS = ("pred_model", "label", "model", "answer")


def parse_label(text: Column, allowed: Sequence[str]) -> Column:
    """Find one allowed label in a free-form answer, null when there is none.

    JSON answers come first, then an exact match, then the first allowed name
    that stands as a word of its own.
    """
    labels = F.array(*[F.lit(a) for a in allowed])
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    bare = strip(F.regexp_replace(strip(text), r"^`+|`+$", ""))
    bare = F.regexp_replace(bare, "^[\"']+|[\"']+$", "")
    checked = lambda c: F.when(F.array_contains(labels, c), c)
    document = F.when(bare.rlike(r"(?s)^\{.*\}$"), bare)
    fields = F.from_json(
        document, ", ".join(f"{key} STRING" for key in ANSWER_KEYS), {"allowSingleQuotes": "false"}
    )
    answers = [checked(strip(fields[key])) for key in ANSWER_KEYS]
    mentions = F.regexp_extract_all(bare, F.lit(r"(?U)\bModel_[A-Za-z]\b"), F.lit(0))
    mentioned = F.get(F.filter(mentions, lambda m: F.array_contains(labels, m)), F.lit(0))
    return F.coalesce(*answers, checked(bare), mentioned)
