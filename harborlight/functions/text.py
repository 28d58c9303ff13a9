"""Text checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlight.functions.numeric import round_to

# Patterns of attempts to override instructions, and their names.
# They are tried in this order; the first one found names the attempt.
INJECTION_PATTERNS = [
    (r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?", "instruction override"),
    (r"(?i)forget\s+(?:all\s+)?(?:previous|prior|above)\s+(?:instructions?|context)", "context wipe"),
    (r"(?i)you\s+are\s+now\s+(?:a\s+)?(?:different|new|another|evil|unrestricted)", "role override"),
    (r"(?i)disregard\s+(?:your\s+)?(?:previous\s+|prior\s+)?(?:system\s+)?(?:instructions?|prompt)",
     "system prompt override"),
    (r"(?i)<\s*/?(?:system|instruction|prompt|override)\s*>", "XML/HTML tag injection"),
    (r"(?i)\[INST\]|\[\/INST\]|<\|im_start\|>|<\|im_end\|>", "model-delimiter injection"),
    (r"(?i)act\s+as\s+(?:if\s+you\s+are\s+)?(?:jailbroken|unrestricted|dan|evil)", "jailbreak attempt"),
    (r"(?i)print\s+(?:your\s+)?(?:system\s+prompt|instructions?|api\s+key)", "secret extraction attempt"),
]

# Words that show an answer proposes something to do.
ACTION_WORDS = [
    "recommend", "action", "priority", "immediate", "route", "supplier",
    "delay", "risk", "mitigate", "escalate", "alternative",
]

# Control characters that are taken out, and marks of a structured answer.
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
STRUCTURE_MARKS = ["1.", "2.", "•", "-", "*"]


def injection_label(text: Column) -> Column:
    """Name of the first pattern found in the text; empty if none is."""
    label = F.lit("")
    for pattern, name in reversed(INJECTION_PATTERNS):
        label = F.when(F.rlike(text, F.lit(pattern)), name).otherwise(label)
    return F.when(text.isNull(), "").otherwise(label)


def sanitize(text: Column, max_length: int = 4000) -> Column:
    """Control characters out (line breaks and tabs stay); long text cut and marked."""
    clean = F.regexp_replace(text, CONTROL_CHARS, "")
    return F.when(
        F.length(clean) > max_length,
        F.concat(F.substring(clean, 1, max_length), F.lit("...[truncated]")),
    ).otherwise(clean)


def response_quality(text: Column) -> Column:
    """0 to 1 for length, words that propose action, structure and numbers."""
    size = F.length(text)
    low = F.lower(text)
    length_part = F.when(size.between(200, 2000), 0.3).when(size > 100, 0.15).otherwise(0.0)
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in ACTION_WORDS), F.lit(0))
    word_part = F.least(hits * F.lit(0.05), F.lit(0.3))
    marked = F.lit(False)
    for mark in STRUCTURE_MARKS:
        marked = marked | F.contains(text, F.lit(mark))
    structure = F.when(marked, 0.2).otherwise(0.0)
    numbers = F.when(F.rlike(text, F.lit(r"\d")), 0.2).otherwise(0.0)
    score = F.least(round_to(length_part + word_part + structure + numbers, 3), F.lit(1.0))
    return F.when(text.isNull() | (size < 50), 0.0).otherwise(score)
