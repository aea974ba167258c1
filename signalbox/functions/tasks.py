"""Task labels from text: two first-match cascades of patterns, JVM side throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The nine task labels and the pattern of each, in order of precedence.
# (?iU) makes \b, \w and case folding Unicode-aware.
TASK_PATTERNS = {
    "coding": (
        r"(?iUm)```|<code>|<issue>|traceback|diff --git|\b(def|class|import|function)\b|"
        r"\b(pytest|github|bug|exception|error|leetcode|codeforces|atcoder)\b|"
        r"sample input|sample output|constraints\s*\n"
    ),
    "math": (
        r"(?iU)\\frac|\\sqrt|\\sum|\\int|\$|\b(prove|solve|equation|integer|prime|"
        r"probability|triangle|matrix|derivative|integral|geometry|algebra)\b"
    ),
    "multilingual": r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]",
    "science": (
        r"(?iU)\b(physics|chemistry|biology|molecule|protein|gene|cell|disease|"
        r"reaction|velocity|force|pressure|temperature|organism|experiment)\b"
    ),
    "factual_qa": r"(?iU)^\s*(who|what|when|where|which|how many|how much|in what|why)\b",
    "creative_language": (
        r"(?iU)\b(write|rewrite|summarize|summary|story|poem|haiku|creative|compose|"
        r"translate|tone|style|email|essay)\b"
    ),
    "agentic": (
        r"(?iU)\b(order|cancel|refund|return|tracking|booking|reservation|profile|"
        r"cart|customer|agent|tool|api call|function call)\b"
    ),
    "reasoning": (
        r"(?iU)\b(riddle|logic puzzle|deduce|infer|correct order|arrange|constraint|"
        r"reason step by step|which statement)\b"
    ),
}
TASK_NAMES = (*TASK_PATTERNS, "general")


def task_label(text: Column) -> Column:
    """One of ``TASK_NAMES``; the first pattern found decides."""
    lowered = F.lower(text)
    cascade = None
    for label, pattern in TASK_PATTERNS.items():
        hit = text.rlike(pattern)
        if label == "reasoning":
            hit = hit | (lowered.contains("step by step") & ~lowered.contains("explain"))
        cascade = F.when(hit, label) if cascade is None else cascade.when(hit, label)
    return cascade.otherwise("general")


# Patterns and word lists of the two-level profile, in order of precedence.
FAMILY_TASK = r"(?iU)^\s*ARC-AGI Task\b"
REPOSITORY_ISSUE = (
    r"(?iUm)<issue>|<code>|partial code base|traceback|\bdiff --git\b|\bpytest\b|"
    r"\bgithub\b|\bbug\b|\bregression\b|\bexception\b|\berror\b"
)
COMPETITIVE_PROGRAMMING = (
    r"(?iUm)Sample Input|Sample Output|\bInput\s*\n|\bOutput\s*\n|Constraints\s*\n|"
    r"Standard Input|AtCoder|Codeforces"
)
CODE_GENERATION = (
    r"(?iUm)```|\bdef\s+\w+\s*\(|\bclass\s+\w+|\bimport\s+\w+|"
    r"\bpublic\s+class\b|\bfunction\s+\w+"
)
NON_ENGLISH = r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]"
SYMBOLIC_REASONING = (
    r"(?iU)\\frac|\\sqrt|\$|\bFind\b|\bLet\b|\bprobability\b|\binteger\b|"
    r"\btriangle\b|\bparabola\b|\bprime\b|\bdivisor\b|\\log_"
)
SHORT_ANSWER = r"(?iU)^(Who|What|When|Where|Which|How many|In what|The .* called)\b"
MULTILINGUAL_WRITING_WORDS = ("haiku", "poem", "rewrite", "translate", "summarize")
SCIENCE_WORDS = (
    "physics", "force", "velocity", "pressure", "molecule", "protein", "e. coli", "gene",
    "cell", "disease", "chemical", "co_2", "resistance",
)
WRITING_WORDS = (
    "summarize", "summary", "article", "rewrite", "write a", "story", "poem", "haiku", "creative",
)
INSTRUCTION_WORDS = (
    "order", "cancel", "return", "refund", "tracking", "profile", "agent correctly handles",
)
PUZZLE_WORDS = ("riddle", "correct order", "hint:", "logic puzzle")
HARD_CHARS = 2500
MEDIUM_CHARS = 700


def _mentions(lowered: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | lowered.contains(word)
    return hit


def task_profile(text: Column) -> dict[str, Column]:
    """Domain, subtask, difficulty and the two combined keys of a text."""
    lowered = F.lower(text)
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    rules = [
        (text.rlike(FAMILY_TASK), "arc_agi/grid_abstraction"),
        (text.rlike(REPOSITORY_ISSUE), "coding/repository_issue"),
        (text.rlike(COMPETITIVE_PROGRAMMING), "coding/competitive_programming"),
        (text.rlike(CODE_GENERATION), "coding/code_generation"),
        (
            text.rlike(NON_ENGLISH) & _mentions(lowered, MULTILINGUAL_WRITING_WORDS),
            "creative_language/multilingual_writing",
        ),
        (text.rlike(NON_ENGLISH), "multilingual/non_english"),
        (text.rlike(SYMBOLIC_REASONING), "math/symbolic_reasoning"),
        (_mentions(lowered, SCIENCE_WORDS), "science/science_qa"),
        (stripped.rlike(SHORT_ANSWER), "factual_qa/short_answer"),
        (_mentions(lowered, WRITING_WORDS), "creative_language/writing_summarization"),
        (_mentions(lowered, INSTRUCTION_WORDS), "agentic/instruction_following"),
        (_mentions(lowered, PUZZLE_WORDS), "reasoning/puzzle"),
    ]
    key = None
    for hit, name in rules:
        key = F.when(hit, name) if key is None else key.when(hit, name)
    key = key.otherwise("general/general")
    length = F.length(text)
    difficulty = (
        F.when(length >= HARD_CHARS, "hard").when(length >= MEDIUM_CHARS, "medium").otherwise("easy")
    )
    return {"task_subtask_key": key, "task_difficulty": difficulty}


def with_task_profile(df, text: str = "query"):
    """Add task_domain, task_subtask, task_difficulty, task_profile and task_subtask_key."""
    out = df.withColumns(task_profile(F.col(text)))
    parts = F.split("task_subtask_key", "/")
    return out.withColumns(
        {
            "task_domain": F.get(parts, F.lit(0)),
            "task_subtask": F.get(parts, F.lit(1)),
            "task_profile": F.concat_ws("/", "task_subtask_key", "task_difficulty"),
        }
    )
