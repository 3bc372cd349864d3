"""Column-level text functions (all JVM-side built-ins, no UDFs).

Each function takes and returns ``Column`` objects, so it composes into
any projection and stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the values the answers were produced with.
# Prompt template wrapped around a problem statement ({} is the problem).
SYSTEM_PROMPT = "Please provide a Python script that solves the following problem. \n\n{}\n\n```python\n"
# Stop strings, applied in this order; an answer is cut at the first
# occurrence of each one that is found at an index above 0.
STOP_STRINGS = [
    "<|endoftext|>",
    "<|endofmask|>",
    "<｜end▁of▁sentence｜>",
    "<[PAD▁TOKEN]>",
    "</s>",
    "\nif __name__",
    "\ndef main(",
    "\nprint(",
    "\n#",
    "\n```",
]
# Function name that entry points are renamed to.
ENTRY_NAME = "solver"
# Error-frequency score that marks a passing answer.
PASS_SCALAR = 0.0
# SFT text layout: question, then answer.
SFT_TEMPLATE = ("### Question: ", "\n ### Answer: ")
# Characters Python's str.strip() removes (str.isspace), as a regex class.
WHITESPACE_CLASS = (r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# Line breaks Python's str.splitlines() splits on.
LINE_BREAK_PATTERN = r"\r\n|[\n\r\x{B}\x{C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"
# ---------------------------------------------------------------------------

# Top-level function definitions: 'def' at the start of a line, then
# whitespace in Python's sense (Java's \s alone is ASCII-only), then a name.
DEF_PATTERN = r"(?md)^def" + WHITESPACE_CLASS + r"+([a-zA-Z_][a-zA-Z0-9_]*)"

_STRIP_RE = f"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$"


def sql_literal(text: str) -> str:
    """The text as a DuckDB string literal (line breaks may stand in it)."""
    return "'" + text.replace("'", "''") + "'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c) -> Column:
    """Unicode strip with Python's whitespace set (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(_col(c), _STRIP_RE, "")


def add_system_prompt(c, template: str = SYSTEM_PROMPT) -> Column:
    """``template.format(problem)`` as a null-propagating concat."""
    head, tail = template.split("{}", 1)
    return F.concat(F.lit(head), _col(c), F.lit(tail))


def truncate_at_stops(c, stops=STOP_STRINGS) -> Column:
    """Cut at the first occurrence of each stop string, in order, unless it is at index 0."""
    arr = F.array(*[F.lit(s) for s in stops])

    def step(acc, s):
        # The text before the stop: all of it where the stop is absent, nothing where it comes first.
        head = F.call_function("substring_index", acc, s, F.lit(1))
        return F.coalesce(F.nullif(head, F.lit("")), acc)

    return F.aggregate(arr, _col(c), step)


def entry_point(c) -> Column:
    """Name of the last top-level ``def`` in the text, or NULL."""
    names = F.regexp_extract_all(_col(c), F.lit(DEF_PATTERN), 1)
    return F.try_element_at(names, F.lit(-1))


def first_def_line(c) -> Column:
    """First line that, stripped, starts with ``'def '`` (stripped), or NULL."""
    lines = F.transform(F.split(_col(c), LINE_BREAK_PATTERN), strip_text)
    return F.get(F.filter(lines, lambda x: x.startswith("def ")), 0)


def rename_entry_point(c, name: str = ENTRY_NAME) -> Column:
    """Replace every occurrence of the entry-point name unless ``name`` already occurs."""
    c = _col(c)
    ep = entry_point(c)
    return F.when(ep.isNotNull() & ~c.contains(name), F.replace(c, ep, F.lit(name))).otherwise(c)


def strip_echo(response, problem) -> Column:
    """Drop the first ``len(problem)`` characters of a generated response."""
    r = _col(response)
    return F.substr(r, F.length(_col(problem)) + 1, F.length(r))


def sft_text(problem, answer) -> Column:
    q, a = SFT_TEMPLATE
    return F.concat(F.lit(q), _col(problem), F.lit(a), _col(answer))


def check_program(answer, test, entry) -> Column:
    """answer + newline + test, plus ``check(entry)`` when an entry point is given."""
    base = F.concat(_col(answer), F.lit("\n"), _col(test))
    return F.when(_col(entry).isNotNull(),
                  F.concat(base, F.lit("\ncheck("), _col(entry), F.lit(")"))).otherwise(base)


def round_ratio(num, den) -> Column:
    """``round(num / den * 100, 2)``; NULL when den is 0."""
    return F.round(F.try_divide(_col(num).cast("double"), _col(den)) * 100.0, 2)


def cov(std, avg) -> Column:
    return F.try_divide(_col(std), _col(avg))


def truncate_pair_tokens(prompt_ids, chosen_ids, rejected_ids, max_len: int, eos_id: int):
    """Append EOS to both completions, keep the prompt's last ``max_len`` ids and
    the completions' first ``max_len // 2`` ids (EOS is lost when over-long)."""
    half = max_len // 2
    p = _col(prompt_ids)
    keep_tail = F.slice(p, F.greatest(F.size(p) - max_len, F.lit(0)) + 1, max_len)
    eos = F.array(F.lit(eos_id).cast("long"))
    ch = F.slice(F.concat(_col(chosen_ids), eos), 1, half)
    rj = F.slice(F.concat(_col(rejected_ids), eos), 1, half)
    return keep_tail, ch, rj
