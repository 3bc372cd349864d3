"""Chat formatting as a relational job: conversations become one training string with a loss mask.

Turn rows of a conversation are collected as structs and sorted by turn;
adjacent turns of one role are merged into a block by array functions, and
blocks are concatenated. Everything is a Spark expression over one shuffle by
conversation (null texts are settled before it).

The template marks a block by ``open`` + role + newline and ends each turn's
text by ``close``, so that merged turns can still be told apart. Marks inside a
text (and the escape character itself) are escaped, and :func:`read_back`
restores every role and text exactly:

    \\ -> \\s    <turn> -> \\oturn>    </turn> -> \\c/turn>    newline in a role -> \\n

The loss mask is a list of spans (code points, end exclusive): the escaped text
of each turn whose role is in ``train_roles``, without marks.

Defined results: a null text or role is the empty string; turns sort by turn
number (null first), then role, then text, so ties and repeated rows have one
order and all of them stay; rows with a null conversation id form one
conversation; empty tables give no rows; other columns are ignored, whatever
their names. One formatted conversation is one cell (2 GB at most, as any
Spark string). For longer ones ``piece_turns`` cuts conversations into pieces
of that many turn numbers, each its own group and row; the pieces' strings in
order are a formatted conversation again, which reads back to the same turns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm.registry import register, table

ESCAPE = "\\"
OUTPUT = ("piece", "n_turns", "n_blocks", "formatted", "loss_spans")


@dataclass(frozen=True)
class Template:
    """Block mark and turn end. Neither may hold the escape character or a newline, nor overlap the other or itself."""

    open: str = "<turn>"
    close: str = "</turn>"

    def __post_init__(self):
        marks = (self.open, self.close)
        if any(len(m) < 2 or ESCAPE in m or "\n" in m for m in marks):
            raise ValueError("marks need two characters or more, without backslash and newline")
        for a in marks:
            for b in marks:
                if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"marks {a!r} and {b!r} overlap")
        if self.open == self.close:
            raise ValueError("marks must differ")

    @property
    def pairs(self) -> list[tuple[str, str]]:
        """(plain, escaped), in the order of escaping; unescaping goes backwards."""
        return [(ESCAPE, ESCAPE + "s"), (self.open, ESCAPE + "o" + self.open[1:]), (self.close, ESCAPE + "c" + self.close[1:])]

    def escape(self, text: Column) -> Column:
        for plain, escaped in self.pairs:
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        return text

    def unescape(self, text: Column) -> Column:
        for plain, escaped in reversed(self.pairs):
            text = F.replace(text, F.lit(escaped), F.lit(plain))
        return text

    def escape_role(self, role: Column) -> Column:
        return F.replace(self.escape(role), F.lit("\n"), F.lit(ESCAPE + "n"))

    def unescape_role(self, role: Column) -> Column:
        return self.unescape(F.replace(role, F.lit(ESCAPE + "n"), F.lit("\n")))


def _starts(turns: Column) -> Column:
    """Positions in sorted (turn, role, text) structs at which the role changes, the first included."""
    return F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))


def _blocks(turns: Column, starts: Column) -> Column:
    """(role, texts) structs of adjacent turns of one role."""
    def block(i, k):
        end = F.coalesce(F.get(starts, k + 1), F.size(turns))
        return F.struct(F.get(turns, i)["role"].alias("role"),
                        F.transform(F.slice(turns, i + 1, end - i), lambda t: t["text"]).alias("texts"))
    return F.transform(starts, block)


def _segments(blocks: Column, template: Template, train_roles) -> Column:
    """Blocks -> (text, learn) structs whose texts in order are the formatted conversation."""
    roles = [template_role(template, r) for r in train_roles]

    def of_block(b):
        learn = b["role"].isin(roles) if roles else F.lit(False)
        head = F.struct(F.concat(F.lit(template.open), b["role"], F.lit("\n")).alias("text"), F.lit(False).alias("learn"))
        end = F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("learn"))
        body = F.flatten(F.transform(b["texts"], lambda t: F.array(F.struct(t.alias("text"), learn.alias("learn")), end)))
        return F.concat(F.array(head), body)
    return F.flatten(F.transform(blocks, of_block))


def template_role(template: Template, role: str) -> str:
    """``role`` as it stands in a formatted conversation."""
    for plain, escaped in template.pairs:
        role = role.replace(plain, escaped)
    return role.replace("\n", ESCAPE + "n")


def _spans(segments: Column) -> Column:
    """Start and end (code points) of the segments to learn."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"))

    def step(acc, s):
        end = (acc["at"] + F.length(s["text"])).cast("int")
        own = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["learn"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))
    return F.aggregate(segments, start, step, lambda acc: acc["spans"])


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 template: Template = Template(), train_roles=("assistant",), piece_turns: int | None = None) -> DataFrame:  # noqa: B008
    """One row per conversation (with ``piece_turns``: per conversation and ``piece``): its id, ``n_turns``, ``n_blocks``,
    ``formatted`` and ``loss_spans``."""
    if conv_col in OUTPUT:
        raise ValueError(f"the id column may not be named {conv_col}")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keys = [F.col(conv_col).alias(conv_col)]
    if piece_turns:
        keys.append(F.floor(F.col(turn_col) / F.lit(piece_turns)).cast("long").alias("piece"))
    turn = F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    names = [conv_col, "piece"][:len(keys)]
    # Sorted by the plain values: escaping does not keep their order.
    collected = rows.select(*keys, turn.alias("_turn")).groupBy(*names).agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    escaped = F.transform("_turns", lambda t: F.struct(template.escape_role(t["role"]).alias("role"), template.escape(t["text"]).alias("text")))
    out = collected.select(*names, escaped.alias("_turns"))
    out = out.select(*names, "_turns", _starts(F.col("_turns")).alias("_starts"))
    out = out.select(*names, F.size("_turns").cast("long").alias("n_turns"), _blocks(F.col("_turns"), F.col("_starts")).alias("_blocks"))
    out = out.select(*names, "n_turns", F.size("_blocks").cast("long").alias("n_blocks"),
                     _segments(F.col("_blocks"), template, train_roles).alias("_segments"))
    return out.select(*names, "n_turns", "n_blocks", F.array_join(F.transform("_segments", lambda s: s["text"]), "").alias("formatted"),
                      _spans(F.col("_segments")).alias("loss_spans"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """Adds ``turns`` (array of role, text) and ``loss_text`` (all text under the mask, unescaped), read from the formatted strings alone."""
    quoted = lambda mark: r"\Q" + mark + r"\E"

    def split_block(b):
        role = F.substring_index(b, "\n", 1)
        return F.struct(template.unescape_role(role).alias("role"),
                        F.split(F.substr(b, F.length(role) + 2), quoted(template.close), -1).alias("parts"))

    def turns_of(b):
        return F.transform(F.slice(b["parts"], F.lit(1), F.size(b["parts"]) - 1),
                           lambda p: F.struct(b["role"].alias("role"), template.unescape(p).alias("text")))
    blocks = F.split("formatted", quoted(template.open), -1)
    turns = F.flatten(F.transform(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), split_block), turns_of))
    learnt = F.transform("loss_spans", lambda s: template.unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(learnt, "")})


# The conversation the contract adds, and its text.
ADDED_ID, ADDED_TEXT = -7, r"\### Assistant: </turn> ok"

SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
r AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS head,
             length(replace(replace(replace(text, '\', '\s'), '<turn>', '\oturn>'), '</turn>', '\c/turn>')) AS n_text,
             length(replace(replace(replace(replace(role, '\', '\s'), '<turn>', '\oturn>'), '</turn>', '\c/turn>'), chr(10), '\n')) AS n_role
      FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       sum(n_text + 7 + CASE WHEN head THEN 6 + n_role + 1 ELSE 0 END)::BIGINT AS formatted_chars,
       count_if(head)::BIGINT AS n_blocks
FROM r GROUP BY conv_id
"""


@register("op11_relational_chat", SQL)
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(ADDED_ID, 0, "user", ADDED_TEXT), (ADDED_ID, 1, "assistant", ADDED_TEXT)], rows.schema)
    back = read_back(format_chats(rows.unionByName(added)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks")
