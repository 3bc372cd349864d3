"""Registered queries: text post-processing and prompt construction."""

from pyspark.sql import functions as F

from pairforge.functions import text as T
from pairforge.plans import fixtures as X
from pairforge.plans import oracle_fixtures as O
from pairforge.functions.draws import sql_unit_draw
from pairforge.plans.q_merge import R2_MERGE, merged
from pairforge.plans.q_pairs import _TASKS_SQL
from pairforge.operators import pairs as P
from pairforge.operators import vocabulary as V
from pairforge.plans.registry import register
from pairforge.session import materialize

NL = "chr(10)"
SYS_HEAD, SYS_TAIL = (T.sql_literal(part) for part in T.SYSTEM_PROMPT.split("{}"))
_STOPS_SQL = [T.sql_literal(stop) for stop in T.STOP_STRINGS]
_WS = T.WHITESPACE_CLASS


def sql_truncate_chain(src_cte: str, col: str, keep: str) -> str:
    """CTE chain s0..s10 cutting ``col`` at each stop string in turn."""
    parts = [f"s0 AS (SELECT {keep}, {col} AS t FROM {src_cte})"]
    for i, stop in enumerate(_STOPS_SQL, start=1):
        parts.append(f"s{i} AS (SELECT {keep}, CASE WHEN strpos(t, {stop}) > 1 "
                     f"THEN left(t, strpos(t, {stop}) - 1) ELSE t END AS t FROM s{i - 1})")
    return ",\n".join(parts)


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


@register("truncate_at_stops", O.with_ctes(("x1", O.X1)) + ",\n" + sql_truncate_chain("x1", "raw", "doc_id") + """
SELECT doc_id, t AS answer, length(t) AS answer_length FROM s10
""")
def truncate_at_stops(spark, sf_dir):
    x = X.x1_raw_answers(spark, sf_dir)
    t = T.truncate_at_stops("raw")
    return x.select("doc_id", t.alias("answer"), F.length(t).cast("long").alias("answer_length"))


@register("entry_point", O.with_ctes(("x2", O.X2)) + f"""
SELECT task_id, regexp_extract_all(code, '(?m)^def{_WS}+([a-zA-Z_][a-zA-Z0-9_]*)', 1)[-1] AS entry_point
FROM x2
""")
def entry_point(spark, sf_dir):
    x = X.x2_code(spark, sf_dir)
    return x.select("task_id", T.entry_point("code").alias("entry_point"))


@register("first_def_line", O.with_ctes(("x2", O.X2)) + rf"""
SELECT task_id,
       list_filter(list_transform(
           regexp_split_to_array(code, {T.sql_literal(T.LINE_BREAK_PATTERN)}),
           lambda x: {sql_strip('x')}), lambda x: starts_with(x, 'def '))[1] AS def_line
FROM x2
""")
def first_def_line(spark, sf_dir):
    x = X.x2_code(spark, sf_dir)
    return x.select("task_id", T.first_def_line("code").alias("def_line"))


@register("rename_entry_point", O.with_ctes(("x2", O.X2)) + f"""
, ep AS (SELECT task_id, code,
                regexp_extract_all(code, '(?m)^def{_WS}+([a-zA-Z_][a-zA-Z0-9_]*)', 1)[-1] AS ep FROM x2)
SELECT task_id, CASE WHEN ep IS NOT NULL AND NOT contains(code, {T.sql_literal(T.ENTRY_NAME)}) THEN replace(code, ep, {T.sql_literal(T.ENTRY_NAME)})
                     ELSE code END AS code
FROM ep
""")
def rename_entry_point(spark, sf_dir):
    x = X.x2_code(spark, sf_dir)
    return x.select("task_id", T.rename_entry_point("code").alias("code"))


@register("check_program", O.with_ctes(("x2", O.X2)) + f"""
SELECT task_id, CASE WHEN entry_point IS NOT NULL
                     THEN code || {NL} || test || {NL} || 'check(' || entry_point || ')'
                     ELSE code || {NL} || test END AS program
FROM x2
""")
def check_program(spark, sf_dir):
    x = X.x2_code(spark, sf_dir)
    return x.select("task_id", T.check_program("code", "test", "entry_point").alias("program"))


@register("add_system_prompt", O.with_ctes(("ch", O.CH)) + f"""
SELECT conv_id, turn, {SYS_HEAD} || {sql_strip('prompt')} || {SYS_TAIL} AS prompt FROM ch
""")
def add_system_prompt(spark, sf_dir):
    c = X.ch_chat(spark, sf_dir)
    return c.select("conv_id", "turn", T.add_system_prompt(T.strip_text("prompt")).alias("prompt"))


@register("strip_echo", O.with_ctes(("ch", O.CH)) + ",\n" + """
g AS (SELECT conv_id, turn, """ + SYS_HEAD + " || prompt || " + SYS_TAIL + """ AS problem, answer FROM ch),
e AS (SELECT conv_id, turn, substr(problem || answer, length(problem) + 1) AS echo_free FROM g),
""" + sql_truncate_chain("e", "echo_free", "conv_id, turn") + """
SELECT conv_id, turn, t AS answer FROM s10
""")
def strip_echo(spark, sf_dir):
    c = X.ch_chat(spark, sf_dir).withColumn("problem", T.add_system_prompt("prompt"))
    generated = F.concat("problem", "answer")
    answer = T.truncate_at_stops(T.strip_echo(generated, F.col("problem")))
    return c.select("conv_id", "turn", answer.alias("answer"))


# Long enough that short answers keep their end token and long ones are cut; a vocabulary that leaves rare words out.
MAX_LEN = 800
EOS_ID, OOV_ID, FIRST_ID = 0, 1, 2
MAX_WORDS = 3000


def _sql_words(x):
    return f"unnest(string_split({x}, ' ')) AS w"


def _sql_encoded(name, x):
    """CTE: (split, id, ids) of one text of ``op``, in word order."""
    return f"""{name} AS (SELECT split, id, list(coalesce(v.vid, {OOV_ID}) ORDER BY pos) AS ids
        FROM (SELECT split, id, {_sql_words(x)}, generate_subscripts(string_split({x}, ' '), 1) AS pos FROM op) e
             LEFT JOIN vocab v ON v.w = e.w GROUP BY split, id)"""


_PROMPT_SQL = f"{SYS_HEAD} || prompt || {SYS_TAIL}"
_VOCABULARY_SQL = f"""
words AS (SELECT {_sql_words(_PROMPT_SQL)} FROM ranked UNION ALL SELECT {_sql_words('answer')} FROM ranked),
vocab AS (SELECT w, n, nth + {FIRST_ID} AS vid
          FROM (SELECT w, n, row_number() OVER (ORDER BY n DESC, md5(w), w) - 1 AS nth
                FROM (SELECT w, count(*) AS n FROM words WHERE w IS NOT NULL GROUP BY w))
          WHERE nth < {MAX_WORDS})"""

_PAIR_TOKENS_SQL = R2_MERGE + _TASKS_SQL + f"""
, t AS (SELECT *, CAST(floor({sql_unit_draw(7, 'split', 'task_id', "'chosen'")} * n_pass) AS BIGINT) AS c_pos,
               CAST(floor({sql_unit_draw(7, 'split', 'task_id', "'rejected'")} * n_fail) AS BIGINT) AS r_pos
        FROM tasks),
op AS (SELECT t.split, t.task_id AS id, t.prompt, c.answer AS chosen, r.answer AS rejected
       FROM t JOIN ranked c ON c.split = t.split AND c.task_id = t.task_id AND c.is_pass AND c.side_rank = t.c_pos
              JOIN ranked r ON r.split = t.split AND r.task_id = t.task_id AND NOT r.is_pass
               AND r.side_rank = t.r_pos),
{_VOCABULARY_SQL},
{_sql_encoded('ep', _PROMPT_SQL)},
{_sql_encoded('ec', 'chosen')},
{_sql_encoded('er', 'rejected')},
tok AS (SELECT ep.split, ep.id, ep.ids AS p, list_append(ec.ids, {EOS_ID}) AS c, list_append(er.ids, {EOS_ID}) AS r
        FROM ep JOIN ec ON ec.split = ep.split AND ec.id = ep.id JOIN er ON er.split = ep.split AND er.id = ep.id)
SELECT split, id,
       array_to_string(list_slice(p, greatest(len(p) - {MAX_LEN}, 0) + 1,
                                  greatest(len(p) - {MAX_LEN}, 0) + {MAX_LEN}), ',') AS prompt_ids,
       array_to_string(list_slice(c, 1, {MAX_LEN // 2}), ',') AS chosen_ids,
       array_to_string(list_slice(r, 1, {MAX_LEN // 2}), ',') AS rejected_ids
FROM tok
"""


def _vocabulary(spark, sf_dir):
    r = merged(spark, sf_dir, "r2")["ranked"]
    return V.learn_vocabulary(r, [T.add_system_prompt("prompt"), F.col("answer")], MAX_WORDS, FIRST_ID)


@register("learn_vocabulary", R2_MERGE + "," + _VOCABULARY_SQL + "\nSELECT w AS word, n, vid AS id FROM vocab")
def learn_vocabulary(spark, sf_dir):
    return _vocabulary(spark, sf_dir)


@register("truncate_pair_tokens", _PAIR_TOKENS_SQL)
def truncate_pair_tokens(spark, sf_dir):
    vocabulary = materialize(_vocabulary(spark, sf_dir), "vocabulary")
    pr = P.one_pair(merged(spark, sf_dir, "r2")["ranked"], seed=7)
    tokens = V.encode(pr, ["split", "id"], {"p": V.split_words(T.add_system_prompt("prompt"), last=MAX_LEN),
                                            "c": V.split_words("chosen", first=MAX_LEN // 2),
                                            "r": V.split_words("rejected", first=MAX_LEN // 2)},
                      vocabulary, OOV_ID, FIRST_ID)
    p, c, j = T.truncate_pair_tokens("p", "c", "r", MAX_LEN, EOS_ID)
    return tokens.select("split", "id", F.array_join(p, ",").alias("prompt_ids"),
                         F.array_join(c, ",").alias("chosen_ids"), F.array_join(j, ",").alias("rejected_ids"))
