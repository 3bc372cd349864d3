"""DuckDB twins of ``pairforge.plans.fixtures`` as CTE bodies.

Each value is the SELECT of one fixture over the pre-registered views
(region nation customer supplier part orders lineitem events documents
embeddings pages benchmark labels conversations).
"""

R1 = """
SELECT CAST(user_id AS VARCHAR) AS task_id,
       CASE WHEN user_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split,
       event_id, ts,
       'task ' || CAST(user_id AS VARCHAR) AS prompt,
       concat_ws('|', event_type, props, CAST(user_id % 25 AS VARCHAR)) AS answer,
       CASE WHEN event_type = 'purchase' THEN 'passed' ELSE 'failed' END AS output,
       CASE WHEN event_type = 'purchase' THEN '' ELSE event_type END AS error_type,
       CASE WHEN event_type = 'purchase' THEN value END AS avg_time,
       CASE WHEN event_type = 'purchase' THEN value * 0.05 END AS std_time,
       CASE WHEN event_type = 'purchase'
            THEN length(concat_ws('|', event_type, props, CAST(user_id % 25 AS VARCHAR))) END AS answer_length,
       CASE WHEN event_type <> 'purchase'
            THEN 'Traceback: ' || event_type || ' at event ' || CAST(event_id AS VARCHAR) END AS error_trace,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS answer_id
FROM events
"""

R1X2 = """
SELECT *, CAST(0 AS BIGINT) AS check_id FROM r1
UNION ALL
SELECT * REPLACE (avg_time * 1.1 AS avg_time, std_time * 1.1 AS std_time), CAST(1 AS BIGINT) AS check_id FROM r1
"""

R2 = """
SELECT 'train' AS split,
       d.source || '/' || d.lang AS task_id,
       d.doc_id AS answer_id,
       'write ' || d.source || '/' || d.lang AS prompt,
       d.text AS answer,
       CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'passed' ELSE 'failed' END AS output,
       CASE WHEN l.quality = 1 AND l.toxic = 0 THEN ''
            WHEN l.quality = 0 AND l.toxic = 1 THEN 'Both'
            WHEN l.toxic = 1 THEN 'Toxic' ELSE 'LowQuality' END AS error_type,
       CASE WHEN l.quality = 1 AND l.toxic = 0 THEN CAST(d.n_chars AS DOUBLE) / 1000.0 END AS avg_time,
       CASE WHEN l.quality = 1 AND l.toxic = 0 THEN CAST(d.n_chars AS DOUBLE) / 1000.0 * 0.1 END AS std_time,
       CASE WHEN l.quality = 1 AND l.toxic = 0 THEN length(d.text) END AS answer_length,
       CAST(NULL AS VARCHAR) AS error_trace
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

R3 = """
SELECT 'all' AS split, CAST(l_partkey AS VARCHAR) AS task_id,
       CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber <= 2
            THEN 'passed' ELSE 'failed' END AS output
FROM lineitem
"""

R4 = """
SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS answer_id,
       'task ' || CAST(user_id AS VARCHAR) AS prompt, props AS answer
FROM events
"""

V1 = """
SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS step,
       error_type, count(*) AS n
FROM r1 WHERE split = 'validation'
GROUP BY ALL
"""

TM = """
SELECT l_suppkey AS candidate, CAST(l_linenumber AS BIGINT) AS round, l_extendedprice AS ns
FROM lineitem
"""

X1 = """
SELECT doc_id,
       CASE WHEN doc_id % 10 = 0 THEN '</s>' ELSE '' END
       || left(text, length(text) // 2)
       || CASE doc_id % 4 WHEN 0 THEN chr(10) || '```rest'
                          WHEN 1 THEN chr(10) || 'print(1)' || chr(10) || '#x'
                          WHEN 2 THEN '' ELSE '</s>z' END
       || substr(text, length(text) // 2 + 1) AS raw
FROM documents
"""

X2 = """
SELECT p_partkey AS task_id,
       CASE WHEN p_partkey % 7 = 0 THEN 'x = ' || CAST(p_size AS VARCHAR)
            ELSE CASE WHEN p_partkey % 2 = 0
                      THEN '  def inner_' || CAST(p_partkey AS VARCHAR) || '(y):' || chr(10) || '    return y' || chr(10)
                      ELSE '' END
                 || 'def ' || replace(p_name, ' ', '_') || '(x):' || chr(10) || '  return ' || CAST(p_size AS VARCHAR)
       END AS code,
       'assert True' AS test,
       CASE WHEN p_partkey % 3 <> 0 THEN replace(p_name, ' ', '_') END AS entry_point
FROM part
"""

CH = """
SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS answer
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
"""

P1_PROBLEMS = """
SELECT CAST(item_id AS VARCHAR) AS task_id, text AS prompt, 'assert True' AS test,
       CAST(NULL AS VARCHAR) AS entry_point
FROM benchmark
"""

P1_SAMPLES = """
SELECT CAST(item_id AS VARCHAR) AS task_id, text AS answer, item_id * 2 AS pos FROM benchmark
UNION ALL
SELECT CAST(item_id + 20 AS VARCHAR) AS task_id, 'second ' || text AS answer, item_id * 2 + 1 AS pos
FROM benchmark
"""


def with_ctes(*named: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({body})" for n, body in named)


# The merge stage over a CTE named ``runs``: freq, averaged, scored,
# deduped, kept, ranked (with is_pass, rank, side_rank).
MERGE_CTES = """
freq AS (
  SELECT split, task_id, error_type,
         CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY split, task_id) AS frequency
  FROM runs WHERE error_type IS NOT NULL GROUP BY split, task_id, error_type),
averaged AS (
  SELECT split, task_id, answer_id, prompt, answer, output, error_type,
         avg(avg_time) AS avg_time, avg(std_time) AS std_time
  FROM runs
  WHERE split IS NOT NULL AND task_id IS NOT NULL AND answer_id IS NOT NULL AND prompt IS NOT NULL
    AND answer IS NOT NULL AND output IS NOT NULL AND error_type IS NOT NULL
  GROUP BY split, task_id, answer_id, prompt, answer, output, error_type),
scored AS (
  SELECT a.*,
         CASE WHEN a.error_type = '' THEN CAST(0.0 AS DOUBLE)
              ELSE coalesce(f.frequency, CAST('inf' AS DOUBLE)) END AS error_frequency,
         CASE WHEN a.output = 'passed' THEN CAST(length(a.answer) AS BIGINT)
              ELSE max(length(a.answer)) OVER (PARTITION BY a.split) + 10000 END AS answer_length
  FROM averaged a LEFT JOIN freq f
    ON a.split = f.split AND a.task_id = f.task_id AND a.error_type = f.error_type),
deduped AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY split, answer
          ORDER BY try_cast(task_id AS BIGINT) NULLS LAST, task_id, error_frequency, answer_length,
                   answer_id, output) = 1),
kept AS (
  SELECT * FROM deduped
  QUALIFY count_if(error_frequency = 0) OVER (PARTITION BY split, task_id) >= 2
      AND count_if(error_frequency <> 0) OVER (PARTITION BY split, task_id) >= 2),
ranked0 AS (
  SELECT *, error_frequency = 0 AS is_pass,
         row_number() OVER (PARTITION BY split, task_id
                            ORDER BY error_frequency, answer_length, answer_id, output) - 1 AS rank,
         CAST(count_if(error_frequency = 0) OVER (PARTITION BY split, task_id) AS BIGINT) AS n_pass,
         CAST(count_if(error_frequency <> 0) OVER (PARTITION BY split, task_id) AS BIGINT) AS n_fail
  FROM kept),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY split, task_id, is_pass ORDER BY rank) - 1 AS side_rank
  FROM ranked0)
"""


def merge_over(runs_body: str, *extra: tuple[str, str]) -> str:
    """WITH-clause: fixture CTEs, ``runs``, then the merge chain."""
    ctes = ",\n".join(f"{n} AS ({b})" for n, b in extra)
    head = "WITH " + (ctes + ",\n" if ctes else "")
    return head + f"runs AS ({runs_body}),\n" + MERGE_CTES
