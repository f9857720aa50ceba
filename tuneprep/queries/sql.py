"""Common table expressions shared by the SQL statements."""

from tuneprep.functions.text import PYTHON_WHITESPACE

EXCHANGES = """
asked AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
answered AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant'),
exchanges AS (
  SELECT asked.conv_id, asked.turn, question, answer
  FROM asked JOIN answered ON asked.conv_id = answered.conv_id AND asked.turn = answered.turn
)"""

QA = (
    EXCHANGES
    + """,
qa AS (
  SELECT e.conv_id, e.turn, e.question, e.answer AS response_j, coalesce(b.text, e.question) AS response_k
  FROM exchanges e LEFT JOIN conversations b
    ON b.conv_id = e.conv_id AND b.turn + 1 = e.turn AND b.role = 'assistant'
)"""
)

CHAT = """
chat AS (
  SELECT u.conv_id, u.turn, t.turn AS message_turn, t.role, t.text
  FROM conversations u JOIN conversations t
    ON u.conv_id = t.conv_id AND t.turn BETWEEN u.turn - 1 AND u.turn + 1
  WHERE u.role = 'user'
)"""



def mixed(name: str, cases: list[str], shift: int, answer: str, other: str) -> str:
    """A case for each way in which a side of a mixed pair is put; ``{a}`` and ``{o}`` are its own and the other reply."""
    kinds = " ".join(f"WHEN {i} THEN {case.format(a=answer, o=other)}" for i, case in enumerate(cases))
    return f"CASE (conv_id + turn + {shift}) % {len(cases)} {kinds} END AS {name}"


WHITESPACE = " || ".join(f"chr({ord(c)})" for c in PYTHON_WHITESPACE)


def strip(text: str) -> str:
    return f"trim({text}, {WHITESPACE})"


def qa_text(question: str, answer: str) -> str:
    return f"'Question: ' || {question} || chr(10) || chr(10) || 'Answer: ' || {answer}"


def template_message(role: str, content: str) -> str:
    """One message in the default template."""
    return (
        f"CASE {role} WHEN 'system' THEN '<|system|>' WHEN 'assistant' THEN '<|assistant|>' ELSE '<|user|>' END"
        f" || chr(10) || {content} || '<|end|>' || chr(10)"
    )


def words(name: str, source: str, keys: str, text: str = "text") -> str:
    """``name``: one row per word of a text, with its position from 1."""
    return f"""
{name} AS (
  SELECT {keys}, unnest(list) AS token, generate_subscripts(list, 1) AS pos
  FROM (
    SELECT {keys}, list_filter(regexp_split_to_array({text}, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS list
    FROM {source}
  )
)"""


def vocab(source: str, size: int, first_id: int) -> str:
    """``vocab``: the most frequent words of a word table."""
    return f"""
vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) - 1 + {first_id} AS INTEGER) AS id, n
  FROM (SELECT token, count(*) AS n FROM {source} GROUP BY token ORDER BY n DESC, token LIMIT {size})
)"""


def split(name: str, source: str, keys: list[str], size: int, seed: int) -> str:
    """``name``: a table with ``split_hash`` and ``split`` added."""
    hashed = " || ':' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"""
{name} AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY split_hash, {", ".join(keys)})
      <= greatest(1, least({size}, count(*) OVER () - 1)) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, md5({hashed}) AS split_hash FROM {source})
)"""


def fit(name: str, features: str, reg_param: float, steps: int) -> str:
    """``name``(i, w): weights that minimise the mean pairwise log-loss, by accelerated gradient steps.

    ``features`` has rows (pair, i, x) of the differences. The step is the inverse of a bound of the curvature;
    momentum suits the bound's ratio to ``reg_param``.
    """
    return f"""
{name}_shape AS (
  SELECT 0.25 * max(s) + {reg_param} AS curve, count(*) AS n FROM (SELECT sum(x * x) AS s FROM {features} GROUP BY pair)
),
{name}_rate AS (SELECT n, curve, (sqrt(curve / {reg_param}) - 1) / (sqrt(curve / {reg_param}) + 1) AS momentum FROM {name}_shape),
{name}_steps(step, i, w, v) AS (
  SELECT 0, i, 0.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT i FROM {features})
  UNION ALL
  SELECT step + 1, i, new_w, new_w + momentum * (new_w - w) FROM (
    SELECT s.step, s.i, s.w, r.momentum, s.v - ({reg_param} * s.v - g.g / r.n) / r.curve AS new_w
    FROM {name}_steps s JOIN {name}_rate r ON true JOIN (
      SELECT f.i, sum(f.x * p.wrong) AS g FROM {features} f JOIN (
        SELECT f.pair, 1 / (1 + exp(sum(f.x * s.v))) AS wrong FROM {features} f JOIN {name}_steps s ON f.i = s.i GROUP BY f.pair
      ) p ON f.pair = p.pair GROUP BY f.i
    ) g ON g.i = s.i
    WHERE s.step < {steps}
  )
),
{name} AS (SELECT i, w FROM {name}_steps WHERE step = {steps})"""
