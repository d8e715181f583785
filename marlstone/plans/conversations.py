"""Question-answer pairs, compression windows, summaries, slots and review candidates of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import slots
from ..operators import dialogue
from . import evaluation
from .registry import query, table

_PAIRS = """
pairs AS (SELECT conv_id, turn, substr(text, 1, 200) AS question, substr(answer, 1, 500) AS answer FROM (
  SELECT *, lead(role) OVER w AS next, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant')
"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.question_answer_pairs(_turns(spark, sf_dir))


@query(
    """SELECT conv_id, n AS n_turns, least(n, conv_id % 3) AS "begin", CASE WHEN n >= 10 THEN greatest(least(n, conv_id % 3), n - 8) ELSE least(n, conv_id % 3) END AS "end"
FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)"""
)
def compression_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be summarised of conversations of ten turns or more, eight of which stay; some were begun before."""
    turns = _turns(spark, sf_dir)
    marks = turns.groupBy("conv_id").agg(F.least(F.count("*"), F.first("conv_id") % 3).alias("upto"))
    return dialogue.compression(turns, 10, 8, marks)


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 8")
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.recent(_turns(spark, sf_dir), 8)


_SUMMARY = f"""{_PAIRS},
sl AS (SELECT conv_id, turn, question, list_filter(list_transform(string_split(answer, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM pairs),
su AS (SELECT conv_id, substr(string_agg('- Q: ' || substr(question, 1, 80) || ' -> ' || CASE WHEN len(ls) > 0 THEN substr(ls[1], 1, 150) ELSE '(no answer)' END, chr(10) ORDER BY turn), 1, 2000) AS summary FROM sl GROUP BY conv_id)
"""


@query(f"WITH {_SUMMARY} SELECT * FROM su")
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question and the first line of its answer."""
    return dialogue.summaries(qa_pairs(spark, sf_dir))


@query(
    f"""WITH {_SUMMARY}, k AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations),
q AS (SELECT conv_id, min_by(text, turn) AS question FROM conversations GROUP BY 1), l AS (SELECT conv_id, role, text FROM k WHERE b = 1),
u AS (SELECT conv_id, 0 AS part, 0 AS turn, 'system' AS role, summary AS text FROM su UNION ALL SELECT conv_id, 1, turn, role, text FROM k WHERE b <= 8
  UNION ALL SELECT conv_id, 2, 0, 'user', question FROM q JOIN l USING (conv_id) WHERE NOT (role = 'user' AND text = question))
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) - 1)::INT AS place, role, md5(text) AS text_md5 FROM u"""
)
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary, last turns and a new question, here the conversation's first turn asked again."""
    turns = _turns(spark, sf_dir)
    asked = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    rows = dialogue.messages(turns, extractive_summary(spark, sf_dir), asked, 8)
    return rows.select("conv_id", "place", "role", F.md5("text").alias("text_md5"))


@query(
    r"""WITH p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS known FROM conversations),
v AS (SELECT conv_id, turn, coalesce(known, '') AS known, trim(regexp_replace(trim(text), '^(?:(?:Answer:|A:)\s*){1,3}', '')) AS v FROM p WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN v = '' THEN 0.0 ELSE round(greatest(0, 1.0 - CASE WHEN length(v) < 3 THEN 0.5 ELSE 0 END - CASE WHEN length(v) > 300 THEN 0.2 ELSE 0 END
  - CASE WHEN known <> '' AND len(list_filter(regexp_extract_all(v, '\d+(?:\.\d+)?'), lambda n: NOT contains(known, n))) > 0 THEN 0.4 ELSE 0 END), 2) END::DOUBLE AS slot_score FROM v"""
)
def slot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as slot values, the turn before as what their numbers must come from."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = _turns(spark, sf_dir).withColumn("known", before).where("role = 'assistant'")
    value = slots.clean_slot(F.col("text"), ("Answer:", "A:"))
    return rows.select("conv_id", "turn", slots.slot_score(value, F.col("known"), 3, 300).alias("slot_score"))


@query(
    f"""WITH {evaluation._GUARD}, c AS (SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS query,
  trim(text) AS answer, role FROM conversations),
s AS (SELECT conv_id, turn, query, c.answer, CASE WHEN skip_reason IS NULL THEN overall END AS score, CASE WHEN skip_reason IS NULL THEN 0 ELSE 1 END AS class FROM c JOIN go USING (conv_id, turn) WHERE role = 'assistant' AND trim(c.answer) <> '')
SELECT conv_id, turn, md5(query) AS query_md5, md5(answer) AS answer_md5, score, class::INT AS class FROM s ORDER BY class, coalesce(score, 0), conv_id, turn LIMIT 20"""
)
def review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 answers to look at first: least score first, then what was not checked."""
    scores = evaluation._checked(spark, sf_dir).select("conv_id", "turn", F.col("overall").alias("score"), "risk")
    rows = dialogue.worst_first(dialogue.candidates(_turns(spark, sf_dir), scores), 20)
    return rows.select("conv_id", "turn", F.md5("query").alias("query_md5"), F.md5("answer").alias("answer_md5"), "score", "class")


@query(
    """SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn, substr(coalesce(min_by(text, turn) FILTER (role = 'user'), ''), 1, 40) AS title FROM conversations GROUP BY conv_id"""
)
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.sessions(_turns(spark, sf_dir))
