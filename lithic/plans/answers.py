"""Queries over claims: overlap screens, alignment, rendering and the audit record.

A document's source is a question, its lines are claims and the benchmark items that share its
number are the passages, so every claim is held against real text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.functions import text as tx
from lithic.operators import claims as cl
from lithic.plans.base import numbered, query, table

STOP_LIST, ALIGN_LIST = (", ".join(f"'{w}'" for w in dict.fromkeys(words)) for words in (tx.STOP, tx.ALIGN_STOP))
LONG_SQL = f"list_filter(regexp_extract_all(lower({{t}}), '[a-z]{{{{{{{{4,}}}}}}}}'), lambda w: w NOT IN ({STOP_LIST}))"
CONTENT_SQL = f"list_filter(regexp_extract_all(lower({{t}}), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({ALIGN_LIST}))"

CLAIMS_SQL = """docs AS (SELECT doc_id, text, (doc_id % (SELECT count(*) FROM benchmark))::BIGINT AS item FROM documents),
items AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS item, text AS passage FROM benchmark),
claims AS (SELECT doc_id AS qid, (generate_subscripts(l, 1) - 1)::INT AS claim_no, unnest(l) AS text, item FROM (SELECT doc_id, item, string_split(text, chr(10)) AS l FROM docs))"""


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as claims (qid, claim_no, text, label)."""
    n = table(spark, sf, "benchmark").count()
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("qid"), (F.col("doc_id") % n).alias("label"), F.posexplode(F.split("text", "\n")).alias("claim_no", "text"))


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """(label, passage): benchmark items by their number; as many rows as the benchmark has."""
    return numbered(table(spark, sf, "benchmark"), "item_id", "label").select("label", F.col("text").alias("passage"))


OVERLAP_SQL = f"""{CLAIMS_SQL}, o AS (SELECT qid, claim_no, claim_no % 5 <> 4 AS valid, {LONG_SQL.format(t='text').replace('{{', '{').replace('}}', '}')} AS w, lower(passage) AS p FROM claims JOIN items USING (item)),
screen AS (SELECT qid, claim_no, valid, CASE WHEN NOT valid OR len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: contains(p, x))) / len(w) END AS o FROM o)"""


def screened(spark: SparkSession, sf: str) -> DataFrame:
    """Claims with their label, valid but for every fifth, held against the passage they cite."""
    n = table(spark, sf, "benchmark").count()
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), (F.col("doc_id") % n).alias("item"))
    name = F.concat(F.lit("S"), (F.col("item") + 1).cast("string"))
    held = docs.join(passages(spark, sf).withColumnRenamed("label", "item"), "item").select("qid", name.alias("label"), "passage")
    said = claims(spark, sf).withColumn("label", F.when(F.col("claim_no") % 5 == 4, "X1").otherwise(F.concat(F.lit("S"), (F.col("label") + 1).cast("string"))))
    return cl.screened(cl.labelled(said, held), held)


@query("overlap_screen", f"WITH {OVERLAP_SQL} SELECT qid, claim_no, valid, round(o, 6)::DOUBLE AS overlap, valid AND o < 0.45 AS weak FROM screen")
def overlap_screen(spark, sf):
    """Overlap of every claim with its passage; only valid claims are weak (A-GE5, 6, 7)."""
    return screened(spark, sf).select("qid", "claim_no", "valid", F.round("overlap", 6).alias("overlap"), "weak")


UNITS_SQL = f"""{CLAIMS_SQL},
units AS (SELECT qid, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS text FROM (SELECT doc_id AS qid, string_split(passage, chr(10)) AS l FROM docs JOIN items USING (item))),
have AS (SELECT DISTINCT qid, pos, unnest({CONTENT_SQL.format(t='text')}) AS token FROM units),
cnt AS (SELECT qid, count(*) AS n FROM units GROUP BY qid),
idf AS (SELECT qid, token, ln((n + 1) / (count(*) + 0.5)) AS w FROM have JOIN cnt USING (qid) GROUP BY qid, token, n),
said AS (SELECT qid, claim_no, token, count(*) AS times FROM (SELECT qid, claim_no, unnest({CONTENT_SQL.format(t='text')}) AS token FROM claims) GROUP BY ALL),
ws AS (SELECT qid, claim_no, token, coalesce(w, 1.0) * times AS w FROM said LEFT JOIN idf USING (qid, token)),
den AS (SELECT qid, claim_no, sum(w) AS den FROM ws GROUP BY ALL),
num AS (SELECT qid, claim_no, pos, sum(w) AS num FROM ws JOIN have USING (qid, token) GROUP BY ALL),
sim AS (SELECT c.qid, c.claim_no, u.pos, round(coalesce(num / den, 0), 6) AS score FROM claims c JOIN units u ON c.qid = u.qid LEFT JOIN den ON den.qid = c.qid AND den.claim_no = c.claim_no LEFT JOIN num ON num.qid = c.qid AND num.claim_no = c.claim_no AND num.pos = u.pos),
best AS (SELECT qid, claim_no, score, lead(score) OVER w AS second, row_number() OVER w AS k FROM sim WINDOW w AS (PARTITION BY qid, claim_no ORDER BY score DESC, pos))"""


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the passage that a document is held against."""
    n = table(spark, sf, "benchmark").count()
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), (F.col("doc_id") % n).alias("label"))
    return docs.join(passages(spark, sf), "label").select("qid", "label", F.posexplode(F.split("passage", "\n")).alias("pos", "text")).withColumn("locator", F.lit(""))


@query("idf_align", f"WITH {UNITS_SQL} SELECT qid, claim_no, CASE WHEN score < 0.65 THEN 'FLOOR' WHEN second IS NOT NULL AND score - second < 0.05 THEN 'TIE' ELSE 'NOLOC' END AS verdict, score AS best, coalesce(second, 0)::DOUBLE AS runner_up FROM best WHERE k = 1")
def idf_align(spark, sf):
    return cl.align(claims(spark, sf), units(spark, sf)).select("qid", "claim_no", "verdict", "best", "runner_up")


@query("floor_sweep", f"WITH {UNITS_SQL} SELECT f AS floor, count(*) AS n, count(*) FILTER (score >= f AND NOT (second IS NOT NULL AND score - second < 0.05)) AS aligned FROM best, (VALUES (0.4), (0.5), (0.6), (0.65), (0.7)) v(f) WHERE k = 1 GROUP BY 1".replace("f AS floor", "f::DOUBLE AS floor"))
def floor_sweep(spark, sf):
    """Claims that align under each of a few floors."""
    best = cl.align(claims(spark, sf), units(spark, sf), floor=-1.0)
    tied = F.col("verdict") == "TIE"
    rows = best.select(F.explode(F.array(*(F.lit(f) for f in (0.4, 0.5, 0.6, 0.65, 0.7)))).alias("floor"), "best", tied.alias("tied"))
    return rows.groupBy("floor").agg(F.count("*").alias("n"), F.count_if((F.col("best") >= F.col("floor")) & ~F.col("tied")).alias("aligned"))


#: Turns as passages: their sentences are paragraphs, marked in a third of the conversations, with numbered
#: children in another third; every fourth one ends with its first paragraph once more. Sentences are also the claims.
SENTENCES_SQL = """said AS (SELECT conv_id * 1000 + turn AS qid, conv_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS text, len(l) AS n, l[1] AS opening FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), '. ') AS l FROM conversations)),
marked AS (SELECT qid, conv_id, pos, CASE WHEN conv_id % 3 = 0 THEN '5.' || (pos + 1) || ' ' ELSE '' END || text AS text FROM said UNION ALL SELECT qid, conv_id, n::INT, CASE WHEN conv_id % 3 = 0 THEN '5.' || (n + 1) || ' ' ELSE '' END || opening FROM said WHERE pos = 0 AND conv_id % 4 = 0),
paragraphs AS (SELECT qid, pos, CASE WHEN conv_id % 3 = 0 THEN 'CRE5.' || (pos + 1) ELSE '' END AS locator, trim(text, ' ' || chr(10) || chr(9)) AS text FROM marked WHERE length(trim(text, ' ' || chr(10) || chr(9))) >= 40),
children AS (SELECT qid, pos, CASE conv_id % 3 WHEN 0 THEN 'CRE5.1' ELSE 'Principle ' || pos END AS locator, text FROM said WHERE (conv_id % 3 = 1 AND pos % 2 = 0) OR (conv_id % 3 = 0 AND pos = 0)),
numbered AS (SELECT * FROM children WHERE qid NOT IN (SELECT qid FROM paragraphs WHERE locator <> '')),
units AS (SELECT * FROM paragraphs WHERE qid NOT IN (SELECT qid FROM numbered) UNION ALL SELECT * FROM numbered),
claims AS (SELECT qid, pos AS claim_no, text FROM said)"""


def turn_sentences(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, passages, children) of conversation turns, as SENTENCES_SQL states them."""
    t = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.lit("S1").alias("label"), "conv_id", F.split(F.coalesce("text", F.lit("")), r"\. ").alias("l"))
    c = F.col("conv_id")
    shown = F.concat("l", F.when(c % 4 == 0, F.array(F.col("l")[0])).otherwise(F.array().cast("array<string>")))
    number = F.transform(shown, lambda x, i: F.when(c % 3 == 0, F.concat(F.lit("5."), (i + 1).cast("string"), F.lit(" "), x)).otherwise(x))
    said = t.select("qid", "label", "conv_id", F.posexplode("l").alias("pos", "text"))
    lettered = said.filter((c % 3 == 0) & (F.col("pos") == 0)).withColumn("locator", F.lit("CRE5.1"))
    principles = said.filter((c % 3 == 1) & (F.col("pos") % 2 == 0)).withColumn("locator", F.concat(F.lit("Principle "), F.col("pos").cast("string")))
    return said.withColumnRenamed("pos", "claim_no"), t.select("qid", "label", F.array_join(number, "\n\n").alias("passage")), lettered.unionByName(principles)


def locator_alignment(spark: SparkSession, sf: str) -> DataFrame:
    said, passages_, children = turn_sentences(spark, sf)
    return cl.align(said, cl.paragraph_units(passages_, children, "passage"))


LOCATED_SQL = f"""{SENTENCES_SQL},
have AS (SELECT DISTINCT qid, pos, unnest({CONTENT_SQL.format(t='text')}) AS token FROM units),
cnt AS (SELECT qid, count(*) AS n, min(pos) AS first_pos FROM units GROUP BY qid),
idf AS (SELECT qid, token, ln((n + 1) / (count(*) + 0.5)) AS w FROM have JOIN cnt USING (qid) GROUP BY qid, token, n),
toks AS (SELECT qid, claim_no, token, count(*) AS times FROM (SELECT qid, claim_no, unnest({CONTENT_SQL.format(t='text')}) AS token FROM claims) GROUP BY ALL),
ws AS (SELECT qid, claim_no, token, coalesce(w, 1.0) * times AS w FROM toks LEFT JOIN idf USING (qid, token)),
den AS (SELECT qid, claim_no, sum(w) AS den FROM ws GROUP BY ALL),
num AS (SELECT qid, claim_no, pos, sum(w) AS num FROM ws JOIN have USING (qid, token) GROUP BY ALL),
sim AS (SELECT c.qid, c.claim_no, u.pos, u.locator, round(coalesce(num / den, 0), 6) AS score FROM claims c JOIN units u ON c.qid = u.qid LEFT JOIN den ON den.qid = c.qid AND den.claim_no = c.claim_no LEFT JOIN num ON num.qid = c.qid AND num.claim_no = c.claim_no AND num.pos = u.pos),
best AS (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS k FROM sim WINDOW w AS (PARTITION BY qid, claim_no ORDER BY score DESC, pos)),
judged AS (SELECT c.qid, c.claim_no, CASE WHEN score IS NULL THEN 'EMPTY' WHEN score < 0.65 THEN 'FLOOR' WHEN second IS NOT NULL AND score - second < 0.05 THEN 'TIE' WHEN locator = '' THEN 'NOLOC' ELSE 'MATCH' END AS verdict, coalesce(score, 0)::DOUBLE AS best, locator
  FROM claims c LEFT JOIN best b ON b.qid = c.qid AND b.claim_no = c.claim_no AND k = 1)"""


@query("aligned_locators", f"WITH {LOCATED_SQL} SELECT qid, claim_no, verdict, best, CASE WHEN verdict = 'MATCH' THEN locator END AS moved_to FROM judged")
def aligned_locators(spark, sf):
    """Where claims move to: markers of paragraphs, or children's locators where none opens one (A-GE11, A-GE12)."""
    return locator_alignment(spark, sf).select("qid", "claim_no", "verdict", "best", "moved_to")


@query("alignment_tally", f"WITH {LOCATED_SQL} SELECT verdict, count(*) AS n FROM judged GROUP BY 1")
def alignment_tally(spark, sf):
    """Claims by verdict: all five are reached."""
    return locator_alignment(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"))


@query("answers_of_turns", f"""WITH {LOCATED_SQL},
cited AS (SELECT c.qid, c.claim_no, trim(c.text) AS t, 'turn' || CASE WHEN verdict = 'MATCH' THEN ', ' || locator ELSE '' END AS citation FROM claims c JOIN judged j ON j.qid = c.qid AND j.claim_no = c.claim_no WHERE trim(c.text) <> ''),
nums AS (SELECT qid, citation, row_number() OVER (PARTITION BY qid ORDER BY min(claim_no), citation) AS no FROM cited GROUP BY 1, 2),
l AS (SELECT qid, claim_no, t, no::VARCHAR AS m FROM cited JOIN nums USING (qid, citation))
SELECT b.qid, sha256(b.body) AS body_sha, sources FROM (SELECT qid, string_agg(CASE WHEN right(t, 1) IN ('.', '!', '?') THEN left(t, length(t) - 1) || ' [' || m || ']' || right(t, 1) ELSE t || ' [' || m || '].' END, ' ' ORDER BY claim_no) AS body FROM l GROUP BY qid) b JOIN (SELECT qid, string_agg('[' || no || '] ' || citation, chr(10) ORDER BY no) AS sources FROM nums GROUP BY qid) USING (qid)""")
def answers_of_turns(spark, sf):
    """From claims to numbered answers, cited by the paragraphs that they moved to (A-GE15)."""
    said, passages_, children = turn_sentences(spark, sf)
    cites = passages_.select("qid", "label", F.lit("turn").alias("citation"))
    return cl.answers(said, cl.paragraph_units(passages_, children, "passage"), cites).select("qid", F.sha2("body", 256).alias("body_sha"), "sources")


@query("prompts_of_turns", """WITH p AS (SELECT conv_id, string_agg('[S' || (turn + 1) || '] ' || role || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS c, min_by(text, turn) AS q FROM conversations GROUP BY 1),
m AS (SELECT conv_id, 'EXCERPTS' || chr(10) || chr(10) || c || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'QUESTION' || chr(10) || coalesce(q, '') AS m FROM p)
SELECT conv_id, sha256(m) AS message_sha, length(m) // 4 >= 1000 - 64 AS truncated FROM m""")
def prompts_of_turns(spark, sf):
    """The message that each conversation's turns and first turn make, and whether its end may be lost (A-GE3, A-GE16)."""
    t = table(spark, sf, "conversations")
    rows = t.select(F.col("conv_id").alias("qid"), F.col("turn").alias("o"), "role", F.coalesce("text", F.lit("")).alias("text"))
    first = t.groupBy(F.col("conv_id").alias("qid")).agg(F.coalesce(F.min_by("text", "turn"), F.lit("")).alias("q"))
    message = cl.user_message(F.col("q"), F.col("context"))
    made = cl.render_context(rows, "o", "role", "text").join(first, "qid").select(F.col("qid").alias("conv_id"), message.alias("m"))
    return made.select("conv_id", F.sha2("m", 256).alias("message_sha"), cl.truncated(F.floor(F.length("m") / 4), 1000).alias("truncated"))


MARK_SQL = "CASE WHEN right(t, 1) IN ('.', '!', '?') THEN left(t, length(t) - 1) || ' [' || m || ']' || right(t, 1) ELSE t || ' [' || m || '].' END"
ANSWER_SQL = f"""said AS (SELECT conv_id AS qid, turn AS claim_no, trim(split_part(text, chr(10), 1)) AS t, CASE WHEN turn % 3 <> 2 THEN role || ' ' || (turn % 4)::VARCHAR END AS citation FROM conversations),
s AS (SELECT * FROM said WHERE t <> ''),
nums AS (SELECT qid, citation, row_number() OVER (PARTITION BY qid ORDER BY min(claim_no), citation) AS no FROM s WHERE citation IS NOT NULL GROUP BY 1, 2),
l AS (SELECT qid, claim_no, t, coalesce(no::VARCHAR, 'unattributed') AS m FROM s LEFT JOIN nums USING (qid, citation))"""


@query("answer_format", f"WITH {ANSWER_SQL} SELECT b.qid, sha256(b.body) AS body_sha, coalesce(sources, '') AS sources FROM (SELECT qid, string_agg({MARK_SQL}, ' ' ORDER BY claim_no) AS body FROM l GROUP BY qid) b LEFT JOIN (SELECT qid, string_agg('[' || no || '] ' || citation, chr(10) ORDER BY no) AS sources FROM nums GROUP BY qid) USING (qid)")
def answer_format(spark, sf):
    """First lines of turns as claims, cited by role and number."""
    t = table(spark, sf, "conversations")
    cite = F.when(F.col("turn") % 3 != 2, F.concat("role", F.lit(" "), (F.col("turn") % 4).cast("string")))
    said = t.select(F.col("conv_id").alias("qid"), F.col("turn").alias("claim_no"), F.trim(F.substring_index("text", "\n", 1)).alias("text"), cite.alias("citation"))
    return cl.format_answers(said).select("qid", F.sha2("body", 256).alias("body_sha"), "sources")


@query("render_context", "WITH p AS (SELECT conv_id AS qid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role, text FROM conversations), c AS (SELECT qid, string_agg('[S' || k || '] ' || role || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k) AS t FROM p GROUP BY qid) SELECT qid, sha256(t) AS context_sha, length(t) > 30000 AS too_large FROM c")
def render_context(spark, sf):
    from pyspark.sql import Window

    t = table(spark, sf, "conversations")
    rows = t.select(F.col("conv_id").alias("qid"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("o"), "role", "text")
    return cl.render_context(rows, "o", "role", "text").select("qid", F.sha2("context", 256).alias("context_sha"), "too_large")


@query("parse_replies", "SELECT event_id AS qid, 'k' AS label, event_type AS text FROM events WHERE event_id % 3 <> 0")
def parse_replies(spark, sf):
    """Claims out of JSON replies, a third of which are malformed (A-GE4)."""
    reply = F.when(F.col("event_id") % 3 == 0, F.lit("{not json")).otherwise(F.concat(F.lit('{"claims":[{"text":"'), "event_type", F.lit('","source":"k"}]}')))
    replies = table(spark, sf, "events").select(F.col("event_id").alias("qid"), reply.alias("reply"))
    return cl.parsed_claims(replies, "reply").select("qid", "label", "text")


@query("pending_turns", "SELECT conv_id, turn, CASE WHEN role = 'user' AND prev IS NOT NULL THEN prev || ' (' || role || ')' ELSE role END AS asked FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)")
def pending_turns(spark, sf):
    """A reply to a clarifying question is put with what was pending (A-GA12)."""
    from pyspark.sql import Window

    prev = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = table(spark, sf, "conversations").withColumn("prev", prev)
    return t.select("conv_id", "turn", F.when((F.col("role") == "user") & F.col("prev").isNotNull(), F.concat("prev", F.lit(" ("), "role", F.lit(")"))).otherwise(F.col("role")).alias("asked"))


@query("audit_json", "SELECT event_id, json_extract_string(j, '$.gate.decision') AS decision, CAST(json_extract(j, '$.user') AS BIGINT) AS user_id FROM (SELECT event_id, json_object('user', user_id, 'gate', json_object('decision', event_type)) AS j FROM events)")
def audit_json(spark, sf):
    """The audit record as JSON and back (S19, A-OB1)."""
    record = F.to_json(F.struct(F.col("user_id").alias("user"), F.struct(F.col("event_type").alias("decision")).alias("gate")))
    e = table(spark, sf, "events").select("event_id", record.alias("j"))
    return e.select("event_id", F.get_json_object("j", "$.gate.decision").alias("decision"), F.get_json_object("j", "$.user").cast("long").alias("user_id"))
