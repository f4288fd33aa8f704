"""Queries that read questions: whole conversation turns, after one of eight wordings and before a
document's name in some of them, against the registry that suppliers play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.operators import gate, reading
from lithic.operators import planning as pl
from lithic.plans.base import query, table
from lithic.plans.registry import ASK, REG_SQL, registry
from lithic.sources.shared import stored

KEY = ["conv_id", "turn"]


def has_sql(text: str, terms) -> str:
    """Whole-word occurrence of any of the terms in a lowered text."""
    escaped = "|".join(t.replace(".", r"\.").replace("'", "''") for t in terms)
    return f"regexp_matches({text}, '(^|[^a-z0-9])(?:{escaped})($|[^a-z0-9])')"


def named_sql(text: str, tables: dict) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {has_sql(text, terms)} THEN '{name}' END" for name, terms in tables.items()) + "], lambda x: x IS NOT NULL)"


WORDING_SQL = "CASE conv_id % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in ASK.items()) + " END"
ASKED_SQL = f"""asked AS (
  SELECT conv_id, turn, text, {WORDING_SQL} || ' ' || coalesce(text, '') || CASE conv_id % 5 WHEN 0 THEN ' see doc ' || (conv_id % 50 + 1) WHEN 1 THEN ', DOC' || (turn + 1) || ' and doc ' || (conv_id % 40 + 1) ELSE '' END AS q
  FROM conversations)"""


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """(key, text, q): turns as questions, with their whole text."""
    t, c, n = table(spark, sf, "conversations"), F.col("conv_id"), F.col("turn")
    wording = F.element_at(F.array(*(F.lit(ASK[k]) for k in sorted(ASK))), (c % 8 + 1).cast("int"))
    one, two = F.concat(F.lit(" see doc "), (c % 50 + 1).cast("string")), F.concat(F.lit(", DOC"), (n + 1).cast("string"), F.lit(" and doc "), (c % 40 + 1).cast("string"))
    mention = F.when(c % 5 == 0, one).when(c % 5 == 1, two).otherwise("")
    return t.select(F.struct(*KEY).alias("key"), "conv_id", "turn", "text", F.concat(wording, F.lit(" "), F.coalesce("text", F.lit("")), mention).alias("q"))


NAMED_SQL = f"""{REG_SQL}, {ASKED_SQL},
aliases AS (SELECT DISTINCT doc_id, short_name, alias FROM (SELECT doc_id, short_name, lower(short_name) AS alias FROM reg UNION ALL SELECT doc_id, short_name, regexp_replace(lower(short_name), '[^a-z0-9]', '', 'g') FROM reg)),
own AS (SELECT *, CASE WHEN regexp_full_match(alias, '[a-z]{{2,4}}[0-9]{{0,3}}') THEN '\\s?[0-9]{{0,3}}' ELSE '' END AS tail FROM aliases WHERE alias IN (SELECT alias FROM aliases GROUP BY alias HAVING count(DISTINCT doc_id) = 1)),
named AS (
  SELECT conv_id, turn, doc_id, any_value(short_name) AS short_name, arg_max(alias, (length(alias), alias)) AS alias
  FROM asked JOIN own ON regexp_matches(lower(q), '(^|[^a-z0-9])' || alias || tail || '($|[^a-z0-9])') GROUP BY ALL)"""


@query("documents_in_questions", f"WITH {NAMED_SQL} SELECT conv_id, turn, doc_id, alias FROM named")
def documents_in_questions(spark, sf):
    """Documents that whole turns name, through grams of aliases (A-PL5)."""
    found = reading.documents_named(asked(spark, sf), pl.alias_index(registry(spark, sf)), "key", "q")
    return found.select("key.conv_id", "key.turn", "doc_id", "alias")


READ_SQL = f"""read AS (
  SELECT conv_id, turn, q, {named_sql('lower(q)', pl.SUBJECTS)} AS subjects, {named_sql('lower(q)', pl.JURISDICTIONS)} AS js, {has_sql('lower(q)', pl.STRONG_VERSION)} AS version FROM asked)"""


@query("question_readings", f"WITH {ASKED_SQL}, {READ_SQL} SELECT conv_id, turn, CASE WHEN len(subjects) = 1 THEN subjects[1] END AS subject, CASE WHEN len(js) = 1 THEN js[1] END AS jurisdiction, array_to_string(js, '|') AS jurisdictions, version FROM read")
def question_readings(spark, sf):
    """Subject, jurisdictions and version that whole turns state (A-GA8)."""
    read = reading.readings(asked(spark, sf), "key", "q")
    return read.select("key.conv_id", "key.turn", "subject", "jurisdiction", F.array_join("jurisdictions", "|").alias("jurisdictions"), "version")


SAID_SQL = """said AS (
  SELECT conv_id, turn, turn % 11 <> 10 AS banking, CASE conv_id % 4 WHEN 0 THEN 'capital_adequacy' WHEN 1 THEN 'GLOBAL' WHEN 2 THEN 'data_quality' END AS subject,
         CASE turn % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'MARS' END AS jurisdiction,
         CASE conv_id % 7 WHEN 0 THEN 'DOC ' || (turn + 3) WHEN 1 THEN 'the doc' WHEN 2 THEN 'US guidance' WHEN 3 THEN split_part(text, ' ', 1) WHEN 4 THEN 'Solvency II' WHEN 6 THEN '' END AS document
  FROM asked WHERE conv_id % 9 <> 4)"""


def said(questions: DataFrame) -> DataFrame:
    """Parsed replies of a model: some name a document, some a word of the text, some none; a ninth is missing."""
    c, n = F.col("conv_id"), F.col("turn")

    def of(which: Column, *values) -> Column:
        out = None
        for k, v in values:
            out = F.when(which == k, v) if out is None else out.when(which == k, v)
        return out

    document = of(c % 7, (0, F.concat(F.lit("DOC "), (n + 3).cast("string"))), (1, F.lit("the doc")), (2, F.lit("US guidance")), (3, F.substring_index("text", " ", 1)), (4, F.lit("Solvency II")), (6, F.lit("")))
    return questions.filter(c % 9 != 4).select(
        "key", (n % 11 != 10).alias("banking"), of(c % 4, (0, F.lit("capital_adequacy")), (1, F.lit("GLOBAL")), (2, F.lit("data_quality"))).alias("subject"), of(n % 3, (0, F.lit("US")), (1, F.lit("MARS"))).alias("jurisdiction"), document.alias("document"))


GENERIC_SQL = ", ".join(f"'{t}'" for t in sorted(gate.generic_tokens()))
KINDS_SQL = f"""{SAID_SQL},
names AS (SELECT lower(short_name) AS low, min(doc_id::BIGINT) AS ord, arg_min(short_name, doc_id::BIGINT) AS name FROM reg GROUP BY 1),
idx AS (SELECT *, count(*) OVER (PARTITION BY token) AS owners FROM (SELECT DISTINCT name, ord, unnest(regexp_extract_all(low, '[a-z0-9]+')) AS token FROM names)),
toks AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(document), '[a-z0-9]+')) AS token FROM said),
met AS (SELECT conv_id, turn, name, ord, count(*) AS common, min(owners) AS owners FROM toks JOIN idx USING (token) GROUP BY ALL),
best AS (SELECT conv_id, turn, arg_max(name, (common, -ord)) FILTER (owners = 1) AS hit FROM met GROUP BY ALL),
tells AS (SELECT conv_id, turn, bool_or(token NOT IN ({GENERIC_SQL})) AS tells FROM toks GROUP BY ALL),
kinds AS (
  SELECT s.conv_id, s.turn, hit, CASE WHEN hit IS NOT NULL THEN 'EXACT' WHEN b.conv_id IS NOT NULL THEN 'FAMILY' WHEN tells THEN 'ABSENT' ELSE 'NONE' END AS name_kind
  FROM said s LEFT JOIN best b ON b.conv_id = s.conv_id AND b.turn = s.turn LEFT JOIN tells t ON t.conv_id = s.conv_id AND t.turn = s.turn)"""


def with_order(reg: DataFrame) -> DataFrame:
    return reg.withColumn("row_ord", F.col("doc_id").cast("long"))


@query("name_kinds", f"WITH {REG_SQL}, {ASKED_SQL}, {KINDS_SQL} SELECT conv_id, turn, name_kind, hit FROM kinds")
def name_kinds(spark, sf):
    """Names that a model gave against the registry's, through an index of their tokens (A-GA1, A-GA2, A-GA4)."""
    found = reading.name_kinds(said(asked(spark, sf)), reading.name_index(with_order(registry(spark, sf))), "key", "document")
    return found.select("key.conv_id", "key.turn", "name_kind", "hit")


SEEN_SQL = f"list_filter(list_distinct(regexp_extract_all(lower(document), '[a-z0-9]+')), lambda w: w NOT IN ({GENERIC_SQL}))"
#: What ``planning.decide`` takes, from readings, replies and names, and its cascade.
JUDGED_SQL = f"""{NAMED_SQL}, {READ_SQL}, {KINDS_SQL},
docs AS (SELECT DISTINCT conv_id, turn FROM named),
x AS (
  SELECT r.conv_id, r.turn, r.q, r.js, r.version, d.conv_id IS NOT NULL OR s.conv_id IS NULL AS passes,
         coalesce(CASE WHEN len(subjects) = 1 THEN subjects[1] END, s.subject) AS subject, len(subjects) = 1 AS subject_read,
         CASE WHEN len(js) <= 1 THEN coalesce(js[1], s.jurisdiction) END AS jurisdiction, s.banking, k.name_kind,
         CASE WHEN trim(coalesce(document, '')) <> '' THEN len({SEEN_SQL}) > 0 AND list_has_all(regexp_extract_all(lower(r.q), '[a-z0-9]+'), {SEEN_SQL}) END AS seen
  FROM read r LEFT JOIN docs d ON d.conv_id = r.conv_id AND d.turn = r.turn LEFT JOIN said s ON s.conv_id = r.conv_id AND s.turn = r.turn LEFT JOIN kinds k ON k.conv_id = r.conv_id AND k.turn = r.turn),
g AS (SELECT subject, jurisdiction, count(*) AS n, list_sort(list(short_name)) AS names FROM reg GROUP BY ALL),
y AS (
  SELECT *, CASE WHEN subject IN (SELECT subject FROM g) THEN subject END AS su,
         CASE WHEN jurisdiction IN (SELECT jurisdiction FROM g) THEN jurisdiction WHEN subject NOT IN (SELECT subject FROM g) AND subject IN (SELECT jurisdiction FROM g) THEN subject END AS ju FROM x),
a AS (SELECT conv_id, turn, count(*) AS n_asked, count(n) AS n_covered, count(*) FILTER (n > 1) AS n_several FROM (SELECT conv_id, turn, su, unnest(js) AS j FROM y) z LEFT JOIN g ON g.subject = su AND g.jurisdiction = j WHERE j IN (SELECT jurisdiction FROM g) GROUP BY ALL),
v AS (
  SELECT conv_id, turn, count(DISTINCT short_name) FILTER (status <> 'superseded') AS now, count(DISTINCT short_name) FILTER (status = 'superseded') AS before
  FROM y JOIN reg ON reg.subject = su AND (ju IS NULL OR reg.jurisdiction = ju) GROUP BY ALL),
judged AS (
  SELECT y.*, CASE WHEN passes THEN 'ANSWERABLE' WHEN NOT coalesce(banking, false) THEN 'OUT_OF_DOMAIN' WHEN name_kind = 'EXACT' THEN 'ANSWERABLE' WHEN name_kind = 'ABSENT' AND coalesce(seen, true) THEN 'OUT_OF_CORPUS'
    WHEN n_asked > 1 AND NOT (su IS NOT NULL AND subject_read) THEN 'INCOMPLETE' WHEN n_asked > 1 AND n_covered > 0 AND n_several = 0 THEN 'ANSWERABLE' WHEN n_asked > 1 THEN 'INCOMPLETE'
    WHEN su IS NOT NULL AND subject_read AND version AND now > 0 AND before > 0 THEN CASE WHEN now > 1 OR before > 1 THEN 'INCOMPLETE' ELSE 'ANSWERABLE' END
    WHEN su IS NULL THEN 'INCOMPLETE' WHEN ju IS NULL AND (SELECT count(*) FROM g WHERE g.subject = su) = 1 THEN 'ANSWERABLE' WHEN ju IS NULL THEN 'INCOMPLETE'
    WHEN EXISTS (SELECT 1 FROM g WHERE g.subject = su AND g.jurisdiction = ju) THEN 'ANSWERABLE' ELSE 'INCOMPLETE' END AS decision
  FROM y LEFT JOIN a ON a.conv_id = y.conv_id AND a.turn = y.turn LEFT JOIN v ON v.conv_id = y.conv_id AND v.turn = y.turn)"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Whole turns through reading, names and the cascade."""
    reg, questions = with_order(registry(spark, sf)), asked(spark, sf)
    x = reading.classified(questions, said(questions), reg, pl.alias_index(reg), "key", "q")
    return pl.decide(x, pl.corpus_grid(reg), pl.status_view(reg))


@query("gate_questions", f"WITH {JUDGED_SQL} SELECT conv_id, turn, decision FROM judged")
def gate_questions(spark, sf):
    """The gate's decision on whole turns (A-GA5, A-GA9)."""
    return judged(spark, sf).select("key.conv_id", "key.turn", "decision")


ABOUT_SQL = "CASE WHEN n = 1 THEN j || ': using ' || names[1] WHEN n > 1 THEN j || ': ' || array_to_string(names, ', ') || ' - which one?' ELSE j || ': nothing held' END"
CLARIFIED_SQL = f"""{JUDGED_SQL},
choice AS (
  SELECT conv_id, turn, i, unnest(js) AS j, subject FROM (SELECT conv_id, turn, subject, js, 0 AS i FROM judged WHERE len(js) > 1 AND subject_read)
  UNION ALL SELECT conv_id, turn, 1, g.jurisdiction, judged.subject FROM judged JOIN g ON g.subject = judged.subject WHERE NOT (len(js) > 1 AND subject_read)),
placed AS (SELECT c.*, CASE i WHEN 0 THEN list_position(js, j)::VARCHAR ELSE j END AS place, n, names FROM choice c JOIN judged k USING (conv_id, turn) LEFT JOIN g ON g.subject = c.subject AND g.jurisdiction = c.j),
listed AS (SELECT conv_id, turn, string_agg({ABOUT_SQL}, '; ' ORDER BY place) AS choices FROM placed GROUP BY ALL)"""


@query("gate_clarifications", f"""WITH {CLARIFIED_SQL}
SELECT conv_id, turn, CASE WHEN NOT EXISTS (SELECT 1 FROM g WHERE g.subject = judged.subject) OR (len(js) > 1 AND NOT subject_read) THEN 'Which document or regulator should be used?' ELSE sha256('On ' || translate(judged.subject, '_', ' ') || ': ' || choices) END AS message
FROM judged LEFT JOIN listed USING (conv_id, turn) WHERE decision = 'INCOMPLETE'""")
def gate_clarifications(spark, sf):
    """What is asked back, from the grid (A-GA7); long menus as their hash."""
    found = stored(judged(spark, sf).filter("decision = 'INCOMPLETE'").select("key", "decision", "subject", "jurisdictions", "subject_read"))
    said_back = reading.clarified(found, pl.corpus_grid(registry(spark, sf)), lambda choice: F.sha2(choice, 256))
    return said_back.select("key.conv_id", "key.turn", "message")


@query("gate_settled", f"""WITH {JUDGED_SQL}, l AS (SELECT conv_id, turn, string_agg(names[1], ', ' ORDER BY i) AS locked FROM (SELECT conv_id, turn, subject, unnest(js) AS j, generate_subscripts(js, 1) AS i FROM judged WHERE subject_read AND len(js) > 1) z JOIN g ON g.subject = z.subject AND g.jurisdiction = z.j WHERE n = 1 GROUP BY ALL)
SELECT conv_id, turn, coalesce(locked, '') AS locked, sha256(CASE WHEN locked IS NOT NULL AND decision = 'ANSWERABLE' THEN q || ' (' || locked || ')' ELSE q END) AS sent FROM judged LEFT JOIN l USING (conv_id, turn)""")
def gate_settled(spark, sf):
    """Documents that the grid settles, and the question that is sent with them (A-GA6, A-GA10)."""
    rows = reading.settled(judged(spark, sf), pl.corpus_grid(registry(spark, sf)))
    return rows.select("key.conv_id", "key.turn", F.array_join("locked", ", ").alias("locked"), F.sha2("sent", 256).alias("sent"))


@query("gaps_in_documents", """WITH gaps AS (SELECT item_id, substr(text, 1, 16) AS instrument, split_part(text, ' ', 3) AS short_name FROM benchmark)
SELECT DISTINCT doc_id, instrument FROM documents, gaps WHERE contains(lower(text), lower(instrument)) OR contains(lower(text), lower(short_name))""")
def gaps_in_documents(spark, sf):
    """Documents that hold the opening or the third word of a benchmark item, as known gaps."""
    gaps = table(spark, sf, "benchmark").select(F.substring("text", 1, 16).alias("instrument"), F.split_part("text", F.lit(" "), F.lit(3)).alias("short_name"))
    return reading.gaps_mentioned(table(spark, sf, "documents").select("doc_id", "text"), gaps, "doc_id", "text")


MODES_SQL = f"""{NAMED_SQL}, {READ_SQL}, n AS (SELECT conv_id, turn, count(*) AS named FROM named GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN coalesce(named, 0) >= 2 THEN 'document_fanout' WHEN len(js) >= 2 THEN 'jurisdiction_fanout' WHEN version THEN 'version_fanout' WHEN named = 1 THEN 'single_document' WHEN len(js) = 1 THEN 'single_jurisdiction' WHEN len(subjects) > 0 THEN 'jurisdiction_fanout' ELSE 'fallback' END AS mode,
       coalesce(named, 0) < 1 AND len(js) = 0 AND NOT version AS inferred FROM read LEFT JOIN n USING (conv_id, turn)"""


@query("plan_modes_of_turns", f"WITH {MODES_SQL}")
def plan_modes_of_turns(spark, sf):
    """Plans of whole turns, documents named in them included (A-PL5, A-PL6)."""
    questions = asked(spark, sf)
    named = reading.documents_named(questions, pl.alias_index(registry(spark, sf)), "key", "q").groupBy("key").agg(F.count("*").cast("int").alias("n_documents"))
    return pl.plan_modes(questions, "key", "q", named).select("key.conv_id", "key.turn", "mode", "inferred")
