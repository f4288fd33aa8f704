"""Queries over registries and questions: integrity, families, grids, plans and gate decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.operators import planning as pl
from lithic.operators import reading
from lithic.plans.base import query, table

#: Suppliers play a registry: rank and status from their keys, successors the next key.
REG_SQL = """reg AS (
  SELECT s_suppkey::VARCHAR AS doc_id, 'DOC ' || (s_suppkey - CASE WHEN s_suppkey % 17 = 0 THEN 1 ELSE 0 END)::VARCHAR AS short_name,
         CASE s_suppkey % 4 WHEN 0 THEN 'superseded' WHEN 3 THEN 'partially_revised' ELSE 'in_force' END AS status,
         CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 8 <> 0 THEN [(s_suppkey + 1)::VARCHAR] ELSE [] END AS superseded_by,
         CASE WHEN s_suppkey % 4 = 1 AND s_suppkey % 8 <> 1 THEN [(s_suppkey - 1)::VARCHAR] ELSE [] END AS supersedes,
         (s_suppkey % 6)::INT AS authority_rank, CASE WHEN s_suppkey % 5 = 0 THEN 'rule' ELSE 'guidance' END AS doc_type,
         s_nationkey % 5 AS framework, n_regionkey AS volume, CASE s_nationkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'UK' ELSE 'GLOBAL' END AS jurisdiction,
         CASE n_regionkey WHEN 0 THEN 'capital_adequacy' WHEN 1 THEN 'data_quality' WHEN 2 THEN 'stress_testing' ELSE 'model_risk_management' END AS subject
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def registry(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    none = F.array().cast("array<string>")
    joined = table(spark, sf, "supplier").join(table(spark, sf, "nation"), n == F.col("n_nationkey"))
    return joined.select(
        k.cast("string").alias("doc_id"), F.concat(F.lit("DOC "), (k - F.when(k % 17 == 0, 1).otherwise(0)).cast("string")).alias("short_name"),
        F.when(k % 4 == 0, "superseded").when(k % 4 == 3, "partially_revised").otherwise("in_force").alias("status"),
        F.when((k % 4 == 0) & (k % 8 != 0), F.array((k + 1).cast("string"))).otherwise(none).alias("superseded_by"),
        F.when((k % 4 == 1) & (k % 8 != 1), F.array((k - 1).cast("string"))).otherwise(none).alias("supersedes"),
        none.alias("revises"), none.alias("revised_by"), (k % 6).cast("int").alias("authority_rank"), F.when(k % 5 == 0, "rule").otherwise("guidance").alias("doc_type"),
        F.lit(None).cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.lit(True).alias("verified"), (n % 5).alias("framework"), F.col("n_regionkey").alias("volume"), F.lit(None).cast("string").alias("applicability"),
        F.when(n % 3 == 0, "US").when(n % 3 == 1, "UK").otherwise("GLOBAL").alias("jurisdiction"),
        F.when(F.col("n_regionkey") == 0, "capital_adequacy").when(F.col("n_regionkey") == 1, "data_quality").when(F.col("n_regionkey") == 2, "stress_testing").otherwise("model_risk_management").alias("subject"))


def _one_sided(a: str, b: str) -> str:
    return f"SELECT 'one_sided_{a}', doc_id FROM (SELECT doc_id, unnest({a}) AS t FROM reg) x WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest({b}) AS t FROM reg) y WHERE y.doc_id = x.t AND y.t = x.doc_id)"


@query("registry_violations", f"""WITH {REG_SQL}
SELECT 'superseded_without_successor' AS rule, doc_id AS key FROM reg WHERE status = 'superseded' AND len(superseded_by) = 0
UNION ALL SELECT 'successor_of_document_in_force', doc_id FROM reg WHERE status = 'in_force' AND len(superseded_by) > 0
UNION ALL SELECT 'reference_data_as_requirement', doc_id FROM reg WHERE authority_rank = 0 AND doc_type = 'rule'
UNION ALL SELECT 'duplicate_short_name', short_name FROM reg GROUP BY short_name HAVING count(*) > 1
UNION ALL SELECT 'dangling_superseded_by', doc_id FROM (SELECT doc_id, unnest(superseded_by) AS t FROM reg) WHERE t NOT IN (SELECT doc_id FROM reg)
UNION ALL SELECT 'dangling_supersedes', doc_id FROM (SELECT doc_id, unnest(supersedes) AS t FROM reg) WHERE t NOT IN (SELECT doc_id FROM reg)
UNION ALL {_one_sided("supersedes", "superseded_by")} UNION ALL {_one_sided("superseded_by", "supersedes")}
UNION ALL SELECT 'several_current_in_family', framework || '/' || volume FROM reg WHERE status IN ('in_force', 'partially_revised') AND authority_rank > 0 GROUP BY framework, volume HAVING count(*) > 1""")
def registry_violations(spark, sf):
    return pl.violations(registry(spark, sf))


@query("version_families", f"WITH {REG_SQL} SELECT framework, volume, count(*) AS n, count(*) FILTER (status IN ('in_force', 'partially_revised')) AS n_current FROM reg GROUP BY ALL")
def version_families(spark, sf):
    reg = registry(spark, sf)
    families = pl.version_families(reg).select("framework", "volume", F.explode("doc_ids").alias("doc_id"))
    return families.join(reg.select("doc_id", "status"), "doc_id").groupBy("framework", "volume").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin(*pl.CURRENT)).alias("n_current"))


@query("corpus_grid", f"WITH {REG_SQL} SELECT subject, jurisdiction, array_to_string(list_sort(list(short_name)), '|') AS names FROM reg GROUP BY ALL")
def corpus_grid(spark, sf):
    return pl.corpus_grid(registry(spark, sf)).select("subject", "jurisdiction", F.array_join("names", "|").alias("names"))


@query("status_view", f"WITH {REG_SQL} SELECT subject, jurisdiction, CASE WHEN status = 'superseded' THEN 'historic' ELSE 'current' END AS bucket, count(*) AS n FROM reg GROUP BY ALL")
def status_view(spark, sf):
    return pl.status_view(registry(spark, sf)).select("subject", "jurisdiction", "bucket", F.size("names").cast("long").alias("n"))


@query("empty_cells", f"WITH {REG_SQL} SELECT s.subject, j.jurisdiction FROM (SELECT DISTINCT subject FROM reg) s, (SELECT DISTINCT jurisdiction FROM reg) j EXCEPT SELECT subject, jurisdiction FROM reg")
def empty_cells(spark, sf):
    """Subjects by jurisdictions that nothing is held for (E49): two vocabularies of a few values."""
    reg = registry(spark, sf)
    every = reg.agg(F.collect_set("subject").alias("s"), F.collect_set("jurisdiction").alias("j")).select(F.explode("s").alias("subject"), "j").select("subject", F.explode("j").alias("jurisdiction"))
    return every.join(reg.select("subject", "jurisdiction").distinct(), ["subject", "jurisdiction"], "left_anti")


@query("alias_index", f"WITH {REG_SQL}, a AS (SELECT doc_id, lower(short_name) AS alias FROM reg UNION ALL SELECT doc_id, regexp_replace(lower(short_name), '[^a-z0-9]', '', 'g') FROM reg) SELECT doc_id, alias FROM a WHERE alias IN (SELECT alias FROM a GROUP BY alias HAVING count(DISTINCT doc_id) = 1)")
def alias_index(spark, sf):
    return pl.alias_index(registry(spark, sf)).select("doc_id", "alias")


ASK = {"0": "What is the latest capital guidance in the US and the UK?", "1": "How has the guidance changed?", "2": "model validation", "3": "What does the PRA say about stress testing?", "4": "thus must because", "5": "Compare the rules", "6": "Was the former standard replaced in Basel?", "7": "expected credit losses"}
#: Fixed readings of the eight questions: jurisdictions, strong and weak version words, a subject.
READ_SQL = "(VALUES (0, 2, false, false, true), (1, 0, false, true, false), (2, 0, false, false, true), (3, 1, false, false, true), (4, 0, false, false, false), (5, 0, false, true, false), (6, 1, true, true, false), (7, 0, false, false, true)) r(w, nj, strong, weak, subject)"


def modes_sql(weak: str) -> str:
    return f"""q AS (SELECT conv_id, turn, nj, strong OR (weak AND {weak}) AS v, subject, CASE WHEN conv_id % 16 >= 8 THEN (conv_id // 16) % 3 ELSE 0 END AS named FROM conversations JOIN {READ_SQL} ON conv_id % 8 = w),
modes AS (SELECT conv_id, turn, nj, CASE WHEN named >= 2 THEN 'document_fanout' WHEN nj >= 2 THEN 'jurisdiction_fanout' WHEN v THEN 'version_fanout' WHEN named = 1 THEN 'single_document' WHEN nj = 1 THEN 'single_jurisdiction' WHEN subject THEN 'jurisdiction_fanout' ELSE 'fallback' END AS mode, named < 1 AND nj = 0 AND NOT v AS inferred FROM q)"""


def planned(spark: SparkSession, sf: str, weak: bool = False) -> DataFrame:
    """The plans of all questions; in half of them 0 to 2 documents are named."""
    rows = asked(spark, sf).withColumn("key", F.struct("conv_id", "turn"))
    named = F.when(F.col("conv_id") % 16 >= 8, F.floor(F.col("conv_id") / 16) % 3).otherwise(0).cast("int")
    return pl.plan_modes(rows, "key", "q", rows.select("key", named.alias("n_documents")), weak)


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as questions, each one of eight wordings by its number."""
    at = F.element_at(F.array(*(F.lit(ASK[k]) for k in sorted(ASK))), (F.col("conv_id") % 8 + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", at.alias("q"))


@query("plan_modes", f"WITH {modes_sql('false')} SELECT conv_id, turn, mode, inferred FROM modes")
def plan_modes(spark, sf):
    return planned(spark, sf).select("key.conv_id", "key.turn", "mode", "inferred")


@query("plan_modes_weak", f"WITH {modes_sql('true')} SELECT conv_id, turn, mode, inferred FROM modes")
def plan_modes_weak(spark, sf):
    """Plans where words of change count too (A-PL6 with its switch on)."""
    return planned(spark, sf, weak=True).select("key.conv_id", "key.turn", "mode", "inferred")


@query("plan_mode_tally", f"WITH {modes_sql('false')} SELECT mode, count(*) AS n FROM modes GROUP BY 1")
def plan_mode_tally(spark, sf):
    """Plans by mode."""
    return planned(spark, sf).groupBy("mode").agg(F.count("*").alias("n"))


@query("plan_facets", f"WITH {modes_sql('false')} SELECT conv_id, turn, CASE WHEN mode = 'version_fanout' THEN 2 WHEN inferred THEN 3 ELSE nj END AS n_facets FROM modes WHERE mode = 'version_fanout' OR inferred OR nj > 0".replace("CASE WHEN mode", "(CASE WHEN mode").replace("ELSE nj END AS", "ELSE nj END)::BIGINT AS"))
def plan_facets(spark, sf):
    """Searches that each plan makes, of those that no named document settles."""
    return pl.facets(planned(spark, sf), "key").groupBy("key").agg(F.count("*").alias("n_facets")).select("key.conv_id", "key.turn", "n_facets")


GATE_SQL = f"""WITH {REG_SQL}, g AS (SELECT subject, jurisdiction, count(*) AS n FROM reg GROUP BY ALL),
x AS (SELECT c_custkey AS id, c_custkey % 11 <> 0 AS banking, CASE c_custkey % 6 WHEN 0 THEN 'capital_adequacy' WHEN 1 THEN 'data_quality' WHEN 2 THEN 'GLOBAL' WHEN 3 THEN 'other' ELSE 'model_risk_management' END AS subject,
  CASE c_custkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'UK' WHEN 2 THEN 'MARS' END AS jurisdiction, CASE c_custkey % 13 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'ABSENT' WHEN 2 THEN 'FAMILY' ELSE 'NONE' END AS name_kind, c_custkey % 2 = 0 AS document_seen,
  CASE c_custkey % 7 WHEN 0 THEN ['US', 'UK'] WHEN 1 THEN ['US', 'MARS'] WHEN 2 THEN ['UK', 'GLOBAL', 'US'] ELSE [] END AS js, c_custkey % 3 <> 0 AS subject_read FROM customer),
y AS (SELECT *, CASE WHEN subject IN (SELECT subject FROM g) THEN subject END AS su, CASE WHEN jurisdiction IN (SELECT jurisdiction FROM g) THEN jurisdiction
  WHEN subject NOT IN (SELECT subject FROM g) AND subject IN (SELECT jurisdiction FROM g) THEN subject END AS ju FROM x),
a AS (SELECT id, count(*) AS n_asked, count(n) AS n_covered, count(*) FILTER (n > 1) AS n_several FROM (SELECT id, su, unnest(js) AS j FROM y) z LEFT JOIN g ON g.subject = su AND g.jurisdiction = j WHERE j IN (SELECT jurisdiction FROM g) GROUP BY 1)
SELECT id, CASE WHEN NOT banking THEN 'OUT_OF_DOMAIN' WHEN name_kind = 'EXACT' THEN 'ANSWERABLE' WHEN name_kind = 'ABSENT' AND document_seen THEN 'OUT_OF_CORPUS'
  WHEN n_asked > 1 AND NOT (su IS NOT NULL AND subject_read) THEN 'INCOMPLETE' WHEN n_asked > 1 AND n_covered > 0 AND n_several = 0 THEN 'ANSWERABLE' WHEN n_asked > 1 THEN 'INCOMPLETE'
  WHEN su IS NULL THEN 'INCOMPLETE' WHEN ju IS NULL AND (SELECT count(*) FROM g WHERE g.subject = su) = 1 THEN 'ANSWERABLE' WHEN ju IS NULL THEN 'INCOMPLETE'
  WHEN EXISTS (SELECT 1 FROM g WHERE g.subject = su AND g.jurisdiction = ju) THEN 'ANSWERABLE' ELSE 'INCOMPLETE' END AS decision FROM y LEFT JOIN a USING (id)"""


def extractions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    several = F.when(k % 7 == 0, F.array(F.lit("US"), F.lit("UK"))).when(k % 7 == 1, F.array(F.lit("US"), F.lit("MARS"))).when(k % 7 == 2, F.array(F.lit("UK"), F.lit("GLOBAL"), F.lit("US"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "customer").select(
        k.alias("id"), (k % 11 != 0).alias("banking"), F.when(k % 6 == 0, "capital_adequacy").when(k % 6 == 1, "data_quality").when(k % 6 == 2, "GLOBAL").when(k % 6 == 3, "other").otherwise("model_risk_management").alias("subject"),
        F.when(k % 5 == 0, "US").when(k % 5 == 1, "UK").when(k % 5 == 2, "MARS").alias("jurisdiction"), several.alias("jurisdictions"), (k % 3 != 0).alias("subject_read"),
        F.when(k % 13 == 0, "EXACT").when(k % 13 == 1, "ABSENT").when(k % 13 == 2, "FAMILY").otherwise("NONE").alias("name_kind"), (k % 2 == 0).alias("document_seen"))


@query("gate_decide", GATE_SQL)
def gate_decide(spark, sf):
    return pl.decide(extractions(spark, sf), pl.corpus_grid(registry(spark, sf))).select("id", "decision")


@query("gate_stops", f"SELECT decision, count(*) AS n FROM ({GATE_SQL}) WHERE decision <> 'ANSWERABLE' GROUP BY 1")
def gate_stops(spark, sf):
    """Questions that the gate would have stopped, by decision."""
    return gate_decide(spark, sf).filter("decision <> 'ANSWERABLE'").groupBy("decision").agg(F.count("*").alias("n"))


@query("indexable_rows", f"WITH {REG_SQL} SELECT doc_id, short_name FROM reg WHERE jurisdiction = 'UK' AND status = 'in_force'")
def indexable_rows(spark, sf):
    """Verified rows that agree with all criteria."""
    return pl.select(registry(spark, sf), jurisdiction="UK", status="in_force").select("doc_id", "short_name")


@query("requirement_rows", f"WITH {REG_SQL} SELECT doc_id FROM reg WHERE doc_type IN ('standard', 'rule')")
def requirement_rows(spark, sf):
    """Rows that bind (R14, A-PL7)."""
    return pl.requirement_sources(registry(spark, sf)).select("doc_id")


@query("row_by_id", f"WITH {REG_SQL} SELECT doc_id, status FROM reg WHERE doc_id = '3'")
def row_by_id(spark, sf):
    """One row by its id."""
    return pl.by_id(registry(spark, sf), "3").select("doc_id", "status")


GAPS = [("Regulation Zeta", "REG Z"), ("Order 17", "O17"), ("the of", "and")]


def known_gaps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GAPS, "instrument string, short_name string")


@query("gaps_mentioned", "SELECT item_id, instrument FROM benchmark, (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in GAPS) + ") g(instrument, short_name) WHERE contains(lower(text), lower(instrument)) OR contains(lower(text), lower(short_name))")
def gaps_mentioned(spark, sf):
    """Questions that name a known gap."""
    return reading.gaps_mentioned(table(spark, sf, "benchmark"), known_gaps(spark), "item_id", "text")


@query("gap_for", "SELECT p_name AS instrument, p_brand AS short_name FROM part WHERE lower(trim(p_name)) = (SELECT lower(trim(p_name)) FROM part WHERE p_partkey = 17)")
def gap_for(spark, sf):
    """A known gap whatever the case and the white space around it (R15): parts play the gaps."""
    parts = table(spark, sf, "part").select(F.col("p_name").alias("instrument"), F.col("p_brand").alias("short_name"), "p_partkey")
    asked_for = f"  {parts.filter('p_partkey = 17').first()['instrument'].upper()} "
    return pl.gap_for(parts.drop("p_partkey"), asked_for)


@query("citation_text", f"WITH {REG_SQL} SELECT doc_id, short_name || CASE WHEN contains(short_name, volume::VARCHAR) THEN '' ELSE ', ' || volume END || ', p. ' || doc_id || ' (' || status || '; eff. 2024-01-02)' AS citation FROM reg")
def citation_text(spark, sf):
    """References in full (R18, A-GE2)."""
    where = F.concat(F.lit("p. "), F.col("doc_id"))
    return registry(spark, sf).select("doc_id", pl.citation(F.col("short_name"), F.col("volume").cast("string"), where, F.lit("a heading"), F.col("status"), F.lit("2024-01-02").cast("date")).alias("citation"))


@query("payload_rows", f"WITH {REG_SQL} SELECT doc_id, short_name, status, doc_type, subject, jurisdiction, authority_rank, NULL::VARCHAR AS effective_from FROM reg")
def payload_rows(spark, sf):
    """What chunks carry of their document."""
    return pl.payload(registry(spark, sf)).select("doc_id", "short_name", "status", "doc_type", "subject", "jurisdiction", "authority_rank", "effective_from")


@query("facets_answerable", f"WITH {REG_SQL}, {modes_sql('false')}, f AS (SELECT conv_id, turn, unnest(['US', 'UK', 'GLOBAL']) AS jurisdiction FROM modes WHERE inferred AND mode <> 'version_fanout') SELECT conv_id, turn, count(*) AS n FROM f WHERE jurisdiction IN (SELECT jurisdiction FROM reg) GROUP BY ALL")
def facets_answerable(spark, sf):
    """Searches of inferred plans that some row can match (A-PL8)."""
    wide = pl.facets(planned(spark, sf).filter("inferred and mode <> 'version_fanout'"), "key")
    return pl.answerable(wide, registry(spark, sf)).groupBy("key").agg(F.count("*").alias("n")).select("key.conv_id", "key.turn", "n")


@query("current_row", f"WITH {REG_SQL} SELECT doc_id FROM reg WHERE doc_id = (SELECT min(doc_id::BIGINT)::VARCHAR FROM reg WHERE authority_rank = 0 AND status IN ('in_force', 'partially_revised'))")
def current_row(spark, sf):
    """The first row in force of reference data, of which several may be."""
    rows = registry(spark, sf).filter("authority_rank = 0").withColumn("row_ord", F.col("doc_id").cast("long")).withColumn("all_", F.lit("x"))
    return pl.current(rows, all_="x").select("doc_id")
