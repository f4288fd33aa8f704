"""Registry integrity, question planning and the gate's decisions (R*, A-PL*, A-GA*).

Term tables are small dimensions that stand in the code; matching is by whole words on the lowered
question. A registry is a table; each rule over it is a query that returns violations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions.text import has_term

#: What each vocabulary reads in a question, in the order in which it is reported.
JURISDICTIONS = {
    "US": ("us", "u.s.", "usa", "united states", "american", "federal reserve", "fed", "occ", "fdic", "cfr", "regulation y", "regulation yy", "reg yy"),
    "UK": ("uk", "u.k.", "united kingdom", "british", "pra", "bank of england"),
    "GLOBAL": ("basel", "bcbs", "bis", "international", "iasb"),
}
STRONG_VERSION = (
    "superseded", "replaced", "replaces", "no longer", "used to", "formerly", "former", "previously", "previous", "prior", "earlier", "originally", "old",
    "what changed", "what's changed", "what has changed", "has changed", "have changed", "had changed", "was changed", "were changed",
)
WEAK_VERSION = ("change", "changed", "changes", "changing", "revised", "revision", "amended", "amendment", "differ", "differs", "difference", "differences", "compare", "compared", "comparison", "contrast", "versus", "vs")
DOC_WORDS = ("guidance", "guideline", "guidelines", "rule", "rules", "regulation", "regulations", "standard", "standards", "statement", "version", "edition", "framework")
RECENCY = ("new", "newer", "latest", "current", "updated", "recent", "today")
SUBJECTS = {
    "model_risk_management": ("model risk", "model validation", "validation", "validate", "validating", "model inventory", "model governance", "model development", "model tiering", "effective challenge", "backtest", "backtesting", "back-testing", "benchmarking", "model owner", "model use", "model performance", "outcomes analysis", "challenger model", "challenger models", "revalidate", "revalidated", "revalidation", "model"),
    "capital_adequacy": ("capital", "capital adequacy", "risk weight", "risk weights", "risk-weight", "rwa", "tier 1", "tier 2", "irb", "internal ratings", "standardised approach", "standardized approach", "exposure at default", "ead", "lgd", "pd", "leverage ratio", "large exposure", "securitisation", "securitization"),
    "credit_impairment": ("impairment", "ecl", "expected credit loss", "expected credit losses", "provision", "provisions", "provisioning", "stage 2", "stage 3", "sicr", "significant increase in credit risk", "non-performing", "npa", "npl", "problem asset", "problem assets", "write-off", "forbearance"),
    "data_quality": ("data quality", "data governance", "data aggregation", "risk data", "lineage", "data architecture", "accuracy and integrity", "completeness"),
    "stress_testing": ("stress test", "stress tests", "stress-test", "stress testing", "stress scenario", "ccar", "capital plan", "capital planning", "adverse scenario", "severely adverse", "scenario design", "baseline scenario"),
}
CURRENT, HISTORIC = ("in_force", "partially_revised"), ("superseded",)
LINKS = ("supersedes", "superseded_by", "revises", "revised_by")


def violations(registry: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """(rule, key) of everything that is wrong with a registry, all rules at once."""
    row = lambda df, rule, key="doc_id": df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    has_next = F.size(F.coalesce("superseded_by", F.array())) > 0
    found = [
        row(registry.filter((F.col("status") == "superseded") & ~has_next), "superseded_without_successor"),
        row(registry.filter(has_next & (F.col("status") == "in_force")), "successor_of_document_in_force"),
        row(registry.filter((F.col("authority_rank") == 0) & F.col("doc_type").isin("standard", "rule")), "reference_data_as_requirement"),
        row(registry.filter(F.col("effective_to") < F.col("effective_from")), "ends_before_it_starts"),
    ]
    for key in ("doc_id", "short_name"):
        found.append(row(registry.groupBy(key).agg(F.count("*").alias("n_")).filter("n_ > 1"), f"duplicate_{key}", key))
    ids = registry.select(F.col("doc_id").alias("target")).distinct()
    links = [registry.select("doc_id", F.lit(c).alias("kind"), F.explode(c).alias("target")) for c in LINKS]
    for kind, edges in zip(LINKS, links, strict=True):
        found.append(row(edges.join(ids, "target", "left_anti"), f"dangling_{kind}"))
    for a, b in (("supersedes", "superseded_by"), ("revises", "revised_by")):
        one, other = (registry.select("doc_id", F.explode(c).alias("target")) for c in (a, b))
        back = lambda df: df.select(F.col("target").alias("doc_id"), F.col("doc_id").alias("target"))
        found += [row(one.join(back(other), ["doc_id", "target"], "left_anti"), f"one_sided_{a}"), row(other.join(back(one), ["doc_id", "target"], "left_anti"), f"one_sided_{b}")]
    live = registry.filter(F.col("status").isin(*CURRENT) & F.col("verified") & (F.col("authority_rank") > 0))
    families = live.groupBy("framework", "volume", "applicability").agg(F.count("*").alias("n_")).filter("n_ > 1")
    found.append(row(families.withColumn("family", F.concat_ws("/", "framework", "volume", "applicability")), "several_current_in_family", "family"))
    if gaps is not None:
        named = gaps.select("instrument", F.explode("referenced_by").alias("target"))
        found.append(row(named.join(ids, "target", "left_anti"), "gap_names_unknown_document", "instrument"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def select(registry: DataFrame, verified_only: bool = True, **criteria) -> DataFrame:
    """Rows that agree with all criteria, None agreeing with NULL."""
    df = registry.filter("verified") if verified_only else registry
    for c, v in criteria.items():
        df = df.filter(F.col(c).eqNullSafe(F.lit(v)))
    return df


def citation(short_name: Column, volume: Column, locator: Column, heading: Column, status: Column, effective: Column) -> Column:
    """A full reference: name, volume if not in it, locator or heading, status and date (R18, A-GE2)."""
    vol = F.when(~F.contains(short_name, volume), volume)
    where = F.coalesce(F.nullif(locator, F.lit("")), F.nullif(F.substring(heading, 1, 60), F.lit("")))
    head = F.concat_ws(", ", short_name, vol, where)
    tail = F.concat_ws("; ", status, F.concat(F.lit("eff. "), effective.cast("string")))
    return F.when(tail != "", F.concat(head, F.lit(" ("), tail, F.lit(")"))).otherwise(head)


def aliases(short_name: Column) -> Column:
    """Handles by which a document may be named (A-PL3)."""
    base = F.trim(F.lower(short_name))
    stem = F.trim(F.regexp_replace(base, r"\s*\([^)]*\)", ""))
    inside = F.filter(F.transform(F.regexp_extract_all(base, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda x: F.trim(x)), lambda x: ~F.contains(x, F.lit(" ")))
    a, b = (F.regexp_extract(stem, r"^([a-z]{2,4})\s*(\d+)\s*[-/]\s*(\d+)$", i) for i in (1, 2))
    pair = F.when(a != "", F.array(F.concat(a, F.lit(" "), b), F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    code = F.regexp_extract(stem, r"^(?:basel|bcbs) ([a-z]{2,4}\d{0,3})$", 1)
    part = F.when(F.contains(stem, F.lit("cfr")), F.array(F.replace(stem, F.lit(" part "), F.lit(" ")), F.regexp_extract(stem, r"(part\s+\d+[\.\d]*)", 1))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(F.array(stem, F.regexp_replace(stem, "[^a-z0-9]", ""), code), inside, pair, part)), lambda x: F.length(x) >= 3)


def alias_index(registry: DataFrame) -> DataFrame:
    """(doc_id, short_name, alias, pattern): aliases that only one document has (A-PL4)."""
    rows = registry.select("doc_id", "short_name", F.explode(aliases(F.col("short_name"))).alias("alias"))
    owners = F.size(F.collect_set("doc_id").over(Window.partitionBy("alias")))
    bare = F.col("alias").rlike(r"^[a-z]{2,4}\d{0,3}$")
    tail = F.when(bare, F.lit(r"\s?\d{0,3}")).otherwise("")
    return rows.withColumn("owners_", owners).filter("owners_ = 1").drop("owners_").withColumn("pattern", F.concat(F.lit(r"(?<![a-z0-9])\Q"), "alias", F.lit(r"\E"), tail, F.lit("(?![a-z0-9])")))


def named_in(lowered: Column, tables: dict[str, Sequence[str]]) -> Column:
    """The entries of a term table that a text mentions, in the table's order."""
    each = [F.when(has_term(lowered, terms), F.lit(name)) for name, terms in tables.items()]
    return F.array_compact(F.array(*each))


def plan_modes(questions: DataFrame, key: str, text: str, documents: DataFrame | None = None, weak_version: bool = False) -> DataFrame:
    """How each question is searched: the first of seven rules that holds (A-PL6).

    ``documents``: (key, n_documents) where a registry's documents are named. With ``weak_version``
    words of change together with a word for a document also ask for versions.
    """
    q = F.lower(F.col(text))
    says = lambda terms: F.coalesce(has_term(q, terms), F.lit(False))
    version = says(STRONG_VERSION)
    if weak_version:
        version = version | (says(WEAK_VERSION) & says(DOC_WORDS))
    read = questions.select(
        key, named_in(q, JURISDICTIONS).alias("jurisdictions"), named_in(q, SUBJECTS).alias("subjects"),
        version.alias("version"),
        says(RECENCY).alias("recency"))
    if documents is not None:
        read = read.join(documents, key, "left")
    named = F.coalesce("n_documents", F.lit(0)) if documents is not None else F.lit(0)
    n = F.size("jurisdictions")
    mode = (
        F.when(named >= 2, "document_fanout").when(n >= 2, "jurisdiction_fanout").when(F.col("version"), "version_fanout").when(named == 1, "single_document")
        .when(n == 1, "single_jurisdiction").when(F.size("subjects") > 0, "jurisdiction_fanout").otherwise("fallback")
    )
    inferred = (named < 1) & (n == 0) & ~F.col("version")
    return read.withColumns({"mode": mode, "inferred": inferred})


def facets(planned: DataFrame, key: str) -> DataFrame:
    """(key, facet_ord, label, jurisdiction, status): the searches of plans without named documents."""
    facet = lambda label, j, status: F.struct(label.alias("label"), j.alias("jurisdiction"), F.array(*map(F.lit, status)).alias("status"))
    none = F.lit(None).cast("string")
    only = F.when(F.size("jurisdictions") == 1, F.col("jurisdictions")[0]).otherwise(none)
    by_version = F.array(facet(F.lit("current"), only, CURRENT), facet(F.lit("historic"), only, HISTORIC))
    wide = F.when(F.col("inferred"), F.array(*map(F.lit, JURISDICTIONS))).otherwise(F.col("jurisdictions"))
    spread = F.transform(wide, lambda j: facet(F.concat(j, F.lit("+current")), j, CURRENT))
    rows = F.when(F.col("mode") == "version_fanout", by_version).otherwise(spread)
    return planned.select(key, "mode", F.posexplode(rows).alias("facet_ord", "f")).select(key, "mode", "facet_ord", "f.*")


def corpus_grid(registry: DataFrame) -> DataFrame:
    """(subject, jurisdiction, names): what is held, in registry order."""
    return registry.groupBy("subject", "jurisdiction").agg(F.array_sort(F.collect_list("short_name")).alias("names"))


def decide(extractions: DataFrame, grid: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """``extractions`` with the gate's decision (A-GA5): a cascade over what the registry holds.

    Columns: banking, subject, jurisdiction, jurisdictions (array), subject_read (from the text),
    name_kind (EXACT, FAMILY, ABSENT or NONE), document_seen. With ``status`` (``status_view``) and
    version, a question of old against new is settled where each side holds one document.
    """
    cells = grid.select("subject", "jurisdiction", F.size("names").alias("n"))
    held = cells.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("jurisdiction", "n"))).alias("cells"))
    places = grid.agg(F.collect_set("jurisdiction").alias("all_j"), F.collect_set("subject").alias("all_s"))
    x = extractions.join(F.broadcast(places))
    s_ok, j_ok = F.array_contains("all_s", F.col("subject")), F.array_contains("all_j", F.col("jurisdiction"))
    misfiled = ~F.coalesce(s_ok, F.lit(False)) & ~F.coalesce(j_ok, F.lit(False)) & F.coalesce(F.array_contains("all_j", F.col("subject")), F.lit(False))
    x = x.withColumns({"su": F.when(s_ok, F.col("subject")), "ju": F.when(j_ok, F.col("jurisdiction")).when(misfiled, F.col("subject")), "asked": F.array_intersect(F.coalesce("jurisdictions", F.array().cast("array<string>")), F.col("all_j"))})
    x = x.join(F.broadcast(held.withColumnRenamed("subject", "held_subject")), F.col("su") == F.col("held_subject"), "left")
    in_cell = lambda j: F.coalesce(F.try_element_at("cells", j), F.lit(0))
    covered = F.filter("asked", lambda j: in_cell(j) > 0)
    several = F.exists(covered, lambda j: in_cell(j) > 1)
    many = F.size("asked") > 1
    read = F.col("su").isNotNull() & F.col("subject_read")
    n_held = F.size(F.map_keys(F.coalesce("cells", F.create_map().cast("map<string,int>"))))
    sided = crowded = F.lit(False)
    if status is not None:
        names = status.select("subject", "jurisdiction", "bucket", F.explode("names").alias("name"))
        counted = names.groupBy("subject", "bucket", "jurisdiction").agg(F.count_distinct("name").alias("n")).unionByName(names.groupBy("subject", "bucket").agg(F.count_distinct("name").alias("n")).withColumn("jurisdiction", F.lit("*")))
        sides = counted.groupBy(F.col("subject").alias("side_subject")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("bucket", F.lit("|"), "jurisdiction"), "n"))).alias("sides"))
        x = x.join(F.broadcast(sides), F.col("su") == F.col("side_subject"), "left")
        now, before = (F.coalesce(F.try_element_at("sides", F.concat(F.lit(f"{b}|"), F.coalesce("ju", F.lit("*")))), F.lit(0)) for b in ("current", "historic"))
        sided = F.coalesce(read & F.col("version") & (now > 0) & (before > 0), F.lit(False))
        crowded = (now > 1) | (before > 1)
    decision = (
        F.when(~F.col("banking"), "OUT_OF_DOMAIN").when(F.col("name_kind") == "EXACT", "ANSWERABLE")
        .when((F.col("name_kind") == "ABSENT") & F.coalesce(F.col("document_seen"), F.lit(True)), "OUT_OF_CORPUS")
        .when(many & ~F.coalesce(read, F.lit(False)), "INCOMPLETE").when(many & (F.size(covered) > 0) & ~several, "ANSWERABLE").when(many, "INCOMPLETE")
        .when(sided & crowded, "INCOMPLETE").when(sided, "ANSWERABLE")
        .when(F.col("su").isNull(), "INCOMPLETE").when(F.col("ju").isNull() & (n_held == 1), "ANSWERABLE").when(F.col("ju").isNull(), "INCOMPLETE")
        .when(in_cell(F.col("ju")) > 0, "ANSWERABLE").otherwise("INCOMPLETE")
    )
    return x.withColumn("decision", decision).select(*extractions.columns, "decision")


def by_id(registry: DataFrame, doc_id: str) -> DataFrame:
    """The row of an id; an error that names the known ids if there is none."""
    found = registry.filter(F.col("doc_id") == doc_id)
    if found.limit(1).count() == 0:
        raise KeyError(f"{doc_id}: not one of {sorted(r[0] for r in registry.select('doc_id').limit(1000).collect())}")
    return found


def current(registry: DataFrame, **family) -> DataFrame:
    """The first row in force of a version family; several are an error but for reference data."""
    rows = select(registry, verified_only=True, **family).filter(F.col("status").isin(*CURRENT))
    if rows.filter("authority_rank > 0").limit(2).count() > 1:
        raise ValueError(f"several current documents in {family}")
    return rows.orderBy("row_ord").limit(1)


def version_families(registry: DataFrame) -> DataFrame:
    """All documents by version family, unverified ones too."""
    return registry.groupBy("framework", "volume", "applicability").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def requirement_sources(registry: DataFrame) -> DataFrame:
    """R14, and the base filter of requirement look-ups (A-PL7)."""
    return registry.filter(F.col("doc_type").isin("standard", "rule"))


def gap_for(gaps: DataFrame, instrument: str) -> DataFrame:
    """A known gap by its instrument, whatever the case."""
    return gaps.filter(F.lower(F.trim("instrument")) == instrument.strip().lower())


def payload(registry: DataFrame) -> DataFrame:
    """What each chunk carries of its document, dates as ISO text."""
    dates = {c: F.date_format(c, "yyyy-MM-dd") for c in ("effective_from", "effective_to")}
    return registry.drop("file", "notes", "source_url", "row_ord").withColumns(dates)


def status_view(registry: DataFrame) -> DataFrame:
    """(subject, jurisdiction, bucket, names): what is current and what is historic."""
    bucket = F.when(F.col("status").isin(*CURRENT), "current").when(F.col("status").isin(*HISTORIC), "historic")
    return registry.withColumn("bucket", bucket).filter("bucket is not null").groupBy("subject", "jurisdiction", "bucket").agg(F.array_sort(F.collect_list("short_name")).alias("names"))


def answerable(facets_: DataFrame, registry: DataFrame) -> DataFrame:
    """Facets that some registry row can match, whatever its status (A-PL8)."""
    return facets_.join(registry.select("jurisdiction").distinct(), "jurisdiction", "left_semi").unionByName(facets_.filter("jurisdiction is null"))
