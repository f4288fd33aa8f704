"""Queries of the ingestion family over documents cut into lines: cleaning, sections, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.functions import text as tx
from lithic.operators import ingest
from lithic.plans.base import query, table

LINES_SQL = "lines AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS idx, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
TRIM = "regexp_replace(regexp_replace({}, '^[\\s\\x0B]+', ''), '[\\s\\x0B]+$', '')"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as items: a line each."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))


CLEAN_SQL = f"WITH {LINES_SQL}, c AS (SELECT doc_id, idx, text, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\d*\\[Footnote\\s*', ' ', 'g'), '(?i)\\[F\\s*o\\s*t?\\s*n\\s*\\d*\\s*o?\\s*e\\s*', ' ', 'g'), '\\{{\\{{\\s*([^{{}}]{{1,40}}?)\\s*\\}}\\}}', '\\1', 'g'), '[ \\t]{{2,}}', ' ', 'g')) AS clean FROM lines)"


@query("clean_counts", CLEAN_SQL + " SELECT doc_id, count(*) AS n_in, count(*) FILTER (length(clean) > 0) AS n_out, sum(length(text))::BIGINT AS chars_in, sum(length(clean))::BIGINT AS chars_out FROM c GROUP BY doc_id")
def clean_counts(spark, sf):
    c = lines(spark, sf).withColumn("clean", tx.squeezed(tx.unbraced(tx.unmarked(F.col("text")))))
    return c.groupBy("doc_id").agg(F.count("*").alias("n_in"), F.count_if(F.length("clean") > 0).alias("n_out"), F.sum(F.length("text")).alias("chars_in"), F.sum(F.length("clean")).alias("chars_out"))


@query("clean_fold")
def clean_fold(spark, sf):
    """Lines that Unicode folding and plain characters change (A-CL8, 9)."""
    c = lines(spark, sf).withColumn("plain", tx.fold(tx.plain_characters(F.col("text"))))
    return c.groupBy("doc_id").agg(F.count_if(F.col("plain") != F.col("text")).alias("n_changed"))


@query("clean_report", f"WITH {LINES_SQL} SELECT doc_id, list_sort(list(length(text)))[count(*) // 2 + 1]::INT AS upper_median, max(length(text))::INT AS longest FROM lines WHERE length(text) > 0 GROUP BY doc_id")
def clean_report(spark, sf):
    n = F.length("text")
    return lines(spark, sf).filter(n > 0).groupBy("doc_id").agg(ingest.upper_median(F.collect_list(n)).alias("upper_median"), F.max(n).alias("longest"))


@query("parse_quality", "SELECT lang, source, count(*) AS n, round(avg((text LIKE '%' || chr(10) || '%')::INT), 6)::DOUBLE AS several_lines FROM documents GROUP BY ALL")
def parse_quality(spark, sf):
    """Histogram of labels and how many carry a property (A-CL16)."""
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg(F.contains("text", F.lit("\n")).cast("int")), 6).alias("several_lines"))


@query("prototype_clean", f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n FROM lines WHERE trim(text) <> '' AND NOT regexp_matches(trim(text), '^[0-9]+$') AND NOT regexp_matches(trim(text), '^[•·\\-]+$') GROUP BY doc_id")
def prototype_clean(spark, sf):
    """Lines left without empty, numeric and bullet-only ones (A-CL17)."""
    t = F.trim("text")
    return lines(spark, sf).filter((t != "") & ~t.rlike("^[0-9]+$") & ~t.rlike(r"^[•·\-]+$")).groupBy("doc_id").agg(F.count("*").alias("n"))


HEAD_SQL = "(length(text) < 40 AND text LIKE '%.')"


def is_head():
    """A short line stands for a heading."""
    return (F.length("text") < 40) & F.col("text").endswith(".")


@query("section_intervals", f"WITH {LINES_SQL} SELECT doc_id, text AS code, idx AS start_idx, coalesce(lead(idx) OVER (PARTITION BY doc_id ORDER BY idx), n)::INT AS end_idx FROM (SELECT *, max(idx) OVER (PARTITION BY doc_id) + 1 AS n FROM lines) WHERE {HEAD_SQL}")
def section_intervals(spark, sf):
    return ingest.sections(lines(spark, sf), is_head(), F.col("text"))


@query("section_coverage", f"WITH {LINES_SQL}, s AS (SELECT doc_id, idx AS a, coalesce(lead(idx) OVER (PARTITION BY doc_id ORDER BY idx), n) AS b, n FROM (SELECT *, max(idx) OVER (PARTITION BY doc_id) + 1 AS n FROM lines) WHERE {HEAD_SQL}) SELECT doc_id, count(*) AS n_sections, sum(b - a)::BIGINT AS covered, (max(n) - min(a))::INT AS due FROM s GROUP BY doc_id")
def section_coverage(spark, sf):
    items = lines(spark, sf)
    found = ingest.sections(items, is_head(), F.col("text"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.sum(F.col("end_idx") - F.col("start_idx")).alias("covered"), (F.max("end_idx") - F.min("start_idx")).alias("due"))


@query("chapter_forward_fill", f"WITH {LINES_SQL} SELECT doc_id, idx, last_value(CASE WHEN {HEAD_SQL} THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx) AS header FROM lines")
def chapter_forward_fill(spark, sf):
    return ingest.carried(lines(spark, sf), F.when(is_head(), F.col("text"))).select("doc_id", "idx", "header")


@query("grouped_sections", f"WITH {LINES_SQL}, h AS (SELECT *, last_value(CASE WHEN {HEAD_SQL} THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx) AS header FROM lines) SELECT doc_id, header, min(idx)::INT AS first_idx, count(*) AS n_items, sha256(string_agg(text, chr(10) || chr(10) ORDER BY idx)) AS text_sha FROM h WHERE header IS NOT NULL GROUP BY 1, 2")
def grouped_sections(spark, sf):
    """Items joined under the header they stand below, in order (A-SE13)."""
    h = ingest.carried(lines(spark, sf), F.when(is_head(), F.col("text"))).filter("header is not null")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n\n")
    return h.groupBy("doc_id", "header").agg(F.min("idx").alias("first_idx"), F.count("*").alias("n_items"), F.sha2(joined, 256).alias("text_sha"))


@query("landmark_context", f"WITH {LINES_SQL}, m AS (SELECT doc_id, idx AS mark FROM lines WHERE {HEAD_SQL}) SELECT doc_id, mark, count(*) AS n, min(idx)::INT AS lo, max(idx)::INT AS hi FROM m JOIN lines USING (doc_id) WHERE idx BETWEEN mark - 2 AND mark + 7 GROUP BY 1, 2")
def landmark_context(spark, sf):
    """Lines from two before to seven after each landmark (A-SE11): an equi-join on document and place."""
    items = lines(spark, sf)
    marks = items.filter(is_head()).select("doc_id", F.col("idx").alias("mark"), F.explode(F.sequence(F.col("idx") - 2, F.col("idx") + 7)).alias("idx"))
    return marks.join(items, ["doc_id", "idx"]).groupBy("doc_id", "mark").agg(F.count("*").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))


@query("parent_headings", f"WITH {LINES_SQL}, s AS (SELECT *, sum({HEAD_SQL}::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM lines) SELECT doc_id, k::INT AS span, min(idx)::INT AS start_idx, (max(idx) + 1)::INT AS end_idx, sum(length(text))::BIGINT AS n_chars, CASE WHEN k = 0 THEN '' ELSE substr(arg_min(text, idx), 1, 120) END AS heading FROM s GROUP BY doc_id, k HAVING sum(length(text)) > 0")
def parent_headings(spark, sf):
    return ingest.heading_spans(lines(spark, sf), is_head())


@query("noise_filter", f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n_noise FROM lines WHERE regexp_matches(trim(text), '^(?i:FAQ\\s*\\d*|Footnotes?|Page\\s+\\d+|\\d{{1,4}}|[·■•\\-–—]|n/?a\\.?|\\(?[a-z]\\)?|[ivxlc]{{1,5}}\\.?)$') GROUP BY doc_id")
def noise_filter(spark, sf):
    return lines(spark, sf).filter(tx.is_noise(F.trim("text"))).groupBy("doc_id").agg(F.count("*").alias("n_noise"))


@query("locator_extract", f"WITH n AS (SELECT doc_id, (doc_id % 40)::VARCHAR || '.' || (doc_id % 7)::VARCHAR || CASE WHEN doc_id % 3 = 0 THEN '.' || (doc_id % 5)::VARCHAR ELSE '' END || ' ' || substr(text, 1, 30) AS t FROM documents) SELECT doc_id, CASE WHEN regexp_extract(t, '^(\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})\\s', 1) <> '' THEN regexp_extract(t, '^(\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})\\s', 1) WHEN regexp_extract(t, '^(\\d{{1,3}}\\.\\d{{1,3}})\\.?\\s', 1) <> '' THEN 'CRE' || regexp_extract(t, '^(\\d{{1,3}}\\.\\d{{1,3}})\\.?\\s', 1) END AS locator FROM n".replace("{{", "{").replace("}}", "}"))
def locator_extract(spark, sf):
    """Locators of texts that are numbered by their id, in a chapter named CRE36."""
    number = F.concat((F.col("doc_id") % 40).cast("string"), F.lit("."), (F.col("doc_id") % 7).cast("string"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("."), (F.col("doc_id") % 5).cast("string"))).otherwise(""), F.lit(" "), F.substring("text", 1, 30))
    return table(spark, sf, "documents").select("doc_id", tx.locator(number, F.lit("CRE36")).alias("locator"))


@query("chunk_report", f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n, s[least(len(s) - 1, floor(0.5 * len(s)))::INT + 1]::INT AS p50, s[least(len(s) - 1, floor(0.9 * len(s)))::INT + 1]::INT AS p90, any_value(under)::BIGINT AS under_120 FROM (SELECT doc_id, list_sort(list(length(text))) AS s, count(*) FILTER (length(text) < 120) AS under, unnest(range(count(*))) FROM lines GROUP BY doc_id) GROUP BY doc_id, s")
def chunk_report(spark, sf):
    n = F.length("text")
    sizes = F.collect_list(n)
    return lines(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), ingest.nearest_rank(sizes, 0.5).alias("p50"), ingest.nearest_rank(sizes, 0.9).alias("p90"), F.count_if(n < 120).alias("under_120"))


@query("sentence_repair")
def sentence_repair(spark, sf):
    """Children a document after repair and splitting (A-CH9, 10)."""
    made = ingest.children(lines(spark, sf))
    return made.groupBy("doc_id").agg(F.count("*").alias("n_children"), F.max(F.length("text")).alias("longest"))


@query("recursive_split")
def recursive_split(spark, sf):
    """Chunks of up to 800 characters of every document (A-CH16)."""
    import pandas as pd

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: ingest.split_recursively(t or ""))

    cut.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    chunks = table(spark, sf, "documents").select("doc_id", F.pandas_udf(cut, "array<string>")("text").alias("c"))
    return chunks.select("doc_id", F.size("c").alias("n_chunks"), F.array_max(F.transform("c", lambda x: F.length(x))).alias("longest"))


@query("paragraph_split", "SELECT doc_id, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p) <> '')) AS n_paragraphs FROM documents")
def paragraph_split(spark, sf):
    """Paragraphs between blank lines (A-CH18)."""
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n\n"), lambda p: F.trim(p) != "")).cast("long").alias("n_paragraphs"))


@query("tiny_chunks", f"WITH {LINES_SQL}, n AS (SELECT doc_id, idx, text, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k FROM lines WHERE length(text) BETWEEN 1 AND 59), g AS (SELECT k, count(DISTINCT doc_id) AS docs FROM n GROUP BY k) SELECT CASE WHEN docs > 1 THEN 'duplicate' WHEN k NOT LIKE '% %' THEN 'fragment' ELSE 'real' END AS kind, count(*) AS n FROM n JOIN g USING (k) GROUP BY 1")
def tiny_chunks(spark, sf):
    """Short lines that repeat in another document, fragments, and the rest."""
    k = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    short = lines(spark, sf).filter(F.length("text").between(1, 59)).withColumn("k", k)
    docs = short.select("k", "doc_id").distinct().groupBy("k").agg(F.count("*").alias("docs"))
    kind = F.when(F.col("docs") > 1, "duplicate").when(~F.contains("k", F.lit(" ")), "fragment").otherwise("real")
    return short.join(docs, "k").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


ITEMS_SQL = f"{LINES_SQL}, items AS (SELECT doc_id, idx, text, CASE idx % 7 WHEN 3 THEN '' WHEN 5 THEN text || '*' ELSE text END AS orig, CASE idx % 6 WHEN 0 THEN 'SECTION_HEADER' WHEN 1 THEN 'TEXT' WHEN 2 THEN 'LIST_ITEM' WHEN 3 THEN 'FOOTNOTE' WHEN 4 THEN 'PAGE_FOOTER' ELSE 'CAPTION' END AS label, (idx // 8)::INT AS page FROM lines)"


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as parsed items: labels and pages by their number, an original that differs here and there."""
    i, text = F.col("idx"), F.col("text")
    label = F.element_at(F.array(*map(F.lit, ("SECTION_HEADER", "TEXT", "LIST_ITEM", "FOOTNOTE", "PAGE_FOOTER", "CAPTION"))), i % 6 + 1)
    orig = F.when(i % 7 == 3, "").when(i % 7 == 5, F.concat(text, F.lit("*"))).otherwise(text)
    return lines(spark, sf).select("doc_id", "idx", "text", orig.alias("orig"), label.alias("label"), F.floor(i / 8).cast("int").alias("page"))


CLEANED = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?i)\\d*\\[Footnote\\s*', ' ', 'g'), '(?i)\\[F\\s*o\\s*t?\\s*n\\s*\\d*\\s*o?\\s*e\\s*', ' ', 'g'), '\\{{\\{{\\s*([^{{}}]{{1,40}}?)\\s*\\}}\\}}', '\\1', 'g'), '[ \\t]{{2,}}', ' ', 'g'))"


@query("clean_items", f"WITH {ITEMS_SQL}, s AS (SELECT *, CASE WHEN {TRIM.format('orig')} <> '' AND {TRIM.format('orig')} <> {TRIM.format('text')} THEN {TRIM.format('orig')} ELSE text END AS src FROM items WHERE label <> 'PAGE_FOOTER') SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1)::INT AS idx, idx AS orig_idx, label = 'FOOTNOTE' AS is_footnote, src LIKE '%*' AS from_orig FROM s WHERE length({TRIM.format(CLEANED.format('src'))}) > 0")
def clean_items(spark, sf):
    """Items that are left, numbered anew, footnotes told (A-CL1, 3, 4, 11, 12)."""
    return ingest.clean(items(spark, sf)).select("doc_id", "idx", "orig_idx", "is_footnote", F.col("text").endswith("*").alias("from_orig"))


TREE = ("#/texts/0", "#/texts/1", "#/tables/0", "#/texts/2", "#/texts/3")


@query("reading_order", "SELECT doc_id::VARCHAR AS doc_id, i::INT AS idx, ref FROM documents, (VALUES " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(TREE)) + ") t(i, ref)")
def reading_order(spark, sf):
    """Leaves of a tree of groups, depth first, a group that is named twice only once (A-CL2)."""
    ids = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    body = ids.select("doc_id", F.posexplode(F.array(*map(F.lit, ("#/texts/0", "#/groups/0", "#/texts/3", "#/groups/1")))).alias("pos", "ref"))
    groups = ids.select("doc_id", F.inline(F.array(F.struct(F.lit("#/groups/0").alias("ref"), F.array(*map(F.lit, ("#/texts/1", "#/groups/1", "#/texts/2"))).alias("children")), F.struct(F.lit("#/groups/1").alias("ref"), F.array(F.lit("#/tables/0")).alias("children")))))
    seen = ingest.reading_order(body.filter("ref <> '#/groups/1'"), groups)
    return seen


@query("prose_tables", f"WITH {LINES_SQL} SELECT doc_id, doc_id % 5 + 1 <= 3 AND max(length(text)) > 120 AND count(*) FILTER (regexp_matches(text, '\\.{{4,}}|(?:\\. ){{4,}}')) < greatest(2, count(*) // 4) AS prose FROM lines GROUP BY doc_id")
def prose_tables(spark, sf):
    """Tables that hold running text (A-CL13)."""
    return table(spark, sf, "documents").select("doc_id", ingest.is_prose_table(F.split("text", "\n"), F.col("doc_id") % 5 + 1).alias("prose"))


@query("table_row_lines", "SELECT doc_id, source || ' ' || lang || ' ' || source AS line FROM documents WHERE source <> lang")
def table_row_lines(spark, sf):
    """Table rows as lines, a cell that repeats the last one left out (A-CL14)."""
    cells = F.array(F.col("source"), F.col("source"), F.lit(""), F.col("lang"), F.lit(None).cast("string"), F.col("lang"), F.col("source"))
    return table(spark, sf, "documents").filter("source <> lang").select("doc_id", ingest.table_line(cells).alias("line"))


BOOK_SQL = f"{LINES_SQL}, book AS (SELECT doc_id, idx, (idx // 8)::INT AS page, CASE idx % 9 WHEN 0 THEN 'CRE' || (10 + idx % 80) || ' Title' WHEN 1 THEN 'Version effective as of' WHEN 3 THEN '15 Dec ' || (2010 + idx % 13) WHEN 4 THEN 'see CRE10 here' WHEN 7 THEN 'CRE101 x' ELSE text END AS text FROM lines), ch AS (SELECT doc_id, 'CRE' || (10 + idx % 80) AS code, idx AS start_idx, coalesce(lead(idx) OVER (PARTITION BY doc_id ORDER BY idx), n)::INT AS end_idx FROM (SELECT *, max(idx) OVER (PARTITION BY doc_id) + 1 AS n FROM book) WHERE idx % 9 = 0)"


def book(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as a book: chapter lines, version stamps and their dates among them."""
    i = F.col("idx")
    text = F.when(i % 9 == 0, F.concat(F.lit("CRE"), (10 + i % 80).cast("string"), F.lit(" Title"))).when(i % 9 == 1, "Version effective as of").when(i % 9 == 3, F.concat(F.lit("15 Dec "), (2010 + i % 13).cast("string"))).when(i % 9 == 4, "see CRE10 here").when(i % 9 == 7, "CRE101 x").otherwise(F.col("text"))
    return lines(spark, sf).select("doc_id", "idx", F.floor(i / 8).cast("int").alias("page"), text.alias("text"))


def chapters(spark: SparkSession, sf: str) -> DataFrame:
    starts = ingest.chapter_starts(book(spark, sf), "CRE")
    opened = book(spark, sf).join(starts.select("doc_id", F.col("start_idx").alias("idx"), "code"), ["doc_id", "idx"], "left")
    return ingest.sections(opened, F.col("code").isNotNull(), F.col("code"))


@query("chapter_starts", f"WITH {BOOK_SQL} SELECT doc_id, start_idx, code FROM ch")
def chapter_starts(spark, sf):
    """Lines that open a chapter (A-SE2)."""
    return ingest.chapter_starts(book(spark, sf), "CRE")


@query("single_chapter", f"WITH {BOOK_SQL} SELECT doc_id, min(idx)::INT AS start_idx, 'CRE10' AS code FROM book WHERE contains(text, 'CRE10') GROUP BY 1")
def single_chapter(spark, sf):
    """A volume of one chapter opens at its first mention (A-SE3)."""
    return ingest.chapter_starts(book(spark, sf), "CRE10")


STAMPED = "CASE WHEN start_idx + 3 < end_idx THEN (2010 + (start_idx + 3) % 13)::VARCHAR || '-12-15' END"


@query("chapter_dates", f"WITH {BOOK_SQL} SELECT doc_id, code, start_idx, {STAMPED} AS effective_from FROM ch")
def chapter_dates(spark, sf):
    """The date that a chapter's stamp announces (A-SE4, 5)."""
    return ingest.stamps(book(spark, sf), chapters(spark, sf), "effective as of").select("doc_id", "code", "start_idx", F.col("effective_from").cast("string").alias("effective_from"))


@query("chapter_pages", f"WITH {BOOK_SQL} SELECT doc_id, start_idx, (start_idx // 8)::INT AS page_from, ((end_idx - 1) // 8)::INT AS page_to FROM ch")
def chapter_pages(spark, sf):
    """Pages that chapters reach over (A-SE6)."""
    return ingest.page_spans(book(spark, sf), chapters(spark, sf)).select("doc_id", "start_idx", "page_from", "page_to")


@query("overlaid_dates", f"WITH {BOOK_SQL} SELECT doc_id, start_idx, coalesce({STAMPED}, CASE WHEN doc_id % 2 = 0 THEN '2001-02-03' END) AS effective_from FROM ch")
def overlaid_dates(spark, sf):
    """A chapter's date over its document's (A-SE9)."""
    whole = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit("2001-02-03").cast("date")).alias("effective_from"))
    dated = ingest.stamps(book(spark, sf), chapters(spark, sf), "effective as of")
    return ingest.overlaid(dated, whole).select("doc_id", "start_idx", F.col("effective_from").cast("string").alias("effective_from"))


@query("sections_report", f"WITH {BOOK_SQL} SELECT doc_id, array_to_string(list_sort(list_distinct(list(code))), '|') AS codes, count(DISTINCT {STAMPED}) AS n_dates, sum(end_idx - start_idx)::BIGINT AS covered FROM ch GROUP BY 1")
def sections_report(spark, sf):
    """Codes, dates and covered items of each document (A-SE10)."""
    dated = ingest.stamps(book(spark, sf), chapters(spark, sf), "effective as of")
    return ingest.sections_report(dated).select("doc_id", F.array_join("codes", "|").alias("codes"), "n_dates", "covered")


@query("without_chapters", f"WITH {LINES_SQL} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lines WHERE idx = 9)")
def without_chapters(spark, sf):
    """Documents without a second chapter line (A-SE8)."""
    later = ingest.chapter_starts(book(spark, sf).filter("idx >= 9"), "CRE")
    return ingest.without_chapters(table(spark, sf, "documents").select("doc_id"), later)


@query("letter_parents", f"WITH {LINES_SQL}, h AS (SELECT doc_id, idx, idx % 11 = 10 AS head FROM lines) SELECT doc_id, idx, NOT head AND coalesce(max(CASE WHEN idx % 5 = 0 AND NOT head THEN idx END) OVER w, -1) > coalesce(max(CASE WHEN head THEN idx END) OVER w, -1) AS opens FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY idx)")
def letter_parents(spark, sf):
    """Lines whose letter continues the sequence of their document; a heading ends it (A-CH2)."""
    i = F.col("idx")
    lettered = F.concat(F.lit("("), F.element_at(F.array(*map(F.lit, "abcde")), i % 5 + 1), F.lit(") "), F.col("text"))
    marked = lines(spark, sf).select("doc_id", "idx", lettered.alias("text"), (i % 11 == 10).alias("is_heading"))
    return ingest.letter_parents(marked).select("doc_id", "idx", "opens")


@query("child_lines", f"WITH {ITEMS_SQL}, k AS (SELECT doc_id, page, idx, text, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id, page) AS n FROM items WHERE label IN ('TEXT', 'LIST_ITEM', 'PARAGRAPH', 'FOOTNOTE', 'CAPTION', 'FORMULA') WINDOW w AS (PARTITION BY doc_id, page ORDER BY idx)) SELECT doc_id, idx FROM k WHERE NOT (k = 1 AND n > 1 AND length(text) < 120)")
def child_lines(spark, sf):
    """Items that may be children, less a short line that heads a part (A-CH5, 6)."""
    usable = items(spark, sf).filter(F.col("label").isin(*ingest.CHILD))
    return ingest.without_heading_line(usable, ["doc_id", "page"]).select("doc_id", "idx")


PARENTS_SQL = f"WITH {LINES_SQL}, s AS (SELECT *, sum({HEAD_SQL}::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM lines), sp AS (SELECT doc_id, k, min(idx) AS a, count(*) FILTER (length(text) >= 10) AS kids, count(*) FILTER ({TRIM.format('text')} <> '') AS n_full, sum(CASE WHEN {TRIM.format('text')} <> '' THEN length(text) ELSE 0 END) AS chars FROM s GROUP BY 1, 2 HAVING sum(length(text)) > 0), p AS (SELECT doc_id, printf('%s::doc::%04d', doc_id::VARCHAR, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT) AS parent_id, (chars + 2 * (n_full - 1))::INT AS n_chars, kids AS n_children FROM sp QUALIFY kids > 0 AND n_full > 0)"


def assembled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = lines(spark, sf)
    spans = ingest.heading_spans(own, is_head()).withColumn("chapter", F.lit(None).cast("string"))
    return ingest.assembled(own, spans, own.filter(F.length("text") >= 10))


@query("parent_rows", PARENTS_SQL + " SELECT parent_id, n_chars, n_children FROM p")
def parent_rows(spark, sf):
    """Parents with their ids, texts and children (A-CH12, 13)."""
    return assembled(spark, sf)[0].select("parent_id", "n_chars", "n_children")


@query("parents_report", PARENTS_SQL + " SELECT doc_id, count(*) AS n, list_sort(list(n_chars))[least(count(*) - 1, floor(0.5 * count(*)))::INT + 1]::INT AS p50, max(n_chars) AS longest, count(*) FILTER (n_chars > 8000) AS over_8000 FROM p GROUP BY doc_id")
def parents_report(spark, sf):
    """Sizes of parents against their caps (A-CH15)."""
    return ingest.parents_report(assembled(spark, sf)[0]).select("doc_id", "n", "p50", "longest", "over_8000")


@query("bin_headings", f"WITH {LINES_SQL} SELECT doc_id, idx, trim(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g')) IN ('footnotes', 'footnote', 'notes', 'table', 'tables', '') OR length(text) > 90 AS bin FROM lines")
def bin_headings(spark, sf):
    """Headings that open a bag of unrelated notes (A-AS13)."""
    return lines(spark, sf).select("doc_id", "idx", tx.is_bin(F.col("text")).alias("bin"))


@query("prototype_texts", "SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n_words, len(regexp_extract_all(lower(source || ' ' || text), '[\\p{L}\\p{N}_]+')) AS n_indexed, length(regexp_replace(regexp_replace(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g'), '^ ', ''), ' $', ''))::BIGINT AS n_chars FROM documents")
def prototype_texts(spark, sf):
    """The prototypes' tokenizer and normaliser, and the indexed text (A-LX2, A-LX5, A-CL18)."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.size(tx.word_tokens(t)).cast("long").alias("n_words"), F.size(tx.word_tokens(tx.indexed_text(F.col("source"), t))).cast("long").alias("n_indexed"), F.length(tx.one_line(t)).cast("long").alias("n_chars"))
