"""Reading questions in a plan: what they name, what a model said of them, what is said back (A-GA*, A-PL5).

Many patterns meet many texts through a shared key and never in a nested loop: a pattern is filed
under one gram that every match of it must show, texts give their grams, an equal join fetches the
candidates, and only those run the pattern. Names are found through an index of their tokens that
knows how many names own a token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.functions.text import has_term
from lithic.operators.gate import generic_tokens
from lithic.operators.planning import JURISDICTIONS, STRONG_VERSION, SUBJECTS, named_in

#: What a text is filed under for patterns that have no gram of their own.
ANY = ""
#: Characters of a substring's gram.
GRAM = 3
#: Rows of an index, a few dozen bytes each, that every task may hold.
HELD_ROWS = 1_000_000
#: Names of gaps that the driver and every task may hold, and texts that are Python objects in a task at a time.
HELD_NAMES, SLICE = 50_000, 256


def sent_if_small(rows: DataFrame) -> DataFrame:
    """``rows`` marked for broadcast if they are counted to be at most HELD_ROWS."""
    return F.broadcast(rows) if rows.limit(HELD_ROWS + 1).count() <= HELD_ROWS else rows


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def word_grams(text: Column) -> Column:
    """Words of a text, and those words less up to three closing digits, which a code may carry."""
    found = F.array_distinct(words(text))
    shorter = F.flatten(F.transform(F.filter(found, lambda w: w.rlike("[0-9]$")), lambda w: F.array(*(F.regexp_replace(w, f"[0-9]{{{n}}}$", "") for n in (1, 2, 3)))))
    return F.array_union(F.array_union(found, F.filter(shorter, lambda w: w != "")), F.array(F.lit(ANY)))


def by_rarest_word(index: DataFrame, alias: str) -> DataFrame:
    """``index`` with ``gram``, the word of each alias that fewest aliases have: every whole-word match shows it."""
    held = index.select(alias).distinct().select(alias, F.explode(F.array_distinct(words(F.col(alias)))).alias("w_"))
    shared = held.groupBy("w_").agg(F.count("*").alias("n_"))
    rarest = held.join(shared, "w_").groupBy(alias).agg(F.min_by("w_", F.struct("n_", -F.length("w_"), "w_")).alias("gram"))
    return index.join(rarest, alias, "left").withColumn("gram", F.coalesce("gram", F.lit(ANY)))


def letter_grams(text: Column, sizes: list[int]) -> Column:
    """Distinct runs of so many characters within the words of a text."""
    parts = F.array_distinct(F.split(text, r"\s+"))

    def runs(n: int) -> Column:
        return F.flatten(F.transform(parts, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))))

    return F.array_union(F.array_distinct(F.concat(*map(runs, sizes))), F.array(F.lit(ANY)))


def letter_gram(name: Column) -> Column:
    """The opening of the longest part of a substring without white space: every match shows it in a word."""
    held = F.transform(F.split(name, r"\s+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    return F.substring(F.array_max(held)["w"], 1, GRAM)


def candidates(texts: DataFrame, patterns: DataFrame, key: str, grams: Column) -> DataFrame:
    """``texts`` beside those ``patterns`` (with ``gram``) whose gram they show.

    Grams that no pattern has leave before anything is shuffled by text. Where every task may hold the
    patterns, texts stay where they are and a pair may stand twice; else they are joined back by key.
    """
    if patterns.limit(HELD_ROWS + 1).count() <= HELD_ROWS:
        return texts.select(*texts.columns, F.explode(grams).alias("gram")).join(F.broadcast(patterns), "gram").drop("gram")
    shown = texts.select(key, F.explode(grams).alias("gram")).join(sent_if_small(patterns.select("gram").distinct()), "gram", "left_semi")
    return shown.join(patterns, "gram").drop("gram").distinct().join(texts, key)


def documents_named(questions: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """(key, doc_id, short_name, alias): documents a question names, by their longest alias (A-PL5)."""
    lowered = questions.select(key, F.lower(text).alias("q_"))
    met = candidates(lowered, by_rarest_word(index, "alias"), key, word_grams(F.col("q_"))).filter(F.expr("regexp_like(q_, pattern)"))
    longest = F.max_by(F.struct("short_name", "alias"), F.struct(F.length("alias"), F.col("alias")))
    return met.groupBy(key, "doc_id").agg(longest.alias("best")).select(key, "doc_id", "best.*")


def gaps_mentioned(texts: DataFrame, gaps: DataFrame, key: str, text: str) -> DataFrame:
    """(key, instrument): texts that hold a known gap's instrument or short name as a substring."""
    lowered = texts.select(key, F.lower(text).alias("t_"))
    names = gaps.select("instrument", F.explode(F.array(F.lower("instrument"), F.lower("short_name"))).alias("name_")).filter("name_ is not null").distinct()
    filed = names.withColumn("gram", letter_gram(F.col("name_")))
    sizes = sorted({r[0] for r in filed.select(F.length("gram").alias("n")).distinct().limit(GRAM + 1).collect()} - {0})  # at most GRAM + 1 of them
    if not sizes:
        sizes = [GRAM]
    if filed.limit(HELD_NAMES + 1).count() <= HELD_NAMES:
        return _held_gaps(lowered, filed, key, sizes).distinct()
    met = candidates(lowered, filed, key, letter_grams(F.col("t_"), sizes))
    return met.filter(F.contains("t_", F.col("name_"))).select(key, "instrument").distinct()


def _held_gaps(lowered: DataFrame, filed: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """(key, instrument) where every task holds the names: a text's grams fetch those that it may hold."""
    named: dict[str, list[tuple[str, str | None]]] = {}
    for r in filed.select("gram", "name_", "instrument").collect():  # at most HELD_NAMES
        named.setdefault(r["gram"], []).append((r["name_"], r["instrument"]))
    shared = lowered.sparkSession.sparkContext.broadcast(named)
    schema = T.StructType([lowered.schema[key], T.StructField("instrument", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for part in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            at, found = [], []
            for k, text in enumerate(part.column("t_").to_pylist()):
                if text is None:
                    continue
                shown = {text[i : i + n] for n in sizes for i in range(len(text) - n + 1)} | {ANY}
                hits = {instrument for gram in shown & held.keys() for name, instrument in held[gram] if name in text}
                at += [k] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], schema.names)

    return lowered.select(key, "t_").mapInArrow(run, schema)


def name_index(names: DataFrame, name: str = "short_name", order: str = "row_ord") -> DataFrame:
    """(token, name, row_ord, owners): how many names own each token of each name (A-GA1)."""
    once = names.groupBy(F.lower(name).alias("low_")).agg(F.min_by(name, order).alias("name"), F.min(order).alias("row_ord"))
    tokens = once.select("name", "row_ord", F.explode(F.array_distinct(words(F.col("low_")))).alias("token"))
    return tokens.join(tokens.groupBy("token").agg(F.count("*").alias("owners")), "token")


def name_kinds(asked: DataFrame, index: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name_kind, hit) of every row: EXACT with the name that shares most tokens, at least one of
    them its own; FAMILY with shared tokens only; ABSENT or NONE by whether a token tells anything (A-GA2, A-GA4)."""
    tokens = asked.select(key, F.explode(F.array_distinct(words(F.col(name)))).alias("token"))
    told = tokens.groupBy(key).agg(F.bool_or(~F.col("token").isin(*sorted(generic_tokens()))).alias("tells"))
    # A row a token: names that share a token are never listed, since only names with one of their own count.
    known = index.groupBy("token").agg(F.min(F.when(F.col("owners") == 1, F.struct("name", "row_ord"))).alias("own"))
    met = tokens.join(sent_if_small(known), "token").groupBy(key).agg(F.collect_set("token").alias("shared"), F.collect_set("own").alias("owned"))
    whole = index.groupBy("name").agg(F.collect_set("token").alias("all_"))
    held = met.select(key, "shared", F.explode("owned").alias("own")).select(key, "shared", "own.*").join(whole, "name")
    common = F.size(F.array_intersect("shared", "all_"))
    best = held.groupBy(key).agg(F.max_by("name", F.struct(common, -F.col("row_ord"))).alias("hit"))
    kind = F.when(F.col("hit").isNotNull(), "EXACT").when(F.col("met"), "FAMILY").when(F.col("tells"), "ABSENT").otherwise("NONE")
    x = asked.select(key).join(told, key, "left").join(met.select(key, F.lit(True).alias("met")), key, "left").join(best, key, "left")
    return x.select(key, kind.alias("name_kind"), "hit")


def document_seen(name: Column, question: Column) -> Column:
    """Whether a question holds, as whole words, all that tells a document's name apart (A-GA3)."""
    content = F.filter(F.array_distinct(words(name)), lambda w: ~w.isin(*sorted(generic_tokens())))
    return (F.size(content) > 0) & (F.size(F.array_except(content, words(question))) == 0)


def readings(questions: DataFrame, key: str, text: str) -> DataFrame:
    """What a question's own words say: subject and jurisdiction if there is one, all jurisdictions, version (A-GA8)."""
    q = F.lower(F.col(text))
    found = questions.select(key, F.col(text).alias("question"), named_in(q, SUBJECTS).alias("subjects"), named_in(q, JURISDICTIONS).alias("jurisdictions"), has_term(q, STRONG_VERSION).alias("version"))
    one = lambda c: F.when(F.size(c) == 1, F.col(c)[0])
    return found.select(key, "question", one("subjects").alias("subject"), one("jurisdictions").alias("jurisdiction"), "jurisdictions", "version")


def classified(questions: DataFrame, said: DataFrame, registry: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """What ``planning.decide`` takes of every question, with what was read over what a model said (A-GA9).

    ``said``: key, banking, subject, jurisdiction, document of the replies that could be parsed. A
    question that names a document passes without a model, and so does one without a reply.
    """
    read = readings(questions, key, text)
    named = documents_named(questions, index, key, text).groupBy(key).agg(F.array_sort(F.collect_list("short_name")).alias("named"))
    kinds = name_kinds(said, name_index(registry), key, "document")
    model = said.select(key, F.lit(True).alias("replied"), "banking", F.col("subject").alias("m_subject"), F.col("jurisdiction").alias("m_jurisdiction"), "document")
    x = read.join(named, key, "left").join(model, key, "left").join(kinds, key, "left")
    passes = F.col("named").isNotNull() | F.col("replied").isNull()
    several = F.size("jurisdictions") > 1
    kind = F.when(passes, "EXACT").otherwise(F.coalesce("name_kind", F.lit("NONE")))
    seen = F.when(F.trim(F.coalesce("document", F.lit(""))) != "", document_seen(F.col("document"), F.col("question")))
    return x.select(
        key, "question", F.coalesce("named", F.array().cast("array<string>")).alias("documents"), F.when(passes, True).otherwise(F.coalesce("banking", F.lit(False))).alias("banking"),
        F.coalesce("subject", "m_subject").alias("subject"), F.when(several, None).otherwise(F.coalesce("jurisdiction", "m_jurisdiction")).alias("jurisdiction"), "jurisdictions",
        F.col("subject").isNotNull().alias("subject_read"), "version", kind.alias("name_kind"), F.when(~passes, seen).alias("document_seen"))


def held(grid: DataFrame, names: Column) -> DataFrame:
    """(subject, cells): what ``names`` gives of each jurisdiction of a subject, as a map."""
    return grid.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("jurisdiction", names.alias("names")))).alias("cells"))


def settled(judged: DataFrame, grid: DataFrame) -> DataFrame:
    """``judged`` with ``locked``, the documents that the grid settles for a question of several
    jurisdictions whose subject was read (A-GA6), and ``sent``, the question with them (A-GA10).

    Of a cell of several names only that it settles nothing goes to the questions."""
    met = judged.join(F.broadcast(held(grid, F.when(F.size("names") == 1, F.col("names")[0]))), "subject", "left")
    alone = F.array_compact(F.transform("jurisdictions", lambda j: F.try_element_at("cells", j)))
    locked = F.when(F.col("subject_read") & (F.size("jurisdictions") > 1), F.coalesce(alone, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    out = met.withColumn("locked", locked)
    sent = F.when((F.col("decision") == "ANSWERABLE") & (F.size("locked") > 0), F.concat("question", F.lit(" ("), F.array_join("locked", ", "), F.lit(")"))).otherwise(F.col("question"))
    return out.withColumn("sent", sent).select(*judged.columns, "locked", "sent")


def clarified(judged: DataFrame, grid: DataFrame, told: Callable[[Column], Column] = lambda choice: choice) -> DataFrame:
    """``judged`` with ``message``: for INCOMPLETE questions the choices that the grid holds (A-GA7).

    Choices are written once for each subject and list of jurisdictions, and questions fetch what
    ``told`` makes of them. ``judged`` is read twice: store it if it is dear.
    """
    several = F.size("jurisdictions") > 1
    own = F.when(several & F.col("subject_read"), F.col("jurisdictions"))
    x = judged.withColumns({"own_": own, "open_": F.coalesce(F.col("decision") == "INCOMPLETE", F.lit(False)) & ~F.coalesce(several & ~F.col("subject_read"), F.lit(False))})
    listed = lambda j: F.when(F.size(F.try_element_at("cells", j)) == 1, F.concat(j, F.lit(": using "), F.try_element_at("cells", j)[0])).when(F.size(F.try_element_at("cells", j)) > 1, F.concat(j, F.lit(": "), F.array_join(F.try_element_at("cells", j), ", "), F.lit(" - which one?"))).otherwise(F.concat(j, F.lit(": nothing held")))
    about = F.concat(F.lit("On "), F.translate("subject", "_", " "), F.lit(": "))
    asked = F.coalesce("own_", F.array_sort(F.map_keys("cells")))
    menus = x.filter("open_").select("subject", "own_").distinct().join(held(grid, F.col("names")), "subject")
    menus = menus.select(F.col("subject").alias("subject_"), F.col("own_").alias("for_"), told(F.concat(about, F.array_join(F.transform(asked, listed), "; "))).alias("choice_"))
    # a row for each subject of the grid and list that is asked: the grid's subjects are few
    met = x.join(F.broadcast(menus), F.col("open_") & (F.col("subject") == F.col("subject_")) & F.col("own_").eqNullSafe(F.col("for_")), "left")
    unread = F.lit("Which document or regulator should be used?")
    message = F.when(F.col("decision") == "INCOMPLETE", F.coalesce("choice_", unread))
    return met.withColumn("message", message).select(*judged.columns, "message")
