"""Line dedup by a join of deletion neighbourhoods.

A line is dropped when an earlier line is at most one edit (insertion, deletion, substitution of a
character) away, equal lines included; earlier means by document id, line number, then text
key. Only lines of ``min_chars`` characters or more, without the ASCII white space around them, take
part; all others stay. Whether the earlier line is dropped itself does not matter, so the
result does not depend on any order of work.

Equal lines are summed to one row each first. A line then emits its variants within the bound,
itself and itself less one character, as hashed keys; lines that meet under a key are checked by
edit distance, each against the earliest it met. Under the key (length, place, variant) any two
lines differ in that one place, and under the key (variant) a line meets those one character
longer, so the earliest of each side stands for all of them and a key that very many lines
share costs each of them one comparison.

Emitting variants of every line would cost a row a character. Narrowing joins come first, all
exact: a line takes part only if it equals some other line outside one of its halves, then
outside an eighth of it within that half, then outside a 64th within that eighth, and so on in
lines that are longer than WIDEST characters a segment, the longer of two lines being cut like the
shorter one. Variants then lack a character of such a segment; every pair within the bound passes,
as its edit lies in some segment at each step. So a line costs its length at each step.

Defined cases: a null text stays null and has no lines; an empty text has one empty line; rows
without an id come before all others; repeated rows are at the same place and keep the same
lines; an empty table gives no rows; other columns are passed through by ``drop_lines``, except one
that has the name of a column it adds, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import checkpointed, let_go, written

#: Line numbers to drop are broadcast for up to so many texts (16 bytes and a few numbers each).
BROADCAST_TEXTS = 500_000
FIRST = -(1 << 63)
#: Segments of the further narrowing joins, and characters of a segment beyond which there are more.
NARROWER, WIDEST = (8, 64), 32
LINE = ["k1", "k2"]
PLACE = ["rid", "line_no", "content"]


def segment_key(line: Column, parts: int, j: Column, longer: Column | int) -> Column:
    """A key of a line less its j-th of ``parts`` segments; ``longer`` 1 for the longer of two lines,
    which is cut like the shorter one and loses one character more."""
    n = F.length(line).cast("long") - longer
    start, stop = F.floor(n * j / parts).cast("int"), F.floor(n * (j + 1) / parts).cast("int") + longer
    return F.xxhash64(n, j, F.substring(line, F.lit(1), start), F.substring(line, stop + 1, F.length(line)))


def halves_of(line: Column) -> Column:
    return F.array(*(segment_key(line, 2, F.lit(j), longer) for longer in (0, 1) for j in (0, 1)))


def line_rows(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """rid, content, line_no and line of the lines that take part."""
    # Keyed and split below the generator, which would do both again for every line.
    texts = docs.filter(F.col(text_col).isNotNull()).select(rid(id_col).alias("rid"), F.xxhash64(text_col).alias("content"), F.split(F.col(text_col), "\n").alias("lines"))
    rows = texts.select("rid", "content", F.posexplode("lines").alias("line_no", "line"))
    trimmed = F.trim(F.col("line"), F.lit(" \t\r\x0b\x0c"))
    return rows.select("rid", "content", "line_no", trimmed.alias("line")).filter(F.length("line") >= min_chars)


def rid(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST).cast("long"))


def in_company(spread: DataFrame) -> DataFrame:
    """The rows of (..., key) whose key stands in another row too."""
    many = spread.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1").select("key")
    return spread.join(many, "key").drop("key")


def narrowed(segments: DataFrame, text: DataFrame, parts: int, finer: int) -> DataFrame:
    """Of (k1, k2, longer, j): the ``finer`` segments within them outside which lines agree."""
    within = F.explode(F.sequence(F.col("j") * (finer // parts), (F.col("j") + 1) * (finer // parts) - 1)).alias("j")
    rows = segments.join(text.select(*LINE, "line"), LINE).select(*LINE, "line", "longer", within)
    return in_company(rows.select(*LINE, "longer", "j", segment_key(F.col("line"), finer, F.col("j"), F.col("longer")).alias("key")))


def narrow_enough(segments: DataFrame, text: DataFrame, parts: int) -> DataFrame:
    """(k1, k2, longer, j, parts): the segments, those of long lines narrowed to WIDEST characters."""
    done = segments.withColumn("parts", F.lit(parts))
    while True:
        long_lines = text.filter(F.length("line") > parts * WIDEST)
        wide = checkpointed(segments.join(long_lines.select(*LINE), LINE))
        if wide.limit(1).count() == 0:
            return done
        segments = checkpointed(narrowed(wide, long_lines, parts, 8 * parts))
        done = done.join(wide.select(*LINE, F.lit(parts).alias("parts")).distinct(), [*LINE, "parts"], "left_anti")
        parts *= 8
        done = checkpointed(done.unionByName(segments.withColumn("parts", F.lit(parts))))


def texts_of(docs: DataFrame, wanted: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """Lines of the wanted places (PLACE of k1, k2), read again from the documents."""
    by_text = checkpointed(wanted.groupBy("rid", "content").agg(F.collect_set("line_no").alias("at")))
    # Split before the join: an expression inside the transform would split once a wanted line.
    rows = docs.filter(F.col(text_col).isNotNull()).select(rid(id_col).alias("rid"), F.xxhash64(text_col).alias("content"), F.split(F.col(text_col), "\n").alias("lines"))
    found = rows.join(bounded(by_text), ["rid", "content"])
    lines = found.select("rid", "content", F.explode(F.transform("at", lambda i: F.struct(i.alias("line_no"), F.get("lines", i).alias("line")))).alias("x"))
    trimmed = F.trim(F.col("x.line"), F.lit(" \t\r\x0b\x0c"))
    return lines.select("rid", "x.line_no", "content", trimmed.alias("line")).dropDuplicates(PLACE)


def bounded(by_text: DataFrame) -> DataFrame:
    return F.broadcast(by_text) if by_text.count() <= BROADCAST_TEXTS else by_text


def near_lines(docs: DataFrame, lines: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, before): lines with an earlier line one edit away, and the earliest such place."""
    spread = lines.select(*LINE, F.posexplode("halves").alias("seg", "key"))
    segments = checkpointed(in_company(spread).select(*LINE, F.floor(F.col("seg") / 2).cast("int").alias("longer"), (F.col("seg") % 2).alias("j")))
    some = lines.join(segments.select(*LINE).distinct(), LINE).select(*LINE, "place.*")
    text = checkpointed(texts_of(docs, some, min_chars, id_col, text_col).join(some, PLACE))
    parts = 2
    for finer in NARROWER:
        segments = checkpointed(narrowed(segments, text, parts, finer))
        parts = finer
    segments = narrow_enough(segments, text, parts)
    few = text.join(segments.select(*LINE).distinct(), LINE).select(*LINE, F.struct(*PLACE).alias("place"), "line")
    # Numbers that rise with the place stand for the lines.
    few = checkpointed(few.orderBy("place").withColumn("no", F.monotonically_increasing_id()))

    # The character that a variant lacks lies in a segment outside which the line agrees with another.
    n = F.length("line").cast("long") - F.col("longer")
    first, last = F.floor(n * F.col("j") / F.col("parts")).cast("int") + 1, F.floor(n * (F.col("j") + 1) / F.col("parts")).cast("int") + F.col("longer")
    lacking = segments.join(few, LINE).filter(first <= last).select("no", "longer", "line", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("i")).distinct()
    variant = F.xxhash64(F.expr("concat(substring(line, 1, i - 1), substring(line, i + 1))"))
    # Side 0: lines less the character at one place; 1: lines less any character; 2: whole lines.
    key = F.when(F.col("longer") == 0, F.xxhash64(F.length("line"), "i", variant)).otherwise(F.xxhash64(F.length("line") - 1, F.lit(0), variant))
    less = lacking.select("no", key.alias("key"), F.col("longer").alias("side"), "i")
    whole = few.select("no", F.xxhash64(F.length("line"), F.lit(0), F.xxhash64("line")).alias("key"), F.lit(2).alias("side"), F.lit(0).alias("i"))
    emitted = written(less.union(whole))
    earliest = emitted.groupBy("key", "side").agg(F.min(F.struct("no", "i")).alias("b"))
    met = checkpointed(earliest.select("key", F.when(F.col("side") == 0, 0).otherwise(3 - F.col("side")).alias("side"), F.col("b.no").alias("before"), F.col("b.i").alias("before_i")))
    pairs = emitted.join(met, ["key", "side"]).filter("before < no").select("no", "before", "i", "before_i").distinct()
    mine = few.select(*LINE, "no", F.col("line").alias("mine"))
    theirs = few.select(F.col("no").alias("before"), F.col("line").alias("theirs"), "place")
    # Lines that are equal less the characters which their keys lack are one edit apart at most.
    same = "concat(substring(mine, 1, i - 1), substring(mine, i + 1)) = concat(substring(theirs, 1, before_i - 1), substring(theirs, before_i + 1))"
    at = F.expr("case when i > 0 and before_i > 0 then i = before_i and length(mine) = length(theirs) and " + same + " when i > 0 then concat(substring(mine, 1, i - 1), substring(mine, i + 1)) = theirs else mine = concat(substring(theirs, 1, before_i - 1), substring(theirs, before_i + 1)) end")
    checked = pairs.join(mine, "no").join(theirs, "before").filter(at)
    return checked.groupBy(*LINE).agg(F.min("place").alias("before"))


def dropped_lines(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, content, dropped): the numbers of the lines to drop, for texts that lose any."""
    text = F.col("line")
    keyed = line_rows(docs, min_chars, id_col, text_col).select(*PLACE, F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), halves_of(text).alias("halves"))
    every = written(keyed)
    lines = written(every.groupBy(*LINE).agg(F.min(F.struct(*PLACE)).alias("place"), F.count("*").alias("times"), F.first("halves").alias("halves")))
    near = near_lines(docs, lines, min_chars, id_col, text_col)
    let_go(docs.sparkSession)
    before = lines.join(near, LINE, "left").select(*LINE, "times", "place", F.least("place", F.coalesce("before", "place")).alias("first"))
    first = checkpointed(before.filter("times > 1 or first < place").select(*LINE, "first"))
    gone = every.select(*LINE, *PLACE).join(first, LINE).filter(F.struct(*PLACE) > F.col("first"))
    return checkpointed(gone.groupBy("rid", "content").agg(F.collect_set("line_no").alias("dropped")))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_lines(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "n_lines_", n_dropped: str = "n_dropped_") -> DataFrame:
    """``docs`` with shortened texts and two more columns: lines there were, lines dropped."""
    gone = dropped_lines(docs, min_chars, id_col, text_col)
    let_go(docs.sparkSession)
    rid_, content_, lines_, dropped_ = (unused(docs, x) for x in ("rid", "content", "lines", "dropped"))
    keys = docs.withColumns({rid_: rid(id_col), content_: F.xxhash64(text_col), lines_: F.split(F.col(text_col), "\n")}).drop(text_col)
    found = bounded(gone).select(F.col("rid").alias(rid_), F.col("content").alias(content_), F.col("dropped").alias(dropped_))
    met = keys.join(found, [rid_, content_], "left")
    size = F.coalesce(F.size(lines_), F.lit(0)).cast("long")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.col(dropped_))
    kept = F.when(F.col(dropped_).isNull(), F.col(lines_)).otherwise(F.transform(left, lambda i: F.get(lines_, i)))
    new = {text_col: F.array_join(kept, "\n"), n_lines: size, n_dropped: F.coalesce(F.size(dropped_), F.lit(0)).cast("long")}
    passed = [c for c in docs.columns if c not in (n_lines, n_dropped)]
    return met.select(*(new[c].alias(c) if c == text_col else F.col(c) for c in passed), *(new[c].alias(c) for c in (n_lines, n_dropped)))


def keep_lines(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated lines; a text that loses lines and has no word left goes."""
    n_lines, n_dropped = unused(docs, "n_lines"), unused(docs, "n_dropped")
    cut = drop_lines(docs, min_chars, id_col, text_col, n_lines, n_dropped)
    return cut.filter((F.col(n_dropped) == 0) | F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
