"""Markdown as a machine whose steps compose, so that any run of lines is one step; and edits of texts by section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle

#: What an open element is: plain text, or what an opening line began.
MODES = {"0": "TEXT", "1": "CODE", "2": "FORMULA", "3": "MIXED_VISUAL"}
SAME = "".join(MODES)
#: Lines to a block; only lines that change a mode are kept in it.
SPAN = 512


def _after(mode: Column, step: Column) -> Column:
    """A step names for each mode the one that follows it, so translate applies a step to a mode, and puts one step after another."""
    return F.call_function("translate", mode, F.lit(SAME), step)


def stripped(text: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\f"))


def line_features(line: Column, t: Column | None = None) -> dict[str, Column]:
    """What a line may begin or end; t is the line stripped, where that is a column already."""
    t = stripped(line) if t is None else t
    return {
        "marker": t.startswith("<!--") & t.rlike(r"(?i)^<!--\s*page\s*:\s*[0-9]{1,18}\s*-->"), "heading": t.startswith("#") & t.rlike(r"^#+\s+\S"), "fence": t.startswith("```"), "dollars": t.startswith("$$"),
        "figure": t.contains("<figure"), "closes": t.contains("</figure>"), "bar": line.contains("|"), "nothing": (t == "") | (t == "---"),
    }


def _step(f: dict[str, Column]) -> Column:
    plain = F.when(f["heading"], "0").when(f["fence"], "1").when(f["dollars"], "2").when(f["figure"] & ~f["closes"], "3").otherwise("0")
    ends = F.when(f["fence"], "0").otherwise("1"), F.when(f["dollars"], "0").otherwise("2"), F.when(f["closes"], "0").otherwise("3")
    return F.when(f["marker"], "0000").otherwise(F.concat(plain, *ends))


def mode_changes(lines: DataFrame) -> DataFrame:
    """lines(doc_id, chunk_index, content) -> (doc_id, chunk_index, mode): the mode after each line that can change one.

    The steps of a block of lines compose to one step; a document's blocks in order give the mode each begins in, and then the blocks
    are walked at the same time. No task holds a document's lines, one at most the steps of its blocks, four characters each.
    """
    own = lines.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.coalesce("content", F.lit("")).alias("line")).withColumn("t", stripped(F.col("line")))
    # by a lambda, as the filter repeats the step and both as plain columns make a method too large to be compiled; written, as it is read twice
    step = F.get(F.transform(F.array(F.struct("line", "t")), lambda r: _step(line_features(r["line"], r["t"]))), 0)
    steps = settle(own.select("doc_id", "chunk_index", step.alias("step")).where(F.col("step") != SAME))
    block = F.floor(F.col("chunk_index") / SPAN)
    blocks = steps.groupBy("doc_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("chunk_index", "step"))).alias("steps"))
    whole = F.aggregate("steps", F.lit(SAME), lambda a, x: _after(a, x["step"]))
    docs = blocks.select("doc_id", F.struct("block", whole.alias("step")).alias("b")).groupBy("doc_id").agg(F.sort_array(F.collect_list("b")).alias("b"))
    walk = lambda steps, first: F.aggregate(steps, first, lambda a, x: F.concat(a, _after(F.right(a, F.lit(1)), x["step"])))
    begins = docs.select(F.col("doc_id").alias("__d"), F.posexplode(F.col("b")["block"]).alias("__p", "__b"), walk(F.col("b"), F.lit("0")).alias("__w"))
    begins = begins.select("__d", "__b", F.substring("__w", F.col("__p") + 1, F.lit(1)).alias("first"))
    found = blocks.join(begins, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("block") == F.col("__b")))
    each = found.select("doc_id", walk(F.col("steps"), F.col("first")).alias("w"), F.posexplode(F.col("steps")["chunk_index"]).alias("p", "chunk_index"))
    return each.select("doc_id", "chunk_index", F.substring("w", F.col("p") + 2, F.lit(1)).alias("mode"))


def _in_modes(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """Lines with the mode each begins in. Changes ride along as rows of their own behind their line, so lines are shuffled once."""
    rows = lines.unionByName(changes.withColumn("__change", F.lit(True)), allowMissingColumns=True)
    change = F.col("__change").isNotNull()
    x = rows.withColumn("__m", F.last("mode", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("chunk_index", change).rowsBetween(Window.unboundedPreceding, 0)))
    return x.where(~change).withColumn("mode", F.coalesce("__m", F.lit("0"))).drop("__m", "__change")


def _marked_headings(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """Headings, from lines that look like one: (doc_id, number, depth, title)."""
    t = stripped(F.col("content"))
    x = _in_modes(lines.where(line_features(F.col("content"))["heading"]), changes).where("mode = '0'")
    w = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")).cast("long"))
    # the stack's depth is min(depth before + 1, rank): with i headings so far, i plus the least of 0 and every rank less its number
    rank = F.length(F.regexp_extract(t, "^(#+)", 1))
    x = x.withColumn("depth", F.col("number") + F.least(F.lit(0).cast("long"), F.min(rank - F.col("number")).over(w)))
    return x.select("doc_id", "number", "depth", stripped(F.regexp_replace(t, r"^#+\s+", "")).alias("title"))


def heading_paths(headings: DataFrame) -> DataFrame:
    """headings(doc_id, number, depth, title) -> (doc_id, number, path): a heading's titles from the top to itself.

    Depth rises by one at most from one heading to the next, so the title at a depth is the last one met there. Depths have no bound.
    """
    x = headings.withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("depth"))))
    w = Window.partitionBy("doc_id", "at").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("title", F.last(F.when(F.col("depth") == F.col("at"), F.col("title")), ignorenulls=True).over(w))
    return x.groupBy("doc_id", "number").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "title"))), lambda r: r["title"]).alias("path"))


def structure(lines: DataFrame) -> DataFrame:
    """lines(doc_id, chunk_index, content) of Markdown -> (doc_id, element, kind, page, path, first_line, lines, content).

    kind is HEADING, PARAGRAPH, TABLE, CODE, FORMULA or MIXED_VISUAL. A page marker gives the page from there on (1 before any) and ends whatever is open,
    even code; inside code, formulas and figures nothing else counts. Headings of any rank cut a stack of titles to their rank less one; path is that
    stack. Blank lines and rules part paragraphs and are no element. An element left open ends with the document. Content has no white space at its ends,
    but a heading is its whole line. A null content is a blank line; chunk_index is unique in a document, and a null doc_id is a document of its own.
    """
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    changes = settle(mode_changes(lines))
    own = lines.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.coalesce("content", F.lit("")).alias("content"))
    t = F.col("__t")
    f = line_features(F.col("content"), t)
    # what a line is in plain text; NONE are markers, which count in any mode
    plain = (
        F.when(f["marker"], "NONE").when(f["heading"], "HEADING").when(f["fence"], "CODE").when(f["dollars"], "FORMULA").when(f["figure"], "MIXED_VISUAL")
        .when(f["bar"], "TABLE").when(f["nothing"], None).otherwise("PARAGRAPH")
    )
    page = F.when(f["marker"], F.regexp_extract(t, "([0-9]+)", 1).cast("long"))
    x = _in_modes(own.withColumn("__t", stripped(F.col("content"))).withColumn("plain", plain).withColumn("page", page).drop("__t"), changes)
    outside = F.col("mode") == "0"
    open_kind = F.element_at(F.create_map(*[F.lit(v) for kv in MODES.items() for v in kv]), F.col("mode"))
    kind = F.when(F.col("plain").eqNullSafe("NONE"), None).when(~outside, open_kind).otherwise(F.col("plain"))
    x = x.withColumn("kind", kind).withColumn("page", F.coalesce(F.last("page", ignorenulls=True).over(so_far), F.lit(1)))
    opens = outside & F.col("kind").isin("HEADING", "CODE", "FORMULA", "MIXED_VISUAL")
    new = F.col("kind").isNotNull() & (opens | (outside & ~F.lag("kind").over(w).eqNullSafe(F.col("kind"))))
    x = x.withColumn("__new", new.cast("int")).withColumn("__head", F.col("kind").eqNullSafe("HEADING").cast("int"))
    x = x.withColumn("element", F.sum("__new").over(so_far)).withColumn("number", F.sum("__head").over(so_far))
    paths = heading_paths(_marked_headings(own, changes)).withColumnRenamed("doc_id", "__d").withColumnRenamed("number", "__n")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda r: r["content"]), "\n")
    e = x.where("kind IS NOT NULL").groupBy("doc_id", "element").agg(
        F.min("kind").alias("kind"), F.min("page").alias("page"), F.min("number").alias("number"), F.min("chunk_index").alias("first_line"), F.count("*").alias("lines"), text.alias("content")
    )
    e = e.join(paths, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("number") == F.col("__n")), "left")
    content = F.when(F.col("kind") == "HEADING", F.col("content")).otherwise(stripped(F.col("content")))
    return e.select("doc_id", "element", "kind", "page", F.coalesce("path", F.array().cast("array<string>")).alias("path"), "first_line", "lines", content.alias("content"))


def _first(text: Column, pattern: Column) -> Column:
    """What stands before the first match of a pattern, null if there is none. Lengths of it are code points, as substring takes them."""
    return F.when(F.rlike(text, F.concat(F.lit("(?md)"), pattern)), F.call_function("regexp_extract", text, F.concat(F.lit(r"(?mds)\A(.*?)"), pattern), F.lit(1)))


def section_span(text: Column, heading: Column) -> Column:
    """Start and end (code points from 0) of the section of the first heading of rank 1 to 6 with this title; it ends before the next heading of its rank or above. Null if there is none."""
    title = F.concat(F.lit(r"\Q"), F.replace(stripped(heading), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    here = F.concat(F.lit(r"^#{1,6}\s+"), title, F.lit(r"\s*$"))
    before = _first(text, here)
    line = F.regexp_substr(F.substring(text, F.length(before) + 1, F.length(text)), F.concat(F.lit("(?md)"), here))
    past = F.length(before) + F.length(line)
    rest = F.substring(text, past + 1, F.length(text))
    rank = F.length(F.regexp_extract(line, "^(#+)", 1))
    until = _first(rest, F.concat(F.lit("^#{1,"), rank.cast("string"), F.lit(r"}\s+")))
    end = F.coalesce(past + F.length(until), F.length(text))
    return F.when(before.isNotNull(), F.struct(F.length(before).cast("long").alias("start"), end.cast("long").alias("end")))


def _edit(text: Column, expected: Column | None, errors: list[tuple[Column, str]], made: Column) -> Column:
    """The text made, or the text as it was with the first error that holds. A digest that is null or empty is not compared."""
    digest = F.lit("") if expected is None else F.coalesce(expected, F.lit(""))
    why = F.when((digest != "") & (digest != F.sha2(text, 256)), "changed since it was read")
    for holds, says in errors:
        why = why.when(holds, says)
    return F.struct(F.when(why.isNull(), made).otherwise(text).alias("text"), why.alias("error"))


def replaced(text: Column, needle: Column, replacement: Column, everywhere: Column, expected: Column | None = None) -> Column:
    """struct(text, error): the first occurrence of a needle replaced, or all of them. An empty needle, or one not in the text, is an error."""
    text = F.coalesce(text, F.lit(""))
    at = F.call_function("locate", needle, text)
    once = F.concat(F.substring(text, F.lit(1), at - 1), replacement, F.substring(text, at + F.length(needle), F.length(text)))
    return _edit(text, expected, [(F.coalesce((needle == "") | (at == 0), F.lit(True)), "text not found")], F.when(everywhere, F.replace(text, needle, replacement)).otherwise(once))


def _joined(text: Column, start: Column, end: Column, between: Column) -> Column:
    return F.concat(F.regexp_replace(F.substring(text, F.lit(1), start), r"\s+\z", ""), between, F.regexp_replace(F.substring(text, end + 1, F.length(text)), r"\A\s+", ""))


def inserted(text: Column, section: Column, position: Column, heading: Column, expected: Column | None = None) -> Column:
    """struct(text, error): a section put BEFORE or AFTER the section of a heading, or at the END of the text, a blank line apart."""
    text, end = F.coalesce(text, F.lit("")), position == "END"
    span = section_span(text, heading)
    at = F.when(position == "BEFORE", span["start"]).otherwise(span["end"]).cast("int")
    last = F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit("\n\n"), stripped(section), F.lit("\n"))
    inside = _joined(text, at, at, F.concat(F.lit("\n\n"), stripped(section), F.lit("\n\n")))
    return _edit(text, expected, [(~end & span.isNull(), "heading not found")], F.when(end, last).otherwise(inside))


def deleted(text: Column, heading: Column, confirmed: Column, expected: Column | None = None) -> Column:
    """struct(text, error, preview): the section of a heading taken out; unless confirmed, only its first 1200 characters are shown."""
    text = F.coalesce(text, F.lit(""))
    span = section_span(text, heading)
    start, end = span["start"].cast("int"), span["end"].cast("int")
    sure = F.coalesce(confirmed, F.lit(False))
    e = _edit(text, expected, [(span.isNull(), "heading not found"), (~sure, "confirmation required")], F.concat(stripped(_joined(text, start, end, F.lit("\n\n"))), F.lit("\n")))
    preview = F.when(e["error"] == "confirmation required", F.substring(text, start + 1, F.least(end - start, F.lit(1200))))
    return F.struct(e["text"].alias("text"), e["error"].alias("error"), preview.alias("preview"))
