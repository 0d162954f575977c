"""Documents to sections and chunks (9.1-9.4): prefix sums over lines, split points from cumulative lengths; all in DataFrame functions.

A document's lines, pieces and chunks are rows; what depends on all rows before (fences, heading runs, lengths) are running sums. The two
greedy steps are folds over arrays of numbers, one per section and one per document, that only note where to cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sizes in characters, the title of a text without a complete section, and the separators, tried in this order.
MAX_CHARS, MIN_CHARS, OVERLAP = 1000, 600, 50
DEFAULT = "default"
SEPARATORS = ("\n", "。", "！")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _documents(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, doc (hash of the text), copies, text: equal rows are cut once and given out as often as they occur."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("id", "text").agg(F.count("*").alias("copies")).select("id", F.xxhash64("text", F.length("text")).alias("doc"), "copies", "text")


def _sections(docs: DataFrame) -> DataFrame:
    """id, doc, copies, section (from 0), title (null for the default section) and its lines."""
    lines = docs.select("id", "doc", "copies", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("at", "line")).withColumn("line", _stripped(F.col("line"))).where("line <> ''")
    order = Window.partitionBy("id", "doc").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.startswith("line", F.lit("```")) | F.startswith("line", F.lit("~~~"))
    lines = lines.withColumn("fence", fence).withColumn("open", F.sum(F.col("fence").cast("int")).over(order) % 2 == 1)
    heading = ~F.col("fence") & ~F.col("open") & F.col("line").rlike(r"^#{1,6}\s.+")
    lines = lines.withColumn("run", F.sum(heading.cast("int")).over(order))
    runs = lines.groupBy("id", "doc", "copies", "run").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("lines"))
    whole = (F.col("run") > 0) & (F.size("lines") > 1)
    of = Window.partitionBy("id", "doc")
    runs = runs.withColumn("whole", whole).withColumn("any", F.max("whole").over(of)).withColumn("last", F.max("run").over(of)).where("whole OR (NOT any AND run = last)")
    number = F.row_number().over(of.orderBy("run")) - 1
    return runs.select("id", "doc", "copies", number.alias("section"), F.when(F.col("whole"), F.get("lines", F.lit(0))).alias("title"), "lines")


def title_sections(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, section (from 0), title, content of every heading's section (9.1).

    Lines are stripped and blank ones go; a heading is one to six # and text outside of ``` or ~~~ fences; its line is the title and the first
    line of the content. Text before the first heading and headings without a body give nothing; a document without any complete section
    is one section `default` of the lines since its last heading. Null and blank texts give nothing; ids may be null or repeated.
    """
    found = _sections(_documents(df, id_col, text))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return found.select(F.col("id").alias(id_col), F.col("section").cast("long").alias("section"), F.coalesce("title", F.lit(DEFAULT)).alias("title"), F.array_join("lines", "\n").alias("content"), copies).drop("copy")


def _cut(text: Column, size: Column, *marks: str) -> Column:
    """The text before each occurrence of the first mark that it has; a text shorter than `size` stays whole."""
    out = F.array(text)
    for mark in reversed(marks):
        out = F.when(F.contains(text, F.lit(mark)), F.split(text, f"(?={mark})")).otherwise(out)
    return F.when(F.length(text) < size, F.array(text)).otherwise(out)


#: Where to cut units of cumulative lengths `cum` (from 0): a chunk ends before the unit that would exceed `size`; the next one starts with the
#: last units that fit into the overlap and leave room for that unit.
_CUTS = """aggregate(sequence(0, size(units) - 1), named_struct('cuts', CAST(array() AS array<struct<lo:int,hi:int>>), 'lo', 0),
  (s, i) -> IF(cum[i + 1] - cum[s.lo] > size AND i > s.lo, named_struct('cuts', concat(s.cuts, array(named_struct('lo', s.lo, 'hi', i))),
    'lo', s.lo + size(filter(slice(cum, s.lo + 1, i - s.lo), c -> cum[i] - c > {overlap} OR cum[i + 1] - c > size))), s),
  s -> concat(s.cuts, array(named_struct('lo', s.lo, 'hi', size(units)))))"""

#: Which neighbouring chunks become one: while the first is short, of the same parent, and the sum stays within the limit.
_MERGES = """aggregate(slice(chunks, 2, size(chunks)), named_struct('cuts', CAST(array() AS array<struct<lo:int,hi:int>>), 'lo', 0, 'hi', 1, 'n', length(chunks[0].content)),
  (s, c) -> IF(s.n < {least} AND chunks[s.lo].parent IS NOT NULL AND chunks[s.lo].parent = c.parent AND s.n + 1 + length(c.body) <= {most},
    named_struct('cuts', s.cuts, 'lo', s.lo, 'hi', s.hi + 1, 'n', s.n + 1 + length(c.body)),
    named_struct('cuts', concat(s.cuts, array(named_struct('lo', s.lo, 'hi', s.hi))), 'lo', s.hi, 'hi', s.hi + 1, 'n', length(c.content))),
  s -> concat(s.cuts, array(named_struct('lo', s.lo, 'hi', s.hi))))"""


def _pieces(sections: DataFrame, max_chars: int, overlap: int) -> DataFrame:
    """id, doc, section, part (from 1), body: pieces of the long sections (9.2)."""
    title = F.coalesce("title", F.lit(DEFAULT))
    rows = sections.where(F.length(F.array_join("lines", "\n")) > max_chars).withColumn("size", F.greatest(F.lit(max_chars) - F.length(title) - 1, F.lit(overlap + 1)))
    body = F.when(F.col("title").isNotNull(), F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines"))
    # a line keeps the break before it, a sentence the mark before it
    one = rows.select("id", "doc", "section", "size", "title", F.posexplode(body).alias("u1", "line")).withColumn("unit", F.when((F.col("u1") == 0) & F.col("title").isNull(), F.col("line")).otherwise(F.concat(F.lit("\n"), F.col("line"))))
    two = one.select("id", "doc", "section", "size", "u1", F.length("unit").alias("l1"), F.posexplode(_cut(F.col("unit"), F.col("size"), *SEPARATORS[1:])).alias("u2", "unit"))
    three = two.select("id", "doc", "section", "size", "u1", "u2", "l1", F.length("unit").alias("l2"), F.posexplode(_cut(F.col("unit"), F.col("size"), SEPARATORS[2])).alias("u3", "unit")).where("unit <> ''")
    # units are joined only with those of their own level and parent, and a unit that nothing cuts stands alone
    level = F.when(F.col("l1") < F.col("size"), F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"))).when(F.col("l2") < F.col("size"), F.struct(F.col("u1").alias("a"), F.lit(-1).alias("b"))).otherwise(F.struct(F.col("u1").alias("a"), F.col("u2").alias("b")))
    of = Window.partitionBy("id", "doc", "section").orderBy("u1", "u2", "u3")
    three = three.withColumn("level", level).withColumn("alone", F.length("unit") >= F.col("size"))
    starts = F.col("alone") | F.coalesce(F.lag("alone").over(of), F.lit(True)) | ~F.col("level").eqNullSafe(F.lag("level").over(of))
    three = three.withColumn("group", F.sum(starts.cast("int")).over(of))
    three = three.withColumn("end", F.sum(F.length("unit")).over(of.partitionBy("id", "doc", "section", "group").rowsBetween(Window.unboundedPreceding, 0)))
    groups = three.groupBy("id", "doc", "section", "size", "group").agg(F.sort_array(F.collect_list(F.struct("u1", "u2", "u3", "unit", "end"))).alias("units"))
    groups = groups.withColumn("cum", F.concat(F.array(F.lit(0).cast("long")), F.transform("units", lambda u: u["end"])))
    cut = groups.select("id", "doc", "section", "group", "units", F.posexplode(F.expr(_CUTS.format(overlap=overlap))).alias("n", "cut"))
    text = _stripped(F.array_join(F.transform(F.slice("units", F.col("cut.lo") + 1, F.col("cut.hi") - F.col("cut.lo")), lambda u: u["unit"]), ""))
    cut = cut.select("id", "doc", "section", "group", "n", text.alias("body")).where("body <> ''")
    return cut.select("id", "doc", "section", F.row_number().over(Window.partitionBy("id", "doc", "section").orderBy("group", "n")).alias("part"), "body")


def recursive_chunks(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """id, chunk_index (from 0), title, parent_title, part (from 1), content (9.4).

    Sections of over max_chars are cut at line breaks, lines that are too long at the other separators in turn, and joined again up to the
    limit, each piece repeating up to `overlap` characters of whole units before it and led by the section's title (9.2). A unit without
    any separator stays whole, however long. Neighbouring pieces of one section are joined while the first has under min_chars and both fit
    (9.3). Parts are counted anew for each parent; titles are <parent>_<part>. Ids may be null or repeated; null and blank texts give nothing.
    """
    sections = _sections(_documents(df, id_col, text))
    whole = F.array_join("lines", "\n")
    short = sections.where(F.length(whole) <= max_chars).select("id", "doc", "copies", "section", F.lit(0).alias("part"), F.lit(None).cast("string").alias("parent"), F.coalesce("title", F.lit(DEFAULT)).alias("own"), whole.alias("content"), F.lit("").alias("body"))
    own = sections.select("id", "doc", "section", "copies", F.coalesce("title", F.lit(DEFAULT)).alias("own"))
    pieces = _pieces(sections, max_chars, overlap).alias("p")
    long = pieces.join(own.alias("o"), F.col("p.id").eqNullSafe(F.col("o.id")) & (F.col("p.doc") == F.col("o.doc")) & (F.col("p.section") == F.col("o.section")))
    long = long.select("p.id", "p.doc", "copies", "p.section", "part", F.col("own").alias("parent"), "own", F.concat_ws("\n", "own", "body").alias("content"), "body")
    docs = short.unionByName(long).groupBy("id", "doc", "copies").agg(F.sort_array(F.collect_list(F.struct("section", "part", "parent", "own", "content", "body"))).alias("chunks"))
    merged = docs.select("id", "doc", "copies", "chunks", F.posexplode(F.expr(_MERGES.format(least=min_chars, most=max_chars))).alias("chunk_index", "cut"))
    first = F.get("chunks", F.col("cut.lo"))
    more = F.transform(F.slice("chunks", F.col("cut.lo") + 2, F.col("cut.hi") - F.col("cut.lo") - 1), lambda c: F.concat(F.lit("\n"), c["body"]))
    rows = merged.select("id", "doc", "copies", "chunk_index", first["parent"].alias("parent"), first["own"].alias("own"), F.concat(first["content"], F.array_join(more, "")).alias("content"))
    by = Window.partitionBy("id", "doc").orderBy("chunk_index")
    starts = F.col("parent").isNull() | ~F.col("parent").eqNullSafe(F.lag("parent").over(by))
    rows = rows.withColumn("run", F.sum(starts.cast("int")).over(by)).withColumn("part", F.row_number().over(by.partitionBy("id", "doc", "run")))
    out = rows.select(F.col("id").alias(id_col), F.col("chunk_index").cast("long").alias("chunk_index"), F.concat_ws("_", "own", F.col("part").cast("string")).alias("title"), F.col("own").alias("parent_title"), "part", "content", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.drop("copy")
