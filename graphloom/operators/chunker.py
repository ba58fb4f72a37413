"""Structure-aware chunking: lines, elements, section stacks and chunks, as window and array expressions."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import roman_value, strip

#: Heading families in the order of detection: name, what stands before the mark, the mark, Roman or not.
FAMILIES = (
    ("phan", r"[Pp][Hh][Ầầ][Nn]\s+", "[IVX]+", True),
    ("chuong", r"[Cc][Hh][Ưư][Ơơ][Nn][Gg]\s+", "[IVX]+", True),
    ("uppercase_alphabetical", "", "[A-HJ-UW-Z]", False),
    ("roman", "", "[IVX]+", True),
    ("muc", r"[Mm][Ụụu][Cc]\s+", r"\d+", False),
    ("sub_decimal", "", r"\d+\.\d+\.\d+", False),
    ("decimal", "", r"\d+\.\d+", False),
    ("arabic", "", r"\d+", False),
    ("alphabetical", "", "[a-z]", False),
)
#: The families from the outermost to the innermost level.
HIERARCHY = ("phan", "chuong", "uppercase_alphabetical", "roman", "muc", "arabic", "decimal", "sub_decimal", "alphabetical")
#: Special sections, what their header lines look like (any case) and their display names.
SPECIAL = (
    ("appendix", r"phụ\s+lục\s*(\d*|\s[ivx]+)|appendix(\s+[a-z0-9]+)?", "Phụ lục"),
    ("footnote", r"chú\s+thích|notes?", "Chú thích"),
    ("reference", r"tài\s+liệu\s+tham\s+khảo|references?", "Tài liệu tham khảo"),
)
ROW = r"(?dU)^\s*\|.*\|\s*$"


def special_section(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern, _ in reversed(SPECIAL):
        out = F.when(strip(line).rlike(f"(?diuU)^({pattern})$"), name).otherwise(out)
    return out


def _marked(line: Column) -> Column:
    """The stripped line from its first run of # on, with one space after the run."""
    return F.regexp_replace(strip(line), r"(?dU)^[^#]*?(#+)\s*", "$1 ")


def heading_pattern(line: Column) -> Column:
    """markdown_N, a family's name, or null."""
    out = F.lit(None).cast("string")
    for name, before, mark, roman in reversed(FAMILIES):
        pattern = rf"(?dU)^{before}({mark})[.)]\s+(.+)$"
        hit = strip(line).rlike(pattern)
        if roman:
            hit &= roman_value(F.regexp_extract(strip(line), pattern, 1)).isNotNull()
        out = F.when(hit, name).otherwise(out)
    hashes = F.length(F.regexp_extract(_marked(line), r"(?dU)^(#{1,9})\s+(.+)$", 1))
    return F.when(hashes > 0, F.concat(F.lit("markdown_"), hashes.cast("string"))).otherwise(out)


def heading_text(line: Column, pattern: Column) -> Column:
    s = strip(line)
    out = s
    for name, before, mark, _ in FAMILIES:
        regex = rf"(?dU)^{before}({mark})[.)]\s+(.+)$"
        joined = F.concat(F.regexp_extract(s, regex, 1), F.lit(". "), F.regexp_extract(s, regex, 2))
        out = F.when((pattern == name) & ~F.endswith(s, F.lit(".")), joined).otherwise(out)
    return F.when(F.startswith(pattern, F.lit("markdown_")), F.regexp_extract(_marked(line), r"(?dU)^#{1,9}\s+(.+)$", 1)).otherwise(out)


def lines(docs: DataFrame, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """doc_id, i, line, special, pattern, is_row, kind: what a line is on its own."""
    each = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(content, "\n")).alias("i", "line"))
    each = each.withColumn("special", special_section(F.col("line"))).withColumn("pattern", heading_pattern(F.col("line"))).withColumn("is_row", F.col("line").rlike(ROW))
    kind = F.when(F.length(strip(F.col("line"))) == 0, "blank").when(F.col("special").isNotNull(), "special").when(F.col("pattern").isNotNull(), "heading").when(F.col("is_row"), "row").otherwise("text")
    return each.withColumn("kind", kind)


def elements(found: DataFrame) -> DataFrame:
    """One row per element: doc_id, e, kind, content, first and last line, pattern, heading_text, special."""
    by = Window.partitionBy("doc_id").orderBy("i")
    breaker = ~F.col("is_row") & (F.col("kind") != "blank")
    began = F.max(F.when(F.col("kind") == "row", F.col("i"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    ended = F.max(F.when(breaker, F.col("i"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    g = found.withColumn("open", F.coalesce(began > F.coalesce(ended, F.lit(-1)), F.lit(False)))
    kind = F.when(F.col("open") & F.col("is_row"), "row").when(F.col("open") & (F.col("kind") == "blank"), "gap").otherwise(F.col("kind"))
    g = g.withColumn("kind", kind)
    lone = (F.col("kind") == "blank") & (F.lag("kind").over(by) == "text") & (F.coalesce(F.lead("kind").over(by), F.lit("end")) != "blank")
    g = g.withColumn("kind", F.when(lone, "absorbed").otherwise(F.col("kind"))).withColumn("was", F.lag("kind").over(by))
    fresh = F.col("kind").isin("heading", "special", "blank") | ((F.col("kind") == "text") & ~F.coalesce(F.col("was").isin("text", "absorbed"), F.lit(False))) | ((F.col("kind") == "row") & ~F.col("open"))
    g = g.withColumn("e", F.sum(fresh.cast("int")).over(by)).filter(~F.col("kind").isin("blank", "gap"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    first = lambda c: F.min_by(c, "i")
    out = g.groupBy("doc_id", "e").agg(
        F.when(first("kind") == "row", "table").when(first("kind") == "text", "paragraph").otherwise(first("kind")).alias("kind"),
        whole.alias("content"), F.min("i").alias("first"), F.max("i").alias("last"), first("pattern").alias("pattern"), first("special").alias("special"), first("line").alias("line"),
    )
    text = F.when(F.col("kind") == "heading", heading_text(F.col("line"), F.col("pattern")))
    active = F.last("special", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("e"))
    return out.withColumn("pattern", F.when(F.col("kind") == "heading", F.col("pattern"))).withColumn("heading_text", text).withColumn("active", active).drop("line")


#: Marks of the deepest Markdown heading; with the numbered families, as deep as a stack can be.
MARKDOWN = 9


def levelled(found: DataFrame) -> DataFrame:
    """Elements with level (headings) and stack, the headings they stand under, by windows over a document's elements.

    A heading of level L cuts the stack to L - 1 and is put on top, and the stack begins anew where a special section does.
    So the n-th heading since then has the place len(n) = min(len(n - 1) + 1, L(n)), which unrolls to n plus the least of 0
    and of all L(m) - m so far: a running minimum. And what stands at a place of the stack is the last heading with that
    place. All of that is running windows in one partitioning, so a document of many headings is as many rows."""
    by, whole = Window.partitionBy("doc_id").orderBy("e"), Window.partitionBy("doc_id")
    depth = F.when(F.startswith("pattern", F.lit("markdown_")), F.substring("pattern", 10, 2).cast("int"))
    row = found.withColumns({"level": depth, "own": F.when(F.col("kind") != "special", F.col("active"))})
    row = row.withColumns({"most": F.coalesce(F.max("level").over(whole), F.lit(0)), "patterns": F.collect_set("pattern").over(whole), "was": F.lag("own").over(by)})
    present = F.filter(F.array(*[F.lit(x) for x in HIERARCHY]), lambda p: F.array_contains("patterns", p))
    below = F.when(F.col("pattern").isNotNull(), F.col("most") + F.array_position(present, F.col("pattern")).cast("int"))
    scope = F.sum((~F.col("own").eqNullSafe(F.col("was"))).cast("int")).over(by)
    row = row.withColumns({"level": F.coalesce("level", below), "scope": scope})
    within, heading = Window.partitionBy("doc_id", "scope").orderBy("e").rowsBetween(Window.unboundedPreceding, 0), F.col("kind") == "heading"
    row = row.withColumn("n", F.sum(heading.cast("int")).over(within).cast("int"))
    least = F.min(F.when(heading, F.col("level") - F.col("n"))).over(within)
    row = row.withColumn("place", F.when(heading, F.col("n") + F.least(F.lit(0), least)))
    last = [F.last(F.when(F.col("place") == k, F.col("heading_text")), ignorenulls=True).over(within).alias(f"at{k}") for k in range(1, MARKDOWN + len(HIERARCHY) + 1)]
    held = row.select("*", *last)
    stack = F.when(heading, F.slice(F.array(*[f"at{k}" for k in range(1, len(last) + 1)]), F.lit(1), F.col("place")))
    return held.select(*found.columns, "level", stack.alias("stack"))


def words(text: Column) -> Column:
    """How many words a text has: the token count where no vocabulary is given."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def tokens_by(path: str) -> Callable[[Column], Column]:
    """Token counts by a vocabulary in the tokenizers library's format, whose file every executor finds at path."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        counted = counter_of(path)
        return texts.map(lambda t: None if t is None else counted(t))

    return count


@lru_cache(maxsize=4)
def counter_of(path: str | None) -> Callable[[str], int]:
    """The same counts as a function of a text, on an executor."""
    if path is None:
        return lambda t: len(t.split())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


def chunks(docs: DataFrame, doc_id: str = "doc_id", content: str = "content", size: int = 2048, count: Callable[[Column], Column] = words) -> DataFrame:
    """The chunks of documents: doc_id, chunk (from 0), chunk_type, level, hierarchy, content (null for headers), heading_text,
    special_section, element_count, contains_table, tokens (by count), is_oversized."""
    edge = F.col("kind").isin("heading", "special")
    e = levelled(elements(lines(docs, doc_id, content)))
    e = e.withColumn("b", F.sum(edge.cast("int")).over(Window.partitionBy("doc_id").orderBy("e")))  # a heading and what follows it
    head = lambda c: F.max(F.when(edge, F.col(c))).alias(c)
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~edge, F.struct("e", "content")))), lambda x: x["content"]), "\n\n")
    blocks = e.groupBy("doc_id", "b").agg(
        head("level"), head("stack"), head("heading_text"), head("special"), F.max("active").alias("active"), parts.alias("content"),
        F.count_if(~edge).alias("n"), F.max(F.col("kind") == "table").alias("tabular"), F.max(F.when(edge, F.col("kind"))).alias("kind"),
    )
    blocks = blocks.withColumn("closed_by", F.lead("kind").over(Window.partitionBy("doc_id").orderBy("b")))
    name = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, _, v in SPECIAL])
    none = F.array().cast("array<string>")
    prefixed = lambda s, stack: F.concat(F.when(s.isNull(), none).otherwise(F.array(name(s))), F.coalesce(stack, none))
    heading, special = F.col("kind") == "heading", F.col("kind") == "special"
    shown = F.when(F.coalesce(F.col("closed_by"), F.lit("")) != "special", F.col("active"))
    header = F.struct(
        F.lit(0).alias("o"), F.when(special | (F.col("level") == 1), "section").otherwise("subsection").alias("chunk_type"),
        F.when(special, 1).otherwise(F.col("level")).alias("level"),
        F.when(special, F.array(name(F.col("special")))).otherwise(prefixed(F.col("active"), F.col("stack"))).alias("hierarchy"),
        F.lit(None).cast("string").alias("content"), "heading_text", F.col("active").alias("special_section"), F.lit(1).cast("long").alias("element_count"), F.lit(False).alias("contains_table"),
    )
    body = F.struct(
        F.lit(1).alias("o"), F.when(F.col("tabular"), "table").otherwise("paragraph").alias("chunk_type"),
        F.when(heading, F.col("level") + 1).otherwise(1).alias("level"), prefixed(shown, F.when(heading, F.col("stack"))).alias("hierarchy"),
        "content", "heading_text", shown.alias("special_section"), F.col("n").alias("element_count"), F.col("tabular").alias("contains_table"),
    )
    both = blocks.select("doc_id", "b", F.explode(F.array_compact(F.array(F.when(F.col("kind").isNotNull(), header), F.when(F.col("n") > 0, body)))).alias("c")).select("doc_id", "b", "c.*")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("b", "o")) - 1
    tokens = F.coalesce(count(F.col("content")), F.lit(0))
    return both.withColumn("chunk", place).withColumn("tokens", tokens).withColumn("is_oversized", F.col("tokens") > size).drop("b", "o")


def structure_tree(found: DataFrame) -> DataFrame:
    """Per document and prefix of a section hierarchy the number of its chunks."""
    prefixes = F.explode(F.when(F.size("hierarchy") > 0, F.transform(F.sequence(F.lit(1), F.size("hierarchy")), lambda i: F.array_join(F.slice("hierarchy", F.lit(1), i), " > "))))
    return found.select("doc_id", prefixes.alias("path")).groupBy("doc_id", "path").agg(F.count(F.lit(1)).alias("n_chunks"))


def structure_summary(found: DataFrame) -> DataFrame:
    """Per document its chunks, those that are oversized, and the depth of its sections."""
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("is_oversized").alias("n_oversized"), F.max(F.size("hierarchy")).alias("max_depth"))


#: Where texts are cut, from the coarsest mark to the finest.
SEPARATORS = ["\n\n", "\n", ". ", "!", "?", ",", " ", ""]


def split_text(text: str, size: int, overlap: int = 0, count: Callable[[str], int] | None = None, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most size tokens, cut before the first separator that occurs, and at finer ones where parts stay as
    large; a piece begins with up to overlap tokens of parts that end the one before. A piece's tokens are the sum of its
    parts', each counted once. Pieces are stripped, blank ones left out."""
    count = count or counter_of(None)
    if count(text) <= size:
        return [text.strip()] if text.strip() else []
    mark = next((s for s in separators if not s or s in text), "")
    finer = separators[separators.index(mark) + 1 :]
    first, *rest = text.split(mark) if mark else [*text] or [""]
    parts = [p for p in (first, *[mark + x for x in rest]) if p]
    out: list[str] = []
    held: deque[tuple[str, int]] = deque()
    total = 0

    def close() -> None:
        out.append("".join(p for p, _ in held).strip())

    for part in parts:
        n = count(part)
        if n > size and finer:
            close()
            held.clear()
            total = 0
            out += split_text(part, size, overlap, count, finer)
            continue
        if held and total + n > size:
            close()
            while held and (total > overlap or total + n > size):
                total -= held.popleft()[1]
        held.append((part, n))
        total += n
    close()
    return [x for x in out if x]


def split_oversized(found: DataFrame, size: int = 2048, overlap: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Chunks with each oversized one replaced by its pieces: sub (from 0), type recursive_split, level, parent (the section,
    then the numbers of the pieces within one another). A piece that counts more tokens as a whole than its parts did is
    split again, a level deeper, unless it does not come apart."""

    @F.pandas_udf("array<struct<content:string,depth:int,chain:string>>")
    def pieces(texts: pd.Series) -> pd.Series:
        count = counter_of(tokenizer)

        def all_of(text: str, depth: int, chain: str) -> list[dict]:
            got = []
            for i, x in enumerate(split_text(text, size, overlap, count)):
                if count(x) > size and x != text.strip():
                    got += all_of(x, depth + 1, f"{chain}_{i}")
                else:
                    got.append({"content": x, "depth": depth, "chain": f"{chain}_{i}"})
            return got

        return texts.map(lambda t: None if t is None else all_of(t, 1, ""))

    # one pass over the chunks; posexplode() would have them split once more, for a filter below it
    each = found.select("*", F.posexplode_outer(pieces(F.when(F.col("is_oversized"), F.col("content")))).alias("sub", "p")).filter("NOT is_oversized OR p IS NOT NULL")
    parent = F.concat(F.coalesce(F.try_element_at("hierarchy", F.lit(-1)), F.lit("root")), F.col("p.chain"))
    cut = lambda yes, no: F.when(F.col("is_oversized"), yes).otherwise(no)
    return each.select(
        "doc_id", "chunk", F.coalesce("sub", F.lit(0)).alias("sub"), cut(F.lit("recursive_split"), F.col("chunk_type")).alias("chunk_type"), (F.col("level") + cut(F.col("p.depth"), F.lit(0))).alias("level"),
        "hierarchy", cut(F.col("p.content"), F.col("content")).alias("content"), cut(parent, F.lit(None)).alias("parent"),
    )


def export(found: DataFrame) -> DataFrame:
    """Chunks as JSON rows: number, level, type, hierarchy, is_oversized, parent and content, and how many the document has."""
    total = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    parent = F.col("parent") if "parent" in found.columns else F.lit(None).cast("string")
    return found.select("doc_id", "chunk", F.to_json(F.struct(F.col("chunk").alias("chunk_id"), "level", "chunk_type", F.col("hierarchy").alias("section_hierarchy"), "is_oversized", parent.alias("parent_chunk_id"), "content"), {"ignoreNullFields": "false"}).alias("json"), total.alias("total_chunks"))
