"""Page structure: repeated lines, headings, tables, chapters, document families."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.normalizers import line_key


def page_lines(pages: DataFrame, text: str = "text", edge: int = 3) -> DataFrame:
    """``(doc_id, page, line_no, line, key, at_edge)``: lines that are not blank, with those at the top and bottom marked."""
    kept = F.filter(F.split(F.col(text), r"\n"), lambda x: F.trim(x) != "")
    out = pages.select("doc_id", "page", kept.alias("l")).select("doc_id", "page", F.size("l").alias("n"), F.posexplode("l").alias("line_no", "line"))
    return out.select("doc_id", "page", "line_no", F.trim("line").alias("line"), line_key(F.col("line")).alias("key"), ((F.col("line_no") < edge) | (F.col("line_no") >= F.col("n") - edge)).alias("at_edge"))


def repeated_lines(lines: DataFrame, share: float = 0.4, least: int = 2) -> DataFrame:
    """``(doc_id, key, n_pages)``: edge lines, digits apart, that stand on at least this share of a document's pages."""
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    hits = lines.where("at_edge").groupBy("doc_id", "key").agg(F.count_distinct("page").alias("n_pages"))
    return hits.join(pages, "doc_id").where(F.col("n_pages") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share))).select("doc_id", "key", "n_pages")


def drop_repeated(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """Lines without the running headers and footers."""
    return lines.join(repeated.select("doc_id", "key"), ["doc_id", "key"], "left_anti")


def is_scanned(pages: DataFrame, text: str = "text", short: int = 30, share: float = 0.8) -> DataFrame:
    """``(doc_id, scanned)``: whether most pages hold next to no text."""
    bare = F.avg((F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < short).cast("double"))
    return pages.groupBy("doc_id").agg((bare >= share).alias("scanned"))


def margins(words: DataFrame, share: float = 0.05, low: float = 20.0, high: float = 120.0) -> DataFrame:
    """``(doc_id, top)``: the 5th percentile of word tops, kept within limits."""
    return words.groupBy("doc_id").agg(F.least(F.greatest(F.percentile("top", share), F.lit(low)), F.lit(high)).alias("top"))


def body_size(words: DataFrame) -> DataFrame:
    """``(doc_id, body)``: the most frequent font size."""
    return words.groupBy("doc_id").agg(F.mode(F.round("size", 1)).alias("body"))


def headings(words: DataFrame, factor: float = 1.3, near: float = 5.0) -> DataFrame:
    """``(doc_id, page, top, heading)``: words much larger than the body, put together by height on the page."""
    big = words.join(body_size(words), "doc_id").where(F.col("size") >= factor * F.col("body"))
    w = Window.partitionBy("doc_id", "page").orderBy("top", "x0")
    new = (F.col("top") - F.lag("top").over(w) > near).cast("int")
    rows = big.withColumn("_g", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    words_in = F.array_sort(F.collect_list(F.struct("x0", "word")))
    return rows.groupBy("doc_id", "page", "_g").agg(F.min("top").alias("top"), F.array_join(F.transform(words_in, lambda x: x["word"]), " ").alias("heading")).drop("_g")


def reconstruct_lines(words: DataFrame, near: float = 4.0) -> DataFrame:
    """``(doc_id, page, line_no, line)``: words in rows; a row ends where a word is further than ``near`` from its first one."""
    w = F.array_sort(F.collect_list(F.struct("top", "x0", "word")))
    kind = "array<struct<anchor:double,words:array<struct<x0:double,word:string>>>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        cell = F.struct(x["x0"].cast("double").alias("x0"), x["word"].alias("word"))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["anchor"].alias("anchor"), F.concat(last["words"], F.array(cell)).alias("words"))))
        fresh = F.concat(acc, F.array(F.struct(x["top"].cast("double").alias("anchor"), F.array(cell).alias("words"))))
        return F.when(F.coalesce(x["top"] - last["anchor"] <= near, F.lit(False)), joined).otherwise(fresh).cast(kind)

    rows = words.groupBy("doc_id", "page").agg(F.aggregate(w, F.array().cast(kind), step).alias("r"))  # one page per group
    text = F.array_join(F.transform(F.array_sort(F.col("x.words")), lambda y: y["word"]), " ")
    return rows.select("doc_id", "page", F.posexplode("r").alias("line_no", "x")).select("doc_id", "page", "line_no", text.alias("line"))


def is_contents_page(text: Column, least: int = 5) -> Column:
    """Whether a page is a table of contents or an index: enough lines that lead to numbers."""
    leaders = F.regexp_count(text, F.lit(r"(?m)\.{3,}\s*\d+\s*$"))
    numbered = F.regexp_count(text, F.lit(r"(?m)^\s*\d+(\.\d+)+\s+.*\d+\s*$"))
    return (leaders >= least) | (numbered >= least)


def clean_heading(c: Column) -> Column:
    """A heading without dot leaders and page number."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\.{2,}\s*\d*\s*$", ""), r"\s+\d+\s*$", ""))


def carry_chapter(pages: DataFrame, found: str = "chapter") -> DataFrame:
    """Pages without a chapter of their own take that of the page before them."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn(found, F.last(found, ignorenulls=True).over(w))


def table_keys(tables: DataFrame) -> DataFrame:
    """``chapter.n`` for the n-th table of a chapter."""
    n = F.row_number().over(Window.partitionBy("doc_id", "chapter").orderBy("page", "ord"))
    return tables.withColumn("table_key", F.concat_ws(".", F.coalesce(F.col("chapter").cast("string"), F.lit("0")), n.cast("string")))


def family(pages: DataFrame) -> DataFrame:
    """``(doc_id, family)``: manual, table or sparse, by the shares of page kinds."""
    s = pages.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.avg(F.length("text")).alias("chars"), F.avg((F.coalesce("n_tables", F.lit(0)) > 0).cast("double")).alias("tabled"), F.max(F.col("text").rlike(r"(?im)^\s*(chapter|section|chapitre)\s+\d+").cast("int")).alias("chapters")
    )
    kind = F.when((F.col("tabled") >= 0.6) & (F.col("chapters") == 0), "table").when((F.col("chars") < 200) & (F.col("tabled") < 0.3), "sparse").otherwise("manual")
    return s.select("doc_id", kind.alias("family"))


def good_table(cells: DataFrame, rows: int = 2, least: int = 4, giant: int = 400, most_giant: int = 2) -> DataFrame:
    """Keys of tables with enough rows and cells and few giant cells."""
    s = cells.groupBy("doc_id", "table_key").agg(F.count_distinct("row").alias("r"), F.count("*").alias("c"), F.count_if(F.length("text") > giant).alias("g"))
    return s.where((F.col("r") >= rows) & (F.col("c") >= least) & (F.col("g") <= most_giant)).select("doc_id", "table_key")


class _Cells(HTMLParser):
    """Rows of (role, text, rowspan, colspan) of the tables in a text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.cell: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "table":
            self.tables.append([])
        elif tag == "tr":
            if not self.tables:
                self.tables.append([])
            self.tables[-1].append([])
        elif tag in ("td", "th"):
            if not self.tables:
                self.tables.append([])
            if not self.tables[-1]:
                self.tables[-1].append([])
            span = lambda k: max(1, int(a[k])) if str(a.get(k, "")).isdigit() else 1
            self.cell = ["header" if tag == "th" else "data", "", span("rowspan"), span("colspan")]
            self.tables[-1][-1].append(self.cell)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[1] += data


def parse_tables(df: DataFrame, html: str = "html", key: str = "chunk_id") -> DataFrame:
    """``(key, table_no, row, col, role, text, rowspan, colspan)``; col counts the columns that earlier cells span."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, h in zip(pdf[key], pdf[html]):
                p = _Cells()
                p.feed(h or "")
                for t, table in enumerate(p.tables):
                    for r, row in enumerate(table):
                        col = 0
                        for role, text, rs, cs in row:
                            out.append((k, t, r, col, role, " ".join(text.split()), rs, cs))
                            col += cs
            yield pd.DataFrame(out, columns=[key, "table_no", "row", "col", "role", "text", "rowspan", "colspan"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, html).mapInPandas(read, f"`{key}` {kind}, table_no int, row int, col int, role string, text string, rowspan int, colspan int")


def field_values(cells: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``(key, table_no, row, field, values)`` of rows whose first cell is a header."""
    rows = cells.groupBy(key, "table_no", "row").agg(F.array_sort(F.collect_list(F.struct("col", "role", "text"))).alias("c"))
    first = F.element_at("c", 1)
    values = F.transform(F.filter("c", lambda x: (x["role"] == "data") & (x["text"] != "")), lambda x: x["text"])
    return rows.where((first["role"] == "header") & (F.size("c") > 1)).select(key, "table_no", "row", first["text"].alias("field"), values.alias("values"))


def rows_to_html(cells: DataFrame, key: str = "table_key") -> DataFrame:
    """``(key, html)``: a table's cells as HTML."""
    tag = F.when(F.col("role") == "header", "th").otherwise("td")
    esc = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    one = cells.withColumn("h", F.concat(F.lit("<"), tag, F.lit(">"), esc, F.lit("</"), tag, F.lit(">")))
    row = one.groupBy(key, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "h"))), lambda x: x["h"]), "").alias("h"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "h"))), lambda x: F.concat(F.lit("<tr>"), x["h"], F.lit("</tr>"))), "")
    return row.groupBy(key).agg(F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))


def cell_texts(html: Column) -> Column:
    """The texts of a table's cells in order, without markup."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\s+", " "))), lambda x: x != "")


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """Text blocks cleaned, tables reduced to the texts of their cells; blocks with nothing left are dropped."""
    from lodeweave.functions.cleaning import clean_native

    text = F.when(F.col("type") == "text", clean_native(F.col("text"))).otherwise(F.col("text"))
    flat = F.when(F.col("type") == "table", F.array_join(cell_texts(F.col("html")), " "))
    out = blocks.withColumn("text", text).withColumn("html_text", F.coalesce(flat, F.col("html_text")))
    return out.where(F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.nullif(F.trim("html_text"), F.lit(""))).isNotNull())


def strip_title(blocks: DataFrame) -> DataFrame:
    """A first line that repeats the block's title, apart from case and punctuation, is dropped."""
    from lodeweave.functions.normalizers import compare_key

    first = F.substring_index(F.ltrim("text"), "\n", 1)
    same = (compare_key(first) == compare_key(F.coalesce("title", F.lit("")))) & (compare_key(first) != "")
    rest = F.ltrim(F.ltrim(F.col("text")).substr(F.length(first) + 2, F.length("text")))
    return blocks.withColumn("text", F.when(same, rest).otherwise(F.col("text")))


def sections(blocks: DataFrame) -> DataFrame:
    """``(doc_id, document_key, section_key, title, n_blocks, text)``: the blocks of a section in order; sections without text are pruned."""
    row = F.array_sort(F.collect_list(F.when(F.trim(F.coalesce("text", "html_text", F.lit(""))) != "", F.struct("order", F.coalesce("text", "html_text").alias("t")))))
    out = blocks.groupBy("doc_id", "document_key", "section_key").agg(F.min_by("title", "order").alias("title"), F.count("*").alias("n_blocks"), F.array_join(F.transform(row, lambda x: x["t"]), "\n\n").alias("text"))
    return out.where("text <> ''")


def table_titles(tables: DataFrame) -> DataFrame:
    """Adds ``title``: the table's caption, else the line above it if it is short, else its first header cell."""
    caption = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<caption[^>]*>(.*?)</caption>", 1)), F.lit(""))
    above = F.when(F.length(F.trim("line_above")) <= 120, F.nullif(F.trim("line_above"), F.lit("")))
    header = F.try_element_at(F.regexp_extract_all("html", F.lit(r"(?is)<th[^>]*>(.*?)</th>"), F.lit(1)), F.lit(1))
    return tables.withColumn("title", F.coalesce(caption, above, F.nullif(F.trim(header), F.lit(""))))


def match_contents(headings_: DataFrame, contents: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Headings with the entry of the table of contents most like them: ``contents(label, ord)``."""
    from lodeweave.operators.matching import best_match

    return best_match(headings_.select(clean_heading(F.col("heading")).alias("label")), contents, threshold)
