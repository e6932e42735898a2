"""HTML pages to records: tables by header, label/value pages, pagination. Parsing is one Arrow UDF over pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = T.ArrayType(T.StructType([T.StructField("table", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("header", T.BooleanType()), T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(T.StringType()))]))
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr"}


class _Tables(HTMLParser):
    """Collects the rows of all tables; unclosed cells and rows end where the next begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.table, self.row, self.cell, self.depth = -1, None, None, 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.end_row()
            self.table += 1
            self.depth += 1
            self.n = 0
        elif tag == "tr" and self.depth:
            self.end_row()
            self.row = [self.table, self.n, True, [], []]
            self.n += 1
        elif tag in ("td", "th") and self.row is not None:
            self.end_cell()
            self.cell, self.link = [], None
            self.row[2] &= tag == "th"
        elif tag == "a" and self.cell is not None and self.link is None:
            self.link = dict(attrs).get("href")
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.end_cell()
        elif tag == "tr":
            self.end_row()
        elif tag == "table" and self.depth:
            self.end_row()
            self.depth -= 1

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def end_cell(self):
        if self.cell is not None:
            self.row[3].append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
            self.row[4].append(self.link)
            self.cell = None

    def end_row(self):
        self.end_cell()
        if self.row is not None and self.row[3]:
            self.rows.append(self.row)
        self.row = None


@F.pandas_udf(CELLS)
def table_rows(pages: pd.Series) -> pd.Series:
    """Rows of all tables of a page: number of the table and row, whether all cells are headers, cell texts and first links."""

    def one(page):
        p = _Tables()
        p.feed(page)
        p.close()
        p.end_row()
        return [dict(zip(("table", "row", "header", "cells", "links"), r)) for r in p.rows]

    return pages.map(one, na_action="ignore")


def field_of(header: Column, rules: dict[str, str]) -> Column:
    """The field a table header names: the first rule (field: pattern) its lower-case text matches, else NULL."""
    bare = F.regexp_replace(F.lower(F.trim(header)), ":", "")
    return F.coalesce(*(F.when(bare.rlike(p), F.lit(f)) for f, p in rules.items()))


def records(pages, page: str, key: list[str], rules: dict[str, str], positional: list[str] | None = None):
    """One line for each data row of the tables whose header names at least two fields.

    Columns: the key, ``row``, one text column a field of the rules. With ``positional``, a
    first table whose header names fewer than three fields gives its columns in that order.
    Rows shorter than the header have NULL in what is missing.
    """
    cells = pages.select(*key, F.explode(table_rows(F.col(page))).alias("r")).select(*key, "r.*")
    head = cells.filter("row = 0").select(*key, "table", F.transform("cells", lambda c: field_of(c, rules)).alias("fields"))
    named = F.size(F.array_compact("fields"))
    if positional:
        fixed = F.array(*(F.lit(p) for p in positional))
        head = head.withColumn("fields", F.when((named < 3) & (F.col("table") == 0), fixed).otherwise(F.col("fields")))
    head = head.filter(F.size(F.array_compact("fields")) >= 2)
    body = cells.filter("row > 0").join(head, [*key, "table"])
    return body.select(*key, "table", "row", *(F.try_element_at("cells", F.nullif(F.array_position("fields", F.lit(f)), F.lit(0)).cast("int")).alias(f) for f in rules))


def labelled(pages, page: str, key: list[str], labels: list[str]):
    """Label/value pages as one wide line: two-cell rows whose first cell is a label (case and a final colon aside), the first of each."""
    rows = pages.select(*key, F.explode(table_rows(F.col(page))).alias("r")).filter(F.size("r.cells") == 2)
    label = F.regexp_replace(F.lower(F.trim(F.col("r.cells")[0])), r"\s*:$", "")
    pairs = rows.select(*key, label.alias("l"), F.struct(F.col("r.table").alias("t"), F.col("r.row").alias("i"), F.col("r.cells")[1].alias("v")).alias("s"))
    return pairs.groupBy(*key).agg(*(F.min(F.when(F.col("l") == x.lower(), F.col("s"))).getField("v").alias(x.lower().replace(" ", "_")) for x in labels))


def pagination(page: Column) -> Column:
    """Struct of the current, previous, next and last page number that links with ``page=N`` show; NULL where absent."""
    numbers = F.transform(F.regexp_extract_all(page, F.lit(r"[?&](?:amp;)?page=(\d{1,9})"), F.lit(1)), lambda x: x.cast("int"))
    rel = lambda r: F.expr("null").cast("int") if r is None else F.nullif(F.regexp_extract(page, rf'(?i)<a[^>]*rel="{r}"[^>]*[?&](?:amp;)?page=(\d+)', 1), F.lit("")).cast("int")
    return F.struct(rel("prev").alias("prev"), rel("next").alias("next"), F.array_max(numbers).alias("last"))
