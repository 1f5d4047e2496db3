"""Captured pages to readable text, sections, tables and lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework import fixed
from passagework.functions import html, wikitext
from passagework.functions.arrays import slices

SECTION_TYPE = "struct<section_no:int,level:int,heading:string,skipped:boolean>"
ROW_TYPE = "struct<row_no:int,is_header:boolean,cells:array<string>>"
TABLE_TYPE = (
    f"struct<table_no:int,caption:string,width:int,rows:array<{ROW_TYPE}>,notes:array<string>>"
)
PART_TYPES = {
    "content": "string",
    "sections": f"array<{SECTION_TYPE}>",
    "tables": f"array<{TABLE_TYPE}>",
    "lists": "array<string>",
}

ARROW_ROW = pa.struct(
    [("row_no", pa.int32()), ("is_header", pa.bool_()), ("cells", pa.list_(pa.string()))]
)
ARROW_PARTS = {
    "content": pa.string(),
    "sections": pa.list_(
        pa.struct(
            [
                ("section_no", pa.int32()),
                ("level", pa.int32()),
                ("heading", pa.string()),
                ("skipped", pa.bool_()),
            ]
        )
    ),
    "tables": pa.list_(
        pa.struct(
            [
                ("table_no", pa.int32()),
                ("caption", pa.string()),
                ("width", pa.int32()),
                ("rows", pa.list_(ARROW_ROW)),
                ("notes", pa.list_(pa.string())),
            ]
        )
    ),
    "lists": pa.list_(pa.string()),
}


def _reader(parts: tuple[str, ...], root_id: str | None, root_tag: str | None):
    """A UDF that returns only the asked-for parts, plus the row's own error.

    Like the other costly UDFs here it is marked non-deterministic, or the
    optimizer would copy it into the filters it derives and run it twice.
    """

    def read(page: str | None) -> dict:
        if page is None:
            return {"error": "no page"}
        try:
            found = html.read_page(page, root_id, root_tag)
        except Exception as problem:  # one bad page must not fail the job
            return {"error": f"{type(problem).__name__}: {problem}"}
        if found is None:
            return {"error": "content root not found"}
        content = "\n\n".join(found.parts) or None
        values = {
            "content": content,
            "sections": found.sections,
            "tables": found.tables,
            "lists": found.lists,
        }
        return {name: values[name] for name in parts}

    schema = ",".join(f"{name}:{PART_TYPES[name]}" for name in parts)
    arrow = pa.struct([*((name, ARROW_PARTS[name]) for name in parts), ("error", pa.string())])

    @F.arrow_udf(f"struct<{schema},error:string>")
    def reader(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for (part,) in slices(batch):
                yield pa.array([read(page) for page in part.to_pylist()], type=arrow)

    return reader.asNondeterministic()


def read_parts(
    pages: DataFrame,
    *parts: str,
    html_col: str = "html",
    root_id: str | None = fixed.CONTENT_ROOT_ID,
    root_tag: str | None = None,
) -> DataFrame:
    """`pages` without its html column, plus the chosen parts and `error`."""
    keep = [c for c in pages.columns if c != html_col]
    reader = _reader(parts, root_id, root_tag)
    return (
        pages
        .withColumn("_page", reader(F.col(html_col)))
        .select(*keep, *[F.col(f"_page.{p}").alias(p) for p in parts], F.col("_page.error"))
    )


def extract_pages(pages: DataFrame, **root) -> DataFrame:
    """Readable text per page; `content` is NULL where there is none, `error` says why."""
    return read_parts(pages, "content", **root)


def page_errors(pages: DataFrame, **root) -> DataFrame:
    """The pages that the other outputs have no rows of because they cannot be read, and why."""
    return read_parts(pages, "content", **root).where("error IS NOT NULL").drop("content")


def _listed(pages: DataFrame, part: str, with_errors: bool, root: dict) -> tuple[DataFrame, list[str]]:
    """`pages` with one part, and the columns to keep: `error` only if asked for."""
    found = read_parts(pages, part, **root)
    return found, [c for c in found.columns if c != part and (with_errors or c != "error")]


def _there(rows: DataFrame, mark: str, with_errors: bool) -> DataFrame:
    """Rows of readable pages that have any, and the unreadable pages if asked for."""
    there = F.col(mark).isNotNull()
    return rows.where(there | F.col("error").isNotNull() if with_errors else there)


def extract_sections(pages: DataFrame, *, with_errors: bool = False, **root) -> DataFrame:
    """One row per section heading with its level and whether the section is left out.

    `with_errors` adds the column `error` and a row for every page that cannot be read, as
    in `extract_tables` and `extract_lists`.
    """
    found, keep = _listed(pages, "sections", with_errors, root)
    return _there(found.select(*keep, F.inline_outer("sections")), "section_no", with_errors)


def extract_tables(pages: DataFrame, *, with_errors: bool = False, **root) -> DataFrame:
    """One row per non-blank table row, spans already expanded."""
    found, keep = _listed(pages, "tables", with_errors, root)
    tables = found.select(*keep, F.inline_outer("tables"))
    rows = tables.select(*keep, "table_no", "caption", F.inline_outer("rows"))
    return _there(rows, "row_no", with_errors)


def extract_lists(pages: DataFrame, *, with_errors: bool = False, **root) -> DataFrame:
    """One row per outermost list, as indented text."""
    found, keep = _listed(pages, "lists", with_errors, root)
    rows = found.select(*keep, F.posexplode_outer("lists").alias("list_no", "list_text"))
    return _there(rows, "list_no", with_errors)


def _wikitext_cleaner():
    """A UDF: readable text of wiki markup, or why there is none."""
    arrow = pa.struct([("content", pa.string()), ("error", pa.string())])

    def clean(raw):
        if raw is None:
            return {"error": "no text"}
        try:
            return {"content": wikitext.clean(raw)}
        except Exception as problem:  # same outcome as an unreadable page
            return {"error": f"{type(problem).__name__}: {problem}"}

    @F.arrow_udf("struct<content:string,error:string>")
    def cleaner(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for (part,) in slices(batch):
                yield pa.array([clean(raw) for raw in part.to_pylist()], type=arrow)

    return cleaner.asNondeterministic()


def clean_wikitext(df: DataFrame, raw_col: str, out: str = "content", error: str = "error") -> DataFrame:
    """`df` plus the readable text of its wiki markup column, and why a row has none."""
    cleaned = df.withColumn("_clean", _wikitext_cleaner()(F.col(raw_col)))
    return cleaned.withColumns({out: F.col("_clean.content"), error: F.col("_clean.error")}).drop("_clean")


def readable(content: Column) -> Column:
    """Rows worth storing: text present and not empty."""
    return content.isNotNull() & (F.length(content) > 0)
