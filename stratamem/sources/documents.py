"""Document sources: markdown, page text, code, web pages and docx.

Formats that regular expressions can cut are cut in the JVM; the others go through
one Arrow-batched helper per format. Every reader returns one row per section:
the kept columns, section_index, content, title and metadata.
"""

from __future__ import annotations

import ast
import io
import re
import zipfile
from collections.abc import Callable, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamem import constants as K
from stratamem import schema
from stratamem.functions import routing, text
from stratamem.operators.chunking import paragraph_groups
from stratamem.sources.html import page_sections

SECTIONS = T.ArrayType(schema.SECTION)
# The metadata key of a source that could not be parsed.
ERROR = "error"
INLINE_WS = r"[\t\x{1f} \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
HEADING_LINE = rf"#{{1,6}}{INLINE_WS}+[^\n]+"


def normalize_lines(content: Column) -> Column:
    return F.regexp_replace(content, K.LINE_BREAK, "\n")


def markdown_parts(content: Column) -> Column:
    """The pieces of a markdown text, each from one ``#`` heading to the next."""
    return F.split(normalize_lines(content), rf"(?m)(?=^{HEADING_LINE}$)")


def markdown_section(part: Column) -> tuple[Column, Column]:
    """Title and content of a piece of ``markdown_parts``; blank content is no section."""
    heading = F.regexp_extract(part, rf"\A({HEADING_LINE})", 1)
    has_heading = heading != ""
    title = text.strip(F.regexp_replace(heading, rf"\A#{{1,6}}{INLINE_WS}+", ""))
    body = text.strip(F.regexp_replace(part, rf"\A{HEADING_LINE}", ""))
    return (F.when(has_heading, title).otherwise(F.lit(K.DEFAULT_SECTION)),
            F.when(has_heading, body).otherwise(text.strip(part)))


def markdown_sections(docs: DataFrame, content: str, keep: Sequence[str]) -> DataFrame:
    """Sections under ``#`` headings, split inside the row.

    Text before the first heading is titled "Introduction"; fenced code is not
    treated specially. Sections without content vanish.
    """
    title, body = markdown_section(F.col("part"))
    return (docs.select(*keep, F.posexplode(markdown_parts(F.col(content))).alias("section_index", "part"))
            .select(*keep, "section_index", title.alias("title"), body.alias("content"))
            .filter(F.col("content") != "")
            .select(*keep, "section_index", "content", "title",
                    F.create_map(F.lit("section"), F.col("title")).alias("metadata")))


def page_text_sections(pages: DataFrame, content: str, keep: Sequence[str], page: str = "page",
                       total: str = "total_pages") -> DataFrame:
    """Groups of three paragraphs per page of extracted text."""
    groups = paragraph_groups(pages, content, [*keep, page, total])
    return groups.select(
        *keep, (F.col(page) * 1000 + F.col("group_index")).alias("section_index"), "content",
        F.concat(F.lit("Page "), F.col(page).cast("string")).alias("title"),
        F.create_map(F.lit("page"), F.col(page).cast("string"),
                     F.lit("total_pages"), F.col(total).cast("string")).alias("metadata"))


def _section(content: str, title: str, **metadata: object) -> dict:
    return {"content": content, "title": title, "metadata": {k: str(v) for k, v in metadata.items()}}


def python_sections(source: str, content: str) -> list[dict]:
    """Definitions of a Python file, or the whole file where none is found."""
    name = source.rsplit("/", 1)[-1]
    return _python_definitions(source, content) or [_section(content, name, language="python", file=source)]


CODE_BOUNDARY = K.CODE_BOUNDARY.replace(r"\s", r"[\s\x1c-\x1f]")


def code_parts(content: Column) -> Column:
    """The pieces of a source file, each from one definition to the next."""
    return F.split(content, f"(?mdU)(?={CODE_BOUNDARY})")


def code_name(part: Column) -> Column:
    """What a piece of ``code_parts`` defines; empty for the piece before the first definition."""
    return F.regexp_extract(part, f"(?U)\\A{CODE_BOUNDARY[1:]}", 1)


def code_section(path: Column, name: Column, part: Column, at: Column, pieces: Column,
                 preface: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Index, content, title and metadata of piece ``at`` of a file's ``pieces``, and whether it is a section."""
    file, found = F.regexp_extract(path, "[^/]*$", 0), name != ""
    facts = F.create_map(F.lit("language"), F.lower(F.regexp_extract(file, r"[^.]*$", 0)), F.lit("file"), path)
    named = F.map_concat(facts, F.create_map(F.lit("name"), name))
    content = F.when(found, text.strip(part)).otherwise(part)
    return (at - (preface & (pieces > 1)).cast("int"), content, F.when(found, name).otherwise(file),
            F.when(found, named).otherwise(facts), (found | (pieces == 1)) & ~text.is_blank(content))


def sliced_code(docs: DataFrame, source: str, content: str, keep: Sequence[str]) -> DataFrame:
    """Slices of other source files from one definition to the next, cut inside the row.

    What stands before the first definition is left out; a file without any is one section.
    """
    parts = code_parts(F.col(content))
    rows = docs.select(*keep, F.col(source).alias("_path"), F.size(parts).alias("_n"), (code_name(parts[0]) == "").alias("_preface"),
                       F.posexplode(parts).alias("_at", "part")).withColumn("_name", code_name(F.col("part")))
    index, body, title, metadata, kept = code_section(*[F.col(c) for c in ("_path", "_name", "part", "_at", "_n", "_preface")])
    return rows.filter(kept).select(*keep, index.alias("section_index"), body.alias("content"), title.alias("title"),
                                    metadata.alias("metadata"))


def _python_definitions(source: str, content: str) -> list[dict]:
    try:
        nodes = list(ast.walk(ast.parse(content)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = content.splitlines()
    kinds = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)
    return [
        _section("\n".join(lines[n.lineno - 1:n.end_lineno]), n.name, language="python", file=source,
                 name=n.name, docstring=(ast.get_docstring(n) or "")[:K.DOCSTRING_CHARS],
                 line_start=n.lineno)
        for n in nodes if isinstance(n, kinds)
    ]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(data: bytes) -> list[tuple[str, str]]:
    """(text, style name) of the body's paragraphs and tables in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        styles = {}
        if "word/styles.xml" in archive.namelist():
            for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
                label = style.find(f"{_W}name")
                styles[style.get(f"{_W}styleId")] = "" if label is None else label.get(f"{_W}val", "")

    def runs(node) -> str:
        glyph = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
        return "".join(n.text or "" if n.tag == f"{_W}t" else glyph.get(n.tag, "") for n in node.iter())

    blocks = []
    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            mark = child.find(f"{_W}pPr/{_W}pStyle")
            style = "" if mark is None else mark.get(f"{_W}val", "")
            blocks.append((runs(child).strip(), _display_name(styles.get(style, style))))
        elif child.tag == f"{_W}tbl":
            rows = [["\n".join(runs(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")]
                    for row in child.findall(f"{_W}tr")]
            blocks.append(("\n".join(" | ".join(r) for r in rows if any(r)), ""))
    return [b for b in blocks if b[0]]


def _display_name(style: str) -> str:
    """Built-in heading styles are stored in lower case and shown capitalised."""
    return style.capitalize() if re.fullmatch(r"heading \d", style) else style


def is_docx_heading(content: str, style: str) -> bool:
    """A heading style, or a short line that opens with a number."""
    numbered = content[:2].rstrip(". ").isdigit() or (content[0].isdigit() and "." in content[:4])
    return "Heading" in style or (len(content) < 80 and numbered)


def docx_sections(data: bytes) -> list[dict]:
    groups: list[tuple[str, list[str]]] = [(K.DEFAULT_SECTION, [])]
    for content, style in docx_blocks(data):
        if is_docx_heading(content, style):
            groups.append((content, []))
        else:
            groups[-1][1].append(content)
    return [_section("\n".join(parts), title, section=title) for title, parts in groups if parts]


def _batched(helper: Callable[..., list[dict]]):
    """An Arrow-batched function that applies a per-document helper.

    A source that fails gives one section without content that names the error in its
    metadata; the others of its batch go on.
    """

    def one(source, content) -> list[dict]:
        if content is None:
            return []
        try:
            return helper(source, content)
        except Exception as e:
            return [{"content": None, "title": None, "metadata": {ERROR: f"{type(e).__name__}: {e}"}}]

    @F.pandas_udf(SECTIONS)
    def run(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(first, second)])

    return run


def _explode(docs: DataFrame, sections: Column, keep: Sequence[str]) -> DataFrame:
    return (docs.select(*keep, F.posexplode_outer(sections).alias("section_index", "s"))
            .filter(F.col("s").isNotNull()).select(*keep, "section_index", "s.content", "s.title", "s.metadata")
            .filter(~text.is_blank(F.col("content")) | failed(F.col("metadata"))))


def failed(metadata: Column) -> Column:
    """Whether a section stands for a source that could not be parsed."""
    return F.coalesce(F.map_contains_key(metadata, F.lit(ERROR)), F.lit(False))


def read_code(docs: DataFrame, source: str, content: str, keep: Sequence[str]) -> DataFrame:
    """Sections of source files; only Python files leave the JVM, to be parsed."""
    python = F.endswith(F.col(source), F.lit(".py"))
    parsed = _explode(docs.filter(python), _batched(python_sections)(F.col(source), F.col(content)), keep)
    return sliced_code(docs.filter(~python), source, content, keep).unionByName(parsed)


def read_html(docs: DataFrame, source: str, html: str, keep: Sequence[str]) -> DataFrame:
    return _explode(docs, _batched(page_sections)(F.col(source), F.col(html)), keep)


def read_docx(files: DataFrame, source: str, data: str, keep: Sequence[str]) -> DataFrame:
    return _explode(files, _batched(lambda _, raw: docx_sections(bytes(raw)))(F.col(source), F.col(data)), keep)


def read_pdf(files: DataFrame, source: str, data: str, keep: Sequence[str]) -> DataFrame:
    """Page text of PDF files; needs ``pdfplumber`` on the executors."""
    page = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])

    @F.pandas_udf(T.ArrayType(page))
    def extract(blobs: pd.Series) -> pd.Series:
        import pdfplumber

        def one(raw):
            with pdfplumber.open(io.BytesIO(raw)) as pdf:
                return [{"page": i, "text": p.extract_text() or ""} for i, p in enumerate(pdf.pages, 1)]

        return blobs.map(one)

    pages = files.withColumn("_pages", extract(F.col(data)))
    rows = pages.select(*keep, F.size("_pages").alias("total_pages"), F.explode("_pages").alias("p"))
    return page_text_sections(rows.select(*keep, "total_pages", "p.page", F.col("p.text").alias("_text")),
                              "_text", keep)


def read_files(spark: SparkSession, paths: str | list[str],
               parsers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Files of any supported kind as sections, each routed to its parser.

    ``parsers`` adds or replaces kinds: by a file suffix with its dot, a function from
    rows of source, content (bytes) and body (text) to sections. Files without a parser
    raise when read, as an unknown source is an error.
    """
    files = (spark.read.format("binaryFile").load(paths)
             .select(F.col("path").alias("source"), "content"))
    own = text.suffix(F.col("source"))
    routed = files.withColumn("parser", F.when(own.isin(*(parsers or {})), own).otherwise(
        routing.parser_of(F.col("source")))).withColumn(
        "parser", F.coalesce("parser", F.raise_error(F.concat(F.lit("no parser for "), F.col("source")))))
    body = routed.withColumn("body", F.make_valid_utf8(F.col("content").cast("string")))
    keep = ["source"]
    kinds = {
        "markdown": lambda d: markdown_sections(d, "body", keep),
        "code": lambda d: read_code(d, "source", "body", keep),
        "docx": lambda d: read_docx(d, "source", "content", keep),
    }
    try:
        import pdfplumber  # noqa: F401
        kinds["pdf"] = lambda d: read_pdf(d, "source", "content", keep)
    except ImportError:
        kinds["pdf"] = lambda d: markdown_sections(
            d.withColumn("body", F.raise_error(F.lit("reading PDF files needs pdfplumber"))), "body", keep)
    kinds |= parsers or {}
    out = None
    for kind, reader in kinds.items():
        part = reader(body.filter(F.col("parser") == kind))
        out = part if out is None else out.unionByName(part)
    return out
