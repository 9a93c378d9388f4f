"""Folders of mixed files as a Spark data source, with parsers as plug-ins.

``spark.read.format("memory_files").load(folder)`` gives one row per section; the same format
streams, taking files in the order of their modification. Files are dealt to partitions by
size. A file that no parser takes, that cannot be read or that its parser fails on is a row
that names the error, and the others go on.

Parsers are found by suffix. Built in are Python source, word processor files and saved web
pages; the option ``parsers`` adds or replaces some, as JSON of suffix to ``module:function`` of a
module the executors have, or to a name in ``NAMED``. A parser is called with (path, bytes) and
gives sections (content, title, metadata). What the JVM cuts best,
markdown and other source code, comes as one row ``raw`` per file; ``read_sections`` cuts it.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from stratamem import constants as K
from stratamem.sources import documents
from stratamem.sources.documents import docx_sections, python_sections
from stratamem.sources.html import page_sections

FORMAT = "memory_files"
SCHEMA = ("source string, parser string, section_index int, content string, title string, "
          "metadata map<string,string>, error string")
PARTITION_BYTES = 32 << 20
# A file costs about this much to open. A task costs far more than that to start, so the files of a
# large folder go to a task by hundreds; those of a small one spread over this many tasks.
OPEN_BYTES = 64 << 10
SPREAD = 64
RAW = "raw"
MARKDOWN = (".md", ".mdx", ".markdown")

Parser = Callable[[str, bytes], list[dict]]


def _decoded(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def built_in() -> dict[str, Parser]:
    def page(path: str, data: bytes) -> list[dict]:
        return page_sections(path, _decoded(data))
    return {".py": lambda path, data: python_sections(path, _decoded(data)),
            ".docx": lambda path, data: docx_sections(data), ".html": page, ".htm": page}


def paragraphs(path: str, data: bytes) -> list[dict]:
    """Plain notes: a section per paragraph."""
    parts = [p for p in _decoded(data).split("\n\n") if p.strip()]
    return [{"content": p, "title": f"Paragraph {i}", "metadata": {"file": path}} for i, p in enumerate(parts, 1)]


NAMED: dict[str, Parser] = {"paragraphs": paragraphs}


def parsers_of(option: str | None) -> dict[str, Parser]:
    found = built_in()
    for suffix, name in json.loads(option or "{}").items():
        module, _, function = name.partition(":")
        found[suffix.lower()] = getattr(importlib.import_module(module), function) if function else NAMED[name]
    return found


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""


@dataclass
class Files(InputPartition):
    """Paths that one task reads."""

    paths: tuple[str, ...]

    def __post_init__(self):
        super().__init__(self.paths)


def _system(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[int, str, int]]:
    """(modification in nanoseconds, path, size) of every file below a folder, in that order.

    Names that start with a dot or an underscore are none of the user's, as elsewhere in Spark.
    """
    from pyarrow import fs
    system, root = _system(path)
    infos = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((i.mtime_ns or 0, i.path, i.size or 0) for i in infos if i.type == fs.FileType.File
                  and not any(p[:1] in "._" for p in i.path[len(root):].split("/") if p))


def dealt(files: Sequence[tuple[int, str, int]], limit: int) -> list[Files]:
    """Files in groups of about ``limit`` bytes."""
    groups: list[list[str]] = []
    held = 0
    for _, path, size in files:
        cost = size + OPEN_BYTES
        if not groups or held + cost > limit:
            groups.append([])
            held = 0
        groups[-1].append(path)
        held += cost
    return [Files(tuple(g)) for g in groups]


def sections_of(path: str, root: str, parsers: dict[str, Parser]) -> Iterator[tuple]:
    """The rows of one file."""
    suffix = suffix_of(path)
    parser = parsers.get(suffix)
    raw = parser is None and (suffix in MARKDOWN or suffix in K.CODE_SUFFIXES)
    try:
        if parser is None and not raw:
            raise ValueError(f"no parser for {suffix or 'a file without a suffix'}")
        with _system(root)[0].open_input_stream(path) as file:
            data = file.read()
        if raw:
            yield path, RAW, 0, _decoded(data), None, None, None
            return
        for i, s in enumerate(parser(path, data)):
            if (s.get("content") or "").strip():
                yield path, suffix, i, s["content"], s.get("title"), s.get("metadata"), None
    except Exception as e:
        yield path, suffix, None, None, None, None, f"{type(e).__name__}: {e}"


class _Reading:
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("load a folder")
        self.root = options["path"]
        self.limit = int(options.get("partitionbytes") or options.get("partitionBytes") or PARTITION_BYTES)
        self.option = options.get("parsers")
        parsers_of(self.option)  # an unknown parser ends the query where it is planned

    def read(self, partition: Files) -> Iterator[tuple]:
        parsers = parsers_of(self.option)
        for path in partition.paths:
            yield from sections_of(path, self.root, parsers)


class FilesReader(_Reading, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        files = listed(self.root)
        share = sum(size + OPEN_BYTES for _, _, size in files) // SPREAD
        return dealt(files, min(self.limit, max(share, OPEN_BYTES))) or [Files(())]


class FilesStreamReader(_Reading, DataSourceStreamReader):
    """Offsets name the last file taken; files that appear with an older time are not seen."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.root)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return dealt([f for f in listed(self.root) if low < f[:2] <= high], self.limit)

    def commit(self, end: dict) -> None:
        pass


class MemoryFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FilesReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FilesStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(MemoryFiles)


def cut_raw(rows: DataFrame) -> DataFrame:
    """Rows of the format with markdown and other source code cut into sections, batch or stream.

    All kinds are cut in one pass, so that the files are read once.
    """
    raw = F.col("parser") == RAW
    markdown = F.lower(F.regexp_extract("source", r"(\.[^./]+)$", 1)).isin(*MARKDOWN)
    kind = F.when(raw & markdown, "markdown").when(raw, "code")
    body = F.col("content")
    pieces = F.when(F.col("_kind") == "markdown", documents.markdown_parts(body)).when(
        F.col("_kind") == "code", documents.code_parts(body))
    own = ("section_index", "content", "title", "metadata")
    # Rows that are sections already have no pieces and stay one row in the outer explode.
    cut = (rows.withColumn("_kind", kind).withColumn("_pieces", pieces)
           .select("source", "parser", "error", "_kind", "section_index", "title", "metadata",
                   F.when(F.col("_kind").isNull(), body).alias("content"), F.size("_pieces").alias("_n"),
                   F.when(F.col("_kind") == "code", documents.code_name(F.get("_pieces", F.lit(0))) == "").alias("_preface"),
                   F.posexplode_outer("_pieces").alias("_at", "_part"))
           .withColumn("_name", F.when(F.col("_kind") == "code", documents.code_name(F.col("_part")))))
    title, text = documents.markdown_section(F.col("_part"))
    code = documents.code_section(*[F.col(c) for c in ("source", "_name", "_part", "_at", "_n", "_preface")])
    of_markdown = (F.col("_at"), text, title, F.create_map(F.lit("section"), title))
    is_markdown, is_code = F.col("_kind") == "markdown", F.col("_kind") == "code"
    return cut.filter(F.when(is_markdown, text != "").when(is_code, code[4]).otherwise(True)).select(
        "source", F.coalesce("_kind", "parser").alias("parser"),
        *[F.when(is_markdown, of_markdown[i]).when(is_code, code[i]).otherwise(F.col(n)).alias(n) for i, n in enumerate(own)], "error")


def read_sections(spark: SparkSession, path: str, **options) -> DataFrame:
    """Every section and every error of the files below a folder."""
    register(spark)
    return cut_raw(spark.read.format(FORMAT).options(**options).load(path))


def stream_sections(spark: SparkSession, path: str, **options) -> DataFrame:
    """Sections and errors of files as they appear below a folder."""
    register(spark)
    return cut_raw(spark.readStream.format(FORMAT).options(**options).load(path))


def write_files(rows: DataFrame, folder: str) -> int:
    """Write each row's ``body`` to a file ``name`` below a folder that all executors share; returns how many."""
    def run(batches):
        import pyarrow as pa
        system, root = _system(folder)
        for batch in batches:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist()):
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write((body or "").encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    _system(folder)[0].create_dir(_system(folder)[1], recursive=True)
    return rows.select("name", "body").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
