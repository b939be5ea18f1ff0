"""Source archives as tables: members, statistics, root files, include expansion, format routing."""

from __future__ import annotations

import io
import posixpath
import re
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import mapped

#: Fixed value: endings of image files.
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "pdf", "eps", "svg", "gif", "tif", "tiff", "bmp")
#: Characters that an inlined source may have.
INLINE_BUDGET = 200_000
_INCLUDE = re.compile(r"\\(?:input|include|subfile)\s*\{([^}]*)\}")
_COMMENT = re.compile(r"(?<!\\)%.*")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file below `path`, by Spark's binary source (any Hadoop file system)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


#: Bytes of members that are handed on together.
BATCH_BYTES = 8 << 20
_MEMBER = "path string, name string, size long, content binary"


def members(archives: DataFrame) -> DataFrame:
    """path, name, size, content of the files in tar archives (path, content; plain or compressed), a row each; a file that is no
    tar gives one row of its path. For archives that pyarrow reaches, archive_source reads them without a cell for the whole."""

    def listed(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                for m in tar:
                    if m.isfile():
                        yield path, m.name, m.size, tar.extractfile(m).read()
        except (tarfile.TarError, EOFError, OSError, TypeError):
            yield path, None, None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "name", "size", "content"]
        for pdf in batches:
            held, size = [], 0
            for row in (m for path, content in zip(pdf["path"], pdf["content"], strict=True) for m in listed(path, content)):
                held.append(row)
                size += row[2] or 0
                if size > BATCH_BYTES:
                    yield pd.DataFrame(held, columns=columns).astype({"size": "Int64"})
                    held, size = [], 0
            yield pd.DataFrame(held, columns=columns).astype({"size": "Int64"})

    return archives.select("path", "content").mapInPandas(run, _MEMBER)


def folder_files(spark: SparkSession, base: str, endings: str = "*.tex") -> DataFrame:
    """path (the first folder below base), name, size, content of plain files, by Spark's binary source: sources that are no archives."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", endings).load(base)
    bare = base.rstrip("/").removeprefix("file:").rstrip("/")
    inner = F.substr("path", F.instr("path", bare) + len(bare) + 1)
    cut = F.instr(inner, "/")
    return found.select(F.substr(inner, F.lit(1), cut - 1).alias("path"), F.substr(inner, cut + 1).alias("name"), F.col("length").alias("size"), "content")


#: Characters of a file in which its document class is looked for.
CLASS_CHARS = 4096


def described(files: DataFrame) -> DataFrame:
    """path, name, is_root (it has a document class and body), has_class (near its start), has_title, body_length (without
    comments) of .tex files (path, name, content), natively."""
    text = F.decode("content", "UTF-8")
    bare = F.regexp_replace(text, r"(?<!\\)%[^\n]*", "")
    return files.where(F.lower("name").endswith(".tex")).select(
        "path", "name", (text.contains("\\documentclass") & text.contains("\\begin{document}")).alias("is_root"), F.left(text, F.lit(CLASS_CHARS)).contains("\\documentclass").alias("has_class"),
        text.contains("\\title").alias("has_title"), F.char_length(bare).alias("body_length"),
    )


def is_pdf(content: Column) -> Column:
    """Whether the bytes begin as a PDF does."""
    return F.coalesce(F.substring(content, 1, 5) == F.lit("%PDF-").cast("binary"), F.lit(False))


def source_stats(files: DataFrame, key: str) -> DataFrame:
    """key, tar_bytes, latex_char_count (bytes of .tex files), figure_count. files: key, name, size."""
    ending = F.lower(F.substring_index("name", ".", -1))
    image = ending.isin(list(IMAGE_ENDINGS))
    return files.groupBy(key).agg(
        F.sum("size").alias("tar_bytes"), F.sum(F.when(ending == "tex", F.col("size")).otherwise(0)).alias("latex_char_count"), F.sum(F.when(image, 1).otherwise(0)).cast("long").alias("figure_count")
    )


def _first(files: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return files.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*order, "name"))).where("__rn = 1").select(key, "name")


def _depth() -> Column:
    return F.size(F.split("name", "/")) - 1


def root_by_body(files: DataFrame, key: str) -> DataFrame:
    """The root file: of those with a document body (is_root) the longest, then the least deep; else the least deep."""
    return _first(files, key, [F.col("is_root").desc(), F.when(F.col("is_root"), F.col("body_length")).otherwise(0).desc(), _depth()])


def root_by_name(files: DataFrame, key: str) -> DataFrame:
    """The root file: the least deep main.tex, else the least deep with a document body."""
    return _first(files, key, [F.when(F.col("name").endswith("main.tex"), 0).when(F.col("is_root"), 1).otherwise(2), _depth()])


def root_by_depth(files: DataFrame, key: str) -> DataFrame:
    """The root file: with a document class, at the top level before folders, the longest."""
    return _first(files, key, [F.col("is_root").desc(), (_depth() > 0).cast("int"), F.col("body_length").desc()])


def _resolve(name: str, files: dict[str, str], folders: list[str]) -> str | None:
    """The archive's name for an include, without regard to case, with or without .tex."""
    by_lower = {f.lower(): f for f in files}
    for folder in folders:
        base = posixpath.normpath(posixpath.join(folder, name.strip()))
        for candidate in (base, base + ".tex"):
            if candidate.lower() in by_lower:
                return by_lower[candidate.lower()]
    return None


def expand(root: str, files: dict[str, str], once: bool = False, missing: Callable[[str], str] = lambda name: "", budget: int | None = None) -> str:
    """The root's text with its includes in place. A file that includes itself, through others or not, ends there.

    once: every file is inlined at most once in all (else only not within itself). missing(name) stands for a file that is
    not there. Comments do not include. budget: characters after which the text is cut.
    """
    seen: set[str] = set()

    def text_of(name: str, open_files: tuple[str, ...]) -> str:
        seen.add(name)
        folders = [posixpath.dirname(name), posixpath.dirname(root), ""]
        folders += [p.strip() for group in re.findall(r"\\def\\input@path\{((?:\{[^}]*\})+)\}", files[name]) for p in re.findall(r"\{([^}]*)\}", group)]

        def replace(match: re.Match) -> str:
            target = _resolve(match[1], files, folders)
            if target is None:
                return missing(match[1])
            if target in open_files or target == name or (once and target in seen):
                return ""
            return text_of(target, (*open_files, name))

        lines = []
        for line in files[name].split("\n"):
            comment = _COMMENT.search(line)
            cut = comment.start() if comment else len(line)
            lines.append(_INCLUDE.sub(replace, line[:cut]) + line[cut:])
        return "\n".join(lines)

    out = text_of(root, ())
    return out if budget is None else out[:budget]


def latex_texts(files: DataFrame, once: bool = False, budget: int | None = None, missing: str = "") -> DataFrame:
    """path, text: each source's root file (the longest with a document body, else the least deep) with its includes.

    files: path, name, content. Only .tex files are brought together, one shuffle by path; a source without any has null.
    missing: what stands for an include that is not there, with its name for {}.
    """

    def choose(files: dict[str, str]) -> str | None:
        roots = [n for n in files if "\\documentclass" in files[n] and "\\begin{document}" in files[n]]
        if roots:
            return min(roots, key=lambda n: (-len(_COMMENT.sub("", files[n])), n.count("/"), n))
        return min(files, key=lambda n: (n.count("/"), not n.lower().endswith("main.tex"), n), default=None)

    def text_of(found: list[dict]) -> str | None:
        named = {f["name"].removeprefix("./"): f["content"].decode("utf-8", "replace") for f in found}
        root = choose(named)
        return expand(root, named, once, lambda name: missing.replace("{}", name), budget) if root else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), mapped(batch.column(1), text_of)], names=["path", "text"])

    tex = F.when(F.lower("name").endswith(".tex"), F.struct("name", "content"))
    return files.groupBy("path").agg(F.collect_list(tex).alias("files")).mapInArrow(run, "path string, text string")


def first_parsed(*candidates: Column) -> Column:
    """The first parser's text that is not null: parsers return null where they do not apply or fail."""
    return F.coalesce(*candidates)


def join_pages(pages: Column, budget: int | None = None) -> Column:
    """Page texts joined by a blank line, cut to a budget."""
    text = F.array_join(pages, "\n\n")
    return text if budget is None else F.substring(text, 1, budget)
