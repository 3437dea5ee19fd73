"""Reading raw records from text, Markdown, JSON lines, CSV and PDF files, and corpora from and to JSON lines.

Every reader gives `path`, `place` (which sorts as the records of a file do), `base_id` and `text`; `scan` puts them
together and adds `seq`, the place in the order of path and record. Formats go by the suffix, whatever its case. Blank
texts are left out. JSON lines, and CSV whose quoted fields hold no line ends, are read by splits, so a file may be of any
size; text, other CSV and PDF files are read whole, up to 2 GB each.
"""

from __future__ import annotations

import csv
import io
import json
import sys
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.window import Window

from kvlake.functions import text as T

try:
    import pypdf
except ImportError:  # PDF files are then left out
    pypdf = None

csv.field_size_limit(sys.maxsize)  # texts of any length
RECORD = "path string, place string, base_id string, text string"


def _glob(suffix: str) -> str:
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def _files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """path, content (binary) of the files with a suffix, below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(suffix)).load(root)
    return files.select(F.col("_metadata.file_path").alias("path"), "content")


def _parsed(files: DataFrame, parse: Callable[[str, str], list[tuple[int, str, str]]]) -> DataFrame:
    """Records of files that have to be read as a whole; a file that cannot be parsed gives none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                stem = unquote(path.rsplit("/", 1)[-1]).rpartition(".")[0]
                try:
                    rows += [(path, f"{n:012d}", i, t) for n, i, t in parse(stem, content)]
                except (ValueError, AttributeError, TypeError, KeyError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "place", "base_id", "text"])

    return files.mapInPandas(run, RECORD)


def read_text(spark: SparkSession, root: str, suffix: str = "txt") -> DataFrame:
    """A record per file, under the file's stem; bytes that are not UTF-8 become replacement characters."""
    return _parsed(_files(spark, root, suffix), lambda stem, content: [(0, stem, bytes(content).decode("utf-8", "replace"))])


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    return read_text(spark, root, "md")


Record = tuple[str | None, str] | None


def _by_lines(lines: DataFrame, drop: Column, parse: Callable[[str, bytes], Record], whole: Column | None = None, header: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records of the lines of `_lines`, each parsed with its file's first line, under its own id or the stem and its
    number in the file (with a header, from the line after it); and the paths of the files with a line for which `whole`
    holds. Those, and files with a line for which `drop` holds, are left out of the records.

    Two passes over the splits: the first counts the lines of each and looks for files to leave out, and gives one row a
    split (some hundred bytes, and the file's header, for every `spark.sql.files.maxPartitionBytes`), which is broadcast;
    the second parses lines in Arrow batches.
    """
    splits = lines.groupBy("path", "block").agg(
        F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"), F.max(drop).alias("drop"), F.max(F.lit(False) if whole is None else whole).alias("whole"), (F.min_by("value", "at") if header else F.lit("")).alias("head")
    )
    file = Window.partitionBy("path")
    before = file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    told = splits.select(
        "path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("lo") - int(header)).alias("shift"),
        F.max("drop").over(file).alias("drop"), F.max("whole").over(file).alias("whole"), F.min_by("head", "block").over(file).alias("head"),
    )
    starts = told.filter("NOT drop AND NOT whole").select("path", "block", "shift", "head")
    binary = lambda c: F.col(c).cast("binary").alias(c)
    numbered = lines.join(F.broadcast(starts), ["path", "block"]).select("path", (F.col("at") + F.col("shift")).alias("n"), binary("head"), binary("value")).filter("n >= 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, n, head, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if found := parse(head.decode("utf-8"), line):
                    stem = unquote(path.rsplit("/", 1)[-1]).rpartition(".")[0]
                    rows.append((path, f"{n:012d}", found[0] or f"{stem}_{n}", found[1]))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "place", "base_id", "text"])

    return numbered.mapInArrow(run, RECORD), told.filter("NOT drop AND whole").select("path").distinct()


def _lines(spark: SparkSession, root: str, suffix: str, blank: bool = True) -> DataFrame:
    """path, block (where a split begins), at (growing in a split, without gaps), value of the lines, which `\\n` ends;
    without `blank`, blank ones do not count."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(suffix)).option("lineSep", "\n").text(root)
    if not blank:
        lines = lines.filter(F.length(F.regexp_replace("value", "\r", "")) > 0)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _json_record(_: str, line: bytes) -> Record:
    """Id and text of a line; None where it has no text, or is blank or no JSON."""
    try:
        row = json.loads(line)
    except ValueError:
        return None
    text = row.get("text") or row.get("content") or ""
    own = row.get("id") or row.get("doc_id")
    return (str(own) if own else None, text if isinstance(text, str) else json.dumps(text, ensure_ascii=False)) if text else None


def read_jsonl(spark: SparkSession, root: str, suffix: str = "jsonl") -> DataFrame:
    """A record per line: `id` or `doc_id` or the stem and the line's number (all lines count), `text` or `content`. Lines
    that are blank or no JSON are left out; a line that is JSON but no object, or bytes that are not UTF-8, leave out the
    file. Texts that are no strings are kept as JSON."""
    odd = ~F.expr("is_valid_utf8(value)") | (~F.col("value").rlike(r"^\s*(\{|$)") & F.expr("try_parse_json(value)").isNotNull())
    return _by_lines(_lines(spark, root, suffix), odd, _json_record)[0]


def _row_record(row: dict[str, str]) -> Record:
    text = row.get("text") or row.get("content") or ""
    return (row.get("id") or row.get("doc_id") or None, text) if text else None


def _csv_line(head: str, line: bytes) -> Record:
    names, values = ([*csv.reader([x])][0] for x in (head.rstrip("\r"), line.decode("utf-8").rstrip("\r")))
    return _row_record(dict(zip(names, values)))


def _csv_file(stem: str, content: bytes) -> list[tuple[int, str, str]]:
    rows = enumerate(csv.DictReader(io.StringIO(bytes(content).decode("utf-8"), newline="")))
    return [(i, found[0] or f"{stem}_{i}", found[1]) for i, row in rows if (found := _row_record(row))]


def read_csv(spark: SparkSession, root: str) -> DataFrame:
    """A record per row under a header: `id` or `doc_id` or the stem and the row's number (blank lines do not count),
    `text` or `content`. Quoted fields may hold line ends; bytes that are not UTF-8 leave out the file.

    Files in which every line closes the quotes that it opens are read by splits; the others, and those with old line ends
    (a lone carriage return), are read whole.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    spanning = (quotes % 2 == 1) | F.regexp_replace("value", "\r$", "").contains("\r")
    rows, whole = _by_lines(_lines(spark, root, "csv", blank=False), ~F.expr("is_valid_utf8(value)"), _csv_line, spanning, header=True)
    return rows.unionByName(_parsed(_files(spark, root, "csv").join(whole, "path", "left_semi"), _csv_file))


def read_pdf(spark: SparkSession, root: str) -> DataFrame:
    """A record per file, pages parted by blank lines; no records where the reader for PDF is not installed."""
    files = _files(spark, root, "pdf")
    if pypdf is None:
        return files.limit(0).select("path", F.lit("").alias("place"), F.lit("").alias("base_id"), F.lit("").alias("text"))

    def parse(stem: str, content: bytes) -> list[tuple[int, str, str]]:
        pages = [page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(bytes(content))).pages]
        return [(0, stem, "\n\n".join(p for p in pages if p.strip()))]

    return _parsed(files, parse)


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"txt": read_text, "md": read_markdown, "jsonl": read_jsonl, "csv": read_csv, "pdf": read_pdf}


def scan(spark: SparkSession, root: str, formats: list[str]) -> DataFrame:
    """path, place, base_id, text, seq of all records below root; unknown formats are ignored. `seq` is a string that
    sorts as path and record do."""
    found = None
    for name in dict.fromkeys(f.lstrip(".").lower() for f in formats):
        if name in READERS:
            part = READERS[name](spark, root)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], RECORD)
    filled = found.filter(F.length(T.strip(F.col("text"))) > 0)
    return filled.withColumn("seq", F.concat("path", F.lit("\u0000"), "place"))


CORPUS = Ty.StructType([Ty.StructField("id", Ty.StringType()), Ty.StructField("text", Ty.StringType())])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """id, text of a corpus in JSON lines; malformed lines and rows without id or text raise. Of several rows with one id
    the last stands (by file and place in it)."""
    rows = spark.read.schema(CORPUS).option("mode", "FAILFAST").json(path).select("id", "text", "_metadata.file_path", F.monotonically_increasing_id().alias("at"))
    missing = F.col("id").isNull() | F.col("text").isNull()
    checked = rows.withColumn("id", F.when(missing, F.raise_error(F.lit("a row of the corpus has no id or no text")).cast("string")).otherwise(F.col("id")))
    return checked.groupBy("id").agg(F.max_by("text", F.struct("file_path", "at")).alias("text"))


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Writes id and text as JSON lines, non-ASCII characters as they are."""
    corpus.select("id", "text").write.mode("overwrite").json(path)


def write_build_manifest(corpus: DataFrame, path: str, schemes: list[str], elapsed_s: float) -> None:
    """Writes one JSON row: num_docs, doc_ids, schemes, elapsed_s, built_at. The ids are a table of their own beside it
    (`<path>_ids`), since their number grows with the corpus; the row's doc_ids name that table."""
    corpus.select("id").write.mode("overwrite").parquet(f"{path}_ids")
    row = corpus.agg(F.count(F.lit(1)).alias("num_docs")).select(
        "num_docs", F.lit(f"{path}_ids").alias("doc_ids"), F.array(*map(F.lit, schemes)).cast("array<string>").alias("schemes"),
        F.lit(elapsed_s).alias("elapsed_s"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("built_at"),
    )
    row.coalesce(1).write.mode("overwrite").json(path)
