"""Reading samples, logs, sheets, dictionaries and disease lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright import fixed_values as V
from notewright.functions.text import disease_name, trim_u
from notewright.operators.scaling import lookup_join

LABELS = "struct<" + ", ".join(f"{k}: array<string>" for k in V.TRUTH_KEYS) + ">"
SAMPLE_SCHEMA = (
    "index bigint, description string, department string, source string, scenario string, patient_id string, "
    f"admission_date string, disease array<string>, human_annotated {LABELS}, llm_predict array<array<string>>, "
    "llm_annotation string"
)
SUBMISSION_SCHEMA = (
    "index bigint, description string, " + ", ".join(f"{k} array<string>" for k in V.TRUTH_KEYS) + ", is_sure boolean"
)
REPORT_SCHEMA = "description string, results array<array<string>>"


def read_samples(spark: SparkSession, path: str, schema: str | T.StructType = SAMPLE_SCHEMA, lines: bool = False,
                 tolerant: bool = False) -> DataFrame:
    """JSON samples.

    One array per file, or one object per line with ``lines``. Lines are read strictly
    unless ``tolerant``: then broken lines and lines without an index are skipped.
    An array file cannot be split, so convert a large one to Parquet once.
    """
    reader = spark.read.schema(schema)
    if not lines:
        return reader.option("multiLine", True).option("mode", "FAILFAST").json(path)
    if not tolerant:
        return reader.option("mode", "FAILFAST").json(path)
    return reader.option("mode", "PERMISSIVE").json(path).where(F.col("index").isNotNull())


def read_sheets(spark: SparkSession, path: str, columns: dict[str, str] = V.NOTE_COLUMNS, numbered: bool = False) -> DataFrame:
    """Note extracts stored per sheet under ``sheet=<name>/``, with short column names.

    Each extract holds ``row_no`` and the workbook's columns, of which a sheet may lack some (null) and each sheet may
    have its own types: all come as text, whole numbers without a fraction, missing numbers as null. Every sheet's files
    are read by a scan of their own; a folder without sheets gives no rows.

    ``numbered`` adds ``index``, the running number over all sheets in their fixed order, for extracts whose files hold
    the rows in order, as ``writers.write_sheets`` leaves them: it is a row's place in its file plus the rows of all
    files before it, so no row moves.
    """
    out = spark.createDataFrame([], ", ".join(f"{c} string" for c in ("sheet", *columns)) + ", row_no bigint, _file string, _at bigint")
    for name in _sheet_names(spark, path):
        raw = spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/sheet={name}")
        types = dict(raw.dtypes)
        picked = [_as_text(F.col(f"`{c}`"), types[c]).alias(n) if c in types else F.lit(None).cast("string").alias(n) for n, c in columns.items()]
        place = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")
        out = out.unionByName(raw.select(F.lit(name).alias("sheet"), F.col("row_no").cast("bigint").alias("row_no"), *picked, *place))
    if numbered:
        out = lookup_join(out, _rows_before_files(out), ["_file"], ["_at"]).withColumn("index", F.col("_before") + F.col("_at")).drop("_before")
    return out.select("sheet", "row_no", *columns, *(["index"] if numbered else []))


def _sheet_names(spark: SparkSession, path: str) -> list[str]:
    """The sheets of a folder, one per department; they come from folder names alone."""
    try:
        names = spark.read.option("basePath", path).parquet(path).select("sheet").distinct().collect()
    except AnalysisException as e:
        if e.getCondition() in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            return []
        raise
    return sorted(r["sheet"] for r in names)


def _rows_before_files(rows: DataFrame) -> DataFrame:
    """(_file, _before): how many rows stand in the files before each, by sheet and part number. Only row counts are read."""
    order = F.array_position(F.lit(list(V.DEPARTMENTS)), trim_u("sheet"))
    part = F.regexp_extract("_file", r"part-(\d+)[^/]*$", 1)
    files = rows.groupBy("sheet", "_file").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy(order, "sheet", F.length(part), part, "_file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("_file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))


def _as_text(c: Column, kind: str) -> Column:
    if kind not in ("double", "float"):
        return c.cast("string")
    known = F.when(~F.isnan(c), c)
    return F.when(known == F.floor(known), known.cast("bigint").cast("string")).otherwise(known.cast("string"))


def union_sheets(sheets: dict[str, DataFrame]) -> DataFrame:
    """All sheets below each other with the sheet name as a column."""
    out = None
    for name, df in sheets.items():
        df = df.withColumn("sheet", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Term dictionary rows ``(row_no, hpo_id, zh)`` from a CSV file with a header.

    A missing file or column gives no rows and a warning. Several files are numbered one after the other, by name.
    """
    empty = spark.createDataFrame([], "row_no bigint, hpo_id string, zh string")
    try:
        rows = spark.read.option("header", True).csv(path)
    except AnalysisException:
        print(f"warning: no term dictionary at {path}")
        return empty
    if V.TERM_NAME_COLUMN not in rows.columns:
        print(f"warning: no column {V.TERM_NAME_COLUMN} in {path}, only {rows.columns}")
        return empty
    term_id = F.col(V.TERM_ID_COLUMN) if V.TERM_ID_COLUMN in rows.columns else F.lit(None).cast("string")
    placed = rows.select(*_place(), term_id.alias("hpo_id"), F.col(V.TERM_NAME_COLUMN).alias("zh"))
    return _in_order(placed, "row_no", []).select("row_no", "hpo_id", "zh")


def _place() -> list[Column]:
    """Where a row of a text file stands: its file, the split of it, and an ascending number within the split."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_seq")]


def _in_order(rows: DataFrame, name: str, within: list[str]) -> DataFrame:
    """Numbers from 1, in each group of ``within`` or else over all files by name.

    Rows are ranked inside their file split and shifted by the row counts of the splits before it, so a large file is
    never read by one task.
    """
    split = ["file", "_start"]
    before = Window.partitionBy(*within).orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("_n")).select(
        *split, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    rank = F.row_number().over(Window.partitionBy(*split).orderBy("_seq"))
    return rows.withColumn("_rank", rank).join(offsets, split).withColumn(name, F.col("_before") + F.col("_rank"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` with blank lines kept, counted from 1 in each file."""
    lines = spark.read.text(path).select(*_place(), F.col("value").alias("line"))
    return _in_order(lines, "line_no", ["file"]).select("file", "line_no", "line")


def parse_diseases(lines: DataFrame, line: str = "line", position: str = "id") -> DataFrame:
    """Disease ids and names from numbered lines; blank lines give no row but use up their number."""
    return lines.where(trim_u(line) != "").withColumn("name", disease_name(line)).withColumnRenamed(position, "id").drop(line)


def read_diseases(spark: SparkSession, path: str) -> DataFrame:
    """``(id, name)`` from a headerless CSV file: byte-order mark dropped, first field taken.

    The id is the line number, so a quoted field must not span lines; such a line fails the read.
    """
    raw = numbered_lines(spark, path)
    text = F.when(F.col("line_no") == 1, F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line"))
    open_quote = F.pmod(F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))), F.lit(2)) == 1
    checked = F.when(open_quote, F.raise_error(F.lit("quoted field spans lines")).cast("string")).otherwise(text)
    field = F.from_csv(checked, F.lit("c string"), {"sep": ","}).getField("c")
    return parse_diseases(raw.select(F.col("line_no").alias("id"), F.coalesce(field, F.lit("")).alias("line"))).select("id", "name")


def read_term_names(spark: SparkSession, path: str) -> DataFrame:
    """``(hpo_id, name)`` from a headerless TSV; lines with one field are skipped, the last of an id wins."""
    fields = F.split(trim_u("line"), "\t")
    rows = numbered_lines(spark, path).where(F.size(fields) >= 2)
    named = rows.select("file", "line_no", fields[0].alias("hpo_id"), fields[1].alias("name"))
    return named.groupBy("hpo_id").agg(F.max_by("name", F.struct("file", "line_no")).alias("name"))


def report_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Report files of a folder: names that end in .docx and do not start with a tilde. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.startswith("~") & ~F.lower(name).startswith("%7e"))


def only_parts(df: DataFrame, parts: tuple[int, ...] = V.PARTS, column: str = "part") -> DataFrame:
    """Rows of the chosen parts; on data stored by part, other folders are not read."""
    return df.where(F.col(column).isin(*parts))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """``(part, website, disease_key, file, text)`` of written articles."""
    schema = "disease_key string, file string, text string, part int, website int"
    return spark.read.schema(schema).parquet(path).select("part", "website", "disease_key", "file", "text")
