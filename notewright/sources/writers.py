"""Writing samples, lists, article texts and crawl results.

Every writer leaves a folder of part files; none moves the data through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright import fixed_values as V
from notewright.functions.text import col, trim_u
from notewright.operators.reports import public_fields


def write_samples(df: DataFrame, path: str, mode: str = "overwrite", parquet: bool = False) -> None:
    """Samples as JSON lines with unescaped text, or as Parquet."""
    writer = df.write.mode(mode)
    writer.parquet(path) if parquet else writer.option("ignoreNullFields", False).json(path)


def write_sheets(notes: DataFrame, path: str, columns: dict[str, str] = V.NOTE_COLUMNS) -> None:
    """Note rows as extracts under ``sheet=<name>/`` with the workbook's columns, files and rows in order of ``row_no``."""
    named = [F.col(n).alias(c) for n, c in columns.items()]
    parts = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many, so that the extracts are read by many tasks again
    placed = notes.select(trim_u("sheet").alias("sheet"), "row_no", *named).repartitionByRange(parts, "sheet", "row_no")
    placed.sortWithinPartitions("sheet", "row_no").write.mode("overwrite").partitionBy("sheet").parquet(path)


def write_report_rows(rows: DataFrame, path: str, public_path: str) -> None:
    """Report rows in full, and a second copy without the identifying leading fields of each row.

    The rows are written once and the second copy is made from what was written.
    """
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    written = rows.sparkSession.read.schema(rows.schema).json(path)
    cut = F.transform("results", lambda r: public_fields(r))
    written.withColumn("results", cut).write.mode("overwrite").json(public_path)


def append_submissions(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_sorted_list(df: DataFrame, column: str, path: str) -> None:
    """A sorted text list: part files in name order hold the list in code-point order."""
    df.select(F.col(column).alias("value")).orderBy("value").write.mode("overwrite").text(path)


def result_csv_rows(results: DataFrame) -> DataFrame:
    """Crawl results with the nested details as JSON text."""
    return results.select("disease", "id", F.to_json("details").alias("details"))


def write_results(results: DataFrame, path: str) -> None:
    result_csv_rows(results).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def error_rows(errors: DataFrame, at: Column | None = None) -> DataFrame:
    time = F.date_format(F.current_timestamp() if at is None else at, V.TIME_FORMAT)
    return errors.select("disease", "error", time.alias("time"))


def write_errors(errors: DataFrame, path: str, at: Column | None = None) -> bool:
    """Write error rows; nothing is written when there are none. Returns whether there were any."""
    if errors.isEmpty():
        return False
    error_rows(errors, at).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return True


def write_articles(files: DataFrame, path: str, text: Column | str = "text") -> None:
    """Article texts under ``part=/website=`` as Parquet: one row (disease_key, file, text) per article.

    Texts hold line breaks, so a row keeps each article whole and under its file's name; ``read_articles`` reads them.
    """
    out = files.select("part", "website", "disease_key", "file", col(text).alias("text"))
    out.write.mode("overwrite").partitionBy("part", "website").parquet(path)
