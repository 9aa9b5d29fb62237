"""Sequencing reports: table cells to rows, rows to patient and family phenotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright import fixed_values as V
from notewright.functions.phenotypes import no_strings, row_phenotypes, split_phenotypes
from notewright.functions.text import col
from notewright.operators.scaling import running_index, salted_join


def accepted_text(runs: DataFrame, cell: tuple[str, ...] = ("doc", "table", "row", "col")) -> DataFrame:
    """Cell text from runs ``(*cell, para, run, text, is_deleted)``: insertions in, deletions out.

    A cell's runs meet in one task; a cell is a single text value in the result.
    """
    kept = runs.where(~F.coalesce("is_deleted", F.lit(False)))
    pieces = F.array_sort(F.collect_list(F.struct("para", "run", "text")))
    return kept.groupBy(*cell).agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("cell"))


def description_cells(cells: DataFrame, at: tuple[int, int] = V.DESCRIPTION_CELL) -> DataFrame:
    """The description of each document: one cell of its first table."""
    row, column = at
    return cells.where((F.col("table") == 1) & (F.col("row") == row) & (F.col("col") == column)).select(
        "doc", F.col("cell").alias("description")
    )


def body_layout(cells: DataFrame) -> DataFrame:
    """Per document: the table that holds the body, its first row and the row of the sentinel.

    A first table of exactly four rows means that the body is in the second table.
    """
    first, second = F.col("table") == 1, F.col("table") == 2
    ends = (F.col("col") == 0) & F.col("cell").startswith(V.RESULT_SENTINEL)
    facts = cells.groupBy("doc").agg(
        F.max(F.when(first, F.col("row") + 1)).alias("rows"),
        F.min(F.when(first & ends & (F.col("row") >= V.BODY_START), F.col("row"))).alias("_end1"),
        F.min(F.when(second & ends & (F.col("row") >= V.BODY_START_SECOND_TABLE), F.col("row"))).alias("_end2"),
    )
    short = F.col("rows") == V.SHORT_TABLE_ROWS
    return facts.select(
        "doc",
        F.when(short, 2).otherwise(1).alias("table"),
        F.when(short, V.BODY_START_SECOND_TABLE).otherwise(V.BODY_START).alias("_start"),
        F.when(short, F.col("_end2")).otherwise(F.col("_end1")).alias("_end"),
    )


def without_sentinel(cells: DataFrame) -> DataFrame:
    """``(doc, table)`` of the documents whose body has no sentinel row, for a check before their rows are used."""
    return body_layout(cells).where(F.col("_end").isNull()).select("doc", "table")


def body_cells(cells: DataFrame, legacy: bool = False) -> DataFrame:
    """Cells between the first body row and the sentinel, or the table's end where there is none (``without_sentinel``).

    With ``legacy`` rows after the 99th are left out, as in older corpora.

    Documents join on document, table and a salt of the row, so that a document with a
    very long table is not handled by one task.
    """
    joined = salted_join(cells, body_layout(cells), ["doc", "table"], ["row"])
    inside = (F.col("row") >= F.col("_start")) & F.coalesce(F.col("row") < F.col("_end"), F.lit(True))
    if legacy:
        inside &= F.col("row") <= V.LAST_BODY_ROW
    return joined.where(inside).drop("_start", "_end")


def rows_before(cells: DataFrame, sentinel: str = V.RESULT_SENTINEL, legacy: bool = False) -> DataFrame:
    """Cells of the rows above each document's first sentinel row, all rows where there is none.

    With ``legacy`` a document without a sentinel ends after row 99.
    """
    ends = (F.col("col") == 0) & F.col("cell").startswith(sentinel)
    stops = cells.groupBy("doc").agg(F.min(F.when(ends, F.col("row"))).alias("_end"))
    joined = salted_join(cells, stops, ["doc"], ["row"])
    none = F.col("row") <= V.LAST_BODY_ROW if legacy else F.lit(True)
    return joined.where(F.coalesce(F.col("row") < F.col("_end"), none)).drop("_end")


def collapse_repeats(cells: DataFrame, row_key: tuple[str, ...] = ("doc", "row")) -> DataFrame:
    """Drop a cell that equals the cell left of it (merged cells read twice).

    The window covers one table row, which the document format limits to 63 cells.
    """
    left = F.lag("cell").over(Window.partitionBy(*row_key).orderBy("col"))
    return cells.withColumn("_left", left).where(F.col("_left").isNull() | (F.col("cell") != F.col("_left"))).drop("_left")


def report_rows(cells: DataFrame, row_key: tuple[str, ...] = ("doc", "row")) -> DataFrame:
    """One row per table row: ``fields`` is the document name followed by the collapsed cells."""
    kept = collapse_repeats(cells, row_key)
    ordered = F.array_sort(F.collect_list(F.struct("col", "cell")))
    return kept.groupBy(*row_key).agg(F.transform(ordered, lambda s: s["cell"]).alias("_cells")).select(
        *row_key, F.concat(F.array(F.col("doc").cast("string")), F.col("_cells")).alias("fields")
    )


def public_fields(fields: Column | str) -> Column:
    """A report row without its identifying leading fields."""
    fields = col(fields)
    n = V.IDENTIFYING_FIELDS
    return F.slice(fields, F.lit(n + 1), F.greatest(F.size(fields) - F.lit(n), F.lit(0)))


def phenotype_rows(rows: DataFrame, key: str = "report_id") -> DataFrame:
    """One row per phenotype with its role: the first report row is the patient, the others are family.

    Works row by row. Repeats are kept; ``pos`` is the place within the row.
    """
    role = F.when(F.col("row_no") == 0, F.lit("patient")).otherwise(F.lit("family"))
    return rows.select(
        key, "row_no", role.alias("role"), F.posexplode(split_phenotypes("phenotypes")).alias("pos", "phenotype")
    )


def family_phenotypes(rows: DataFrame, key: str = "report_id") -> DataFrame:
    return phenotype_rows(rows.where(F.col("row_no") > 0), key).select(key, "phenotype").distinct()


def all_phenotypes(rows: DataFrame, key: str = "report_id") -> DataFrame:
    return phenotype_rows(rows, key).select(key, "phenotype").distinct()


def patient_specific(rows: DataFrame, key: str = "report_id") -> DataFrame:
    """All three label lists of every report in long form.

    ``pos`` orders the patient list, which keeps repeats; family and all are sets with
    ``pos`` null. The long form is the one to compute with: no report is gathered.
    """
    none = F.lit(None).cast("int")
    in_all = F.struct(F.lit("all").alias("labels"), none.alias("pos"))
    own = F.when(F.col("role") == "patient", F.struct(F.lit("patient").alias("labels"), "pos")).otherwise(F.struct(F.lit("family").alias("labels"), none.alias("pos")))
    listed = phenotype_rows(rows, key).select(key, "phenotype", F.explode(F.array(own, in_all)).alias("_l"))
    # one grouping makes the sets and keeps the patient's repeats by their number
    counted = listed.groupBy(key, F.col("_l.labels").alias("labels"), F.col("_l.pos").alias("pos"), "phenotype").agg(F.count(F.lit(1)).alias("_n"))
    times = F.when(F.col("labels") == "patient", F.col("_n")).otherwise(F.lit(1)).cast("int")
    return counted.select(key, "labels", "pos", "phenotype", F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def label_records(reports: DataFrame, position: str) -> DataFrame:
    """Report records ``(description, results)`` with nested labels and a running index in place of the results.

    A record holds its own rows, so all three lists are built inside it.
    """
    rows = F.coalesce("results", F.array().cast("array<array<string>>"))
    patient = F.coalesce(row_phenotypes(F.try_element_at(rows, F.lit(1))), no_strings())
    family = F.array_distinct(F.flatten(F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), row_phenotypes)))
    lists = reports.withColumn("_patient", patient).withColumn("_family", family)
    labels = F.struct(
        F.col("_patient").alias("patient_phenotypes"), F.col("_family").alias("family_phenotypes"),
        F.array_union("_patient", "_family").alias("all_phenotypes"),
    )
    labelled = lists.withColumn("human_annotated", labels).drop("results", "_patient", "_family")
    return running_index(labelled, position)
