"""Clinical notes: standardisation, filters and once-per-patient sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright import fixed_values as V
from notewright.functions.deid import deidentify
from notewright.functions.phenotypes import no_strings
from notewright.functions.text import col, drop_literal, let, missing_to, pattern, trim_u, zero_pad
from notewright.operators.scaling import running_index

# ---- projections ---------------------------------------------------------------------


def scenario(template: Column | str) -> Column:
    return F.concat(F.lit(V.SCENARIO_PREFIX), trim_u(missing_to(template)))


def diagnosis_list(diagnosis: Column | str) -> Column:
    text = trim_u(missing_to(diagnosis))
    return F.when(F.lower(text).isin("", "nan"), no_strings()).otherwise(F.array(text))


def department_key(sheet: Column | str) -> Column:
    """The English key of a sheet name; an unknown name fails the job."""
    sheet = trim_u(sheet)
    table = F.create_map(*[F.lit(x) for pair in V.DEPARTMENTS.items() for x in pair])
    unknown = F.raise_error(F.concat(F.lit("unknown department: "), F.coalesce(sheet, F.lit("null"))))
    return F.coalesce(F.try_element_at(table, sheet), unknown.cast("string"))


def department_order(sheet: Column | str) -> Column:
    return F.array_position(F.lit(list(V.DEPARTMENTS)), trim_u(sheet)).cast("int")


def patient_key(patient: Column | str) -> Column:
    return zero_pad(missing_to(patient), V.PATIENT_ID_WIDTH)


def standardise_notes(raw: DataFrame, names: str | None = None) -> DataFrame:
    """Six fields and a running index from raw note rows.

    ``raw`` holds sheet, row_no, content, template, diagnosis, patient and admission;
    ``names`` optionally names a column with the person names of each note. A column
    ``index``, as ``read_sheets`` gives it, is kept; without one rows are numbered by
    sheet and ``row_no``, for which they are shuffled once.
    """
    numbered = ["index"] if "index" in raw.columns else []
    if isinstance(raw.schema["patient"].dataType, (T.DoubleType, T.FloatType)):
        raw = raw.withColumn("patient", F.nanvl("patient", F.lit(None)).cast("bigint"))
    notes = raw.select(
        deidentify("content", names).alias("description"),
        department_key("sheet").alias("department"),
        department_order("sheet").alias("_sheet"),
        scenario("template").alias("scenario"),
        patient_key("patient").alias("patient_id"),
        missing_to("admission").alias("admission_date"),
        diagnosis_list("diagnosis").alias("disease"),
        "row_no",
        *numbered,
    )
    if numbered:
        return notes.drop("_sheet", "row_no")
    return running_index(notes, "row_no", ["_sheet"]).drop("_sheet", "row_no")


# ---- filters ---------------------------------------------------------------------------


def strip_boilerplate(c: Column | str) -> Column:
    c = col(c)
    for phrase in V.BOILERPLATE:
        c = drop_literal(c, phrase)
    return c


def strip_stamp(c: Column | str, legacy: bool = False) -> Column:
    """Drop a leading time stamp and the space after it.

    ``legacy`` keeps only the one character behind the stamp, as earlier corpora did,
    so that such notes fail the length band.
    """
    if legacy:
        one = F.regexp_replace(col(c), pattern("^" + V.STAMP + "(.?).*$", dotall=True), "$1")
        return let(F.struct(col(c).alias("c"), one.alias("one")), lambda s: F.when(s["c"] != s["one"], trim_u(s["one"])).otherwise(s["c"]))
    return F.regexp_replace(col(c), pattern("^" + V.STAMP + r"\s*"), "")


def in_length_band(c: Column | str, k: int = V.MAX_NOTE_LENGTH, min_len: int = V.MIN_NOTE_LENGTH) -> Column:
    return F.length(col(c)).between(min_len, k)


def has_stop_phrase(c: Column | str) -> Column:
    return F.contains(col(c), F.lit(V.STOP_PHRASE))


def once_per_patient(notes: DataFrame, order: str = "index") -> DataFrame:
    """Keep a daily note only when it is its patient's first note; keep all others.

    Patients' first notes come from narrow rows. Only daily notes are joined with them;
    all others pass without a shuffle.
    """
    daily = F.col("scenario").eqNullSafe(V.DAILY_SCENARIO)
    first = notes.groupBy(F.col("patient_id").alias("_patient")).agg(F.min(order).alias("_lowest"))
    met = F.col("patient_id").eqNullSafe(F.col("_patient")) & (F.col(order) == F.col("_lowest"))
    return notes.where(~daily).unionByName(notes.where(daily).join(first, met, "left_semi"))


def candidates(notes: DataFrame, k: int = V.MAX_NOTE_LENGTH, min_len: int = V.MIN_NOTE_LENGTH,
               legacy_timestamp: bool = False) -> DataFrame:
    """Cleaned notes inside the length band and without the stop phrase."""
    cleaned = strip_stamp(strip_boilerplate("description"), legacy_timestamp)

    def fits(text: Column) -> Column:
        return in_length_band(text, k, min_len) & ~has_stop_phrase(text)

    # opening a list of at most one text drops the row or keeps it, and cleans each text only
    # once; a plain filter would clean it again for every condition
    kept = F.explode(F.filter(F.array(cleaned), fits))
    return notes.select(*[kept.alias(c) if c == "description" else c for c in notes.columns])


def sub_k(notes: DataFrame, k: int = V.MAX_NOTE_LENGTH, min_len: int = V.MIN_NOTE_LENGTH,
          legacy_timestamp: bool = False, order: str = "index") -> DataFrame:
    return once_per_patient(candidates(notes, k, min_len, legacy_timestamp), order)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def disease_list(notes: DataFrame) -> DataFrame:
    """Distinct diseases over all lists, sorted by code point."""
    return notes.select(F.explode("disease").alias("disease")).distinct().orderBy("disease")


def from_row(df: DataFrame, start: int, position: str = "row_no") -> DataFrame:
    """Skip the first ``start`` rows in list order (positions count from 1)."""
    return df.where(F.col(position) > start)


def unlabelled(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label).isNull())
