"""Queries that write what Spark derives from the tables and read it back."""

from __future__ import annotations

import json
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from notewright.functions import phenotypes as H
from notewright.operators import inference as I
from notewright.operators import pages as P
from notewright.plans.inference_queries import annotate, gist
from notewright.plans.page_queries import RESULTS, details
from notewright.plans.registry import query
from notewright.plans.views import Inputs
from notewright.sources import readers, writers
from notewright.sources.scratch import settled

NOTE_SCHEMA = "index bigint, description string, department string, scenario string, patient_id bigint"
NOTE_ROWS = 'select idx as "index", description, department, scenario, patient_id from v_notes'


def notes(t: Inputs):
    return t("v_notes").withColumnRenamed("idx", "index").select("index", "description", "department", "scenario", "patient_id")


@query("k01_written_samples", NOTE_ROWS)
def k01(t: Inputs):
    folder = t.scratch("samples")
    writers.write_samples(notes(t), folder, parquet=True)
    return t.spark.read.parquet(folder)


@query("s01_json_arrays", NOTE_ROWS)
def s01(t: Inputs):
    """Notes written as JSON arrays of up to a thousand, a file each, and read by one scan."""
    folder, rows = t.scratch("arrays"), notes(t)
    arrays = rows.groupBy(F.expr("index div 1000").alias("file")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.write.partitionBy("file").text(folder)
    return readers.read_samples(t.spark, f"{folder}/*", NOTE_SCHEMA)


@query("s02_strict_lines", NOTE_ROWS)
def s02(t: Inputs):
    folder = t.scratch("lines")
    writers.write_samples(notes(t), folder)
    return readers.read_samples(t.spark, folder, NOTE_SCHEMA, lines=True)


@query("s03_tolerant_lines", """select event_id as "index", event_type as description from events where event_id % 5 <> 1 and event_id % 5 <> 2 and event_id % 5 <> 3""")
def s03(t: Inputs):
    """Log lines of which some are broken, blank or without an index."""
    good = F.to_json(F.struct(F.col("event_id").alias("index"), F.col("event_type").alias("description")))
    kind = F.col("event_id") % 5
    line = F.when(kind == 1, F.substring(good, F.lit(1), F.length(good) - 3)).when(kind == 2, F.lit("")).when(
        kind == 3, F.to_json(F.struct(F.col("event_type").alias("description")))
    ).otherwise(good)
    folder = t.scratch("log-lines")
    t("events").select(line.alias("value")).write.text(folder)
    return readers.read_samples(t.spark, folder, "index bigint, description string", lines=True, tolerant=True)


@query("s06_term_names", """select hpo_id, arg_max(name, p_partkey) as name from (select p_partkey, concat('HP:', lpad(cast(p_partkey % 1500 as varchar), 7, '0')) as hpo_id, p_name as name
  from part where p_partkey % 7 <> 0) x group by hpo_id""")
def s06(t: Inputs):
    """Tab-separated term names in file order; some lines have one field only, later ids win."""
    term = F.concat(F.lit("HP:"), F.lpad((F.col("p_partkey") % 1500).cast("string"), 7, "0"))
    line = F.when(F.col("p_partkey") % 7 == 0, term).otherwise(F.concat_ws("\t", term, F.col("p_name"), F.lit("x")))
    folder = t.scratch("term-names")
    t("part").orderBy("p_partkey").select(line.alias("value")).write.text(folder)
    return readers.read_term_names(t.spark, folder)


@query("k02_public_rows", """select doc, concat_ws('|', doc, c0) as kept, c3 as public from v_table_rows""")
def k02(t: Inputs):
    """Report rows written in full and without their identifying fields, both read back."""
    rows = t("v_table_rows").select(
        "doc", "tab", "row_no", F.array(F.array(F.col("doc").cast("string"), "c0", "c12", "c12", "c3")).alias("results")
    )
    full, public = t.scratch("report-rows"), t.scratch("report-rows-public")
    writers.write_report_rows(rows, full, public)
    key = ["doc", "tab", "row_no"]
    a = t.spark.read.schema(rows.schema).json(full).select(*key, F.array_join(F.slice(F.col("results")[0], 1, 2), "|").alias("kept"))
    b = t.spark.read.schema(rows.schema).json(public).select(*key, F.array_join(F.col("results")[0], "|").alias("public"))
    return a.join(b, key).select("doc", "kept", "public")


@query("k06_error_rows", f"with {RESULTS} select disease, error, '2024-01-02 03:04:05' as time from j where error is not null")
def k06(t: Inputs):
    """The error rows as written to CSV and read back."""
    good, bad = P.split_errors(details(t))
    folder, at = t.scratch("errors_csv"), F.lit("2024-01-02 03:04:05").cast("timestamp")
    schema = "disease string, error string, time string"
    if not writers.write_errors(bad, folder, at):
        return t.spark.createDataFrame([], schema)
    return t.spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(schema).csv(folder)


@query("k08_resumed_steps", """select doc_id as "index", case when length(text) % 11 <> 0 then
  concat('[["HP:', lpad(cast(length(text) as varchar), cast(greatest(7, length(cast(length(text) as varchar))) as int), '0'), '"]]') end as response from documents""")
def k08(t: Inputs):
    """Inference written in steps; a second run finds every step finished."""
    rows = t("documents").select(F.col("doc_id").alias("index"), "text")
    folder = t.scratch("steps")
    for _ in range(2):
        out = I.infer_in_steps(rows, "index", "text", annotate, folder, steps=3, clients=2, rate=None)
    return out.select("index", "response")


@query("h03_row_fields", """select report_id, row_no, case when row_no = 4 or phenotypes is null or trim(phenotypes) in ('正常无表型', '-') then ''
  else array_to_string(list_filter(string_split(translate(phenotypes, '；。，,、', ';;;;;'), ';'), lambda x: x <> ''), '|') end as items from v_report_rows""")
def h03(t: Inputs):
    """Rows given as lists; every fifth one lacks its second field."""
    fields = F.when(F.col("row_no") == 4, F.array(F.lit("name"))).otherwise(F.array(F.lit("name"), F.col("phenotypes")))
    return t("v_report_rows").select("report_id", "row_no", F.array_join(H.row_phenotypes(fields), "|").alias("items"))


def flaky():
    """A service that fails a prompt's first ``length % 5`` tries."""
    tried: dict[str, int] = {}

    def call(client: int, prompt: str) -> str:
        tried[prompt] = tried.get(prompt, 0) + 1
        if tried[prompt] <= len(prompt) % 5:
            raise TimeoutError("busy")
        tried[prompt] = 0
        return "fine"

    return call


@query("l04_retries", """select doc_id as "index", case when n % 5 <= 2 then 'fine' end as response, cast(case when n % 5 <= 2 then n % 5 + 1 else 3 end as int) as attempts
  from (select doc_id, length(prompt) as n from (select doc_id, concat(cast(doc_id as varchar), ':', text) as prompt from documents) p) x""")
def l04(t: Inputs):
    rows = t("documents").select(F.col("doc_id").alias("index"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text").alias("prompt"))
    out = I.infer(rows, "index", "prompt", flaky(), clients=2, rate=None, threads=1)
    return out.select("index", "response", "attempts")


def timed():
    """A service that fails the first try of every third length, and answers with the start of each try (microseconds)."""
    starts: dict[str, list[int]] = {}

    def call(client: int, prompt: str) -> str:
        starts.setdefault(prompt, []).append(time.time_ns() // 1000)
        if len(prompt) % 3 == 0 and len(starts[prompt]) == 1:
            raise TimeoutError("busy")
        return json.dumps(starts.pop(prompt))

    return call


@query("l05_rate_cap", """select cast((rn - 1) % 2 as int) as client, cast(sum(case when length(prompt) % 3 = 0 then 2 else 1 end) as bigint) as calls, true as under_rate
  from (select concat(cast(doc_id as varchar), ':', text) as prompt, row_number() over (order by doc_id) as rn from documents) x group by 1""")
def l05(t: Inputs):
    """Two clients under a cap: calls, tries after failures included, and whether no second of a client saw more than its rate."""
    rate, lanes = 4000, 4
    rows = t("documents").select(F.col("doc_id").alias("index"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text").alias("prompt"))
    out = I.infer(rows, "index", "prompt", timed(), clients=2, rate=rate, lanes=lanes, threads=1)
    starts = settled(out.select("client", F.explode(F.from_json("response", "array<bigint>")).alias("at")), "call-starts")
    # a lane's calls are a gap apart, so a second holds one more than the lane's share at most
    second = Window.partitionBy("client").orderBy("at").rangeBetween(-999_999, 0)
    seen = starts.withColumn("n", F.count(F.lit(1)).over(second))
    return seen.groupBy("client").agg(F.count(F.lit(1)).alias("calls"), (F.max("n") <= rate + lanes).alias("under_rate"))


@query("l06_rejected_answers", """select doc_id as "index", case when length(text) % 7 <> 0 then concat(cast(length(text) as varchar), ':', md5(text)) end as response,
  case when length(text) % 7 = 0 then 'rejected answer' end as error from documents""")
def l06(t: Inputs):
    def unusable(answer: str) -> bool:
        return int(answer.split(":", 1)[0]) % 7 == 0

    rows = t("documents").select(F.col("doc_id").alias("index"), "text")
    return I.infer(rows, "index", "text", gist, rate=None, is_failure=unusable).select("index", "response", "error")
