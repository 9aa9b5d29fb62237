"""Queries on batch inference and on the submission stream.

The calls use small deterministic functions in place of a service.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright import fixed_values as V
from notewright.functions import phenotypes as H
from notewright.operators import inference as I
from notewright.operators.review import id_bits
from notewright.plans.registry import q, query, sql_trim
from notewright.plans.views import Inputs
from notewright.sources import readers, writers
from notewright.sources.scratch import settled
from notewright.streaming import submissions as S

HEAD, TAIL = V.ANNOTATION_PROMPT.split(V.PROMPT_SLOT)


def annotate(client: int, prompt: str) -> tuple[str, int]:
    """Stands in for a model: an answer and a token count from the prompt's length; some lengths fail."""
    n = len(prompt)
    if n % 11 == 0:
        raise RuntimeError("no answer")
    return f'[["HP:{n:07d}"]]', n


def gist(client: int, text: str) -> str:
    """Stands in for a translation service: the answer depends on the whole text."""
    return f"{len(text)}:{hashlib.md5(text.encode('utf-8')).hexdigest()}"


def documents(t: Inputs) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("index"), "text")


ANSWERS = """p as (select doc_id as "index", length(text) as n, (row_number() over (order by doc_id) - 1) % 3 as client from documents),
  r as (select "index", cast(client as int) as client, case when n % 11 <> 0 then concat('[["HP:', lpad(cast(n as varchar), cast(greatest(7, length(cast(n as varchar))) as int), '0'), '"]]') end as response,
    case when n % 11 <> 0 then n end as tokens, cast(case when n % 11 = 0 then 3 else 1 end as int) as attempts,
    case when n % 11 = 0 then 'RuntimeError: no answer' end as error from p)"""


def infer(df: DataFrame) -> DataFrame:
    return I.infer(df, "index", "text", annotate, clients=3, rate=None)


@query("l01_prompts", f"select idx, concat({q(HEAD)}, description, {q(TAIL)}) as prompt from v_notes")
def l01(t: Inputs):
    return t("v_notes").select("idx", I.render_prompt("description").alias("prompt"))


@query("l02_round_robin", "select doc_id, cast((row_number() over (order by doc_id) - 1) % 3 as int) as client from documents")
def l02(t: Inputs):
    return I.assign_clients(t("documents").select("doc_id"), 3, "doc_id")


@query("l03_batch_inference", f'with {ANSWERS} select "index", client, response, tokens, attempts, error from r')
def l03(t: Inputs):
    return infer(documents(t))


@query("a15_call_counters", f"with {ANSWERS} select client, count(response) as succeeded, count(*) filter (response is null) as failed from r group by client")
def a15(t: Inputs):
    return I.counters(infer(documents(t))).select("client", "succeeded", "failed")


@query("a16_token_usage", f"with {ANSWERS} select client, cast(sum(tokens) as bigint) as tokens from r group by client")
def a16(t: Inputs):
    return I.counters(infer(documents(t))).select("client", "tokens")


@query("l07_resumed_inference", """select doc_id as "index", case when doc_id % 4 = 0 then 'kept' when length(text) % 11 <> 0 then
  concat('[["HP:', lpad(cast(length(text) as varchar), cast(greatest(7, length(cast(length(text) as varchar))) as int), '0'), '"]]') end as response from documents""")
def l07(t: Inputs):
    done = documents(t).where(F.col("index") % 4 == 0).select(
        "index", F.lit(0).alias("client"), F.lit("kept").alias("response"), F.lit(None).cast("bigint").alias("tokens"),
        F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error"),
    )
    return I.infer_pending(documents(t), done, "index", "text", annotate, clients=3, rate=None).select("index", "response")


FENCE = r"(?s)^\s*```[a-zA-Z]*\s*\n?|\n?\s*```\s*$"
PARSED = f"""b as (select idx, {sql_trim(f"regexp_replace(response, {q(FENCE)}, '', 'g')")} as body from v_answers),
  j as (select idx, from_json(case when json_valid(body) then body else '[]' end, '[["varchar"]]') as rows from b),
  x as (select idx, z[1] as pos, z[2] as f from (select idx, unnest(list_zip(range(len(rows)), rows)) as z from j) y)"""


@query("l08_parsed_answers", f"with {PARSED} select idx, f[1] as hpo_id, f[2] as name_en, f[3] as name_zh, f[4] as mention from (select *, row_number() over (partition by idx, f[1] order by pos) as rn from x) w where rn = 1")
def l08(t: Inputs):
    return t("v_answers").select("idx", F.explode(H.parse_annotations("response")).alias("a")).select("idx", "a.*")


@query("p10_first_elements", f"with {PARSED} select idx, coalesce(string_agg(f[1], '|' order by pos), '') as ids from x group by idx")
def p10(t: Inputs):
    """First elements of the nested lists of each answer, through the parsed JSON."""
    body = F.regexp_replace("response", r"```(?:json)?", "")
    nested = t("v_answers").select("idx", F.from_json(body, "array<array<string>>").alias("rows")).where(F.size("rows") > 0)
    return nested.select("idx", F.array_join(H.first_elements("rows"), "|").alias("ids"))


@query("p11_second_elements", f"with {PARSED} select idx, array_to_string(list_sort(list_distinct(list(f[2]))), '|') as names from x where len(f) >= 2 group by idx")
def p11(t: Inputs):
    body = F.regexp_replace("response", r"```(?:json)?", "")
    nested = t("v_answers").select("idx", F.from_json(body, "array<array<string>>").alias("rows")).where(F.size("rows") > 0)
    return nested.select("idx", F.array_join(F.array_sort(H.second_elements("rows")), "|").alias("names"))


@query("l09_translated_notes", "select idx, concat(cast(length(description) as varchar), ':', md5(description)) as translated from v_notes")
def l09(t: Inputs):
    rows = t("v_notes").select(F.col("idx").alias("index"), "description")
    out = I.infer(rows, "index", "description", gist, clients=2, rate=None)
    return I.with_responses(rows.select("index"), out, "index", "translated").select(F.col("index").alias("idx"), "translated")


@query("u02_phenotype_extractor", """select doc_id as "index", concat(cast(length(text) as varchar), ':', md5(text)) as response from documents where length(text) > 0""")
def u02(t: Inputs):
    """A caller's extractor on every non-empty text, with retries and without a rate cap."""
    rows = documents(t).where(F.length("text") > 0)
    return I.infer(rows, "index", "text", gist, rate=None).select("index", "response")


# ---- stream -------------------------------------------------------------------------------------------


def submission_stream(t: Inputs) -> DataFrame:
    """Submissions as a file stream over the events."""
    source = t("events")
    # as a glob, so that the table may be a single file or a folder of files
    raw = t.spark.readStream.schema(source.schema).parquet(f"{t.folder}/events.parque[t]")
    seq = F.col("event_id")
    sure = F.when(seq % 13 == 0, F.lit(False)).when(seq % 7 != 0, F.lit(True))
    return raw.select(
        seq.alias("seq"), (2 * (seq % 2000)).alias("index"), sure.alias("is_sure")
    )


FIRST = "f as (select idx, min(seq) as seq from v_submissions group by idx)"


@query("r01_accepted_stream", f"with {FIRST} select s.seq, s.idx as \"index\", s.is_sure from v_submissions s join f on f.idx = s.idx and f.seq = s.seq")
def r01(t: Inputs):
    log = t.scratch("accepted")
    stream = submission_stream(t)
    S.accept_stream(stream, log, t.scratch("accepted-state")).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(log).drop("batch")


@query("r01_accepted_stream_with_log", """with l as (select idx from v_submissions where seq < 500), n as (select * from v_submissions where seq >= 500),
  f as (select idx, min(seq) as seq from n where idx not in (select idx from l) group by idx)
  select n.seq, n.idx as "index", n.is_sure from n join f on f.idx = n.idx and f.seq = n.seq""")
def r01_log(t: Inputs):
    """The stream started on a log that holds the first submissions already; the same rows as j04_first_submission_with_log accepts."""
    log, old = t.scratch("accepted"), t.scratch("logged")
    v = t("v_submissions").withColumnRenamed("idx", "index")
    v.where("seq < 500").write.parquet(old)
    stream = submission_stream(t).where("seq >= 500")
    logged = t.spark.readStream.schema(v.schema).parquet(old)
    S.accept_stream(stream, log, t.scratch("accepted-state"), logged=logged).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(log).drop("batch")


@query("r02_stream_progress", """with c as (select (select count(*) from v_notes) as total, (select count(distinct idx) from v_submissions) as annotated,
    (select count(*) from v_notes where idx not in (select idx from v_submissions)) as remaining)
  select total, annotated, remaining, case when total > 0 then round_even(annotated / total * 100, 1) else 0 end as percentage from c""")
def r02(t: Inputs):
    queued = settled(id_bits(t("v_notes"), "idx"), "queued-ids")
    log, counts = t.scratch("progress-log"), t.scratch("progress")
    stream = submission_stream(t)
    after = S.progress_writer(queued, counts)
    S.accept_stream(stream, log, t.scratch("progress-state"), after=after).awaitTermination()
    written = t.spark.read.schema("batch_id bigint, accepted bigint, from_queue bigint").parquet(counts)
    return S.progress_after_batches(queued.agg(F.sum(F.bitmap_count("bits"))).first()[0] or 0, written)


@query("k03_appended_log", "select seq, idx as \"index\", coalesce(is_sure, true) as is_sure from v_submissions")
def k03(t: Inputs):
    """Submissions appended to a JSON log in two writes and read back."""
    folder = t.scratch("log")
    rows = t("v_submissions").select("seq", F.col("idx").alias("index"), F.coalesce("is_sure", F.lit(True)).alias("is_sure"))
    writers.append_submissions(rows.where(F.col("seq") % 2 == 0), folder)
    writers.append_submissions(rows.where(F.col("seq") % 2 == 1), folder)
    return readers.read_samples(t.spark, folder, "seq bigint, index bigint, is_sure boolean", lines=True, tolerant=True)
