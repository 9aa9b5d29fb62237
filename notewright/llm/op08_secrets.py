"""Query of the secret scans and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.llm import secrets
from notewright.llm.common import shared_folder, table
from notewright.llm.registry import query


def _kind_sql(rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
select doc_id, '{rule.kind}' as kind, {[r.kind for r in secrets.RULES].index(rule.kind)} as rank,
       list_sum([length(x) for x in gaps[:i]]) + coalesce(list_sum([length(x) for x in hits[:i - 1]]), 0) as s,
       length(hits[i]) as n
from (select *, unnest(range(1, len(hits) + 1)) as i from (
    select doc_id, string_split_regex(t, '{pattern}') as gaps, regexp_extract_all(t, '{pattern}', 0) as hits,
           regexp_extract_all(t, '{pattern}', {rule.group}) as counted from d))
where length(counted[i]) >= {rule.least}"""


SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
found as ({" union all ".join(_kind_sql(r) for r in secrets.RULES)}),
per_doc as (
    select doc_id, sum((kind = 'assign')::int) as n_assign, sum((kind = 'access')::int) as n_access, sum((kind = 'hex')::int) as n_hex,
           string_agg(kind || ':' || cast(s as bigint) || ':' || cast(s + n as bigint), ',' order by s, rank) as spans
    from found group by doc_id)
select d.doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access,
       cast(coalesce(n_hex, 0) as bigint) as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join per_doc using (doc_id)
"""


@query("op8_secret_scans", SQL)
def op8_secret_scans(spark, folder):
    """All secrets of every document; the ledger starts empty, so every content is scanned once."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.findings(docs, shared_folder(spark, "secret-ledger"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), listed.alias("spans")).withColumn("base_sha256", F.sha2("spans", 256))
