"""Query of the fill-in-the-middle transformation and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.llm import infill
from notewright.llm.common import table
from notewright.llm.registry import query

SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || doc_id) as h from documents),
u as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as units,
             cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(units[1:a], '') as pre, array_to_string(units[a + 1:b], '') as mid, array_to_string(units[b + 1:], '') as suf from c)
select doc_id, cast(n as bigint) as n, form, cast(case when form <> 'plain' then length(pre) end as bigint) as prefix_chars,
       cast(case when form <> 'plain' then length(mid) end as bigint) as middle_chars,
       sha256(case form when 'plain' then t when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid else '<P>' || pre || '<S>' || suf || '<M>' || mid end) as output_sha256,
       sha256(t) as restored_sha256 from p
"""


@query("op11_infill", SQL)
def op11_infill(spark, folder):
    """Every document in its form, and the text rebuilt from it, as digests."""
    done = infill.transform(table(spark, folder, "documents").select("doc_id", "text"))
    out, form = F.col("infill.output"), F.col("infill.form")
    return done.select(
        "doc_id", "infill.n", "infill.form", "infill.prefix_chars", "infill.middle_chars",
        F.sha2(out, 256).alias("output_sha256"), F.sha2(infill.restored(out, form), 256).alias("restored_sha256"))
