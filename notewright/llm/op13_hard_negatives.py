"""Query of the hard-negative mining and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.llm import hard_negatives
from notewright.llm.common import table
from notewright.llm.registry import query

SQL = """
with r as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
    select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
    from r a join r b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, p.other as positive_id, cast(row_number() over w as integer) as rank, n.other as negative_id,
       p.score as positive_score, n.score as negative_score
from p join s n on p.anchor_id = n.anchor_id and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
window w as (partition by p.anchor_id, p.other order by n.score desc, n.other)
qualify row_number() over w <= 3
"""


@query("op13_hard_negatives", SQL)
def op13_hard_negatives(spark, folder):
    """Up to three hard negatives for each of up to five positives of every anchor; some labels are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), label=label)
