"""Query of the token counts and its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from notewright.llm import token_counts as tc
from notewright.llm.common import shared_folder, table
from notewright.llm.registry import query

SQL = f"""
with d as (
    select doc_id, coalesce(text, '') as t, lang, row_number() over (partition by coalesce(text, '') order by doc_id) as copy,
           case when lang = 'en' then 'english' else source end as source from documents),
counted as ({" union all ".join(f"select *, '{name}' as tokenizer, len(regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}')) as n from d" for name, p in tc.COUNTERS.items())})
select source, lang, tokenizer, count(*) as n_docs, cast(sum(n) as bigint) as n_tokens from counted where copy = 1 group by all
"""


@query("op9_token_counts", SQL)
def op9_token_counts(spark, folder):
    """Totals after four batches: all documents come in, English ones move to a source of their own, the second tokenizer
    version counts all anew, and exact copies (all but the least id of a text) go. The second batch is sent twice."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    store = shared_folder(spark, "token-counts")
    first, second = tc.COUNTERS
    moved = F.when(F.col("lang") == "en", F.lit("english")).otherwise(F.col("source"))

    def events(rows, op, tokenizer, source, seq=0):
        counted = F.lit(0).cast("long") if op == "delete" else tc.count_tokens(F.col("text"), tokenizer)
        return rows.select("doc_id", F.lit(tokenizer).alias("tokenizer"), source.alias("source"), "lang", counted.alias("n_tokens"),
                           F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"))

    tc.apply_batch(spark, store, 1, events(docs, "insert", first, F.col("source")))
    english = events(docs.where("lang = 'en'"), "revise", first, moved)
    tc.apply_batch(spark, store, 2, english)
    tc.apply_batch(spark, store, 2, english)
    tc.apply_batch(spark, store, 3, events(docs, "insert", second, moved))
    narrow = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"))
    kept = narrow.groupBy("text").agg(F.min("doc_id").alias("_kept"))  # copies meet in their tasks first
    copies = narrow.join(kept, "text").where("doc_id <> _kept").select("doc_id", "lang", "source", F.lit("").alias("text"))
    tc.apply_batch(spark, store, 4, reduce(lambda a, b: a.unionByName(b), [events(copies, "delete", t, moved) for t in tc.COUNTERS]))
    return tc.totals(spark, store)
