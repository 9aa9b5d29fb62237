"""Query of the WARC source and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.llm import warc
from notewright.llm.common import shared_folder, table
from notewright.llm.registry import query

PREFIX = "urn:page:"

SQL = """
with p as (select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
best as (select payload_digest, payload_bytes, max(page_id) as best from p where payload_bytes >= 1000 group by all)
select page_id, payload_bytes, payload_digest,
       case when best is null or best = page_id then 'response' else 'revisit' end as record_type,
       case when best is null or best = page_id then null else best end as refers_to
from p left join best using (payload_digest, payload_bytes)
"""


@query("op6_warc", SQL)
def op6_warc(spark, folder):
    """Writes every page as a record and reads the archives back; revisits are read by their headers alone."""
    pages = table(spark, folder, "pages")
    records = pages.select(
        F.concat(F.lit(f"<{PREFIX}"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">")).alias("record_id"),
        F.col("page_id").alias("order"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.col("html").alias("body"),
    )
    path = shared_folder(spark, "warc")
    warc.write(warc.deduplicated(records), path)
    number = lambda c: F.regexp_extract(c, rf"^<{PREFIX}(-?\d+)>$", 1).try_cast("long")
    responses = warc.read(spark, path).where(F.col("record_type") == "response").select(
        "record_id", "record_type", "refers_to", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    revisits = warc.read(spark, path, payloads="false").where(F.col("record_type") == "revisit").select(
        "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    return responses.unionByName(revisits).select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))
