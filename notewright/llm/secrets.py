"""Secret scans over versions of files, with a ledger of what was scanned before.

Every version's content is addressed by its SHA-256. A scan looks only at (content, rule version) pairs that the
ledger lacks, appends one self-contained row per pair (also where nothing was found), and joins the findings back
to every path and version that holds the content. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regular expression, the group whose length counts, and the least length."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Kinds in the order in which spans that start together are listed.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)

SPANS = "array<struct<start:int,end:int>>"
LEDGER = T.StructType([
    T.StructField("blob", T.BinaryType()), T.StructField("rule", T.StringType()),
    T.StructField("start", T.ArrayType(T.IntegerType())), T.StructField("end", T.ArrayType(T.IntegerType())),
])


def blob(text: Column) -> Column:
    """The content's address; a null text is the empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows (blob, rule, start, end); empty where none was written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _hits(text: Column, rule: Rule) -> Column:
    """For each match: the length of the text before it since the last match, its own length, and its group's length."""
    every = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(every))
    # side by side first: inside the function the text would be searched again for every match
    groups = [] if rule.group == 0 else [F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))]
    zipped, counted = F.arrays_zip(every, gaps, *groups), "2" if groups else "0"
    return F.transform(zipped, lambda x, i: F.struct(
        i.alias("i"), F.length(x["1"]).alias("gap"), F.length(x["0"]).alias("size"), F.length(x[counted]).alias("counted")))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of (blob, text, todo: array of rule keys); one row per blob and rule in ``todo``.

    Matches are found leftmost and without overlaps per rule, those whose group is too short are left out. Positions
    count code points, ends are exclusive.
    """
    found = F.array(*[
        F.struct(F.lit(r.key).alias("rule"), F.when(F.array_contains("todo", r.key) & F.col("text").rlike(r.pattern), _hits(F.col("text"), r)).alias("hits"), F.lit(r.least).alias("least"))
        for r in rules
    ])
    rows = blobs.select("blob", F.inline(F.filter(found, lambda f: F.array_contains(F.col("todo"), f["rule"]))))
    one = rows.select("blob", "rule", "least", F.inline_outer("hits"))
    run = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(run)
    spans = one.select("blob", "rule", "i", (end - F.col("size")).cast("int").alias("start"), end.cast("int").alias("end"),
                       (F.col("counted") >= F.col("least")).alias("kept"))
    kept = F.collect_list(F.when(F.col("kept"), F.struct("start", "end")))
    spans = spans.groupBy("blob", "rule").agg(F.array_sort(kept).alias("spans"))
    return spans.select("blob", "rule", F.col("spans.start").alias("start"), F.col("spans.end").alias("end"))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Brings the ledger up to date with all contents in ``versions`` and returns its rows for ``rules``.

    A run that breaks off leaves whole rows at most, which the next run need not make again; a second run over
    the same contents scans nothing.
    """
    spark = versions.sparkSession
    contents = versions.select(blob(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seen = read_ledger(spark, ledger).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    every = F.array(*[F.lit(r.key) for r in rules])
    # copies meet inside each task first, so that a content goes over the network once per task at most
    distinct = contents.groupBy("blob").agg(F.first("text").alias("text"))
    todo = distinct.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
    scan_blobs(todo.where(F.size("todo") > 0), rules).write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger).where(F.col("rule").isin([r.key for r in rules])).dropDuplicates(["blob", "rule"])


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text", spans: str = "secrets") -> DataFrame:
    """Adds to every row of ``versions`` the spans found in its content: ``array<struct<start, kind, end>>`` by start, then kind.

    Null texts are empty and have no spans; repeated rows stay; an empty table gives an empty result. Columns of
    ``versions`` may have any names; one named like the result is replaced.
    """
    order = {r.key: (i, r.kind) for i, r in enumerate(rules)}
    rank = F.create_map(*[F.lit(x) for k, (i, _) in order.items() for x in (k, i)])
    rows = scan(versions, ledger, rules, text).where(F.size("start") > 0)
    placed = F.transform(F.arrays_zip("start", "end"), lambda s: F.struct(
        s["start"].alias("start"), rank[F.col("rule")].alias("kind"), s["end"].alias("end")))
    per_blob = rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(placed))).alias("_spans"))
    names = F.array(*[F.lit(kind) for _, kind in order.values()])
    keyed = versions.select("*", blob(F.col(text)).alias("_blob"))
    joined = keyed.join(per_blob, F.col("_blob") == F.col("blob"), "left").drop("blob", "_blob") if "blob" not in versions.columns else \
        keyed.join(per_blob.withColumnRenamed("blob", "_key"), F.col("_blob") == F.col("_key"), "left").drop("_key", "_blob")
    named = F.transform(F.coalesce("_spans", F.array().cast("array<struct<start:int,kind:int,end:int>>")), lambda s: F.struct(
        s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end")))
    return joined.withColumn(spans, named).drop("_spans")


def redact(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The rows with every found span replaced by ``mask``; overlapping spans are replaced as one. Null texts stay null."""
    spans = "_secrets"
    rows = findings(versions, ledger, rules, text, spans)
    t = F.col(text)
    # (text so far, end of what is copied): spans come by start
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(spans, state, lambda acc, s: F.struct(
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))
        .otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at")))
    masked = F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(t, done["at"] + 1, F.length(t)))).otherwise(t)
    return rows.withColumn(text, masked).drop(spans)
