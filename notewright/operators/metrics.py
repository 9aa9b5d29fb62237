"""Macro precision, recall and F1 of extraction methods against human labels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright import fixed_values as V
from notewright.functions.phenotypes import second_elements, union_lists
from notewright.functions.text import col


def truth_set(labels: Column | str, truth_keys: Sequence[str] = V.TRUTH_KEYS) -> Column:
    labels = col(labels)
    return union_lists(*[labels[k] for k in truth_keys])


def prediction_set(df: DataFrame, method: str, nested: Iterable[str] = V.NESTED_METHODS, legacy: bool = False) -> Column:
    """Distinct predictions of a method; a missing column gives the empty set.

    Methods in ``nested`` hold lists per prediction and score their second element.
    ``legacy`` scores a flat list of such a method as empty instead of as it is.
    """
    field = next((f for f in df.schema.fields if f.name == method), None)
    if field is None:
        return union_lists()
    column = F.col(f"`{method}`")
    if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.ArrayType):
        return union_lists(second_elements(column) if method in nested else F.flatten(column))
    return union_lists() if legacy and method in nested else union_lists(column)


def sample_sets(df: DataFrame, methods: Sequence[str] = V.METHODS, truth_keys: Sequence[str] = V.TRUTH_KEYS,
                by: Sequence[str] = ("source", "department"), nested: Iterable[str] = V.NESTED_METHODS,
                legacy: bool = False) -> DataFrame:
    """One row per sample and method with the sizes of truth, prediction and overlap.

    Works inside the row, so no sample is shuffled; only the three sizes are unpivoted.
    """
    have = set(df.columns)
    groups = [F.coalesce(F.col(g), F.lit(V.UNKNOWN)).alias(g) if g in have else F.lit(V.UNKNOWN).alias(g) for g in by]
    sets = df.select(
        "index", *groups, truth_set("human_annotated", truth_keys).alias("_truth"),
        *[prediction_set(df, m, nested, legacy).alias(f"_p{i}") for i, m in enumerate(methods)],
    )
    sizes = [
        F.struct(
            F.lit(m).alias("method"),
            F.size("_truth").cast("bigint").alias("n_truth"),
            F.size(f"_p{i}").cast("bigint").alias("n_pred"),
            F.size(F.array_intersect("_truth", f"_p{i}")).cast("bigint").alias("n_hit"),
        )
        for i, m in enumerate(methods)
    ]
    return sets.select("index", *by, F.explode(F.array(*sizes)).alias("_s")).select("index", *by, "_s.*")


def term_sets(terms: DataFrame, methods: dict[str, str], by: Sequence[str] = ("source", "department"),
              truth: str = "is_truth") -> DataFrame:
    """The same sizes from long rows ``(idx, *by, term, flags)``, for sets too large for a row.

    Repeats of a term are folded by a partial aggregate before the per-sample sums, so
    neither a frequent term nor a huge sample gathers in one task.
    """
    groups = [F.coalesce(F.col(g), F.lit(V.UNKNOWN)).alias(g) for g in by]
    flags = {truth: "_t"} | {c: f"_p{i}" for i, c in enumerate(methods.values())}
    known = F.col("term").isNotNull()
    distinct = terms.groupBy(F.col("idx").alias("index"), *groups, "term").agg(
        *[F.max(F.when(known, F.col(c)).otherwise(F.lit(0))).alias(a) for c, a in flags.items()]
    )
    sums = [F.sum("_t").cast("bigint").alias("n_truth")]
    for i in range(len(methods)):
        sums += [F.sum(f"_p{i}").cast("bigint").alias(f"_n{i}"),
                 F.sum(F.col("_t") * F.col(f"_p{i}")).cast("bigint").alias(f"_h{i}")]
    rows = [
        F.struct(F.lit(m).alias("method"), F.col(f"_n{i}").alias("n_pred"), F.col(f"_h{i}").alias("n_hit"))
        for i, m in enumerate(methods)
    ]
    return (
        distinct.groupBy("index", *by).agg(*sums)
        .select("index", *by, "n_truth", F.explode(F.array(*rows)).alias("_s"))
        .select("index", *by, "_s.method", "n_truth", "_s.n_pred", "_s.n_hit")
    )


def scored(sizes: DataFrame) -> DataFrame:
    """Precision and recall per sample; both sets empty score 1, exactly one empty scores 0."""
    both_empty = (F.col("n_truth") == 0) & (F.col("n_pred") == 0)

    def ratio(total: str) -> Column:
        return (
            F.when(both_empty, F.lit(1.0))
            .when((F.col("n_truth") == 0) | (F.col("n_pred") == 0), F.lit(0.0))
            .otherwise(F.col("n_hit") / F.col(total))
        )

    return sizes.withColumn("precision", ratio("n_pred")).withColumn("recall", ratio("n_truth"))


def _macro() -> list[Column]:
    return [
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("n"),
        F.min("index").alias("first_index"),
    ]


def with_f1(df: DataFrame) -> DataFrame:
    """Harmonic mean of the macro values, 0 when both are 0."""
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))


def metrics(sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return with_f1(scored(sizes).groupBy("method", *by).agg(*_macro()))


def report(sizes: DataFrame, groupings: Sequence[str] = ("source", "department")) -> DataFrame:
    """Overall metrics and metrics by each grouping from one pass over the samples.

    ``grouping`` says which column a row belongs to (``overall`` for none) and
    ``value`` holds its value.
    """
    rows = scored(sizes)
    sets = [[F.col("method")]] + [[F.col("method"), F.col(g)] for g in groupings]
    aggs = [F.grouping(g).alias(f"_g_{g}") for g in groupings]
    out = rows.groupingSets(sets, F.col("method"), *[F.col(g) for g in groupings]).agg(*_macro(), *aggs)
    which, value = F.lit("overall"), F.lit(None).cast("string")
    for g in groupings:
        which = F.when(F.col(f"_g_{g}") == 0, F.lit(g)).otherwise(which)
        value = F.when(F.col(f"_g_{g}") == 0, F.col(g)).otherwise(value)
    out = out.withColumn("grouping", which).withColumn("value", value)
    return with_f1(out).select("grouping", "value", "method", "precision", "recall", "f1", "n", "first_index")


def groups_by_size(df: DataFrame, group: str, position: str) -> DataFrame:
    """Groups by falling size, ties by first appearance."""
    return (
        df.groupBy(F.coalesce(F.col(group), F.lit(V.UNKNOWN)).alias(group))
        .agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first_position"))
        .orderBy(F.desc("n"), "first_position")
    )


def ranked_methods(result: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Methods ranked by F1; ``result`` holds one row per method and group."""
    return result.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc("f1"))))
