"""Reconciliation of routes with API specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import route_key, template_path


def reconcile(routes: DataFrame, spec_ops: DataFrame, specs: DataFrame, *by: str) -> DataFrame:
    """An operation a row: in_code, in_docs, owners, covered (by an authored specification), unsure, ambiguous.

    Both sides are reduced to distinct operations before the full outer join. unsure: in code, and a specification
    of unknown authorship has it; ambiguous: in code, with more than one owner.
    """
    code = routes.select(*by, route_key(F.col("method"), template_path(F.col("ginPath"))).alias("operation")).distinct().withColumn("code", F.lit(True))
    ops = spec_ops.join(specs.select("spec_id", "authorship"), "spec_id")
    docs = ops.select(*by, route_key(F.upper("method"), F.col("path")).alias("operation"), "authorship").groupBy(*by, "operation").agg(F.count(F.lit(1)).alias("owners"), F.bool_or(F.col("authorship") == "authored").alias("authored"), F.bool_or(F.col("authorship") == "unknown").alias("unknown"))
    rows = code.join(docs, [*by, "operation"], "full_outer")
    inside, owners = F.coalesce("code", F.lit(False)), F.coalesce("owners", F.lit(0))
    return rows.select(*by, "operation", inside.alias("in_code"), F.col("owners").isNotNull().alias("in_docs"), owners.alias("owners"), (inside & F.coalesce("authored", F.lit(False))).alias("covered"), (inside & F.coalesce("unknown", F.lit(False))).alias("unsure"), (inside & (owners > 1)).alias("ambiguous"))


def documentation(reconciled: DataFrame, *by: str) -> DataFrame:
    """numerator, denominator, lists' sizes and status by module: complete, or unknown without code or where authorship is unsure."""
    rows = reconciled.groupBy(*by).agg(F.count_if("covered").alias("numerator"), F.count_if("in_code").alias("denominator"), F.count_if(F.col("in_code") & ~F.col("covered")).alias("code_only"), F.count_if(~F.col("in_code")).alias("docs_only"), F.count_if("ambiguous").alias("ambiguous"), F.coalesce(F.bool_or("unsure"), F.lit(False)).alias("unsure"))
    return rows.withColumn("status", F.when((F.col("denominator") == 0) | F.col("unsure"), "unknown").otherwise("complete")).drop("unsure")
