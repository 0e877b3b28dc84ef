"""Conditional probability tables of labelled neighbours, and exact inference on small networks by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.functions.values import normalised, weight_of


def cpt(spark: SparkSession, labels: int = 4, parents: int = 4) -> DataFrame:
    """All labels ** parents combinations c1, c2, ... with the normalised weights w1, w2, ... of their labels."""
    total = labels**parents
    at = spark.range(total)
    picks = [((F.floor(F.col("id") / labels ** (parents - 1 - k)) % labels) + 1).cast("int").alias(f"c{k + 1}") for k in range(parents)]
    cases = at.select(*picks)
    shares = normalised([weight_of(F.col(f"c{k + 1}")).cast("double") for k in range(parents)])
    return cases.select("*", *(s.alias(f"w{k + 1}") for k, s in enumerate(shares)))


def multiplied(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two factors: tables of variables and a column p."""
    shared = [c for c in a.columns if c in b.columns and c != "p"]
    b = b.withColumnRenamed("p", "__q")
    both = a.join(b, shared) if shared else a.crossJoin(b)  # factors of a network are small by construction
    return both.withColumn("p", F.col("p") * F.col("__q")).drop("__q")


def summed_out(factor: DataFrame, variable: str) -> DataFrame:
    keep = [c for c in factor.columns if c not in (variable, "p")]
    return factor.groupBy(*keep).agg(F.sum("p").alias("p"))


def posterior(factors: list[DataFrame], query: str, evidence: dict[str, object]) -> DataFrame:
    """(query, p) given the evidence, by variable elimination in order of name."""
    for name, value in evidence.items():
        factors = [f.where(F.col(name) == value).drop(name) if name in f.columns else f for f in factors]
    for v in sorted({c for f in factors for c in f.columns} - {"p", query}):
        own, factors = [f for f in factors if v in f.columns], [f for f in factors if v not in f.columns]
        product = own[0]
        for f in own[1:]:
            product = multiplied(product, f)
        factors.append(summed_out(product, v))
    product = factors[0]
    for f in factors[1:]:
        product = multiplied(product, f)
    total = product.agg(F.sum("p").alias("__t"))
    return product.crossJoin(F.broadcast(total)).select(query, (F.col("p") / F.col("__t")).alias("p"))
