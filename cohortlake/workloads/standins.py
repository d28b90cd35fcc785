"""Logical tables (predictions, subjects, scans, volumes, runs) as views of the driver tables.

Each function has a SQL twin in :data:`SQL`, used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Binary predictions with heavy ties: run, subject, line, y, p."""
    return table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("run"),
        F.col("l_orderkey").alias("subject"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        (F.col("l_quantity") / 50).alias("p"),
        F.col("l_discount").alias("d"),
    )


def fine_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Binary predictions with near-continuous scores: run, subject, y, p."""
    return table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("run"),
        F.col("l_orderkey").alias("subject"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        (F.col("l_extendedprice") / 200000).alias("p"),
    )


def document_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Imbalanced predictions: lang, doc_id, y, p."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("lang").alias("run"),
        "doc_id",
        F.col("quality").alias("y"),
        ((F.col("n_chars") % 1000) / 1000).alias("p"),
    )


def multiclass(spark: SparkSession, sf: str) -> DataFrame:
    """Three-class predictions: run, y, pred, s0..s2."""
    q = F.col("l_quantity").cast("int")
    return table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("run"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("y"),
        (F.round(F.col("l_discount") * 100).cast("int") % 3).alias("pred"),
        *[((q * (k + 1) % 50) / 50).alias(f"s{k}") for k in range(3)],
    )


def logits(spark: SparkSession, sf: str, n: int = 64) -> DataFrame:
    """vec_id, y, logits array<double> of n classes: the whole vector unless a query asks for two."""
    return table(spark, sf, "embeddings").select(
        "vec_id",
        (F.col("label") % n).alias("y"),
        F.slice("embedding", 1, n).cast("array<double>").alias("logits"),
    )


def runs_of_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated two-class predictions: subject, run, cls, prob."""
    p = F.col("l_discount") * 10
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("subject"),
        (F.col("l_linenumber") * 100 + F.col("l_partkey") % 100).alias("run"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("cls"), (1 - p).alias("prob")),
                F.struct(F.lit(1).alias("cls"), p.alias("prob")),
            )
        ).alias("s"),
    ).select("subject", "run", "s.cls", "s.prob")


SQL = {
    "preds": """preds AS (SELECT l_linestatus AS run, l_orderkey AS subject, l_linenumber AS line,
  CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS y, l_quantity/50 AS p, l_discount AS d FROM lineitem)""",
    "fine": """fine AS (SELECT l_linestatus AS run, l_orderkey AS subject,
  CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS y, l_extendedprice/200000 AS p FROM lineitem)""",
    "docs": """docs AS (SELECT lang AS run, doc_id, quality AS y, (n_chars % 1000)/1000.0::DOUBLE AS p
  FROM labels JOIN documents USING (doc_id))""",
    "multi": """multi AS (SELECT l_linestatus AS run,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
  CAST(round(l_discount*100) AS INT) % 3 AS pred,
  (CAST(l_quantity AS INT) % 50)/50.0::DOUBLE AS s0,
  (CAST(l_quantity AS INT)*2 % 50)/50.0::DOUBLE AS s1,
  (CAST(l_quantity AS INT)*3 % 50)/50.0::DOUBLE AS s2 FROM lineitem)""",
    "logits": """logits AS (SELECT vec_id, label % 64 AS y, k, CAST(embedding[k+1] AS DOUBLE) AS v
  FROM embeddings, unnest(range(64)) AS t(k))""",
    "tta": """tta AS (SELECT l_orderkey AS subject, l_linenumber*100 + l_partkey % 100 AS run, cls,
  CASE WHEN cls=1 THEN l_discount*10 ELSE 1 - l_discount*10 END AS prob
  FROM lineitem, unnest([0,1]) AS t(cls))""",
}


def with_(*names: str, rest: str = "") -> str:
    """``WITH`` prefix holding the named SQL twins."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + (",\n" + rest if rest else "") + "\n"
