"""The given tables seen as trial logs and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialwright.operators.prep import one_hot
from trialwright.operators.scan import number_rows
from trialwright.operators.trials import stage_of

STAGE = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """One run per user, iterations in event order, the value as score."""
    ev = table(spark, sf_dir, "events").select(
        F.lit("events").alias("experiment"), F.col("user_id").alias("run"), F.col("value").alias("score"),
        "ts", "event_id", *extra)
    log = number_rows(ev, ["run"], ["ts", "event_id"])
    return log.select("experiment", "run", "iter", "score", *extra)


def staged_events(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return events_log(spark, sf_dir, *extra).withColumn("stage", stage_of("iter", STAGE))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per customer and priority (the experiment), the order total as score."""
    od = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("experiment"), F.col("o_custkey").alias("run"),
        F.col("o_totalprice").alias("score"), "o_orderdate", "o_orderkey")
    return number_rows(od, ["run"], ["o_orderdate", "o_orderkey"]).select("experiment", "run", "iter", "score")


LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")


def lines_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per supplier, the return flag as experiment, the extended price as score."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("experiment"), F.col("l_suppkey").alias("run"),
        F.col("l_extendedprice").alias("score"), *[c for c in LINE_ORDER if c != "l_extendedprice"], "l_extendedprice")
    return number_rows(li, ["run"], list(LINE_ORDER)).select("experiment", "run", "iter", "score")


FEATURES = ["l_extendedprice", "l_discount", "l_tax", "l_quantity",
            "l_returnflag_A", "l_returnflag_N", "l_returnflag_R", "l_linestatus_F", "l_linestatus_O"]


def line_label() -> Column:
    """The discounted and taxed price."""
    return F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))


def line_key() -> list[Column]:
    """Columns that tell line items apart, in types every SQL engine prints alike."""
    return [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
            F.date_format("l_shipdate", "yyyy-MM-dd"), F.rint(F.col("l_extendedprice") * 100).cast("bigint"),
            F.col("l_quantity").cast("int")]


def lines_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price, discount, tax, quantity and flags, with the discounted and taxed price as label."""
    li = table(spark, sf_dir, "lineitem").withColumn("label", line_label())
    li = li.withColumns({f"__k{i}": c.cast("string") for i, c in enumerate(line_key())})
    flags = one_hot(one_hot(li, "l_returnflag", values=["A", "N", "R"]), "l_linestatus", values=["F", "O"])
    return flags.select(*[f"__k{i}" for i in range(7)], *FEATURES, "label")


LINE_KEYS = [f"__k{i}" for i in range(7)]
