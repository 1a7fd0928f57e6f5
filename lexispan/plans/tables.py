"""The driver's tables in the roles of the rule book's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.functions.text import IN_FORCE
from lexispan.operators.catalog import Book


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dotted(c: str) -> F.Column:
    return F.date_format(F.col(c), "yyyy.MM.dd")


def book(spark: SparkSession, sf_dir: str) -> Book:
    """customer = regulations, orders = amendments, attachments and revisions,
    lineitem = articles and changes; columns a query doesn't use are never read."""
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    lineitem = table(spark, sf_dir, "lineitem")
    regulations = customer.select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("category_l0"),
        F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey").cast("string")).alias("category_l1"), F.lit(None).cast("string").alias("department"),
        F.lit(None).cast("string").alias("enact_date"), F.when(F.col("c_acctbal") >= 0, IN_FORCE).otherwise("폐지").alias("status"), F.lit(None).cast("string").alias("source_pages"),
    )
    amendments = orders.select(F.col("o_custkey").alias("regulation_id"), dotted("o_orderdate").alias("amend_date"), F.col("o_orderkey").cast("int").alias("ordinal"))
    attachments = orders.select(
        F.col("o_custkey").alias("regulation_id"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("label"), F.lit(None).cast("int").alias("start_page"),
        F.lit(None).cast("int").alias("end_page"), F.when(F.col("o_orderstatus") == "F", F.array("o_orderstatus")).alias("rows"), F.lit(None).cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("file_url"),
    )
    revisions = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("regulation_id"), dotted("o_orderdate").alias("revised_at"), F.col("o_orderpriority").alias("summary"), F.col("o_orderstatus").alias("created_at"))
    changes = lineitem.select(F.col("l_orderkey").alias("revision_id"), F.col("l_linenumber").alias("article_no"), F.col("l_returnflag").alias("article_title"))
    return Book(regulations, amendments, attachments=attachments, revisions=revisions, revision_changes=changes)
