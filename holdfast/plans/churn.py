"""The churn frame: a churn-shaped view of the customer, nation and orders tables, and the frames built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions import map_category
from holdfast.operators.featurize import FeatureSpec, featurize
from holdfast.operators.lookup import FeatureLookup

KEY = "customer_id"
LABEL = "churn"
POSITIVE = "Yes"

# Contract names and their length in months.
CONTRACT_MONTHS = {"Month-to-month": 1, "One year": 12, "Two year": 24}
# The segments that stand for a contract; the others are contracts without a known length.
SEGMENT_CONTRACTS = {"BUILDING": "Month-to-month", "AUTOMOBILE": "One year", "MACHINERY": "Two year"}
ACTIVE_SINCE = "2001-02-01 00:00:00"

CHURN_SPEC = FeatureSpec(
    flags={"senior": 1}, categories={"contract": CONTRACT_MONTHS}, amounts={"total_charges": 0.0}
)
COLUMNS = (KEY, "senior", "contract", "segment", "nation", "monthly_charges", "total_charges", LABEL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def churn_frame(spark: SparkSession, sf_dir: str, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """One row per customer. Both joins keep every customer, so a join whose columns are not asked for is left out.

    Orders are reduced to one row per customer before the join: a customer with very many orders is one row by then.
    """
    rows = table(spark, sf_dir, "customer")
    if "nation" in columns:
        nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        rows = rows.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    if LABEL in columns:
        last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
        rows = rows.join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    balance = F.col("c_acctbal")
    definitions = {
        KEY: F.col("c_name"),
        "senior": F.when(F.col("c_nationkey") % 5 == 0, 1).otherwise(0),
        "contract": F.coalesce(map_category("c_mktsegment", SEGMENT_CONTRACTS), "c_mktsegment"),
        "segment": F.col("c_mktsegment"),
        "nation": F.col("n_name"),
        "monthly_charges": balance,
        "total_charges": F.when(balance < 0, "  ").otherwise(balance.cast("string")),
        LABEL: F.when(F.col("last_order") >= F.lit(ACTIVE_SINCE).cast("timestamp"), "No").otherwise("Yes"),
    }
    return rows.select(*[definitions[name].alias(name) for name in columns])


def churn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The churn frame with typed features."""
    return featurize(churn_frame(spark, sf_dir), CHURN_SPEC)


def customer_features(spark: SparkSession, sf_dir: str, key: str = KEY) -> DataFrame:
    """Typed features without the label, by customer name or number."""
    names = [c for c in COLUMNS if c != LABEL]
    typed = featurize(churn_frame(spark, sf_dir, names), CHURN_SPEC)
    return typed.withColumnRenamed(KEY, key)


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the customers that ordered anything; the others have no row."""
    placed = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("orders_placed"), F.max("o_totalprice").alias("largest_order"))
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias(KEY))
    return customers.join(placed, F.col("c_custkey") == F.col("o_custkey")).select(
        KEY, "orders_placed", "largest_order"
    )


def label_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn_frame(spark, sf_dir, [KEY, LABEL])


def churn_lookups(spark: SparkSession, sf_dir: str) -> list[FeatureLookup]:
    return [
        FeatureLookup(customer_features(spark, sf_dir), KEY),
        FeatureLookup(order_features(spark, sf_dir), KEY, ["orders_placed", "largest_order"]),
    ]


def rule_prediction(df: DataFrame, contract: str = "contract") -> DataFrame:
    """A fixed rule in place of a model: customers bound for one month churn."""
    return df.withColumn("prediction", F.when(F.col(contract) == 1, "Yes").otherwise("No"))


def rule_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the rule's prediction, a score and a probability, for the metrics."""
    names = [KEY, "segment", "contract", "monthly_charges", LABEL]
    spec = FeatureSpec(categories={"contract": CONTRACT_MONTHS})
    typed = rule_prediction(featurize(churn_frame(spark, sf_dir, names), spec))
    probability = F.least(F.greatest(F.col("monthly_charges") / 10000, F.lit(0.01)), F.lit(0.99))
    return typed.withColumn("probability", probability)
