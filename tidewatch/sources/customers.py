"""The customer table, derived from orders, line items and events.

Features use orders before the cut-off; a customer churned when none follows it. Lines are
reduced to one row per order and orders and events to one row per customer before any join, so
every join meets unique keys and a hot order, customer or user is combined map-side. Blocks
whose columns are not asked for are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schema import KEY, LABEL
from tidewatch.sources.tables import nan_to_null, read_table

CUTOFF = "2000-10-01"

_LINE_COLUMNS = {"Total_Purchases", "Discount_Usage_Rate", "Returns_Rate"}
_ORDER_COLUMNS = _LINE_COLUMNS | {
    "Signup_Quarter", "Membership_Years", "Average_Order_Value", "Lifetime_Value",
    "Days_Since_Last_Purchase", "Payment_Method_Diversity", LABEL,
}
_EVENT_COLUMNS = {
    "Login_Frequency", "Session_Duration_Avg", "Pages_Per_Session", "Cart_Abandonment_Rate",
    "Wishlist_Items", "Email_Open_Rate", "Customer_Service_Calls", "Product_Reviews_Written",
    "Social_Media_Engagement_Score", "Mobile_App_Usage",
}
ALL_COLUMNS = [
    KEY, "City", "Age", "Membership_Years", "Login_Frequency", "Session_Duration_Avg",
    "Pages_Per_Session", "Cart_Abandonment_Rate", "Wishlist_Items", "Total_Purchases",
    "Average_Order_Value", "Days_Since_Last_Purchase", "Discount_Usage_Rate", "Returns_Rate",
    "Email_Open_Rate", "Customer_Service_Calls", "Product_Reviews_Written",
    "Social_Media_Engagement_Score", "Mobile_App_Usage", "Payment_Method_Diversity",
    "Lifetime_Value", "Credit_Balance", "Gender", "Country", "Signup_Quarter", LABEL,
]


def _per_cent(part, whole):
    return F.when(whole > 0, F.lit(100.0) * part / whole)


def _order_block(spark: SparkSession, folder: str, wanted: set[str]) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    early = F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz")
    money = F.col("o_totalprice").cast("decimal(18,2)")
    aggs = {
        "early_orders": F.count_if(early),
        "late_orders": F.count_if(~early),
        "first_day": F.min(F.when(early, F.to_date("o_orderdate"))),
        "last_day": F.max(F.when(early, F.to_date("o_orderdate"))),
        "spent": F.sum(F.when(early, money)).cast("double"),
    }
    if "Payment_Method_Diversity" in wanted:
        aggs["priorities"] = F.count_distinct(F.when(early, F.col("o_orderpriority")))
    if wanted & _LINE_COLUMNS:
        lines = (
            read_table(spark, folder, "lineitem")
            .groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(
                F.count(F.lit(1)).alias("n_lines"),
                F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
                F.count_if(F.col("l_discount") >= 0.05).alias("n_discounted"),
            )
        )
        orders = orders.join(lines, "o_orderkey", "left")
        for name in ("n_lines", "n_returned", "n_discounted"):
            aggs[name] = F.coalesce(F.sum(F.when(early, F.col(name))), F.lit(0))
    per_customer = orders.groupBy(F.col("o_custkey").alias(KEY)).agg(
        *[expr.alias(name) for name, expr in aggs.items()]
    )
    n = F.col("early_orders")
    out = {
        "Signup_Quarter": F.concat(F.lit("Q"), F.quarter("first_day").cast("string")),
        "Membership_Years": F.date_diff(F.lit(CUTOFF).cast("date"), "first_day") / 365.25,
        "Average_Order_Value": F.when(n > 0, F.col("spent") / n),
        "Lifetime_Value": F.col("spent"),
        "Days_Since_Last_Purchase": F.date_diff(F.lit(CUTOFF).cast("date"), "last_day").cast("double"),
        "has_late": F.col("late_orders") > 0,
    }
    if "priorities" in aggs:
        out["Payment_Method_Diversity"] = F.when(n > 0, F.col("priorities")).cast("double")
    if "n_lines" in aggs:
        out["Total_Purchases"] = F.when(n > 0, n - F.col("n_returned")).cast("double")
        out["Discount_Usage_Rate"] = _per_cent(F.col("n_discounted"), F.col("n_lines"))
        out["Returns_Rate"] = _per_cent(F.col("n_returned"), F.col("n_lines"))
    return per_customer.select(KEY, *[expr.alias(name) for name, expr in out.items()])


def _event_block(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    value = F.col("value").cast("decimal(18,4)")
    per_user = (
        read_table(spark, folder, "events")
        .groupBy(F.col("user_id").alias(KEY))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(kind == "view").alias("views"),
            F.count_if(kind == "click").alias("clicks"),
            F.count_if(kind == "purchase").alias("purchases"),
            F.count_if(kind == "error").alias("errors"),
            F.count_if(kind == "signup").alias("signups"),
            F.sum(value).cast("double").alias("total"),
            F.coalesce(F.sum(F.when(kind == "click", value)).cast("double"), F.lit(0.0)).alias("clicked"),
            F.count_distinct(F.to_date("ts")).alias("days"),
        )
    )
    views, n = F.col("views"), F.col("n")
    return per_user.select(
        KEY,
        n.cast("double").alias("Login_Frequency"),
        (F.col("total") / n).alias("Session_Duration_Avg"),
        (views / F.col("days")).alias("Pages_Per_Session"),
        _per_cent(F.col("clicks") - F.col("purchases"), views).alias("Cart_Abandonment_Rate"),
        F.col("clicks").cast("double").alias("Wishlist_Items"),
        (F.lit(100.0) * views / n).alias("Email_Open_Rate"),
        F.col("errors").cast("double").alias("Customer_Service_Calls"),
        F.col("signups").cast("double").alias("Product_Reviews_Written"),
        F.col("clicked").alias("Social_Media_Engagement_Score"),
        F.col("days").cast("double").alias("Mobile_App_Usage"),
    )


def customer_features(
    spark: SparkSession, folder: str, columns: Iterable[str] | None = None
) -> DataFrame:
    """One row per customer; ``columns`` limits the result and the tables read for it."""
    wanted = set(columns or ALL_COLUMNS) | {KEY}
    customer = read_table(spark, folder, "customer")
    key = F.col("c_custkey")
    out = customer.select(
        key.alias(KEY),
        F.concat(F.lit("CITY_"), (key % 40).cast("string")).alias("City"),
        F.when(key % 17 != 0, 18 + key % 60).cast("double").alias("Age"),
        F.col("c_acctbal").alias("Credit_Balance"),
        F.col("c_mktsegment").alias("Gender"),
        "c_nationkey",
    )
    if "Country" in wanted:
        nation = read_table(spark, folder, "nation").select(
            F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("Country")
        )
        out = out.join(nation, "c_nationkey", "left")
    if wanted & _ORDER_COLUMNS:
        out = out.join(_order_block(spark, folder, wanted), KEY, "left").withColumn(
            LABEL, F.when(F.coalesce("has_late", F.lit(False)), 0).otherwise(1)
        )
    if wanted & _EVENT_COLUMNS:
        out = out.join(_event_block(spark, folder), KEY, "left")
    return nan_to_null(out.select(*[c for c in ALL_COLUMNS if c in wanted]))
