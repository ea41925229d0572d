"""Stage tables the queries share, each with its SQL block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.operators.cleaning import clean
from tidewatch.operators.split import split_limits, stratified_split
from tidewatch.plans.registry import block
from tidewatch.schema import FEATURES, KEY, LABEL
from tidewatch.session import drop_table, input_state, store
from tidewatch.sources.customers import customer_features

_STORED: dict[tuple[str, str, str, str], tuple[str, StructType]] = {}


def stage(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage of the pipeline as a stored table, written once per session and state of the input folder.

    For tables that several jobs read: customers with their split, explained customers, parsed replies. New,
    changed or removed input files give a new stage.
    """
    key = (spark.sparkContext.applicationId, folder, input_state(spark, folder), name)
    if key not in _STORED:
        table = build()
        _STORED[key] = (store(table, name), table.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)


def forget_stages(spark: SparkSession | None = None) -> None:
    """Drop the memory of stored stages, and with a session their folders too."""
    if spark is not None:
        for path, _ in _STORED.values():
            drop_table(spark, path.rsplit("/", 1)[0])
    _STORED.clear()


def features(spark: SparkSession, folder: str, columns=None) -> DataFrame:
    return customer_features(spark, folder, columns)


def cleaned(spark: SparkSession, folder: str, columns=None) -> DataFrame:
    return clean(customer_features(spark, folder, columns or [KEY, *FEATURES, LABEL]))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Keys and labels, as a stored stage of two columns: the split's limits read it twice."""
    return stage(spark, folder, "labels", lambda: customer_features(spark, folder, [KEY, LABEL]))


def with_split(spark: SparkSession, folder: str, columns=None) -> DataFrame:
    """Cleaned customers with their split; the split's limits read only keys and labels."""
    columns = [*columns, KEY, LABEL] if columns else None
    return stratified_split(
        cleaned(spark, folder, columns), limits=split_limits(labelled(spark, folder))
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned customers with their split, over a stored stage: fits read it several times.

    The split's limits (a row per class) are taken from the stored customers, so orders are read once.
    """
    whole = stage(spark, folder, "customers", lambda: cleaned(spark, folder))
    limits = stage(spark, folder, "limits", lambda: split_limits(whole.select(KEY, LABEL)))
    return stratified_split(whole, limits=limits)


def training(spark: SparkSession, folder: str) -> DataFrame:
    return customers(spark, folder).filter(F.col("split") == "train")


block("x_lines", """
SELECT l_orderkey, count(*) AS n_lines,
       count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned,
       count(*) FILTER (WHERE l_discount >= CAST('0.05' AS DOUBLE)) AS n_discounted
FROM lineitem GROUP BY l_orderkey
""")
block("x_early", """
SELECT o_custkey AS customer_id, count(*) AS n_orders,
       CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent,
       count(DISTINCT o_orderpriority) AS priorities,
       CAST(coalesce(sum(n_lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(sum(n_returned), 0) AS BIGINT) AS n_returned,
       CAST(coalesce(sum(n_discounted), 0) AS BIGINT) AS n_discounted
FROM orders LEFT JOIN x_lines ON l_orderkey = o_orderkey
WHERE o_orderdate < TIMESTAMP '2000-10-01' GROUP BY o_custkey
""")
block("x_late", "SELECT DISTINCT o_custkey AS customer_id FROM orders WHERE o_orderdate >= TIMESTAMP '2000-10-01'")
block("x_events", """
SELECT user_id AS customer_id, count(*) AS n,
       count(*) FILTER (WHERE event_type = 'view') AS views,
       count(*) FILTER (WHERE event_type = 'click') AS clicks,
       count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
       count(*) FILTER (WHERE event_type = 'error') AS errors,
       count(*) FILTER (WHERE event_type = 'signup') AS signups,
       CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total,
       coalesce(CAST(sum(CAST(value AS DECIMAL(18,4))) FILTER (WHERE event_type = 'click') AS DOUBLE), 0) AS clicked,
       count(DISTINCT CAST(ts AS DATE)) AS days
FROM events GROUP BY user_id
""")
block("x_features", """
SELECT c_custkey AS customer_id, 'CITY_' || CAST(c_custkey % 40 AS VARCHAR) AS "City",
       CAST(CASE WHEN c_custkey % 17 <> 0 THEN 18 + c_custkey % 60 END AS DOUBLE) AS "Age",
       date_diff('day', first_day, DATE '2000-10-01') / CAST('365.25' AS DOUBLE) AS "Membership_Years",
       CAST(n AS DOUBLE) AS "Login_Frequency",
       total / n AS "Session_Duration_Avg",
       CAST(views AS DOUBLE) / days AS "Pages_Per_Session",
       CASE WHEN views > 0 THEN 100.0::DOUBLE * (clicks - purchases) / views END AS "Cart_Abandonment_Rate",
       CAST(clicks AS DOUBLE) AS "Wishlist_Items",
       CAST(n_orders - n_returned AS DOUBLE) AS "Total_Purchases",
       spent / n_orders AS "Average_Order_Value",
       CAST(date_diff('day', last_day, DATE '2000-10-01') AS DOUBLE) AS "Days_Since_Last_Purchase",
       CASE WHEN n_lines > 0 THEN 100.0::DOUBLE * n_discounted / n_lines END AS "Discount_Usage_Rate",
       CASE WHEN n_lines > 0 THEN 100.0::DOUBLE * n_returned / n_lines END AS "Returns_Rate",
       100.0::DOUBLE * views / n AS "Email_Open_Rate",
       CAST(errors AS DOUBLE) AS "Customer_Service_Calls",
       CAST(signups AS DOUBLE) AS "Product_Reviews_Written",
       clicked AS "Social_Media_Engagement_Score",
       CAST(days AS DOUBLE) AS "Mobile_App_Usage",
       CAST(priorities AS DOUBLE) AS "Payment_Method_Diversity",
       spent AS "Lifetime_Value",
       c_acctbal AS "Credit_Balance",
       c_mktsegment AS "Gender", n_name AS "Country",
       'Q' || CAST(quarter(first_day) AS VARCHAR) AS "Signup_Quarter",
       CASE WHEN x_late.customer_id IS NULL THEN 1 ELSE 0 END AS "Churned"
FROM customer
LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN x_early ON x_early.customer_id = c_custkey
LEFT JOIN x_late ON x_late.customer_id = c_custkey
LEFT JOIN x_events ON x_events.customer_id = c_custkey
""")
block("x_clean", """
SELECT * EXCLUDE ("City") REPLACE (
  CASE WHEN "Total_Purchases" < 0 THEN 0.0::DOUBLE ELSE "Total_Purchases" END AS "Total_Purchases",
  CASE WHEN "Cart_Abandonment_Rate" < 0 THEN 0.0::DOUBLE WHEN "Cart_Abandonment_Rate" > 100 THEN 100.0::DOUBLE
       ELSE "Cart_Abandonment_Rate" END AS "Cart_Abandonment_Rate")
FROM x_features
""")
block("x_label", 'SELECT customer_id, "Churned" FROM x_features')
block("x_quota1", """
SELECT *, n - CAST(floor(n * draws / total) AS BIGINT) AS n_gap,
       CAST(floor(n * draws / total) AS BIGINT)
       + CASE WHEN row_number() OVER (ORDER BY n * draws / total - floor(n * draws / total) DESC, "Churned")
                   <= draws - sum(CAST(floor(n * draws / total) AS BIGINT)) OVER () THEN 1 ELSE 0 END AS n_train
FROM (SELECT "Churned", n, sum(n) OVER () AS total,
             sum(n) OVER () - CAST(ceil(CAST(sum(n) OVER () AS DOUBLE) * CAST('0.30000000000000004' AS DOUBLE)) AS BIGINT) AS draws
      FROM (SELECT "Churned", count(*) AS n FROM x_label GROUP BY 1))
""")
block("x_quota", """
SELECT "Churned", n, n_train,
       CAST(floor(held * draws / total) AS BIGINT)
       + CASE WHEN row_number() OVER (ORDER BY held * draws / total - floor(held * draws / total) DESC, "Churned")
                   <= draws - sum(CAST(floor(held * draws / total) AS BIGINT)) OVER () THEN 1 ELSE 0 END AS n_val
FROM (SELECT "Churned", n, n_train, n - n_train AS held, sum(n - n_train) OVER () AS total,
             sum(n - n_train) OVER () - CAST(ceil(CAST(sum(n - n_train) OVER () AS DOUBLE) * 0.5::DOUBLE) AS BIGINT) AS draws
      FROM x_quota1)
""")
block("x_split", """
SELECT customer_id, "Churned",
       CASE WHEN r <= n_train THEN 'train' WHEN r <= n_train + n_val THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY "Churned" ORDER BY md5(CAST(customer_id AS VARCHAR) || '-42'), customer_id) AS r
      FROM x_label) JOIN x_quota USING ("Churned")
""")
