"""Customer schema and the feature dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

KEY = "customer_id"
LABEL = "Churned"
DROPPED = ["City"]

# The numeric features in table order with readable name and churn
# direction (1: a high value goes with churn, -1: with staying, 0: neither).
NUMERIC = [
    ("Age", "Age", -1),
    ("Membership_Years", "Membership duration (years)", -1),
    ("Login_Frequency", "Login frequency", -1),
    ("Session_Duration_Avg", "Average session duration", -1),
    ("Pages_Per_Session", "Pages browsed per session", -1),
    ("Cart_Abandonment_Rate", "Cart abandonment rate", 1),
    ("Wishlist_Items", "Wishlist items count", -1),
    ("Total_Purchases", "Total purchases", -1),
    ("Average_Order_Value", "Average order value", 1),
    ("Days_Since_Last_Purchase", "Days since last purchase", 1),
    ("Discount_Usage_Rate", "Discount usage rate", -1),
    ("Returns_Rate", "Returns rate", 1),
    ("Email_Open_Rate", "Email open rate", -1),
    ("Customer_Service_Calls", "Customer service calls", 1),
    ("Product_Reviews_Written", "Product reviews written", -1),
    ("Social_Media_Engagement_Score", "Social media engagement score", -1),
    ("Mobile_App_Usage", "Mobile app usage", -1),
    ("Payment_Method_Diversity", "Payment method diversity", 0),
    ("Lifetime_Value", "Lifetime value", -1),
    ("Credit_Balance", "Credit balance", -1),
]
# The categorical features; they have no direction.
CATEGORICAL = [
    ("Gender", "Gender"),
    ("Country", "Country"),
    ("Signup_Quarter", "Signup quarter"),
]
# Valid ranges; either bound may be open.
CLIP_RANGES = {"Total_Purchases": (0.0, None), "Cart_Abandonment_Rate": (0.0, 100.0)}

NUMERIC_NAMES = [name for name, _, _ in NUMERIC]
CATEGORICAL_NAMES = [name for name, _ in CATEGORICAL]
FEATURES = NUMERIC_NAMES + CATEGORICAL_NAMES
DESCRIPTIONS = {n: d for n, d, _ in NUMERIC} | dict(CATEGORICAL)
DIRECTIONS = {n: s for n, _, s in NUMERIC}

CUSTOMER_SCHEMA = T.StructType(
    [T.StructField(KEY, T.LongType()), T.StructField("City", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in NUMERIC_NAMES]
    + [T.StructField(n, T.StringType()) for n in CATEGORICAL_NAMES]
    + [T.StructField(LABEL, T.IntegerType())]
)


def feature_kinds(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature lists, checked against the table's types.

    The lists are explicit: choosing by type alone would turn an integer key into a feature.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    wrong = [n for n in NUMERIC_NAMES if n in types and not isinstance(types[n], T.NumericType)]
    wrong += [n for n in CATEGORICAL_NAMES if n in types and not isinstance(types[n], T.StringType)]
    if wrong:
        raise TypeError(f"columns of unexpected type: {wrong}")
    return [n for n in NUMERIC_NAMES if n in types], [n for n in CATEGORICAL_NAMES if n in types]


def feature_dimension(spark: SparkSession) -> DataFrame:
    """One row per feature: position, name, description, direction, kind (23 rows)."""
    rows = [(i, n, d, s, "numeric") for i, (n, d, s) in enumerate(NUMERIC)]
    rows += [(len(NUMERIC) + i, n, d, 0, "categorical") for i, (n, d) in enumerate(CATEGORICAL)]
    return spark.createDataFrame(
        rows, "position int, feature string, description string, direction int, kind string"
    )
