"""Scans, cleaning, split and class statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import benchmarks, cleaning, prepare, split
from tidewatch.plans import data
from tidewatch.plans.registry import query
from tidewatch.schema import CATEGORICAL_NAMES, FEATURES, KEY, LABEL, NUMERIC_NAMES
from tidewatch.session import work_path
from tidewatch.sources import sinks, tables


@query("scan_customers", "SELECT * FROM x_features")
def scan_customers(spark, folder):
    path = work_path(spark, "customers")
    sinks.write_table(data.features(spark, folder), path, "csv")
    return tables.scan_customers(spark, path, "csv")


@query("customer_features", "SELECT * FROM x_features")
def customer_features(spark, folder):
    return data.features(spark, folder)


@query("scan_intermediate", 'SELECT customer_id, "Churned", split FROM x_split')
def scan_intermediate(spark, folder):
    path = work_path(spark, "split")
    stored = split.persist_split(data.labelled(spark, folder), path)
    return tables.scan_intermediate(spark, path, stored.schema)


@query("drop_columns", 'SELECT * EXCLUDE ("City") FROM x_features')
def drop_columns(spark, folder):
    return cleaning.drop_columns(data.features(spark, folder))


@query("clip_ranges", 'SELECT customer_id, "Total_Purchases", "Cart_Abandonment_Rate" FROM x_clean')
def clip_ranges(spark, folder):
    wanted = ["Total_Purchases", "Cart_Abandonment_Rate"]
    return cleaning.clip_ranges(data.features(spark, folder, wanted))


@query("split_label", 'SELECT * EXCLUDE ("Churned") FROM x_clean')
def split_label(spark, folder):
    return cleaning.split_label(data.cleaned(spark, folder))[0]


@query("class_filter", 'SELECT customer_id, "Lifetime_Value" FROM x_clean WHERE "Churned" = 1')
def class_filter(spark, folder):
    df = data.cleaned(spark, folder, [KEY, "Lifetime_Value", LABEL])
    return cleaning.class_filter(df, 1).drop(LABEL)


@query("stratified_split", 'SELECT customer_id, "Churned", split FROM x_split')
def stratified_split(spark, folder):
    return split.stratified_split(data.labelled(spark, folder))


@query("split_summary", """
SELECT split, count(*) AS n, round_even(avg("Churned") * 100, 6) AS churn_pct FROM x_split GROUP BY split
""")
def split_summary(spark, folder):
    return split.split_summary(split.stratified_split(data.labelled(spark, folder)))


@query("class_counts", """
SELECT count(*) FILTER (WHERE "Churned" = 0) AS negatives, count(*) FILTER (WHERE "Churned" = 1) AS positives,
       round_even(CAST(count(*) FILTER (WHERE "Churned" = 0) AS DOUBLE) / count(*) FILTER (WHERE "Churned" = 1), 6) AS ratio
FROM x_split WHERE split = 'train'
""")
def class_counts(spark, folder):
    df = split.stratified_split(data.labelled(spark, folder))
    return split.class_counts(df.filter(F.col("split") == "train"))


@query("class_weights", """
SELECT "Churned", CAST(sum(n) OVER () AS DOUBLE) / (2 * n) AS balanced,
       CASE WHEN "Churned" = 1 THEN CAST(sum(n) OVER () - n AS DOUBLE) / n ELSE 1.0::DOUBLE END AS positive_weight
FROM (SELECT "Churned", count(*) AS n FROM x_split WHERE split = 'train' GROUP BY 1)
""")
def class_weights(spark, folder):
    df = split.stratified_split(data.labelled(spark, folder))
    return split.class_weights(df.filter(F.col("split") == "train"))


def _benchmark_sql() -> str:
    mean = "CAST(printf('%.3f', avg(\"{c}\") FILTER (WHERE \"Churned\" = {y})) AS DOUBLE)"
    arms = [
        f"SELECT {i} AS position, '{c}' AS feature, {mean.format(c=c, y=1)} AS churned_mean, "
        f"{mean.format(c=c, y=0)} AS retained_mean FROM x_train"
        for i, c in enumerate(NUMERIC_NAMES)
    ]
    return "\nUNION ALL ".join(arms)


data.block("x_train", "SELECT x_clean.* FROM x_clean JOIN x_split USING (customer_id) WHERE split = 'train'")
data.block("x_benchmarks", _benchmark_sql())


@query("population_benchmarks", "SELECT * FROM x_benchmarks")
def population_benchmarks(spark, folder):
    df = data.with_split(spark, folder, NUMERIC_NAMES)
    return benchmarks.population_benchmarks(df.filter(F.col("split") == "train"))


@query("column_audit", "\nUNION ALL ".join(
    [f"""SELECT '{c}' AS "column", min("{c}") AS low, max("{c}") AS high,
       round_even(avg("{c}") FILTER (WHERE "Churned" = 1) - avg("{c}") FILTER (WHERE "Churned" = 0), 6) AS mean_gap,
       CAST(NULL AS BIGINT) AS n_distinct FROM x_features""" for c in NUMERIC_NAMES]
    + [f"""SELECT '{c}', NULL, NULL, NULL, count(DISTINCT "{c}") FROM x_features""" for c in ["City", *CATEGORICAL_NAMES]]
))
def column_audit(spark, folder):
    return cleaning.audit_columns(
        data.features(spark, folder), NUMERIC_NAMES, ["City", *CATEGORICAL_NAMES]
    )


@query("category_audit", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", "{c}" AS value, count(*) AS n,
        round_even(100.0::DOUBLE * sum("Churned") / count(*), 6) AS churn_pct FROM x_features GROUP BY "{c}" """
    for c in ["City", *CATEGORICAL_NAMES]
))
def category_audit(spark, folder):
    names = ["City", *CATEGORICAL_NAMES]
    return cleaning.audit_categories(data.features(spark, folder, [*names, LABEL]), names)


data.block("x_medians", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, median(\"{c}\") AS median FROM x_train" for c in NUMERIC_NAMES
))
data.block("x_modes", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS feature, (SELECT "{c}" FROM x_train WHERE "{c}" IS NOT NULL GROUP BY 1
        ORDER BY count(*) DESC, "{c}" LIMIT 1) AS mode""" for c in CATEGORICAL_NAMES
))


@query("impute_median", "SELECT feature, round_even(median, 6) AS median FROM x_medians")
def impute_median(spark, folder):
    medians = prepare.exact_medians(data.training(spark, folder), NUMERIC_NAMES)
    return medians.select("feature", F.bround("median", 6).alias("median"))


@query("impute_mode", "SELECT feature, mode FROM x_modes")
def impute_mode(spark, folder):
    df = data.with_split(spark, folder, CATEGORICAL_NAMES)
    return prepare.modes(df.filter(F.col("split") == "train"), CATEGORICAL_NAMES)


def _scaled_sql() -> str:
    filled = ", ".join(
        f"coalesce(\"{c}\", (SELECT median FROM x_medians WHERE feature = '{c}')) AS \"{c}\""
        for c in NUMERIC_NAMES
    )
    data.block("x_filled", f"SELECT customer_id, {filled} FROM x_clean")
    data.block("x_filled_train", "SELECT x_filled.* FROM x_filled JOIN x_split USING (customer_id) WHERE split = 'train'")
    data.block("x_scale", "SELECT " + ", ".join(
        f"avg(\"{c}\") AS m_{c}, CASE WHEN stddev_pop(\"{c}\") = 0 THEN 1 ELSE stddev_pop(\"{c}\") END AS s_{c}"
        for c in NUMERIC_NAMES) + " FROM x_filled_train")
    cols = ", ".join(
        f"round_even((\"{c}\" - m_{c}) / s_{c}, 6) + 0.0 AS \"{c}\"" for c in NUMERIC_NAMES
    )
    return f"SELECT customer_id, {cols} FROM x_filled, x_scale"


@query("scale_standard", _scaled_sql())
def scale_standard(spark, folder):
    fitted = prepare.fit_numeric(data.training(spark, folder), NUMERIC_NAMES)
    return prepare.scale(data.customers(spark, folder), fitted).select(
        KEY, *[(F.bround(c, 6) + F.lit(0.0)).alias(c) for c in NUMERIC_NAMES]
    )


@query("onehot", """
SELECT customer_id, p.feature || '_' || p.value AS feature,
       CASE WHEN coalesce(CASE p.feature WHEN 'Gender' THEN "Gender" WHEN 'Country' THEN "Country" ELSE "Signup_Quarter" END,
                          (SELECT mode FROM x_modes m WHERE m.feature = p.feature)) = p.value
            THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hot
FROM x_clean, (
  SELECT DISTINCT 'Gender' AS feature, "Gender" AS value FROM x_train WHERE "Gender" IS NOT NULL
  UNION SELECT DISTINCT 'Country', "Country" FROM x_train WHERE "Country" IS NOT NULL
  UNION SELECT DISTINCT 'Signup_Quarter', "Signup_Quarter" FROM x_train WHERE "Signup_Quarter" IS NOT NULL) p
""")
def onehot(spark, folder):
    fitted = prepare.fit_onehot(data.training(spark, folder), CATEGORICAL_NAMES)
    return prepare.onehot_long(fitted, data.customers(spark, folder))


@query("layout_columns", "SELECT customer_id, " + ", ".join(f'"{c}"' for c in FEATURES) + ', "Churned" FROM x_clean')
def layout_columns(spark, folder):
    return data.cleaned(spark, folder).select(KEY, *FEATURES, LABEL)


@query("limit_rows", "SELECT * FROM x_split ORDER BY customer_id LIMIT 100")
def limit_rows(spark, folder):
    df = split.stratified_split(data.labelled(spark, folder))
    return df.orderBy(KEY).limit(100)
