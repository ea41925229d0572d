"""Raw replies of two models, derived from the scored customers.

No text model ships with the package, so the reply queries read texts composed from each
customer's own scores: well-formed ones in several wordings, and every kind of malformed one. The
composition is plain SQL that both engines run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.registry import block

# Opening phrases as the published reports print them, so that the phrase statistics meet them.
_DEC = "CASE WHEN model = 'qwen' THEN lower(churn_decision) WHEN rf_pred = 1 THEN 'churn' ELSE 'retain' END"
_EXPLANATION = """CASE (customer_id + shift) % 7
 WHEN 0 THEN 'Both XGBoost and Random Forest models unanimously predict ' || dec || ' with high confidence. However, the ' || about || ' stands out against the population benchmarks.'
 WHEN 1 THEN 'Both models agree on ' || dec || ' at 91.5% probability, and ' || about || ' is the dominant driver. The risk tier is ' || risk_tier || '! SHAP values such as +1.25 support this.'
 WHEN 2 THEN 'Both models agree to ' || dec || ' the customer. Despite ' || about || ', strong signals offset the moderate ones.'
 WHEN 3 THEN 'The models disagree, but the ROC-AUC of the superior model favours ' || dec || '. Age and lifetime value outweigh ' || about || '.'
 WHEN 4 THEN 'Both the XGBoost and Random Forest models predict ' || dec || '; SHAP values and SHAP signals show that 7 customer service calls and low email open rate mitigate the average retained customer gap.'
 WHEN 5 THEN 'Panel agreement is full: ' || about || ' while the cart abandonment of 64.17 is above the average churner. Is the tier ' || risk_tier || '? Yes.'
 ELSE 'Low login frequency and few purchases in the mobile app suggest ' || dec || ' although ' || about || ' compares well to the averages.' END"""
_ADVICE = """CASE (customer_id * 3 + shift) % 6
 WHEN 0 THEN 'Immediately offer a personalized discount and reach out by call within 30 days.'
 WHEN 1 THEN 'Maintain the current retention strategy, monitor returns, and focus on loyalty reward offers if the email open rate falls.'
 WHEN 2 THEN 'Implement a targeted retention campaign and investigate the root cause of the 6 service calls. Address the cart friction.'
 WHEN 3 THEN 'Proactively engage this customer with exclusive product recommendations through social media.'
 WHEN 4 THEN 'Encourage a purchase with a curated incentive, and continue to understand the lifetime value.'
 ELSE 'Initiate a proactive outreach on the mobile app; should days since last purchase grow, target a win-back offer with dedicated support.' END"""
_JSON = "'{\"decision\": \"' || dec || '\", \"explanation\": \"' || explanation || '\", \"recommendation\": \"' || advice || '\"}'"
_RAW = f"""CASE (customer_id * 5 + shift) % 31
 WHEN 10 THEN '{{' || chr(10) || '  "decision": "  ' || upper(dec) || ' ",' || chr(10) || '  "explanation": "' || explanation || '",' || chr(10) || '  "recommendation": "' || advice || '"' || chr(10) || '}}'
 WHEN 11 THEN '```json' || chr(10) || {_JSON} || chr(10) || '```'
 WHEN 12 THEN '<think>first' || chr(10) || '{{maybe}}' || chr(10) || 'so</think>' || chr(10) || {_JSON}
 WHEN 13 THEN 'Here it is: ' || {_JSON} || ' Hope this helps.'
 WHEN 14 THEN {_JSON} || ' (see {{1}} above)'
 WHEN 15 THEN '{{' || chr(39) || 'decision' || chr(39) || ': ' || chr(39) || dec || chr(39) || '}}'
 WHEN 16 THEN '{{"decision": "' || dec || '", "explanation": "line one is here' || chr(10) || 'line two is there", "recommendation": "' || advice || '"}}'
 WHEN 17 THEN '{{"decision": " ' || dec || ' ", "explanation": "cut off before the end'
 WHEN 18 THEN '{{"decision": "' || dec || '", "explanation": "' || explanation
 WHEN 19 THEN '{{"decision": "' || dec || '", "explanation": "short'
 WHEN 20 THEN '{{"decision": "' || dec || '", "explanation": "' || explanation || '", "recommendation": "' || advice
 WHEN 21 THEN '{{"decision": "' || dec || '", "explanation": "' || explanation || '", "recommendation": "call'
 WHEN 22 THEN '{{"decision": "maybe", "explanation": "' || explanation || '", "recommendation": "' || advice || '"}}'
 WHEN 23 THEN '{{"decision": "' || dec || '", "explanation": "  ", "recommendation": "' || advice || '"}}'
 WHEN 24 THEN '{{"decision": "' || dec || '", "recommendation": "' || advice || '"}}'
 WHEN 25 THEN '{{"decision": "' || dec || '", "explanation": null, "recommendation": "' || advice || '"}}'
 WHEN 26 THEN 'I would say ' || dec || ' because ' || explanation || ' ' || explanation || ' ' || advice
 WHEN 27 THEN ''
 WHEN 28 THEN '{{"decision": "' || dec || '", "explanation": "' || explanation || '", "recommendation": "' || advice || '", "notes": {{"sure": true}}}}'
 WHEN 29 THEN '{{"decision": "' || dec || '", "explanation": 42, "recommendation": true}}'
 ELSE {_JSON} END"""
_KEEP = "customer_id, model, y_true, y_proba, churn_decision, risk_tier"


def raw_replies(explained: DataFrame) -> DataFrame:
    """(customer_id, model, y_true, y_proba, churn_decision, risk_tier, raw_reply, time_sec)."""
    models = F.array(
        F.struct(F.lit("qwen").alias("model"), F.lit(0).alias("shift")),
        F.struct(F.lit("gemma").alias("model"), F.lit(17).alias("shift")),
    )
    df = explained.withColumn("about", F.lower(F.get("reasons", 0)["feature"])).select(
        "customer_id", "y_true", "y_proba", "churn_decision", "risk_tier", "rf_pred",
        F.regexp_replace("about", "_", " ").alias("about"), F.inline(models),
    )
    df = df.withColumn("dec", F.expr(_DEC))
    df = df.withColumns({"explanation": F.expr(_EXPLANATION), "advice": F.expr(_ADVICE)})
    seconds = (F.col("customer_id") % 97 + F.col("shift")) / 4.0
    return df.select(
        *_KEEP.split(", "), F.expr(_RAW).alias("raw_reply"), seconds.alias("time_sec")
    )


block("x_reply_base", f"""
SELECT *, {_DEC} AS dec FROM (
  SELECT customer_id, y_true, y_proba, churn_decision, risk_tier, rf_pred, replace(lower(f1), '_', ' ') AS about, model, shift
  FROM x_explained, (SELECT 'qwen' AS model, 0 AS shift UNION ALL SELECT 'gemma', 17))
""")
block("x_reply_text", f"SELECT *, {_EXPLANATION} AS explanation, {_ADVICE} AS advice FROM x_reply_base")
block("x_raw", f"SELECT {_KEEP}, {_RAW} AS raw_reply, (customer_id % 97 + shift) / 4.0::DOUBLE AS time_sec FROM x_reply_text")
