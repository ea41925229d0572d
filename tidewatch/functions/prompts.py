"""The advisory prompt as one column expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.schema import NUMERIC_NAMES

# The prompt format. Names in braces are filled per customer.
PROMPT = (
    "You are a senior customer retention analyst reviewing the output of a "
    "two-model advisory panel that has already analyzed the customer below.\n\n"
    "━━━ CUSTOMER PROFILE ━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━\n"
    "  Age              : {Age}\n"
    "  Gender           : {Gender}\n"
    "  Country          : {Country}\n"
    "  Signup quarter   : {Signup_Quarter}\n"
    "  Membership years : {Membership_Years}\n"
    "  Lifetime value   : ${Lifetime_Value}\n"
    "  Credit balance   : ${Credit_Balance}\n\n"
    "━━━ BEHAVIORAL SIGNALS ━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━\n"
    "  Login frequency             : {Login_Frequency} logins/period\n"
    "  Avg session duration        : {Session_Duration_Avg} min\n"
    "  Days since last purchase    : {Days_Since_Last_Purchase}\n"
    "  Total purchases             : {Total_Purchases}\n"
    "  Avg order value             : ${Average_Order_Value}\n"
    "  Cart abandonment rate       : {Cart_Abandonment_Rate}%\n"
    "  Returns rate                : {Returns_Rate}%\n"
    "  Discount usage rate         : {Discount_Usage_Rate}%\n"
    "  Email open rate             : {Email_Open_Rate}%\n"
    "  Social media engagement     : {Social_Media_Engagement_Score}\n"
    "  Mobile app usage            : {Mobile_App_Usage}\n"
    "  Customer service calls      : {Customer_Service_Calls}\n\n"
    "{benchmark_section}"
    "━━━ ADVISORY PANEL SIGNALS ━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━\n\n"
    "[1] XGBOOST  (gradient-boosted tree expert — best model, ROC-AUC {boosted_auc})\n"
    "    Prediction       : {decision}\n"
    "    Churn probability : {probability}%   |   Risk tier: {risk_tier}\n"
    "{reason_lines}\n\n"
    "[2] RANDOM FOREST  (bagging ensemble expert — ROC-AUC {forest_auc})\n"
    "    Prediction       : {second_decision}\n"
    "    Churn probability : {second_probability}%\n"
    "    Top global features (importance): {importances}\n\n"
    "Panel status : {agreement}\n"
    "━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━\n\n"
    "Based on all panel signals, determine the correct final churn decision, "
    "explain your reasoning clearly by referencing the model predictions, SHAP "
    "signals (magnitude labels indicate signal strength), population benchmarks, "
    "and behavioral data, and provide an actionable recommendation for "
    "the business owner on how to retain this customer or confirm churn.\n"
    "{notice}"
    "\nRespond with ONLY a JSON object — no other text, no markdown fences:\n"
    '{"decision": "<churn|retain>", '
    '"explanation": "<2-3 sentences referencing panel signals, SHAP magnitudes and benchmarks>", '
    '"recommendation": "<1-2 sentences of actionable advice for the business owner>"}'
)
# The benchmark heading, the notice for a confident consensus, the system message.
BENCHMARK_HEADING = "━━━ POPULATION BENCHMARKS (training set) ━━━━━━━━━━━━━━━━━\n"
NOTICE = (
    "IMPORTANT: Both models agree on CHURN with ≥80% confidence. "
    "Override to 'retain' ONLY if there is clear overwhelming counter-evidence "
    "in the behavioral signals.\n"
)
SYSTEM_MESSAGE = (
    "You are a customer retention analyst. "
    "Follow the output format exactly. Respond only with the JSON object."
)
# Decimals of the numbers in the prompt; two where not named.
WHOLE_NUMBERS = {
    "Age", "Login_Frequency", "Days_Since_Last_Purchase", "Customer_Service_Calls", "Total_Purchases",
}
def pieces(template: str) -> list[tuple[bool, str]]:
    """The template as (is a name, text) in order."""
    parts = re.split(r"\{([A-Za-z_]+)\}", template)
    return [(i % 2 == 1, p) for i, p in enumerate(parts) if p]


# The numbers a prompt shows, in its order.
PROMPT_NUMBERS = [name for named, name in pieces(PROMPT) if named and name in NUMERIC_NAMES]


def fill(template: str, values: dict[str, Column]) -> Column:
    return F.concat(*[values[p] if named else F.lit(p) for named, p in pieces(template)])


def reason_lines(reasons: list[Column]) -> Column:
    """One numbered line per reason; empty ones and ``N/A`` are skipped."""
    lines = [
        F.when((r != "") & (r != "N/A"), F.concat(F.lit(f"    SHAP reason {k}   : "), r))
        for k, r in enumerate(reasons, 1)
    ]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def panel_agreement(first: Column, second: Column) -> Column:
    """Agreement of the available decisions; none available counts as disagreement."""
    have_first, have_second = first != "N/A", second != "N/A"
    agreed = F.when(have_first & have_second & (first == second), first)
    agreed = agreed.when(have_first & ~have_second, first).when(~have_first & have_second, second)
    return F.when(
        agreed.isNotNull(), F.concat(F.lit("Full agreement — both models predict "), agreed)
    ).otherwise(
        F.concat(
            F.lit("Disagreement — XGBoost predicts "), first, F.lit(", Random Forest predicts "), second
        )
    )


def decision_text(pred: Column) -> Column:
    return F.when(pred.isNull(), "N/A").when(pred == 1, "CHURN").otherwise("RETAIN")


def consensus_notice(first: Column, second: Column, stored_probability: Column) -> Column:
    both = (first == "CHURN") & (second == "CHURN") & (F.coalesce(stored_probability, F.lit(0.0)) >= 0.80)
    return F.when(both, NOTICE).otherwise("")


def short_feature_name(feature: Column) -> Column:
    """The part before the first underscore when the name is longer than 25 characters."""
    return F.when(F.length(feature) > 25, F.substring_index(feature, "_", 1)).otherwise(feature)


def system_and_user(prompt: Column) -> Column:
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_MESSAGE).alias("content")),
        F.struct(F.lit("user").alias("role"), prompt.alias("content")),
    )


def user_blocks(prompt: Column) -> Column:
    """A single user message whose content is a list of text blocks."""
    part = F.struct(F.lit("text").alias("type"), prompt.alias("text"))
    return F.array(F.struct(F.lit("user").alias("role"), F.array(part).alias("content")))
