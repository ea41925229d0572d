"""Reading a model's reply: clean, parse, salvage."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import WHITE_CLASS, strip

# Decisions a reply may give, markers, fallback advice, salvage patterns.
DECISIONS = ["churn", "retain"]
TRUNCATED = "[truncated]"
ERROR_MARK = "[parse_error] "
FALLBACK_ADVICE = "Unable to generate recommendation due to a format error."
ERROR_CHARS = 300
SALVAGE_DECISION = rf'(?iu)"decision"{WHITE_CLASS}*:{WHITE_CLASS}*"(churn|retain)"'
SALVAGE_EXPLANATION = rf'"explanation"{WHITE_CLASS}*:{WHITE_CLASS}*"([^"]{{20,}})'
SALVAGE_RECOMMENDATION = rf'"recommendation"{WHITE_CLASS}*:{WHITE_CLASS}*"([^"]{{10,}})'

# A flat object of plain string members: what almost every reply is, and what the JVM's lenient
# reader and a strict reader take alike. Possessive, so a long text costs one pass.
_PLAIN = r'"[^"\\\x00-\x1f]*+"'
_MEMBER = rf"{_PLAIN}[ \t\n\r]*+:[ \t\n\r]*+{_PLAIN}[ \t\n\r]*+"
SIMPLE_OBJECT = rf"\A\{{[ \t\n\r]*+{_MEMBER}(?:,[ \t\n\r]*+{_MEMBER}){{0,15}}+\}}\z"

FIELDS = ["decision", "explanation", "recommendation"]
_STRICT = "valid boolean, decision string, explanation string, recommendation string"


def strip_reply(raw: Column) -> Column:
    """Trim, drop thinking blocks, drop a code fence at either end."""
    text = strip(raw)
    text = strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    text = strip(F.regexp_replace(text, rf"(?i)\A```(?:json)?{WHITE_CLASS}*", ""))
    return strip(F.regexp_replace(text, r"```\z", ""))


def json_candidate(text: Column) -> Column:
    """From the first opening to the last closing brace; null when there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def _read_strictly(text: str | None, none_text: str) -> tuple:
    if text is None:
        return None, None, None, None
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return False, None, None, None
    values = (found.get(name, "") for name in FIELDS)
    return True, *(none_text if v is None else str(v) for v in values)


def strict_reader(none_text: str):
    """Strict JSON reading for the few candidates that are not simple objects."""

    @F.pandas_udf(_STRICT)
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = [_read_strictly(t, none_text) for t in texts]
        return pd.DataFrame(rows, columns=["valid", *FIELDS])

    return read


def salvaged(text: Column, pattern: str) -> Column:
    part = F.regexp_extract(text, pattern, 1)
    return F.when(part == "", TRUNCATED).otherwise(F.concat(strip(part), F.lit(" " + TRUNCATED)))


def acceptable(raw: str) -> bool:
    """Whether a reply would parse or could be salvaged, for the retry loop around a model call."""
    text = re.sub(r"<think>.*?</think>", "", raw.strip(), flags=re.DOTALL).strip()
    text = re.sub(r"\A```(?:json)?\s*", "", text, flags=re.IGNORECASE).strip()
    text = re.sub(r"```\Z", "", text).strip()
    first, last = text.find("{"), text.rfind("}")
    candidate = text[first : last + 1] if 0 <= first < last else None
    valid, decision, explanation, advice = _read_strictly(candidate, "")
    if valid:
        return decision.strip().lower() in DECISIONS and bool(explanation.strip() and advice.strip())
    return re.search(r'"decision"\s*:\s*"(churn|retain)"', text, re.IGNORECASE) is not None
