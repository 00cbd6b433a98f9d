"""Answers of annotation services: from raw bodies to text, why a call failed, and whether to try it again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: What a message says of a spent quota.
_QUOTA_A = ("current quota", "quota exceeded", "billing details", "free tier")
_QUOTA_B = ("insufficient_quota", "billing", "check your plan")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _texts(parts: Column, key: str = "text", where=None) -> Column:
    """The texts of an array of objects, joined; with `where`, of those it holds for."""
    v = F.coalesce(parts, F.array().cast("array<variant>"))
    kept = F.filter(v, where) if where else v
    return F.array_join(F.transform(kept, lambda p: F.coalesce(_get(p, f"$.{key}"), F.lit(""))), "")


def _settled(df: DataFrame, text: Column, error: Column) -> DataFrame:
    d = df.withColumns({"text": tx.strip(F.coalesce(text, F.lit(""))), "error": error})
    d = d.withColumn("error", F.coalesce("error", F.when(F.col("text") == "", "empty content")))
    return d.withColumn("text", F.when(F.col("error").isNull(), F.col("text"))).drop("_v")


def candidate_text(df: DataFrame, body: str = "body") -> DataFrame:
    """df with text and error of bodies {candidates: [{finishReason, content: {parts: [{text}]}}]}: the first candidate's
    parts, joined. No candidate, a finish reason other than STOP, an empty text, and what isn't JSON are errors."""
    d = df.withColumn("_v", F.try_parse_json(body))
    first = "$.candidates[0]"
    reason = _get(F.col("_v"), f"{first}.finishReason")
    error = F.when(F.col("_v").isNull(), "body is not JSON").when(_get(F.col("_v"), first, "variant").isNull(), "no candidates").when(F.coalesce(reason, F.lit("")).isin("", "STOP"), None).otherwise(F.concat(F.lit("finish reason "), reason))
    return _settled(d, _texts(_get(F.col("_v"), f"{first}.content.parts", "array<variant>")), error)


def message_text(df: DataFrame, body: str = "body") -> DataFrame:
    """df with text and error of bodies {choices: [{finish_reason, message: {content, refusal}}]}; content is a text or a
    list of parts, of which those of type text count. No choice, a finish reason other than stop, a refusal, an empty
    text, and what isn't JSON are errors."""
    d = df.withColumn("_v", F.try_parse_json(body))
    first = "$.choices[0]"
    reason = F.lower(tx.stringify(_get(F.col("_v"), f"{first}.finish_reason")))
    refusal = tx.stringify(_get(F.col("_v"), f"{first}.message.refusal"))
    error = F.when(F.col("_v").isNull(), "body is not JSON").when(_get(F.col("_v"), first, "variant").isNull(), "no choices").when(~reason.isin("", "stop"), F.concat(F.lit("finish reason "), reason)).when(refusal != "", F.concat(F.lit("refusal: "), refusal))
    content = f"{first}.message.content"
    parts = _texts(_get(F.col("_v"), content, "array<variant>"), where=lambda p: _get(p, "$.type") == "text")
    plain = F.when(F.schema_of_variant(_get(F.col("_v"), content, "variant")) == "STRING", _get(F.col("_v"), content))
    return _settled(d, F.coalesce(plain, parts), error)


def batch_text(df: DataFrame, row: str = "row") -> DataFrame:
    """df with custom_id, text and error of batch output rows {custom_id, response: {status_code, body}}: a status other than
    200 or a body that isn't an object is an error; else as message_text."""
    d = df.withColumn("_r", F.try_parse_json(row))
    status, body = _get(F.col("_r"), "$.response.status_code", "int"), _get(F.col("_r"), "$.response.body", "variant")
    whole = F.coalesce(F.schema_of_variant(body), F.lit("")).startswith("OBJECT")
    d = d.withColumns({"custom_id": _get(F.col("_r"), "$.custom_id"), "_bad": F.when(F.coalesce(status, F.lit(0)) != 200, F.concat(F.lit("status "), F.coalesce(status.cast("string"), F.lit("missing")))).when(~whole, "no response body"), "_body": F.to_json(body)})
    d = message_text(d, "_body")
    return d.withColumns({"text": F.when(F.col("_bad").isNull(), F.col("text")), "error": F.coalesce("_bad", "error")}).drop("_r", "_bad", "_body")


def classify_errors(df: DataFrame, status: str = "status", body: str = "body", retry_after: str | None = None) -> DataFrame:
    """df with retry_after_seconds, key_invalid, quota_exhausted, rate_limited and transient, for both kinds of services.

    The delay comes from the header column or the last readable retryDelay among the error's details.
    """
    d = df.withColumn("_v", F.try_parse_json(body))
    e = lambda k: tx.stringify(_get(F.col("_v"), f"$.error.{k}"))
    kind, code, state, message = F.lower(e("type")), F.lower(e("code")), F.upper(e("status")), F.lower(e("message"))
    details = F.coalesce(_get(F.col("_v"), "$.error.details", "array<variant>"), F.array().cast("array<variant>"))
    delays = F.filter(F.transform(details, lambda x: tx.retry_seconds(F.coalesce(_get(x, "$.retryDelay"), F.lit("")))), lambda s: s.isNotNull())
    daily = F.exists(details, lambda x: F.contains(F.lower(F.coalesce(_get(x, "$.quotaId"), F.lit(""))), F.lit("perday")) | F.contains(F.lower(F.coalesce(_get(x, "$.quotaMetric"), F.lit(""))), F.lit("free_tier")))
    quota = daily | ((state == "RESOURCE_EXHAUSTED") & tx.any_of(message, _QUOTA_A)) | (code == "insufficient_quota") | (kind == "insufficient_quota") | ((state == "") & tx.any_of(message, _QUOTA_B))
    header = tx.retry_seconds(F.coalesce(F.col(retry_after).cast("string"), F.lit(""))) if retry_after else F.lit(None).cast("double")
    s = F.col(status)
    return d.withColumns({
        "retry_after_seconds": F.coalesce(header, F.try_element_at(delays, F.lit(-1))), "key_invalid": s.isin(401, 403) | state.isin("UNAUTHENTICATED", "PERMISSION_DENIED") | kind.isin("authentication_error", "invalid_api_key"),
        "quota_exhausted": quota, "rate_limited": (s == 429) | (code == "rate_limit_exceeded"), "transient": tx.transient_status(s),
    }).drop("_v")


def with_retries(call, attempts: int = 3, keys: tuple = ("",), classify=None, sleep=None):
    """call(text, key) with retries: an error that classify(error) calls "key" drops the key, "quota" goes on to the next
    one, "transient" waits (2 seconds for each attempt, 30 at most, or what the error's retry_after says) and tries again; any other is raised. Keys are tried in order, equal ones once. None once all keys or attempts are spent."""
    import time

    wait, judge = sleep or time.sleep, classify or (lambda e: "transient")

    def run(text):
        left = list(dict.fromkeys(keys))
        tried = 0
        while left and tried < attempts:
            try:
                return call(text, left[0])
            except Exception as e:  # noqa: BLE001 - what the service raises is the caller's; classify says what it means
                what = judge(e)
                if what in ("key", "quota"):
                    left.pop(0)
                elif what == "transient":
                    tried += 1
                    wait(getattr(e, "retry_after", None) or min(30.0, 2.0 * tried))
                else:
                    raise
        return None

    return run
