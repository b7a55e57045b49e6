"""Saved answers: content keys, hits and misses, layers with precedence, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions import lazy as F

from ..functions.text import label_of, strip

#: Fixed value: US dollars an input token, where a response has no cost of its own.
PRICE_PER_TOKEN = 4.2e-8
#: Error kinds by HTTP status, hints for them, and words that make a 403 one of billing.
STATUS_KINDS = {401: "auth", 403: "auth", 402: "billing", 429: "rate_limit", 400: "validation", 422: "validation", 404: "not_found", 529: "overloaded", 503: "overloaded"}
BILLING_WORDS = ("credit", "billing", "payment", "plan", "tier")
HINTS = {
    "auth": "Check the API key.",
    "billing": "Check the account's credit and plan.",
    "rate_limit": "Too many calls; they are paced and tried again.",
    "validation": "The request was not accepted; check the question set.",
    "not_found": "Check the endpoint and the model's name.",
    "overloaded": "The service is busy; try again.",
    "server": "The service had an error; try again.",
    "timeout": "The call took too long; try again.",
    "network": "The service could not be reached.",
    "bad_response": "The answer was not understood.",
}


def content_key(state: Column, endpoint: str, model: str, questions: str) -> Column:
    """32 hex digits of the SHA-256 of what is asked. Fields are in the order of their names."""
    asked = F.to_json(F.struct(F.lit(model).alias("model"), F.lit(questions).alias("questions"), state.alias("state"), F.lit(endpoint.rstrip("/")).alias("url")))
    return F.substring(F.sha2(asked, 256), 1, 32)


def usable(records: DataFrame) -> DataFrame:
    return records.where(F.col("answers").isNotNull() & F.col("key").isNotNull())


def latest(records: DataFrame, by: str = "saved_at") -> DataFrame:
    """The last saved record of each key: an aggregation with a map side, where a window would sort."""
    rest = [c for c in records.columns if c != "key"]
    one = records.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct(by, F.xxhash64(F.to_json(F.struct(*rest))))).alias("r"))
    return one.select("key", *[F.col(f"r.{c}") for c in rest]).select(*records.columns)


def merged(seed: DataFrame, live: DataFrame) -> DataFrame:
    """Both layers, one row a key (each has one row a key already); live ones win."""
    return live.unionByName(seed.join(live.select("key"), "key", "left_anti"), allowMissingColumns=True)


def hits(asked: DataFrame, records: DataFrame) -> DataFrame:
    return asked.join(records.select("key"), "key", "left_semi")


def misses(asked: DataFrame, records: DataFrame) -> DataFrame:
    return asked.join(records.select("key"), "key", "left_anti")


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Last write wins."""
    return merged(existing, latest(new))


def export(seed: DataFrame, live: DataFrame) -> DataFrame:
    return merged(seed, live).orderBy("key")


def known_ids(emails: DataFrame, requested: DataFrame | None) -> DataFrame:
    """Requested messages that exist; none requested means all."""
    return emails if requested is None else emails.join(requested.select("id"), "id", "left_semi")


def queue_order(front: Column, batch: Column, position: Column) -> Column:
    """Sort key of a queue to whose front whole batches go, keeping their inner order."""
    return F.struct(F.when(front, -batch).otherwise(batch), position)


def normal_record(response: Column, latency_ms: Column) -> Column:
    """Usage and cost of a raw response (either spelling of names), with a list price where it has none."""
    tokens = F.coalesce(response["usage"]["input_tokens"], response["usage"]["inputTokens"])
    out = F.coalesce(response["usage"]["output_tokens"], response["usage"]["outputTokens"])
    cost = F.coalesce(response["provider_metadata"]["gateway"]["cost"], response["providerMetadata"]["gateway"]["cost"]).try_cast("double")
    price = F.coalesce(tokens, F.lit(0)) * PRICE_PER_TOKEN
    return F.struct(
        response["model"].alias("model"), F.round(latency_ms, 1).alias("latency_ms"), tokens.alias("input_tokens"), out.alias("output_tokens"),
        F.coalesce(cost, price).alias("cost_usd"), cost.isNull().alias("cost_is_estimate"), price.alias("list_price_usd"),
        F.coalesce(response["provider_metadata"]["gateway"]["generationId"], response["providerMetadata"]["gateway"]["generationId"]).alias("generation_id"),
    )


def error_kind(status: Column, message: Column) -> Column:
    words = F.lit(False)
    for w in BILLING_WORDS:
        words = words | F.contains(F.lower(message), F.lit(w))
    out = F.when((status == 403) & words, F.lit("billing"))
    for s, kind in STATUS_KINDS.items():
        out = out.when(status == s, F.lit(kind))
    return out.when(status >= 500, F.lit("server")).otherwise(F.lit("bad_response"))


def error_message(body: Column, fallback: Column) -> Column:
    """The message of an error body in any of its shapes: error.message, error, message, the first detail
    with its place, detail, or (300 characters of) a body that is no JSON; else the fallback."""
    at = lambda path: F.nullif(F.get_json_object(body, path), F.lit(""))
    text = lambda path: F.when(~F.startswith(F.get_json_object(body, path), F.lit("{")) & ~F.startswith(F.get_json_object(body, path), F.lit("[")), at(path))
    loc = F.array_join(F.from_json(F.get_json_object(body, "$.detail[0].loc"), "array<string>"), ".")
    detail = F.when(F.startswith(at("$.detail[0]"), F.lit("{")), F.btrim(F.concat(F.coalesce(loc, F.lit("")), F.lit(": "), F.coalesce(at("$.detail[0].msg"), F.lit("invalid"))), F.lit(": ")))
    plain = F.when(F.get_json_object(body, "$").isNull(), F.nullif(F.substring(strip(body), 1, 300), F.lit("")))
    return F.coalesce(at("$.error.message"), text("$.error"), at("$.message"), detail, text("$.detail"), plain, fallback)


def hint(kind: Column) -> Column:
    return label_of(kind, HINTS)


__all__ = ["content_key", "error_kind", "error_message", "export", "hint", "hits", "known_ids", "latest", "merged", "misses", "normal_record", "queue_order", "upsert", "usable"]
