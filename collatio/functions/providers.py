"""Texts, usage and stop reasons from recorded provider answers (JSON), and from event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = "struct<type:string,text:string,refusal:string>"
#: Reasons by which an answer counts as cut off, and event types that a stream may hold.
CUT = ("max_tokens", "max_output_tokens", "length", "MAX_TOKENS")
EVENTS = (
    "response.created", "response.in_progress", "response.completed", "response.output_item.added", "response.output_item.done", "response.content_part.added",
    "response.content_part.done", "response.output_text.delta", "response.output_text.done", "response.refusal.delta", "response.refusal.done",
    "response.reasoning_summary_part.added", "response.reasoning_summary_part.done", "response.reasoning_summary_text.delta", "response.reasoning_summary_text.done",
    "response.reasoning_text.delta", "response.reasoning_text.done",
)
ANSWER_LIMIT = 16_384


def _at(json: Column, *paths: str) -> Column:
    return F.coalesce(*(F.get_json_object(json, p) for p in paths))


def _parts(json: Column) -> Column:
    out = F.from_json(F.get_json_object(json, "$.output"), f"array<struct<type:string,content:array<{_PART}>>>")
    return F.flatten(F.transform(out, lambda x: F.coalesce(x["content"], F.array().cast(f"array<{_PART}>"))))


def typed_text(json: Column) -> Column:
    """Texts and refusals of `output[].content[]`, joined without a separator."""
    kept = F.filter(_parts(json), lambda p: p["type"].isin("output_text", "refusal"))
    return F.array_join(F.transform(kept, lambda p: F.when(p["type"] == "refusal", p["refusal"]).otherwise(p["text"])), "")


def block_text(json: Column) -> Column:
    """Texts of `content[]` of type text."""
    kept = F.filter(F.from_json(F.get_json_object(json, "$.content"), f"array<{_PART}>"), lambda p: p["type"] == "text")
    return F.array_join(F.transform(kept, lambda p: p["text"]), "")


def candidate_text(json: Column) -> Column:
    """Texts of the first candidate's parts."""
    return F.array_join(F.transform(F.from_json(F.get_json_object(json, "$.candidates[0].content.parts"), f"array<{_PART}>"), lambda p: p["text"]), "")


def chat_text(json: Column) -> Column:
    """Content, then refusal, of the first choice's message."""
    return F.concat_ws("", F.get_json_object(json, "$.choices[0].message.content"), F.get_json_object(json, "$.choices[0].message.refusal"))


def answer_text(json: Column) -> Column:
    """The text in whichever of the four forms the answer has; null if there is none."""
    found = F.coalesce(*(F.nullif(t, F.lit("")) for t in (typed_text(json), block_text(json), candidate_text(json), chat_text(json))))
    return found


def usage(json: Column) -> Column:
    """Struct of input and output tokens, stop reason, truncated and refusal.

    Cached input counts as input where the first form has it, and thinking counts as output in the last form.
    """
    n = lambda p: F.get_json_object(json, p).cast("decimal(20,0)")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(20,0)"))
    given = F.coalesce(n("$.usage.input_tokens") + zero(n("$.usage.cache_read_input_tokens")) + zero(n("$.usage.cache_creation_input_tokens")), n("$.usage.prompt_tokens"), n("$.usageMetadata.promptTokenCount"))
    made = F.coalesce(n("$.usage.output_tokens"), n("$.usage.completion_tokens"), n("$.usageMetadata.candidatesTokenCount") + zero(n("$.usageMetadata.thoughtsTokenCount")))
    stop = _at(json, "$.incomplete_details.reason", "$.stop_reason", "$.choices[0].finish_reason", "$.candidates[0].finishReason", "$.status")
    refused = F.coalesce(F.exists(_parts(json), lambda p: p["type"] == "refusal"), F.lit(False)) | F.get_json_object(json, "$.choices[0].message.refusal").isNotNull()
    return F.struct(given.cast("decimal(20,0)").alias("input_tokens"), made.cast("decimal(20,0)").alias("output_tokens"), stop.alias("stop_reason"), F.coalesce(stop.isin(*CUT), F.lit(False)).alias("truncated"), refused.alias("refusal"))


def stream_events(streams: DataFrame) -> DataFrame:
    """Events of `id`, `body`: blocks between blank lines, their data lines joined; `place`, `type`, `data`."""
    block = F.split(F.replace("body", F.lit("\r\n"), F.lit("\n")), "\n\n")
    rows = streams.select("id", F.posexplode(block).alias("place", "block"))
    data = F.array_join(F.transform(F.filter(F.split("block", "\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")
    rows = rows.select("id", "place", data.alias("data")).filter("data not in ('', '[DONE]')")
    return rows.withColumn("type", F.get_json_object("data", "$.type"))


def stream_results(streams: DataFrame, model: Column) -> DataFrame:
    """By stream: its text and usage, and the first rule it breaks (`fault`), if any."""
    events = stream_events(streams)
    done = F.col("type") == "response.completed"
    last = F.max(F.when(done, F.get_json_object("data", "$.response")))
    by = events.groupBy("id").agg(F.count_if(~F.coalesce(F.col("type").isin(*EVENTS), F.lit(False))).alias("odd"), F.count_if(done).alias("completed"), last.alias("json"))
    rows = streams.select("id", model.alias("model")).join(by, "id", "left")
    text = typed_text(F.col("json"))
    fault = (
        F.when(F.coalesce("odd", F.lit(0)) > 0, "event_type")
        .when(F.coalesce("completed", F.lit(0)) == 0, "not_completed")
        .when(F.col("completed") > 1, "completed_twice")
        .when(~F.col("model").eqNullSafe(F.get_json_object("json", "$.model")) | (F.get_json_object("json", "$.status") != "completed"), "model_or_status")
        .when(F.char_length(text) > ANSWER_LIMIT, "too_long")
    )
    u = usage(F.col("json"))
    return rows.select("id", fault.alias("fault"), F.when(fault.isNull(), text).alias("text"), F.when(fault.isNull(), u["input_tokens"]).alias("input_tokens"), F.when(fault.isNull(), u["output_tokens"]).alias("output_tokens"))
