"""Session summaries: prompt building, fallback summary and reply parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamem import constants as K
from stratamem import schema
from stratamem.functions import text


def session_transcripts(window: DataFrame, keys: tuple[str, ...] = ("user_id", "session_id")) -> DataFrame:
    """One row per session: the window's messages, oldest first, and its tokens.

    ``window`` holds at most the working-memory limit per session, so the lists
    gathered here stay small whatever the session's history.
    """
    line = F.concat(F.lit("["), F.date_format("created_at", "HH:mm"), F.lit("] "), F.col("content"))
    lines = F.sort_array(F.collect_list(F.struct(F.col("seq"), line.alias("line"))))
    return window.groupBy(*keys).agg(
        F.array_join(F.transform(lines, lambda m: m["line"]), "\n").alias("messages"),
        F.sum(text.token_estimate(F.col("content"))).alias("tokens_before"))


def prompt(messages: Column, max_tokens: int = K.SUMMARY_TOKENS, focus: str | None = None) -> Column:
    head, tail = K.SUMMARY_PROMPT.replace("{max_tokens}", str(max_tokens)).split("{messages}")
    body = F.concat(messages, F.lit(f"\n\nFocus on: {focus}")) if focus else messages
    return F.concat(F.lit(head), body, F.lit(tail))


def fallback_reply(prompt_text: Column) -> Column:
    """The reply used without a language model: the prompt's first three lines."""
    first = F.array_join(F.slice(F.split(prompt_text, "\n"), 1, 3), " ")
    return F.concat(F.lit("SUMMARY: "), first, F.lit("\nENTITIES: []"))


def _last_line(reply: Column, marker: str) -> Column:
    lines = F.filter(F.split(reply, K.LINE_BREAK), lambda x: F.startswith(x, F.lit(marker)))
    found = F.try_element_at(lines, F.lit(-1))
    return text.strip(F.substring(found, F.lit(len(marker) + 1), F.length(found)))


def reply_summary(reply: Column) -> Column:
    return F.coalesce(_last_line(reply, "SUMMARY:"), F.lit(""))


def reply_entities(reply: Column) -> Column:
    """Entities of the reply; anything that is not a valid list gives none."""
    kind = T.ArrayType(schema.KEY_ENTITY)
    parsed = F.from_json(_last_line(reply, "ENTITIES:"), kind, {"mode": "PERMISSIVE"})
    full = F.transform(parsed, lambda e: F.struct(
        e["name"].alias("name"), e["type"].alias("type"), e["value"].alias("value"),
        F.coalesce(e["confidence"], F.lit(1.0)).alias("confidence")))
    valid = F.forall(full, lambda e: e["name"].isNotNull() & e["type"].isNotNull()
                     & e["value"].isNotNull() & e["confidence"].between(0.0, 1.0))
    return F.when(parsed.isNotNull() & valid, full).otherwise(F.array().cast(kind))


def summarize(window: DataFrame, reply_of=fallback_reply, max_tokens: int = K.SUMMARY_TOKENS,
              focus: str | None = None) -> DataFrame:
    """Summary, entities and token savings per session.

    ``reply_of`` maps the prompt column to a reply column; plug a model in with an
    Arrow-batched function.
    """
    asked = session_transcripts(window).withColumn("prompt", prompt(F.col("messages"), max_tokens, focus))
    replied = asked.withColumn("reply", reply_of(F.col("prompt")))
    c = F.col
    return (replied.withColumn("summary", reply_summary(c("reply")))
            .withColumn("key_entities", reply_entities(c("reply")))
            .withColumn("tokens_after", text.token_estimate(c("summary")))
            .withColumn("tokens_saved", F.greatest(c("tokens_before") - c("tokens_after"), F.lit(0))))
