"""Questions on their way in and answers on their way out: request checks, routing, payloads, provider results, sessions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Limits
from ..functions import policy
from ..functions.markdown import concepts
from ..functions.text import bare

MESSAGE = "array<struct<role:string,content:string>>"
ROLES = ("user", "assistant")


def checked(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """requests (session_id, message, messages: array of role and content) with messages as they are sent on, and error.

    A lone message is one user message, trimmed. error is the first of no_message, empty, bad_role, empty_content, too_long,
    not_alternating, last_not_user that holds, or null; then messages are the last `history`. A null content is empty; without a
    session the name is anon. Each request is one row, so nothing is shuffled.
    """
    lone = F.coalesce("message", F.lit(""))
    alone = (lone != "") & F.col("messages").isNull()
    found = F.when(alone, F.array(F.struct(F.lit("user").alias("role"), bare(lone).alias("content")))).otherwise(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"))))
    rows = requests.withColumn("_m", found.cast(MESSAGE))
    m = F.col("_m")
    pairs = F.arrays_zip(F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0))).alias("a"), F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))).alias("b"))
    worst = F.transform(m, lambda x: _first([("bad_role", ~F.coalesce(x["role"], F.lit("")).isin(*ROLES)), ("empty_content", bare(x["content"]) == ""), ("too_long", F.length(x["content"]) > limits.message_chars)]))
    first = F.get(F.filter(worst, lambda e: e.isNotNull()), F.lit(0))
    error = _first([
        ("no_message", m.isNull()), ("too_long", alone & (F.length(lone) > limits.message_chars)), ("empty", (F.size(m) == 0) | (alone & (bare(lone) == ""))), (first, first.isNotNull()),
        ("not_alternating", F.exists(pairs, lambda p: p["a"]["role"] == p["b"]["role"])), ("last_not_user", F.element_at(m, -1)["role"] != "user"),
    ])
    tail = F.when(F.size(m) > limits.history, F.slice(m, F.size(m) - limits.history + 1, limits.history)).otherwise(m)
    return rows.withColumns({"error": error, "session_id": F.coalesce(F.nullif("session_id", F.lit("")), F.lit("anon"))}).withColumn("messages", F.when(F.col("error").isNull(), tail)).drop("_m", "message")


def _first(rules: Sequence[tuple[str | Column, Column]]) -> Column:
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(name) if isinstance(name, str) else name).otherwise(out)
    return out


def payload(messages: Column, assistant: str, user: Column) -> Column:
    """The JSON that a provider of typed content arrays takes."""
    typed = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("text"))).alias("content")))
    return F.to_json(F.struct(F.lit(assistant).alias("assistant_id"), user.alias("user_id"), F.lit(False).alias("stream"), typed.alias("messages")))


def is_detailed(query: Column, groups: Sequence[Sequence[str]], pattern: str) -> Column:
    """Whether a question names two or more concepts of a group, or matches pattern. Null is not."""
    return F.coalesce((F.size(concepts(query, [list(g) for g in groups])) > 0) | query.rlike(pattern), F.lit(False))


def contract(query: Column, groups: Sequence[Sequence[str]], pattern: str, base: Sequence[str], more: Sequence[str], cover: str, glue: str = "、") -> Column:
    """The lines an answer must keep to: base, for detailed questions more, and, where concepts are named, cover with them."""
    named = concepts(query, [list(g) for g in groups])
    detailed = is_detailed(query, groups, pattern)
    lines = [F.lit(x) for x in base] + [F.when(detailed, F.lit(x)) for x in more]
    return F.concat_ws("\n", *lines, F.when(F.size(named) > 0, F.replace(F.lit(cover), F.lit("{}"), F.array_join(named, glue))))


def replies(turns: DataFrame) -> DataFrame:
    """(conv_id, rule, reply) for conversations (conv_id, turn, role, text): the rule that stops the last user turn, and what is
    said then, by all that the user said. Both null where nothing stops it."""
    user = F.col("role") == "user"
    asked = turns.groupBy("conv_id").agg(F.max_by("text", F.when(user, F.col("turn"))).alias("last"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(user, F.struct("turn", "text")))), lambda x: x["text"]), "\n").alias("said"))
    rule = policy.request_rule(F.col("last"))
    return asked.select("conv_id", rule.alias("rule"), F.when(rule.isNotNull(), policy.refusal(F.col("said"))).alias("reply"))


def user_id(*sources: str) -> Column:
    """The first of the columns that is neither null nor blank; without one the request has no user."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in sources))


def answered(candidates: Mapping[str, Column]) -> Column:
    """(provider, answer) of the first provider, in order, that gave something; null where none did."""
    out = F.lit(None).cast("struct<provider:string,answer:string>")
    for name, text in reversed(candidates.items()):
        out = F.when(F.nullif(text, F.lit("")).isNotNull(), F.struct(F.lit(name).alias("provider"), text.alias("answer"))).otherwise(out)
    return out


def streamed(tokens: DataFrame) -> DataFrame:
    """(answer_id, text): the pieces (answer_id, seq, piece) of each answer in order; of a piece sent twice the first counts."""
    once = tokens.groupBy("answer_id", "seq").agg(F.min("piece").alias("piece"))
    return once.groupBy("answer_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("text"))


def freshest(responses: DataFrame, key: str = "conv_id", seq: str = "seq") -> DataFrame:
    """Of each key the response of the highest number: what comes late for an older request is dropped."""
    whole = F.struct(*(c for c in responses.columns))
    return responses.groupBy(F.col(key).alias("_k")).agg(F.max_by(whole, seq).alias("_r")).select("_r.*")


def health(calls: DataFrame) -> DataFrame:
    """(provider, last_success, last_failure) of calls (provider, ms, ok)."""
    return calls.groupBy("provider").agg(F.max(F.when(F.col("ok"), F.col("ms"))).alias("last_success"), F.max(F.when(~F.col("ok"), F.col("ms"))).alias("last_failure"))


def labelled(value: Column, labels: Mapping[str, str], other: str) -> Column:
    """The label of a value; the value itself if it has none, `other` if it is null or empty."""
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.coalesce(value, F.lit(""))), F.nullif(value, F.lit("")), F.lit(other))


def failure(blocked: Column, limited: Column, error: Column, status: Column, said: Mapping[str, str]) -> Column:
    """What a failed call is told as: nothing if blocked, its own error, or what `said` has for limited, forbidden (403), busy (429),
    down (500 and over), http (with {} for another status of 400 and over) or else."""
    own = F.nullif(error, F.lit(""))
    return (
        F.when(F.coalesce(blocked, F.lit(False)), F.lit(None).cast("string")).when(F.coalesce(limited, F.lit(False)), F.coalesce(own, F.lit(said["limited"]))).when(own.isNotNull(), own)
        .when(status == 403, said["forbidden"]).when(status == 429, said["busy"]).when(status >= 500, said["down"])
        .when((status < 200) | (status >= 300), F.replace(F.lit(said["http"]), F.lit("{}"), status.cast("string"))).otherwise(said["else"])
    )


def finished(turns: DataFrame) -> DataFrame:
    """Turns but for assistant turns without a text (null or empty): answers that were cut off."""
    return turns.filter(~((F.col("role") == "assistant") & (F.coalesce("text", F.lit("")) == "")))


def latest(sessions: DataFrame, limit: int, order: str = "updated_at") -> DataFrame:
    """The sessions changed last; one without a time counts as the oldest; ties go by session_id."""
    return sessions.orderBy(F.coalesce(order, F.lit(0)).desc(), "session_id").limit(limit)


def slim(hits: DataFrame, most: int = 5, chars: int = 180) -> DataFrame:
    """(query_id, sources): of ranked hits (query_id, position, source_group, chunk_title, score, evidence) the first few, short."""
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).filter(F.col("_n") <= most)
    source = F.coalesce(F.nullif("source_group", F.lit("")), F.nullif("chunk_title", F.lit("")), F.lit("")).alias("source")
    rows = first.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", source, "score", F.substring(F.coalesce("evidence", F.lit("")), 1, chars).alias("evidence")))).alias("sources"))
    return rows


def is_timer(kind: Column, trigger: Column, time: Column, method: Column) -> Column:
    """Whether an event comes from a timer: it says so, or names a trigger, or has a time and no HTTP method."""
    given = lambda c: F.nullif(c, F.lit("")).isNotNull()
    return F.coalesce(kind == "Timer", F.lit(False)) | given(trigger) | (time.isNotNull() & ~given(method))


def allowed(value: Column, listed: Column) -> Column:
    """Whether a value is in a comma list, blanks dropped; a null value or list is not."""
    names = F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.array_contains(names, value), F.lit(False))
