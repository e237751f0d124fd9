"""Chat formatting from an event log: streamed deltas, edits and regenerations are folded into messages, rendered with a template, and read back. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.operators.scan import in_ranges, running

#: The template's control strings. A user's turn is OPEN text CLOSE, an assistant's is a blank, text and END, any other role's ROLE role SAYS text DONE.
OPEN, CLOSE, END = "[INST] ", " [/INST]", " </s>"
ROLE, SAYS, DONE = "[ROLE] ", " [SAYS] ", " [/ROLE]"
#: What is escaped: a control word, with any number of backslashes after its first character; and the same with one backslash at least.
_CONTROL, _ESCAPED = r"([<\[])(\\*/?(?:s>|INST\]|ROLE\]|SAYS\]))", r"([<\[])\\(\\*/?(?:s>|INST\]|ROLE\]|SAYS\]))"
#: The end of a turn, which no escaped text holds.
_TURN_END = r"(?<=\[/INST\]|</s>|\[/ROLE\])"
#: Messages of one segment, as a power of two; code points of one delta that a text is streamed in.
_SEGMENT, _DELTA = 6, 512


def escaped(text: Column) -> Column:
    """text with one backslash more in each control word; unescaped() undoes it."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def _resets(e: Column) -> Column:
    return e["kind"].isin("start", "edit", "regenerate")


def fold(log: DataFrame, order: list[str]) -> DataFrame:
    """(conv_id, message, role, text): the final messages of a log of events (conv_id, message, kind, role, text, order columns).

    Events are taken by conversation in the order of the order columns (null first), ties by kind, role and text. `start`
    begins a message with its text, `delta` adds to it, `edit` puts its text in place of all before, `regenerate` empties
    the message and takes away every message after it, until one of those gets events again. A message has the last role
    that isn't null; null text is empty. Events of other kinds or without message are left out; null conv_id is one
    conversation. Messages are whole numbers; they order the conversation, and may have gaps.

    Events meet by message, not by conversation. What regenerations take away is a running maximum over the messages
    before, inside segments of a conversation and over the segments' own maxima.
    """
    at = F.struct(*order)
    known = log.where(F.col("kind").isin("start", "delta", "edit", "regenerate") & F.col("message").isNotNull())
    event = F.struct(at.alias("at"), F.col("kind"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    again = F.max(F.when(F.col("kind") == "regenerate", at))
    segment = F.shiftright("message", _SEGMENT)
    messages = known.groupBy("conv_id", segment.alias("segment"), "message").agg(F.array_sort(F.collect_list(event)).alias("events"), again.alias("again"))
    before = W.partitionBy("conv_id", "segment").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    messages = messages.withColumn("inside", F.max("again").over(before)).drop("again")
    ends = known.where("kind = 'regenerate'").groupBy("conv_id", segment.alias("segment")).agg(again.alias("again"))
    # What earlier segments' regenerations take away from a segment: their maxima stand behind the segment's own place.
    none = F.lit(None).cast(ends.schema["again"].dataType)
    places = known.select("conv_id", segment.alias("segment")).distinct().select("conv_id", "segment", F.lit(0).alias("behind"), none.alias("again"))
    places = places.unionAll(ends.select("conv_id", "segment", F.lit(1), "again"))
    segments = running(places, ["conv_id"], ["segment", "behind"], {"outside": ("max", F.col("again"))}, name="segments").where("behind = 0 and outside is not null")
    segments = segments.select(F.col("conv_id").alias("s_conv"), F.col("segment").alias("s_segment"), "outside")
    messages = messages.join(segments, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("segment") == F.col("s_segment")), "left")
    cut = F.coalesce(F.greatest("inside", "outside"), "inside", "outside")
    left = messages.withColumn("cut", cut).select("conv_id", "message", F.filter("events", lambda e: F.col("cut").isNull() | (e["at"] > F.col("cut"))).alias("events")).where(F.size("events") > 0)
    last = F.array_max(F.transform("events", lambda e, i: F.when(_resets(e), i + 1)))
    kept = F.slice("events", F.coalesce(last, F.lit(1)), F.size("events"))
    text = F.array_join(F.transform(kept, lambda e: F.when(e["kind"] == "regenerate", "").otherwise(e["text"])), "")
    roles = F.filter(F.transform("events", lambda e: e["role"]), lambda r: r.isNotNull())
    return left.select("conv_id", "message", F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"), text.alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): one text a conversation, and of each turn its length in code points and where its text counts for the loss (start in the turn and length; null: nowhere), as it does for assistants. Escapes count.

    Messages are rendered on their own and joined in segments, and segments to conversations, so that few rows of a long
    conversation meet. A conversation is one value, of at most 2 GB. Null role or text is empty.
    """
    text, role = escaped(F.coalesce("text", F.lit(""))), F.coalesce("role", F.lit(""))
    other = F.concat(F.lit(ROLE), escaped(role), F.lit(SAYS), text, F.lit(DONE))
    turn = F.when(role == "user", F.concat(F.lit(OPEN), text, F.lit(CLOSE))).when(role == "assistant", F.concat(F.lit(" "), text, F.lit(END))).otherwise(other)
    loss = F.when(role == "assistant", F.struct(F.lit(1).alias("start"), F.length(text).alias("length")))
    turns = messages.select("conv_id", F.shiftright("message", _SEGMENT).alias("segment"), "message", turn.alias("turn"), loss.alias("loss"))
    segments = turns.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("message", F.struct(F.length("turn").alias("length"), "loss").alias("mask"), "turn"))).alias("x"))
    segments = segments.select("conv_id", F.struct("segment", F.array_join(F.transform("x", lambda t: t["turn"]), "").alias("text"), F.transform("x", lambda t: t["mask"]).alias("mask")).alias("s"))
    whole = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("x"))
    return whole.select("conv_id", F.array_join(F.transform("x", lambda s: s["text"]), "").alias("formatted"), F.flatten(F.transform("x", lambda s: s["mask"])).alias("mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_text): the (role, text) of the turns that a formatted text is made of, and all unescaped text under its loss mask, nothing between."""
    pieces = F.filter(F.split("formatted", _TURN_END, -1), lambda p: p != "")
    zipped = chats.select("conv_id", "formatted", F.arrays_zip(pieces.alias("turn"), F.col("mask").alias("mask")).alias("x"))

    def turn(p: Column) -> Column:
        rest = lambda start, end: F.substring(p, F.lit(len(start) + 1), F.length(p) - len(start) - len(end))
        named = F.substring_index(p, SAYS, 1)
        said = F.substring(p, F.length(named) + len(SAYS) + 1, F.length(p) - F.length(named) - len(SAYS) - len(DONE))
        role = F.when(p.startswith(OPEN), F.lit("user")).when(p.startswith(ROLE), unescaped(F.substring(named, F.lit(len(ROLE) + 1), F.length(named)))).otherwise(F.lit("assistant"))
        text = F.when(p.startswith(OPEN), rest(OPEN, CLOSE)).when(p.startswith(ROLE), said).otherwise(rest(" ", END))
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    under = F.filter("x", lambda z: z["mask"]["loss"].isNotNull())
    loss = F.transform(under, lambda z: unescaped(F.substring(z["turn"], z["mask"]["loss"]["start"] + 1, z["mask"]["loss"]["length"])))
    return zipped.select("conv_id", "formatted", F.transform("x", lambda z: turn(z["turn"])).alias("turns"), F.array_join(loss, "").alias("loss_text"))


def chat(log: DataFrame, order: list[str]) -> DataFrame:
    """rendered() of fold(): (conv_id, formatted, mask) from a log of events. An empty log gives an empty result."""
    return rendered(fold(log, order))


def as_log(conversations: DataFrame) -> DataFrame:
    """The log (conv_id, message, kind, role, text, seq, step) that writing these turns (conv_id, turn, role, text) leaves: users send whole messages, others stream them.

    Of about one message in four, by hash, there was another beginning: a user's first wording is edited, a stream that
    broke off is regenerated. Messages are in the order of turn (null first), role and text; every row is one.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.col("turn").asc_nulls_first()
    rows = in_ranges(rows, ["conv_id", turn, "role", "text"], ["conv_id", "role", "text"], "messages", ["conv_id", turn, F.substring("role", 1, 16), F.substring("text", 1, 32)])
    twice = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    first, empty = F.substring("text", 1, 256), F.lit("")
    deltas = F.transform(F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % _DELTA), F.lit(0)), lambda t: event("delta", t))
    sent = F.when(twice, F.array(event("start", F.upper(first)), event("edit", F.col("text")))).otherwise(F.array(event("start", F.col("text"))))
    streamed = F.concat(F.array(event("start", empty)), F.when(twice, F.array(event("delta", first), event("regenerate", empty))).otherwise(F.array().cast("array<struct<kind:string,text:string>>")), deltas)
    events = rows.select("conv_id", F.col("__at").alias("message"), "role", F.posexplode(F.when(F.col("role") == "user", sent).otherwise(streamed)).alias("step", "e"))
    return events.select("conv_id", "message", "e.kind", F.when(F.col("e.kind") == "start", F.col("role")).alias("role"), "e.text", F.col("message").alias("seq"), "step")
