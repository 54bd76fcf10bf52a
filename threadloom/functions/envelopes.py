"""What a tool wraps around a prompt, and the calls an assistant's turn makes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import strip_terminal

# Tags of context before a prompt, image lists, the time, the prompt itself, and a prompt that no person wrote.
CONTEXT = r"<(external_links|plugin_info|uploaded_documents|system_notification)\b[^>]*>.*?</\1>"
IMAGES = r"(?:\[Image\]\s*)*<image_files\b[^>]*>.*?</image_files>"
MARKERS = r"(?:\[Image\]\s*)+(?=<(?:timestamp|user_query)\b)"
LEAD = rf"(?is)\A(?:\s*(?:{CONTEXT}|{IMAGES}|{MARKERS})\s*)+"
STAMP = r"(?i)\A\s*<timestamp>([^<\r\n]+)</timestamp>\s*"
SENT = (
    r"\A(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday), ([A-Z][a-z]{2} \d{1,2}, \d{4}, \d{1,2}:\d{2} (?:AM|PM)) "
    r"\(UTC(?:([+-])(\d{1,2})(?::(\d{2}))?)?\)\z"
)
QUERY = r"(?is)\A\s*<user_query>\s*(.*?)\s*</user_query>\s*\z"
FOLLOW_UP = r"(?i)\A\s*<user_query>\s*Briefly inform the user about the task result\b"
#: Calls of one turn, bytes of a call's name and input, and of all calls.
CALLS, NAME_BYTES, INPUT_BYTES, ALL_BYTES = 32, 256, 64 << 10, 128 << 10
CUT = "\n[truncated]"


def _behind(text: Column, pattern: str) -> Column:
    return F.substr(text, F.length(F.regexp_extract(text, pattern, 0)) + 1)


def sent_at(value: Column) -> Column:
    """Epoch seconds of an envelope's time, null where it has another form or no such offset."""
    value = F.trim(value)
    local = F.unix_seconds(F.try_to_timestamp(F.regexp_extract(value, SENT, 1), F.lit("MMM d, yyyy, h:mm a")))
    hours, minutes = (F.coalesce(F.nullif(F.regexp_extract(value, SENT, i), F.lit("")).cast("int"), F.lit(0)) for i in (3, 4))
    good = value.rlike(SENT) & (minutes <= 59) & (hours * 60 + minutes <= 14 * 60)
    offset = (hours * 3600 + minutes * 60) * F.when(F.regexp_extract(value, SENT, 2) == "-", -1).otherwise(1)
    return F.when(good, local - offset)


def split_cursor_user(text: Column) -> Column:
    """content, sent (epoch seconds), context and attachments (names) of a user's row.

    Context tags and image lists count at the begin, and again behind a time of the exact form; then
    the prompt's own tag is taken off. A malformed time, and tags inside a prompt, are the user's text. A row of which
    nothing is recognised stays as it is. A follow-up that the tool writes behind a notification is context.
    """
    text = F.coalesce(text, F.lit(""))
    first = F.regexp_extract(text, LEAD, 0)
    rest = F.substr(text, F.length(first) + 1)
    sent = sent_at(F.regexp_extract(rest, STAMP, 1))
    later = _behind(rest, STAMP)
    second = F.when(sent.isNotNull(), F.regexp_extract(later, LEAD, 0)).otherwise("")
    tagged = rest.rlike(STAMP)
    lead = F.concat(first, second)
    tags = F.transform(F.regexp_extract_all(lead, F.lit(rf"(?is){CONTEXT}"), F.lit(0)), F.trim)
    images = F.array_join(F.regexp_extract_all(lead, F.lit(r"(?is)<image_files\b[^>]*>(.*?)</image_files>"), F.lit(1)), "\n")
    paths = F.regexp_extract_all(images, F.lit(r"(?m)^\s*\d+\.\s+([^\r\n]+?)\s*$"), F.lit(1))
    names = F.transform(F.slice(paths, 1, 32), lambda p: F.coalesce(F.nullif(F.substring(F.trim(F.regexp_extract(F.btrim(p, F.lit('" ')), r"([^\\/]*)$", 1)), 1, 255), F.lit("")), F.lit("Image")))
    marks = F.greatest(F.regexp_count(lead, F.lit(r"(?i)\[Image\]")), F.when(lead.rlike(r"(?i)<image_files\b"), 1).otherwise(0))
    unnamed = F.when(marks > 0, F.transform(F.sequence(F.lit(1), F.greatest(marks, F.lit(1))), lambda i: F.concat(F.lit("Image "), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    body = F.when(sent.isNotNull(), F.substr(later, F.length(second) + 1)).otherwise(rest)
    follow = body.rlike(FOLLOW_UP) & (F.size(tags) > 0) & (sent.isNotNull() | ~tagged)
    query = F.when(sent.isNotNull() | ~tagged, F.nullif(F.regexp_extract(body, QUERY, 1), F.lit("")))
    kept = F.when(sent.isNotNull() | (lead != ""), F.trim(F.regexp_replace(body, r"^\s+|\s+$", ""))).otherwise(text)
    return F.struct(
        F.when(follow, "").when(body.rlike(QUERY) & (sent.isNotNull() | ~tagged), F.coalesce(query, F.lit(""))).otherwise(kept).alias("content"), sent.alias("sent"),
        F.array_join(F.when(follow, F.concat(tags, F.array(F.trim(body)))).otherwise(tags), "\n\n").alias("context"),
        F.when(F.size(names) > 0, names).otherwise(unnamed).alias("attachments"),
    )


def bound_bytes(text: Column, limit: Column) -> Column:
    """At most ``limit`` bytes in UTF-8, whole characters only; what is cut ends with a mark, if the mark fits."""
    mark = len(CUT.encode())

    def head(size: Column) -> Column:
        return F.regexp_replace(F.decode(F.substr(text.cast("binary"), F.lit(1), F.greatest(size, F.lit(0)).cast("int")), "UTF-8"), "\ufffd+$", "")

    return F.when(F.octet_length(text) <= limit, text).when(limit > mark, F.concat(head(limit - mark), F.lit(CUT))).otherwise(F.substring(F.lit(CUT), 1, limit))


def tool_calls(calls: Column, bounded: bool = True) -> Column:
    """The calls (name, input) of a turn as they are shown: trimmed names, bounded inputs, bounded in all.

    A call without a name is a Tool, one without an input has an empty object. Calls that begin
    behind the bound of all are left out. ``bounded=False`` lifts the bounds.
    """

    def plain(call: Column) -> Column:
        name = F.coalesce(F.nullif(F.trim(call["name"]), F.lit("")), F.lit("Tool"))
        said = F.replace(strip_terminal(F.coalesce(call["input"], F.lit("{}"))), F.lit("\x00"), F.lit(""))
        return F.struct((bound_bytes(name, F.lit(NAME_BYTES)) if bounded else name).alias("name"), (bound_bytes(said, F.lit(INPUT_BYTES)) if bounded else said).alias("input"))

    shown = F.transform(F.filter(calls, lambda c: c.isNotNull()), plain)
    if not bounded:
        return shown
    none = F.struct(F.lit(0).alias("bytes"), F.array().cast("array<struct<name: string, input: string>>").alias("calls"))

    def add(done: Column, call: Column) -> Column:
        left = ALL_BYTES - done["bytes"] - F.octet_length(call["name"])
        said = bound_bytes(call["input"], left)
        more = F.struct((done["bytes"] + F.octet_length(call["name"]) + F.octet_length(said)).alias("bytes"), F.concat(done["calls"], F.array(F.struct(call["name"].alias("name"), said.alias("input")))).alias("calls"))
        return F.when(left > 0, more).otherwise(F.struct(F.lit(ALL_BYTES).alias("bytes"), done["calls"].alias("calls")))

    return F.aggregate(F.slice(shown, 1, CALLS), none, add)["calls"]
