"""Prompts out of their envelopes, and calls within bounds."""

import datetime

import pytest
from pyspark.sql import functions as F

from threadloom.functions import envelopes

NOTE = "<system_notification id='1'>\ndone\n</system_notification>"
STAMP = "<timestamp>Monday, Mar 4, 2024, 9:05 PM (UTC{})</timestamp>"


def epoch(*at):
    return int(datetime.datetime(*at, tzinfo=datetime.timezone.utc).timestamp())


CASES = {
    "plain <user_query>x</user_query> text": ("plain <user_query>x</user_query> text", None, "", []),
    " kept as it is ": (" kept as it is ", None, "", []),
    "<user_query>\n fix it \n</user_query>\n": ("fix it", None, "", []),
    STAMP.format("") + "\n<user_query>go</user_query>": ("go", epoch(2024, 3, 4, 21, 5), "", []),
    STAMP.format("-5:30") + " go on": ("go on", epoch(2024, 3, 5, 2, 35), "", []),
    STAMP.format("+15") + " go": (STAMP.format("+15") + " go", None, "", []),
    "<timestamp>yesterday</timestamp> go": ("<timestamp>yesterday</timestamp> go", None, "", []),
    NOTE + "\n<plugin_info>p</plugin_info> ask ": ("ask", None, NOTE + "\n\n<plugin_info>p</plugin_info>", []),
    STAMP.format("+8") + NOTE + "<user_query>Briefly inform the user about the task result.</user_query>":
        ("", epoch(2024, 3, 4, 13, 5), NOTE + "\n\n<user_query>Briefly inform the user about the task result.</user_query>", []),
    "[Image]\n<image_files>\n1. /tmp/a b.png\n2. C:\\x\\two.jpg\n</image_files>\n<user_query>see</user_query>": ("see", None, "", ["a b.png", "two.jpg"]),
    "[Image] [Image] <user_query>see</user_query>": ("see", None, "", ["Image 1", "Image 2"]),
    "<image_files>\n</image_files> see": ("see", None, "", ["Image 1"]),
    "ask <external_links>x</external_links>": ("ask <external_links>x</external_links>", None, "", []),
    None: ("", None, "", []), "": ("", None, "", []),
}


@pytest.mark.parametrize("text", CASES)
def test_envelopes(spark, text):
    found = spark.createDataFrame([(text,)], "t string").select(envelopes.split_cursor_user(F.col("t")).alias("x")).first()["x"]
    assert tuple(found) == CASES[text]


CALL = "calls array<struct<name: string, input: string>>"


def shown(spark, calls, **more):
    return [tuple(c) for c in spark.createDataFrame([(calls,)], CALL).select(envelopes.tool_calls(F.col("calls"), **more).alias("x")).first()["x"]]


def test_calls_are_cleaned(spark):
    assert shown(spark, [(" Read ", '{"a": 1}'), ("", None), (None, "\x1b[31mx\x00\x1b[0m"), None]) == [("Read", '{"a": 1}'), ("Tool", "{}"), ("Tool", "x")]
    assert shown(spark, []) == []


def test_calls_are_bounded(spark):
    long = "é" * 40_000
    calls = [("é" * 200, long)] * 2 + [("C", long), ("D", "last")] + [("E", "x")] * 40
    out = shown(spark, calls)
    assert all(len(n.encode()) <= 256 and len(i.encode()) <= 64 << 10 for n, i in out) and sum(len((n + i).encode()) for n, i in out) <= 128 << 10
    assert out[0][1].endswith("é" + envelopes.CUT) and len(out) == 2
    assert len(shown(spark, [("E", "x")] * 40)) == 32 and shown(spark, calls, bounded=False) == calls
