from __future__ import annotations

import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scribemill.functions import text as ft

# The title phrases one site was filtered with.
CONTAINS = ("the president", "president obama", "president barack", "declaraciones del presidente")
STARTS = ("weekly address", "saturday address", "mensaje semanal")


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_notes_go_in_any_case_and_in_order(spark):
    got = apply(spark, ft.clean_text, [
        "Thank you. [Applause] Yes. [LAUGHTER] So [crosstalk] there.",
        "[laugh[applause]ter]", "[app[laughter]lause]", "a [applauſe] b",
        "Up\n\n\n\nand  down\n\n\n\n\nthe     hill", "\n \n \n", "a\n \n \nb", "  x \u001c",
    ])
    assert got == [
        "Thank you. Yes. So there.", "", "[applause]", "a b",
        "Up\n\nand down\n\nthe hill", "", "a\n \n \nb", "x",
    ]


def test_strip_is_pythons(spark):
    ends = [chr(c) for c in range(0x3100) if chr(c).isspace() or c in (0x180E, 0x200B, 0xFEFF)]
    values = [f"{e}a{e}b{e}{e}" for e in ends]
    assert apply(spark, ft.py_strip, values) == [v.strip() for v in values]


def test_truncate_only_longer_texts(spark):
    values = ["A" * 6000, "A" * 6001, "\U0001f600" * 6001, "short"]
    assert apply(spark, ft.truncate, values) == [
        "A" * 6000, "A" * 6000 + "\n\n[truncated]", "\U0001f600" * 6000 + "\n\n[truncated]", "short",
    ]


def test_title_key(spark):
    got = apply(spark, ft.title_key, [
        "Remarks by the President", "REMARKS BY THE PRESIDENT", "Remarks by the President!", "  a -  b ", "a\tb\nc", "Élan é", "***",
    ])
    assert got == ["remarks by the president"] * 3 + ["a b", "abc", "lan", ""]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0"), max_size=20), min_size=50, max_size=100))
def test_title_keys_have_their_form(spark, values):
    keys = apply(spark, ft.title_key, values)
    assert all(re.fullmatch(r"(?:[a-z0-9]+(?: [a-z0-9]+)*)?", k) for k in keys)
    assert apply(spark, ft.title_key, keys) == keys
    marked = [f"- {v.upper()} !" for v in values if v.isascii()]
    assert apply(spark, ft.title_key, marked) == [k for k, v in zip(keys, values) if v.isascii()]


def test_title_phrases(spark):
    yes = ["Remarks by the President on Jobs", "President Obama Speaks", "Statement by President Barack Obama",
           "Weekly Address: Jobs", " saturday address", "Mensaje Semanal: empleo", "Declaraciones del Presidente"]
    no = ["Remarks by the First Lady", "Vice President Biden", "Press Briefing", "A Weekly Address", "", "Los mensajes"]
    match = lambda c: ft.title_matches(c, CONTAINS, STARTS)
    assert apply(spark, match, yes + no) == [True] * len(yes) + [False] * len(no)


def test_render_fills_missing_and_leaves_braces(spark):
    df = spark.createDataFrame([("a {date} b", None, "{text} {}")], "title string, date string, text string")
    out = df.select(ft.render("T: {title}\nD: {date}\n{text} {{x}}", title=F.col("title"), date=F.col("date"), text=F.col("text")))
    assert out.first()[0] == "T: a {date} b\nD: Unknown\n{text} {} {x}"


def test_control_tokens_go_in_one_pass(spark):
    got = apply(spark, ft.strip_control_tokens, [
        "[INST] what now [/INST]", "<s>plain words</s>", "[Inst]either case[/iNST]", "[INST][/INST]<s></s>", "[IN[INST]ST]", "<ſ>x",
    ])
    assert got == ["what now", "plain words", "either case", "", "[INST]", "x"]


def test_chat_text_needs_both_parts(spark):
    import pytest
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([("q", "a"), ("q", None)], "instruction string, output string")
    chat = ft.chat_text(F.col("instruction"), F.col("output"))
    assert df.limit(1).select(chat).first()[0] == "<s>[INST] q [/INST] a</s>"
    with pytest.raises(PySparkException, match="without output"):
        df.select(chat).collect()


def test_float_text_is_pythons(spark):
    values = [0.396, 0.85, 1e-5, 1e-4, 1.234e-4, 12345678.0, 1e7, 1.5e15, 1e16, -2.5e-7, 0.0, -0.0, 1e100,
              float("nan"), float("inf"), float("-inf"), 9007199254740993.0, -98765432.5, 7.03382088603836e18, 2e-3, 5e-324]
    draw = random.Random(11)
    values += [draw.uniform(-10, 10) * 10.0 ** draw.randint(-300, 300) for _ in range(3000)]
    values += [round(draw.uniform(-1000, 1000), draw.randint(0, 6)) for _ in range(1000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    assert [r[0] for r in df.select(ft.py_float_text(F.col("v"))).collect()] == [str(v) for v in values]
