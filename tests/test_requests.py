from __future__ import annotations

import codecs
import datetime
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scribemill.functions import answers as fa
from scribemill.operators import answers, requests
from scribemill.operators.anchored import (
    BLOCK_CALLS, BLOCK_WINDOWS, FAN, NONE, after, block_map, cell_start, cell_widths, composed, cut_blocks, label_windows, last_starts, starts_from,
)
from scribemill.plans.serving import request_report

T0 = datetime.datetime(2024, 1, 1, 10, 0, 30)
LOG = ("request_id long, ts timestamp, user_id string, client_addr string, authorized boolean, question string, "
       "max_tokens int, temperature double, error string")


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def test_verdicts(spark):
    base = dict(user="u", addr="1.1.1.1", ok=True, q="hi", n=None, t=None, e=None)
    cases = [({}, 200), ({"ok": False}, 401), ({"q": None}, 422), ({"q": ""}, 422), ({"q": "x" * 4000}, 200), ({"q": "x" * 4001}, 422),
             ({"n": 0}, 422), ({"n": 4096}, 200), ({"n": 5000}, 422), ({"t": 2.0}, 200), ({"t": 3.0}, 422), ({"t": -0.1}, 422), ({"t": float("nan")}, 422),
             ({"q": "[INST][/INST]"}, 400), ({"q": "  "}, 400), ({"e": "ModelNotReadyException"}, 503), ({"e": "ThrottlingException"}, 429), ({"e": "X"}, 500),
             ({"ok": False, "q": ""}, 401)]
    rows = []
    for i, (change, _) in enumerate(cases):
        c = base | change
        rows.append((i, at(i * 60), c["user"], c["addr"], c["ok"], c["q"], c["n"], c["t"], c["e"]))
    got = requests.verdicts(spark.createDataFrame(rows, LOG)).orderBy("request_id").collect()
    assert [r.status for r in got] == [status for _, status in cases]
    report = {r.status: (r.requests, r.client) for r in request_report(spark.createDataFrame(rows, LOG)).collect()}
    assert report[200] == (4, "answer") and report[401] == (2, "sign_in") and report[503][1] == "warming" and report[429][1] == "error"


def test_eleventh_call_of_a_minute_is_too_many_and_rejected_ones_count(spark):
    rows = [(i, at(i), "u" if i % 2 else "", "u" if i % 2 == 0 else "9", True, "q", None, None, None) for i in range(13)]
    rows += [(20, at(5), "u", "x", True, "", None, None, None), (21, at(31), "u", "x", True, "q", None, None, None)]
    got = {r.request_id: r.status for r in requests.verdicts(spark.createDataFrame(rows, LOG)).collect()}
    assert [got[i] for i in range(13)] == [200] * 10 + [429] * 3
    assert got[20] == 422 and got[21] == 200


def chain(times, limit, width):
    """Reference walk for one caller."""
    start, used, out = None, 0, []
    for t in times:
        if start is None or t >= start + width:
            start, used = t, 0
        used += 1
        out.append(used <= limit)
    return out


def random_calls(spark, seed=4):
    rng = random.Random(seed)
    rows, expected, n = [], {}, 0
    for caller, rate in (("hot", 3), ("slow", 90), ("burst", 20)):
        t, times = 0, []
        for _ in range(400 if caller == "hot" else 60):
            t += rng.choice([0, 1, rate, rate * 2]) if caller != "burst" else rng.choice([0, 0, 1, 59, 60, 61, 200])
            times.append(t)
        for t, good in zip(times, chain(times, 4, 60)):
            rows.append((caller, at(t), n))
            expected[n] = good
            n += 1
    return spark.createDataFrame(rows, "caller string, ts timestamp, request_id long").repartition(5), expected


@pytest.mark.parametrize("block_windows, batch", [(1, 10_000), (3, 10_000), (32, 10_000), (3, 7)])
def test_anchored_windows(spark, block_windows, batch):
    calls, expected = random_calls(spark)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = requests.rate_limit_anchored(calls, 4, 60, block_windows=block_windows)
        assert got.columns == ["caller", "ts", "request_id", "admitted"]
        assert {r.request_id: r.admitted for r in got.collect()} == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_calls_without_a_caller_are_limited_together(spark):
    calls = spark.createDataFrame([(None, at(i), i) for i in range(5)], "caller string, ts timestamp, request_id long")
    for got in (requests.rate_limit(calls, 2), requests.rate_limit_anchored(calls, 2)):
        assert [r.admitted for r in got.orderBy("request_id").collect()] == [True, True, False, False, False]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=60), st.integers(1, 40), st.integers(1, 4))
def test_block_walk_equals_plain_walk(gaps, width, blocks):
    t = np.unique(np.cumsum(gaps))
    plain = []
    for x in t:
        if not plain or x >= plain[-1] + width:
            plain.append(int(x))
    walked, anchor = [], -(10**9)
    for part in np.array_split(t, blocks):
        if len(part):
            first, last = last_starts(part, width)
            at_ = int(np.searchsorted(first, anchor + width))
            if at_ < len(first):
                walked += starts_from(part, int(first[at_]), width).tolist()
                anchor = int(last[at_])
                assert anchor == walked[-1]
    assert walked == plain


def test_limits_beyond_the_planners_and_large_cut_tables(spark, monkeypatch):
    calls, expected = random_calls(spark)
    plain = {r.request_id: r.admitted for r in requests.rate_limit(calls, 4, "1 minute").collect()}
    monkeypatch.setattr(requests, "_PLANNER_RANK", 0)
    assert {r.request_id: r.admitted for r in requests.rate_limit(calls, 4, "1 minute").collect()} == plain
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.request_id: r.admitted for r in requests.rate_limit(calls, 4, "1 minute").collect()} == plain
        assert {r.request_id: r.admitted for r in requests.rate_limit_anchored(calls, 4, 60).collect()} == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_decoding_lines(spark):
    lines = ['data: {"token": "hi"}', "data: [DONE]", "event: x", "data: {bad", 'data: {"other": 1}', "data:", '  data:   {"token": " a "}  ',
             'data:{"token":"x"}', 'data: {"token": null}', 'data: {"token": "a"} tail', "data: {'token': 'a'}", 'data: "s"', "data: 5",
             'data: {"token": "[DONE]"}', '﻿data: {"token": "b"}　', 'data: {"token": "é\\u00e9\\n"}', 'data: {"token": "a", "token": "b"}',
             'data: {"token": "a"},"y":{"token": "b"}', 'data: {"token": "a"}],[{"token": "b"}', 'data: {"token": ""}', "", 'data: {"token": NaN}',
             'data: {"token": 5}', 'data: {"token": {"a": 1}}']
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string").orderBy("i")
    assert [r[0] for r in df.select(fa.decode_line(F.col("line"))).collect()] == [
        "hi", "[DONE]", None, None, None, None, " a ", "x", None, None, None, None, None, "[DONE]", "b", "éé\n", "b", None, None, "", None, None, "5", '{"a":1}']


def test_encoding(spark):
    events = spark.createDataFrame([("r", 0, 'é "q"\n'), ("r", 1, None), ("r", 2, ""), ("r", 3, "b"), ("none", 0, None)], "request_id string, seq long, text string")
    lines = answers.encode_answers(events).orderBy("request_id", "seq").collect()
    assert [r.line for r in lines if r.request_id == "none"] == ["data: [DONE]"]
    mine = [r.line for r in lines if r.request_id == "r"]
    assert mine[-1] == "data: [DONE]"
    assert [json.loads(x.removeprefix("data: ")) for x in mine[:-1]] == [{"token": 'é "q"\n'}, {"token": "b"}]
    silent = answers.encode_answers(events, spark.createDataFrame([("r",), ("silent",)], "request_id string"))
    assert {(r.request_id, r.seq, r.line) for r in silent.where("request_id = 'silent'").collect()} == {("silent", 0, "data: [DONE]")}


def read_like_a_browser(chunks, strip=None):
    tail, text = "", ""
    for chunk in chunks:
        *lines, tail = (tail + chunk).split("\n")
        for line in lines:
            line = line.strip(strip)
            if not line.startswith("data:"):
                continue
            data = line[5:].strip(strip)
            if data == "[DONE]":
                break
            try:
                token = json.loads(data)["token"]
            except (ValueError, KeyError, TypeError):
                continue
            text += token
    return text


def random_streams(seed=5):
    rng = random.Random(seed)
    streams = {}
    for n in range(60):
        body = ""
        for k in range(rng.randrange(8)):
            body += rng.choice(['data: {"token": "t%d "}\n\n' % k, "data: [DONE]\n\n", ": ping\n", "data: {bad\n\n", 'data: {"token": "é"}\n'])
        body += rng.choice(["", 'data: {"token": "unfinished"}'])
        chunks = []
        while body:
            cut = rng.randrange(1, 25)
            chunks.append(body[:cut])
            body = body[cut:]
        streams[f"r{n}"] = chunks or [""]
    streams["same"] = ['data: {"token": "a"}\ndata: [DONE]\ndata: {"token": "b"}\n', 'data: {"token": "c"}\n']
    return streams


def test_reassembly_of_random_chunkings(spark):
    streams = random_streams()
    rows = [(r, i * 7, c) for r, chunks in streams.items() for i, c in enumerate(chunks)]
    chunks = spark.createDataFrame(rows, "request_id string, chunk long, data string").repartition(6)
    got = {r.request_id: r.text for r in answers.answer_texts(chunks).collect()}
    assert got == {r: read_like_a_browser(c) for r, c in streams.items()}
    assert got["same"] == "ac"


def test_payload(spark):
    df = spark.createDataFrame([("q?", None, None), ('a"b', 7, 0.0)], "question string, max_tokens int, temperature double")
    got = [json.loads(r[0]) for r in df.select(fa.payload(F.col("question"), F.col("max_tokens"), F.col("temperature"))).collect()]
    assert got == [{"question": "q?", "max_tokens": 512, "temperature": 0.7}, {"question": 'a"b', "max_tokens": 7, "temperature": 0.0}]
    assert json.loads(df.select(fa.payload(F.col("question"))).first()[0]) == got[0]


def test_calls_without_a_time_stay(spark):
    rows = [(i, "u", None if i % 3 == 0 else at(0)) for i in range(40)]
    df = spark.createDataFrame(rows, "request_id long, caller string, ts timestamp")
    for limited in (requests.rate_limit(df, 5), requests.rate_limit_anchored(df, 5)):
        got = {r.request_id: r.admitted for r in limited.collect()}
        assert len(got) == 40
        assert not any(got[i] for i in range(0, 40, 3))
        assert sum(got.values()) == 5


def test_request_limits_are_arguments(spark):
    df = spark.createDataFrame([("q" * 20, 100, 1.0)], "question string, max_tokens int, temperature double")
    columns = [F.col(c) for c in df.columns]
    assert df.select(fa.invalid_reason(*columns)).first()[0] is None
    assert df.select(fa.invalid_reason(*columns, question_chars=10)).first()[0] == "question too long"
    assert df.select(fa.invalid_reason(*columns, tokens_limit=50)).first()[0] == "max_tokens out of range"
    assert df.select(fa.invalid_reason(*columns, temperature_limit=0.5)).first()[0] == "temperature out of range"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=60), st.integers(1, 40), st.lists(st.integers(1, 2500), max_size=6))
def test_composed_maps_equal_a_plain_walk(gaps, width, cuts):
    t = np.unique(np.cumsum(gaps))
    blocks = [b for b in np.split(t, np.searchsorted(t, sorted(cuts))) if len(b)]
    maps = [block_map(b, width) for b in blocks]
    while len(maps) > 1:  # three at a time, level by level
        maps = [composed(maps[i : i + 3], width) for i in range(0, len(maps), 3)]
    for anchor in (NONE, int(t[0]) - 1, int(t[0]) - width // 2 - 1, int(t[0]) - 3 * width):
        last = anchor
        for x in t:
            last = int(x) if x >= last + width else last
        assert after(anchor, maps[0], width) == last
    assert all(np.all(first[1:] > first[:-1]) and np.all(last[1:] != last[:-1]) for first, last in maps)


@pytest.mark.parametrize("block_windows, block_calls", [(1, 50_000), (32, 3)])
def test_hot_caller_in_cut_blocks(spark, block_windows, block_calls):
    rng = random.Random(8)
    times, t = [], 0
    for _ in range(1500):
        t += rng.choice([0, 0, 0, 1, 7, 30, 61, 90] if len(times) % 500 < 400 else [0, 0, 0, 0, 1])
        times.append(t)
    rows = [("hot", x * 1_000_000, i) for i, x in enumerate(times)] + [("rare", 10**12 * i, -i - 1) for i in range(3)]
    calls = spark.createDataFrame(rows, "__k string, __t long, __id long").repartition(5)
    got = {r["__id"]: r["__anchor"] for r in label_windows(calls, 60_000_000, block_windows, block_calls).collect()}
    start, want = None, {}
    for i, x in enumerate(times):
        start = x if start is None or x >= start + 60 else start
        want[i] = start * 1_000_000
    assert got == want | {-i - 1: 10**12 * i for i in range(3)}


def test_no_step_holds_more_than_the_parts_of_a_cell(spark):
    """A million windows of one caller: neither a block nor a cell brings many rows together."""
    span, width = 60_000_000 * 1_000_000, 60_000_000
    calls = spark.range(1_000_000).select(F.lit("hot").alias("__k"), (F.col("id") * width).alias("__t"), F.col("id").alias("__id"))
    dealt, widths = cut_blocks(calls, 0, width * BLOCK_WINDOWS, BLOCK_CALLS)
    cells = cell_widths(span, widths)
    for level in range(1, len(cells)):
        cell, above = (cell_start(F.col("__t"), 0, cells[:n]) for n in (level + 1, level))
        parts = dealt.groupBy("__k", above.alias("above")).agg(F.count_distinct(cell).alias("n")).agg(F.max("n")).first()[0]
        assert parts <= FAN
    assert dealt.groupBy("block").count().agg(F.max("count")).first()[0] <= BLOCK_WINDOWS


def test_bytes_cut_inside_characters_give_the_same_tokens(spark):
    """Against the decoder of the standard library, which replaces broken bytes like a browser does."""
    rng = random.Random(11)
    streams = {}
    for n in range(60):
        body = b"\xef\xbb\xbf" if n % 7 == 0 else b""
        for k in range(rng.randrange(8)):
            text = rng.choice(["é", "日本語", "🙂🙂", "a b", "", "plain"]) + str(k)
            body += rng.choice([f"data: {json.dumps({'token': text}, ensure_ascii=False)}\n\n".encode(), b"data: [DONE]\n", b": \xff\xc3\n", b"data: {bad\n",
                                b'data: {"token": "x\xe6\x97y\xf0\x9f\x99"}\n', b'data: {"token": "\xc3'])
        cuts, pieces = sorted(rng.sample(range(len(body) + 1), min(len(body), rng.randrange(12)))), []
        for lo, hi in zip([0, *cuts], [*cuts, len(body)]):
            pieces.append(body[lo:hi])
        streams[f"r{n}"] = pieces
    rows = [(r, i, bytearray(c)) for r, chunks in streams.items() for i, c in enumerate(chunks)]
    chunks = spark.createDataFrame(rows, "request_id string, chunk long, data binary").repartition(6)
    want = {}
    for r, pieces in streams.items():
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        want[r] = read_like_a_browser([decoder.decode(p) for p in pieces], strip=" \t\r\n\v\f\xa0  ﻿")
    assert {r.request_id: r.text for r in answers.answer_texts(chunks).collect()} == want
    assert any("�" in text for text in want.values())
