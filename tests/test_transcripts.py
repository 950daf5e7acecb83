from __future__ import annotations

import json
import os
import random
import subprocess
import sys

import pytest
from places import ROOT

from slotledger import fixed_values as fv
from slotledger.functions.json_tree import first_match, matches
from slotledger.operators import transcripts as tr


@pytest.fixture
def messages(frame):
    """One session whose messages have these texts, or these payloads."""

    def build(texts=None, payloads=None):
        rows = []
        for seq in range(len(texts or payloads)):
            row = {"session_id": "s", "seq": seq}
            if texts:
                row["text"] = texts[seq]
            if payloads:
                value = payloads[seq]
                row["payload"] = value if isinstance(value, str) or value is None else json.dumps(value)
            rows.append(row)
        return frame("agent_events", rows)

    return build


# --- key search ---------------------------------------------------------------

def test_first_match_rules():
    assert first_match({"a": {"k": 1}, "k": 2}, "k") == 2  # own key before children
    assert first_match({"b": {"k": 1}, "a": {"k": 2}}, "k") == 1  # document order
    assert first_match([{"k": None, "x": {"k": 5}}, {"y": [{"k": 6}]}], "k") == 6
    assert first_match({"x": 1}, "k") is None
    assert first_match(json.loads('{"k": 1, "k": 3}'), "k") == 3  # last duplicate


def test_matches_are_in_document_order():
    document = {"x": [{"k": {"k": 2}}, {"k": 3}], "k": 1}
    assert list(matches(document, "k")) == [1, {"k": 2}, 2, 3]


def test_json_key_search(messages):
    payloads = [
        {"other": 1}, None, "not json", {"a": [{"deep": {"key": None}}]},
        {"a": {"key": {"b": [1, "é"]}}}, {"key": "later"},
    ]
    rows = tr.json_key_search(messages(payloads=payloads), "key").collect()
    assert [(r.seq, r.value) for r in rows] == [(4, '{"b": [1, "é"]}')]


def test_json_key_search_finds_escaped_keys(messages):
    rows = tr.json_key_search(messages(payloads=['{"\\u006bey": "v"}']), "key").collect()
    assert [r.value for r in rows] == ["v"]


def test_very_deep_json_is_no_match(messages):
    deep = "[" * 200_000 + '{"key": 1}' + "]" * 200_000
    assert tr.json_key_search(messages(payloads=[deep, {"key": 1}]), "key").first().seq == 1


def test_python_helpers_need_no_package_on_the_workers(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from slotledger.session import build_session
from slotledger.operators import transcripts as tr
spark = build_session(master="local[1]", conf={{"spark.ui.enabled": "false"}})
events = spark.createDataFrame([("s", 0, '{{"key": "v"}}')], "session_id string, seq bigint, payload string")
print("FOUND", tr.json_key_search(events, "key").first().value, tr.tool_tables(events).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, text=True,
                          capture_output=True, timeout=300)
    assert "FOUND v 0" in done.stdout, done.stderr[-2000:]


# --- tables -------------------------------------------------------------------

def tool(name, content, flat=False):
    inner = {"content": content} if flat else {"response": {"name": name, "content": content}}
    return {"functionResponse": {"name": name, **inner}}


def test_tool_tables_keeps_named_tools_with_records(messages):
    records = [{"b": 1, "a": "x"}, {"b": None}]
    payload = {
        "content": {"parts": [
            tool("find_unused_tables", records),
            tool("unknown_tool", records),
            tool("get_common_query_errors", []),
            tool("get_common_query_errors", "text"),
            tool("get_common_query_errors", [1, 2]),
            tool("check_table_permissions", [{"z": 1}], flat=True),
            {"functionResponse": "odd"},
        ]}
    }
    rows = tr.tool_tables(messages(payloads=[payload])).orderBy("node_no").collect()
    assert [r.title for r in rows] == ["Find Unused Tables", "Check Table Permissions"]
    assert [json.loads(t) for t in rows[0].records] == records
    assert list(json.loads(rows[0].records[0])) == ["b", "a"]


def test_latest_tables_keep_last_content_at_first_place(messages):
    payloads = [
        [tool("find_unused_tables", [{"v": 1}]), tool("get_common_query_errors", [{"v": 2}])],
        [tool("find_unused_tables", [{"v": 3}, {"v": 4}])],
    ]
    tables = tr.latest_tables(tr.tool_tables(messages(payloads=payloads)))
    rows = tr.table_records(tables).orderBy("first_seq", "first_node_no", "record_no").collect()
    assert [(r.title, json.loads(r.record)["v"]) for r in rows] == [
        ("Find Unused Tables", 3), ("Find Unused Tables", 4), ("Get Common Query Errors", 2)]


# --- charts -------------------------------------------------------------------

def chart(spec, fence=False):
    text = spec if isinstance(spec, str) else json.dumps(spec)
    return f"before [VEGA]\n{'```json' if fence else ''}{text}{'```' if fence else ''} [/VEGA] after"


def specs(messages, *charts):
    rows = tr.chart_specs(messages(texts=list(charts))).orderBy("seq").collect()
    return {r.seq: json.loads(r.spec) for r in rows}


SIZE = {"width": 500, "height": 320}


def test_chart_color_moves_into_the_encoding(messages):
    got = specs(
        messages,
        chart({"color": {"field": "c"}, "mark": "bar", "width": 9}, fence=True),
        chart({"color": {"field": "c"}, "encoding": {"x": {"field": "a"}}}),
        chart({"color": {"field": "c"}, "encoding": {"color": {"field": "kept"}}}),
        chart({"color": "red", "mark": {"type": "bar"}}),
    )
    assert got[0] == {"mark": "bar", "encoding": {"color": {"field": "c"}}, **SIZE}
    assert got[1] == {"encoding": {"x": {"field": "a"}, "color": {"field": "c"}}, **SIZE}
    assert got[2] == {"encoding": {"color": {"field": "kept"}}, **SIZE}
    assert got[3] == {"color": "red", "mark": {"type": "bar"}, **SIZE}


def test_the_last_of_two_equal_keys_counts(messages, frame):
    got = specs(messages, chart('{"mark": "a", "mark": "bar", "data": {"n": 1, "n": 2}}'))
    assert got[0] == {"mark": "bar", "data": {"n": 2}, **SIZE}
    text = '[FOLLOW_UP][{"k": 1, "k": 2}, "q"][/FOLLOW_UP]'
    rows = tr.follow_ups(messages(texts=[text])).orderBy("position").collect()
    assert [r.question for r in rows] == ['{"k":2}', "q"]
    assert payload_rows(frame, content('[{"k": 1, "k": 2}]')) == [{"k": 2}]
    twice = chart('{"data": {"values": [{"a": 1, "b": 3, "a": 2}, null]}}')
    assert tr.chart_data_csv(messages(texts=[twice])).first().csv == "a,b\n2,3\n,\n"
    records = tr.chart_records(messages(texts=[twice])).orderBy("record_no").collect()
    assert [r.record for r in records] == [{"a": "2", "b": "3"}, None]


def test_texts_that_hold_no_chart(messages):
    got = specs(messages, "none", chart("not json"), chart('{"a": 1} tail'), chart([1]),
                chart({"a": 1}) + chart("x"), "[VEGA]{}", None)
    assert list(got) == [4]


def test_chart_csv(messages):
    values = [{"a": 1, "b": 'say "hi"'}, {"b": "x\ny", "c": 1.50}, {"a": None}]
    texts = [chart({"data": {"values": values}}), chart({"data": {"url": "u"}}), chart({"mark": "m"})]
    rows = tr.chart_data_csv(messages(texts=texts)).collect()
    assert [r.csv for r in rows] == ['a,b,c\n1,"say ""hi""",\n,"x\ny",1.5\n,,\n']
    records = tr.chart_records(messages(texts=texts)).orderBy("record_no").collect()
    assert [r.record for r in records] == [
        {"a": "1", "b": 'say "hi"'}, {"b": "x\ny", "c": "1.5"}, {"a": None}]


# --- follow-ups ---------------------------------------------------------------

@pytest.mark.parametrize("text, wanted", [
    ('[FOLLOW_UP]["a, b", "c"][/FOLLOW_UP]', ["a, b", "c"]),
    ('x [FOLLOW_UP]```json\n["a"]\n```[/FOLLOW_UP] y', ["a"]),
    ("[FOLLOW_UP]['a, b', 'c',][/FOLLOW_UP]", ["a, b", "c"]),
    ('[FOLLOW_UP]["a, b", "c",][/FOLLOW_UP]', ["a, b", "c"]),
    ("[FOLLOW_UP][why, 'how',, ][/FOLLOW_UP]", ["why", "how"]),
    ('[FOLLOW_UP]["a"', []),
    ('[FOLLOW_UP]["a"]', ["a"]),
    ('[FOLLOW_UP]["a"]\n', ["a"]),
    ('[FOLLOW_UP]["a"] and ["b"][/FOLLOW_UP]', ['a"] and ["b']),
    ("[FOLLOW_UP]a, b[/FOLLOW_UP]", []),
    ("[FOLLOW_UP][][/FOLLOW_UP]", []),
    ("[FOLLOW_UP]['a, b', None][/FOLLOW_UP]", ["a, b", "None"]),
    ("[FOLLOW_UP]['so, None, left', True, 1.0][/FOLLOW_UP]", ["so, None, left", "True", "1.0"]),
    ('[FOLLOW_UP]["1.50", 1.0, 2.50][/FOLLOW_UP]', ["1.50", "1.0", "2.5"]),
    ('[FOLLOW_UP][1, true, null, 2.5][/FOLLOW_UP]', ["1", "True", "None", "2.5"]),
    ('[FOLLOW_UP]["first"][/FOLLOW_UP] [FOLLOW_UP]["second"][/FOLLOW_UP]', ["first"]),
    ("no tag", []),
])
def test_follow_ups(messages, text, wanted):
    rows = tr.follow_ups(messages(texts=[text])).orderBy("position").collect()
    assert [r.question for r in rows] == wanted


# --- cleaning -----------------------------------------------------------------

def clean(report, messages, text):
    return report(messages(texts=[text])).first().clean_text


def test_chat_blocks_are_greedy_and_report_blocks_are_not(messages):
    text = "a [VEGA]1[/VEGA] b [VEGA]2[/VEGA] c"
    assert clean(tr.clean_chat_text, messages, text) == "a  c"
    assert clean(tr.clean_report_text, messages, text) == "a  b  c"


def test_all_tags_go(messages):
    text = ("  x [DASHBOARD_GENERATED][DASHBOARD_IMAGE]data:image/png;base64,AA\n"
            "[/DASHBOARD_IMAGE] y [FOLLOW_UP]never closed\n")
    assert clean(tr.clean_chat_text, messages, text) == "x  y"
    assert clean(tr.clean_report_text, messages, text) == "x  y"


def test_embedded_images_leave_reports(messages):
    text = ('a ![p](data:image/png;base64,AA==) b <img alt="q" src=\'data:image/gif;base64,BB\'> c '
            'src=data:image/svg+xml;base64,CC DD\n"end')
    assert clean(tr.clean_report_text, messages, text) == 'a  b  c src="end'
    assert "data:image/png" in clean(tr.clean_chat_text, messages, text)


def test_null_text_stays_null(messages):
    assert clean(tr.clean_chat_text, messages, None) is None


# --- payloads -----------------------------------------------------------------

def test_final_text_is_that_of_the_last_message(messages):
    first = {"content": {"parts": [{"text": "early"}]}}
    last = {"content": {"parts": [{"text": "late"}, {"text": "second part"}]}}
    assert tr.final_text(messages(payloads=[first, last])).first().final_text == "late"
    no_parts = {"content": {"parts": []}}
    assert tr.final_text(messages(payloads=[first, no_parts])).first().final_text == fv.NO_CHAT_TEXT
    report = tr.final_text(messages(payloads=[first, {}]), fv.NO_REPORT_TEXT)
    assert report.first().final_text == fv.NO_REPORT_TEXT


def payload_rows(frame, payload):
    text = payload if isinstance(payload, str) else json.dumps(payload)
    df = tr.parse_tool_payload(frame("tool_payloads", [{"call_id": "c", "payload": text}]))
    return [json.loads(r.row) for r in df.orderBy("row_no").collect()]


def content(*items):
    return {"result": {"content": [{"type": "text", "text": t} for t in items]}}


@pytest.mark.parametrize("text, wanted", [
    ('[{"b":1,"a":[1,{"c":2}]},{"b":null}]', [{"b": 1, "a": [1, {"c": 2}]}, {"b": None}]),
    (' {"a": "x"} ', [{"a": "x"}]),
    ("12", [{"info": "12"}]),
    ("1.5", [{"info": "1.5"}]),
    ("true", [{"info": "True"}]),
    ("null", [{"info": "None"}]),
    ('"quoted"', [{"info": "quoted"}]),
    ("plain words", [{"text": "plain words"}]),
    ("[1] tail", [{"text": "[1] tail"}]),
    ("1, 2", [{"text": "1, 2"}]),
    ("1] , [2", [{"text": "1] , [2"}]),
    ('1} x {"v":2', [{"text": '1} x {"v":2'}]),
    ("{'a': 1}", [{"text": "{'a': 1}"}]),
    ("", [{"text": ""}]),
    ("[]", [{"message": fv.NO_TOOL_DATA}]),
])
def test_payload_items(frame, text, wanted):
    assert payload_rows(frame, content(text)) == wanted


def test_payload_items_are_concatenated(frame):
    payload = content('[{"a":1}]', "x")
    payload["result"]["content"].insert(1, {"type": "image", "text": "no"})
    assert payload_rows(frame, payload) == [{"a": 1}, {"text": "x"}]
    assert payload_rows(frame, {"result": {"content": []}}) == [{"message": fv.NO_TOOL_DATA}]
    assert payload_rows(frame, {"error": {"message": "m"}}) == [{"error": "MCP Error: m"}]
    assert payload_rows(frame, {"error": {}}) == [{"error": "MCP Error: Unknown error"}]
    assert payload_rows(frame, {}) == [{"error": fv.TOOL_NOT_RECOGNISED, "raw": "{}"}]


@pytest.mark.parametrize("text,wanted", [
    ("1.0", "1.0"), ("1.50", "1.5"), ("-0.25", "-0.25"), ("12", "12"), ("100.00", "100.0")])
def test_numbers_keep_their_text(frame, text, wanted):
    assert payload_rows(frame, content(text)) == [{"info": wanted}]


# --- broken input ---------------------------------------------------------------

PIECES = (
    '[VEGA]|[/VEGA]|[FOLLOW_UP]|[/FOLLOW_UP]|[DASHBOARD_IMAGE]|[/DASHBOARD_IMAGE]|```json|```|{|}|'
    '[|]|"a"|"a":|"color":|"encoding":|"data":|"values":|"mark":|1|-|1e999|1.5|true|null|NaN|,|:|'
    "'b'|\\|\\u00|\\ud800|\n|\u2028|\x00|data:image/png;base64,AA|![x](|)|<img src=\"|>|"
    '{"data":{"values":[{"a":1}]}}|{"color":{},"encoding":[]}|["x"]|"functionResponse":|"name":|'
    '"result":{"content":[{"type":"text","text":|"content":{"parts":[{"text":'
).split("|")


def test_broken_texts_never_fail_a_report(frame):
    rnd = random.Random(11)
    texts = ["".join(rnd.choices(PIECES, k=rnd.randrange(1, 14))) for _ in range(3000)]
    texts += ["[VEGA]" + t + "[/VEGA]" for t in texts[:1000]]
    texts += ["[FOLLOW_UP][" + t + "]" for t in texts[:1000]]
    texts += ['{"result":{"content":[{"type":"text","text":' + json.dumps(t) + "}]}}" for t in texts[:1000]]
    events = frame("agent_events", [
        {"session_id": f"s{i % 7}", "seq": i, "payload": t, "text": t} for i, t in enumerate(texts)])
    payloads = frame("tool_payloads", [{"call_id": str(i), "payload": t} for i, t in enumerate(texts)])
    assert tr.clean_chat_text(events).count() == tr.clean_report_text(events).count() == len(texts)
    for df in (
        tr.clean_chat_text(events), tr.clean_report_text(events), tr.chart_specs(events),
        tr.chart_data_csv(events), tr.chart_records(events), tr.follow_ups(events),
        tr.final_text(events), tr.json_key_search(events, "a"),
        tr.latest_tables(tr.tool_tables(events)), tr.parse_tool_payload(payloads),
    ):
        df.write.format("noop").mode("overwrite").save()
