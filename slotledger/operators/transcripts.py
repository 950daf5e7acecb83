"""Reports over assistant transcripts (``agent_events``) and tool payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger import fixed_values as fv
from slotledger.functions.json_tree import first_value, may_hold_key, tool_record_lists
from slotledger.functions.text import (
    block,
    csv_cell,
    is_json,
    scalar_text,
    remove_all,
    string_list,
    strip,
)


def json_key_search(agent_events: DataFrame, key: str) -> DataFrame:
    """First non-null value of ``key`` in each session's messages."""
    found = (
        agent_events.where(may_hold_key(F.col("payload"), key))
        .select("session_id", "seq", first_value(F.col("payload"), key).alias("value"))
        .where(F.col("value").isNotNull())
    )
    first = F.min(F.struct("seq", "value"))
    return found.groupBy("session_id").agg(first.alias("first")).select("session_id", "first.*")


def tool_tables(
    agent_events: DataFrame, tools: tuple[str, ...] = fv.TABLE_TOOLS
) -> DataFrame:
    """One row per table a tool returned: its title and its records (JSON texts)."""
    key = fv.TOOL_RESPONSE_KEY
    nodes = agent_events.where(may_hold_key(F.col("payload"), key)).select(
        "session_id",
        "seq",
        F.posexplode(tool_record_lists(F.col("payload"), key)).alias("node_no", "node"),
    )
    return nodes.where(F.col("node.tool").isin(*tools)).select(
        "session_id",
        "seq",
        "node_no",
        F.col("node.tool").alias("tool"),
        F.initcap(F.replace(F.col("node.tool"), F.lit("_"), F.lit(" "))).alias("title"),
        F.col("node.records").alias("records"),
    )


def latest_tables(tables: DataFrame) -> DataFrame:
    """Per session and title the last table, at the position of the first one."""
    # A task keeps one table a session and title, so only those reach the shuffle, and the
    # walk through the payloads runs once.
    place = F.struct("seq", "node_no")
    found = tables.groupBy("session_id", "title").agg(
        F.min(place).alias("first"), F.max(F.struct("seq", "node_no", "records")).alias("last")
    )
    return found.select(
        "session_id",
        F.col("first.seq").alias("first_seq"),
        F.col("first.node_no").alias("first_node_no"),
        "title",
        F.col("last.records").alias("records"),
    )


def table_records(tables: DataFrame) -> DataFrame:
    """One row per record of ``tool_tables`` or ``latest_tables``."""
    others = [name for name in tables.columns if name != "records"]
    return tables.select(*others, F.posexplode("records").alias("record_no", "record"))


def _chart_text(agent_events: DataFrame) -> DataFrame:
    chart = agent_events.select(
        "session_id", "seq", block(F.col("text"), fv.CHART_BLOCK).alias("chart")
    ).where(F.col("chart").isNotNull())
    return chart.where(F.col("chart").startswith("{") & is_json(F.col("chart")))


def _chart_spec(chart: Column) -> Column:
    """Chart with its top-level color moved into the encoding, and a fixed size."""
    top = F.try_variant_get(F.try_parse_json(chart), "$", "map<string,variant>")
    color = top["color"]
    movable = F.coalesce(F.schema_of_variant(color).startswith("OBJECT"), F.lit(False))
    no_fields = F.create_map().cast("map<string,variant>")
    encoding = F.coalesce(
        F.try_variant_get(top["encoding"], "$", "map<string,variant>"), no_fields
    )
    colored = F.when(F.map_contains_key(encoding, "color"), encoding).otherwise(
        F.map_concat(encoding, F.create_map(F.lit("color"), color))
    )
    size = F.create_map(
        F.lit("width"),
        F.lit(fv.CHART_WIDTH).cast("variant"),
        F.lit("height"),
        F.lit(fv.CHART_HEIGHT).cast("variant"),
    )

    def without(*keys: str) -> Column:
        return F.map_filter(top, lambda k, _: ~k.isin(*keys))

    moved = F.map_concat(
        without("color", "encoding", "width", "height"),
        F.create_map(F.lit("encoding"), F.to_variant_object(colored)),
        size,
    )
    kept = F.map_concat(without("width", "height"), size)
    return F.when(movable, F.to_json(F.to_variant_object(moved))).otherwise(
        F.to_json(F.to_variant_object(kept))
    )


def chart_specs(agent_events: DataFrame) -> DataFrame:
    """Chart specification of each message that holds one (JSON, keys in order)."""
    return _chart_text(agent_events).select(
        "session_id", "seq", _chart_spec(F.col("chart")).alias("spec")
    )


def _last_values(record: Column) -> Column:
    """A map whose keys are unique, each with its last value."""
    keys = F.array_distinct(F.map_keys(record))

    def last(key: Column) -> Column:
        entries = F.filter(F.map_entries(record), lambda e: e["key"] == key)
        return F.try_element_at(entries, F.lit(-1))["value"]

    unique = F.map_from_arrays(keys, F.transform(keys, last))
    return F.when(F.size(keys) == F.size(record), record).otherwise(unique)


def _chart_values(chart: Column) -> Column:
    """Records of a chart, keys in their order."""
    parsed = F.from_json(chart, "data struct<values:array<map<string,string>>>")
    return F.transform(parsed["data"]["values"], _last_values)


def chart_records(agent_events: DataFrame) -> DataFrame:
    """One row per data record embedded in a chart, as a map of column to text."""
    return _chart_text(agent_events).select(
        "session_id",
        "seq",
        F.posexplode(_chart_values(F.col("chart"))).alias("record_no", "record"),
    )


def chart_data_csv(agent_events: DataFrame) -> DataFrame:
    """CSV text, with a header line, of the data embedded in each chart."""
    charts = (
        _chart_text(agent_events)
        .select("session_id", "seq", _chart_values(F.col("chart")).alias("values"))
        .where(F.col("values").isNotNull())
    )
    known = F.filter("values", lambda r: r.isNotNull())
    columns = F.array_distinct(F.flatten(F.transform(known, lambda r: F.map_keys(r))))
    charts = charts.withColumn("columns", columns)

    def line(record: Column) -> Column:
        return F.array_join(F.transform("columns", lambda c: csv_cell(record[c])), ",")

    header = F.array_join(F.transform("columns", csv_cell), ",")
    body = F.array_join(F.transform("values", line), "\n")
    return charts.select(
        "session_id", "seq", F.concat(header, F.lit("\n"), body, F.lit("\n")).alias("csv")
    )


def follow_ups(agent_events: DataFrame) -> DataFrame:
    """Follow-up questions offered by each message."""
    offered = block(F.col("text"), fv.FOLLOW_UP_BLOCK)
    return agent_events.select("session_id", "seq", offered.alias("offered")).where(
        F.col("offered").isNotNull()
    ).select(
        "session_id", "seq", F.posexplode(string_list(F.col("offered"))).alias("position", "question")
    )


def clean_chat_text(agent_events: DataFrame) -> DataFrame:
    """Message text without tag blocks; a block reaches to the last closing tag."""
    cleaned = strip(remove_all(F.col("text"), fv.CHAT_REMOVALS))
    return agent_events.select("session_id", "seq", cleaned.alias("clean_text"))


def clean_report_text(agent_events: DataFrame) -> DataFrame:
    """Report text without tag blocks and embedded images; blocks end at the first closing tag."""
    cleaned = F.col("text")
    *trimmed, last = fv.REPORT_REMOVALS
    for pattern in trimmed:
        cleaned = strip(F.regexp_replace(cleaned, pattern, ""))
    cleaned = F.regexp_replace(cleaned, last, "")
    return agent_events.select("session_id", "seq", cleaned.alias("clean_text"))


def final_text(agent_events: DataFrame, missing: str = fv.NO_CHAT_TEXT) -> DataFrame:
    """First text part of each session's last message, else a fixed sentence.

    The last message is found on two narrow columns; only its payload is parsed.
    """
    last = agent_events.groupBy("session_id").agg(F.max("seq").alias("seq"))
    text = F.get_json_object("payload", "$.content.parts[0].text")
    return (
        agent_events.join(last, ["session_id", "seq"])
        .select("session_id", text.alias("text"))
        .groupBy("session_id")
        .agg(F.max("text").alias("text"))
        .select("session_id", F.coalesce("text", F.lit(missing)).alias("final_text"))
    )


def _json_object(key: str, value: Column) -> Column:
    return F.to_json(F.struct(value.alias(key)))


def _item_rows(text: Column) -> Column:
    """Rows of one text item: list elements, an object, a scalar, or plain text."""
    body = strip(text)
    scalar = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<variant>")[0]
    return (
        F.when(~is_json(text), F.array(_json_object("text", text)))
        .when(body.startswith("["), F.from_json(text, "array<string>"))
        .when(body.startswith("{"), F.array(body))
        .otherwise(F.array(_json_object("info", scalar_text(scalar, body))))
    )


def _failure(payload: Column) -> Column:
    """Error row of a response without a content list; null for any other."""
    message = F.coalesce(
        F.get_json_object(payload, "$.error.message"), F.lit(fv.TOOL_ERROR_UNKNOWN)
    )
    unreadable = F.format_string(fv.TOOL_NOT_JSON, F.coalesce(payload, F.lit("")))
    raw = F.struct(F.lit(fv.TOOL_NOT_RECOGNISED).alias("error"), payload.alias("raw"))
    return (
        F.when(~F.coalesce(is_json(payload), F.lit(False)), _json_object("error", unreadable))
        .when(
            F.get_json_object(payload, "$.error").isNotNull(),
            _json_object("error", F.format_string(fv.TOOL_ERROR, message)),
        )
        .when(_content(payload).isNull(), F.to_json(raw))
    )


def _content(payload: Column) -> Column:
    schema = "result struct<content:array<struct<type:string,text:string>>>"
    return F.from_json(payload, schema)["result"]["content"]


def parse_tool_payload(tool_payloads: DataFrame) -> DataFrame:
    """Rows (JSON texts) that a tool returned; a message row when it returned none.

    A failed call, a response in another form and unreadable JSON give an error row.
    """
    items = _content(F.col("payload"))
    texts = F.filter(items, lambda i: (i["type"] == "text") & i["text"].isNotNull())
    rows = F.flatten(F.transform(texts, lambda i: _item_rows(i["text"])))
    none = F.array(_json_object("message", F.lit(fv.NO_TOOL_DATA)))
    failure = _failure(F.col("payload"))
    found = tool_payloads.select("call_id", failure.alias("failure"), rows.alias("rows"))
    shown = (
        F.when(F.col("failure").isNotNull(), F.array("failure"))
        .when(F.size("rows") > 0, F.col("rows"))
        .otherwise(none)
    )
    return found.select("call_id", F.posexplode(shown).alias("row_no", "row"))
