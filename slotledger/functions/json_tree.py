"""Search for a key anywhere in a JSON document.

Native JSON and VARIANT access needs a known path, and VARIANT sorts object
keys, so document order is lost. Where a key stands once in a document, though, its
place in the text tells its value: ``first_value`` cuts the text there and reads on
natively. Only documents with several such keys, escapes or values that have to be
formatted go to Python, in Arrow batches.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from slotledger.functions.text import is_json

# The helpers travel with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def may_hold_key(document: Column, key: str) -> Column:
    """False only where ``key`` cannot occur (an escaped key needs a ``\\u``)."""
    return document.contains(f'"{key}"') | document.contains("\\u")


def _parse(document: str | None):
    try:
        return json.loads(document) if document is not None else None
    except (ValueError, RecursionError):
        return None


def _children(node) -> list:
    if isinstance(node, dict):
        return list(node.values())[::-1]
    return node[::-1] if isinstance(node, list) else []


def matches(root, key: str) -> Iterator:
    """Every value of ``key``, an object's own key before its children."""
    pending = [root]
    while pending:
        node = pending.pop()
        if isinstance(node, dict) and key in node:
            yield node[key]
        pending.extend(_children(node))


def first_match(root, key: str):
    """First non-null value of ``key``; an object that has the key is not searched further."""
    pending = [root]
    while pending:
        node = pending.pop()
        if isinstance(node, dict) and key in node:
            if node[key] is not None:
                return node[key]
        else:
            pending.extend(_children(node))
    return None


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def _native_value(document: Column, key: str) -> tuple[Column, Column]:
    """Whether the value of ``key`` can be read natively, and that value.

    In valid JSON a quote after a brace, a comma or white space opens a string, as a
    closing one is followed by none of the key's letters; with a colon behind it, the string
    is a member's name. If it is there once, its value is what follows it.
    """
    member = rf'[{{,\s]"\Q{key}\E"\s*:\s*'
    times = F.regexp_count(document, F.lit(member))
    rest = F.regexp_extract(document, rf"(?s){member}(.*)\z", 1)
    whole = F.regexp_extract(rest, r"\A(0|-?[1-9][0-9]*|true|false)[,}\s]", 1)
    text = F.get_json_object(F.concat(F.lit('{"v":'), rest), "$.v")
    easy = rest.startswith('"') | (whole != "") | F.regexp_like(rest, F.lit(r"\Anull[,}\s]"))
    plain = ~document.contains("\\u") & F.coalesce(is_json(document), F.lit(False))
    value = F.when(times == 1, F.when(rest.startswith('"'), text).otherwise(F.nullif(whole, F.lit(""))))
    return plain & ((times == 0) | ((times == 1) & easy)), value


def first_value(document: Column, key: str) -> Column:
    """First non-null value of ``key`` in document order: text, or JSON for other types."""

    @F.pandas_udf("string")
    def find(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: _text(first_match(_parse(d), key)))

    native, value = _native_value(document, key)
    # Documents that need no Python are not sent there.
    return F.when(native, value).otherwise(find(F.when(~native, document)))


def _record_list(response: dict) -> list | None:
    """The records of a tool response: ``response.content``, else its own ``content``."""
    inner = response.get("response")
    content = inner.get("content") if isinstance(inner, dict) else None
    content = content or response.get("content")
    if isinstance(content, list) and content and all(isinstance(r, dict) for r in content):
        return content
    return None


def tool_record_lists(document: Column, key: str) -> Column:
    """Array of (tool, records) for every node under ``key`` that holds a list of records."""

    def extract(document: str | None) -> list[dict]:
        found = []
        for node in matches(_parse(document), key):
            records = _record_list(node) if isinstance(node, dict) else None
            if records and isinstance(node.get("name"), str):
                texts = [json.dumps(r, ensure_ascii=False) for r in records]
                found.append({"tool": node["name"], "records": texts})
        return found

    @F.pandas_udf("array<struct<tool:string,records:array<string>>>")
    def find(documents: pd.Series) -> pd.Series:
        return documents.map(extract)

    return find(document)
