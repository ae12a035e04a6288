"""Search in nested JSON as a table function: a stack of its own in place of recursion, so any depth will do."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r'[ \t\r\n]*("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"|[{}\[\],:]|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|(?:true|false|null)(?!\w)|[ \t\r\n]*$)')
_CLOSES = {"}": "{", "]": "["}


def find_key(text: str, key: str) -> list[tuple[int, int, str, str]] | None:
    """(order, depth, path, value) of a key's values in the order in which their objects open, values as JSON; None if text is no JSON.

    Of a key that an object repeats the last value counts. One pass; what is
    kept is a stack of open objects and arrays, and what was found.
    """
    found: dict[int, tuple[int, int, str, str]] = {}
    stack: list[list] = []  # kind, order, path as written, the member or index now
    order = at = 0
    starts: list[tuple[int, int]] = []  # of found values that are still open: depth of the stack, where
    need = "value"  # value, first (value or end), key, member (key or end), colon, next (comma or end), done
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            return None
        token, begin, at = m[1], m.start(1), m.end()
        if not token.strip():
            return list(dict(sorted(found.items())).values()) if need == "done" else None
        if token in "}]" and stack and stack[-1][0] == _CLOSES[token] and need in ("next", "first" if token == "]" else "member"):
            stack.pop()
            if starts and starts[-1][0] == len(stack):
                _, where = starts.pop()
                _hold(found, stack, key, text[where:at])
        elif token in "{[" and need in ("value", "first"):
            if _wanted(stack, key):
                starts.append((len(stack), begin))
            stack.append([token, order, None])
            order += token == "{"
            need = "first" if token == "[" else "member"
            if token == "[":
                stack[-1][2] = 0
            continue
        elif token == "," and need == "next":
            if stack[-1][0] == "{":
                need = "key"
            else:
                stack[-1][2] += 1
                need = "value"
            continue
        elif token == ":" and need == "colon":
            need = "value"
            continue
        elif token[0] == '"' and need in ("key", "member"):
            stack[-1][2] = json.loads(token)
            need = "colon"
            continue
        elif token not in "{}[],:" and need in ("value", "first"):
            if _wanted(stack, key):
                _hold(found, stack, key, token)
        else:
            return None
        need = "next" if stack else "done"


def _wanted(stack: list[list], key: str) -> bool:
    return bool(stack) and stack[-1][0] == "{" and stack[-1][2] == key


def _hold(found: dict, stack: list[list], key: str, value: str) -> None:
    path = "$" + "".join(f".{s[2]}" if s[0] == "{" else f"[{s[2]}]" for s in stack) if len(stack) <= 64 else "$.."
    found[stack[-1][1]] = (stack[-1][1], len(stack) - 1, path, value)


class JsonFind:
    """json_find(item, key): a row for each object in which the key is, in the order in which the objects open."""

    def eval(self, item: str, key: str) -> Iterator[tuple[int, int, str, str]]:
        if item is not None and key is not None:
            yield from find_key(item, key) or ()


class JsonFirst:
    """json_first(item, key): one row, the first value of the key as a plain string; null where it is empty or missing, or the item malformed."""

    def eval(self, item: str, key: str) -> Iterator[tuple[str | None]]:
        found = find_key(item, key) if item is not None and key is not None else None
        yield (plain(found[0][3]) if found else None,)


def plain(value: str) -> str | None:
    """A JSON value as a string; objects and arrays as they are written, empty values as null."""
    if value[0] in "{[":
        return None if re.fullmatch(r"[{\[]\s*[}\]]", value) else value
    read = json.loads(value)
    return str(read) if read else None


json_find = F.udtf(JsonFind, returnType="ord bigint, depth int, path string, value string", useArrow=False)
json_first = F.udtf(JsonFirst, returnType="value string", useArrow=False)


def register(spark: SparkSession) -> None:
    """The table functions for SQL: SELECT … FROM t, LATERAL json_find(t.item, 'query_id')."""
    spark.udtf.register("json_find", json_find)
    spark.udtf.register("json_first", json_first)


def first_value(df: DataFrame, item: str, key: str, alias: str) -> DataFrame:
    """A column with the first value of a key, by the order in which objects open."""
    return df.lateralJoin(json_first(F.col(item).outer(), F.lit(key))).withColumnRenamed("value", alias)
