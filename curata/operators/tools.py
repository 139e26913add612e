"""Tool calls in text: seven dialects that write calls and find them again.

A dialect is a marker grammar over one JSON reader: calls are found by walking from marker to marker and decoding the
value that follows, so arguments may hold any nesting or the markers' own words. A text without a call, or with a
broken one, is ordinary content.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Call = tuple[str, dict]
_DECODER = json.JSONDecoder()


class Broken(ValueError):
    """A marker without a readable call."""


def value_at(text: str, at: int) -> tuple[object, int]:
    """The JSON value that begins at or after a place (white space and code fences apart), and where it ends."""
    while at < len(text) and text[at] in " \n\t\r`\"":
        at += 1
    try:
        return _DECODER.raw_decode(text, at)
    except ValueError as e:
        raise Broken from e


def between(text: str, begin: str, end: str) -> Iterator[str]:
    """The parts between marker pairs, in order; a part that never ends is broken."""
    at = text.find(begin)
    while at >= 0:
        stop = text.find(end, at + len(begin))
        if stop < 0:
            raise Broken
        yield text[at + len(begin) : stop]
        at = text.find(begin, stop + len(end))


def named(x: object, arguments: str) -> Call:
    if not isinstance(x, dict) or "name" not in x or arguments not in x:
        raise Broken
    return x["name"], x[arguments]


def loose(text: str) -> object:
    """A value that may be bare text."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def dump(x: object) -> str:
    return json.dumps(x, ensure_ascii=False)


@dataclass(frozen=True)
class Dialect:
    write: Callable[[list[Call]], str]
    find: Callable[[str], Iterator[Call]]

    def read(self, text: str) -> list[Call] | None:
        """The calls of a text; None if it has none or a broken one."""
        try:
            return list(self.find(text)) or None
        except Broken:
            return None


def _actions(text: str) -> Iterator[Call]:
    at = text.find("Action:")
    while at >= 0:
        mid = text.find("Action Input:", at)
        if mid < 0:
            raise Broken
        value, end = value_at(text, mid + len("Action Input:"))
        yield text[at + len("Action:") : mid].strip(), value
        at = text.find("Action:", end)


def _two_lines(text: str) -> Iterator[Call]:
    name, line, rest = text.partition("\n")
    if line:
        value, end = value_at(rest, 0)
        if rest[end:].strip():
            raise Broken
        yield name, value


def _whole(arguments: str) -> Callable[[str], Iterator[Call]]:
    def find(text: str) -> Iterator[Call]:
        value, end = value_at(text.strip(), 0)
        if text.strip()[end:]:
            raise Broken
        for x in value if isinstance(value, list) else [value]:
            yield named(x, arguments)

    return find


def _tagged(text: str) -> Iterator[Call]:
    at = text.find("<tool_call>")
    while at >= 0:
        value, end = value_at(text, at + len("<tool_call>"))
        yield named(value, "arguments")
        at = text.find("<tool_call>", end)


def _keyed(text: str) -> Iterator[Call]:
    for part in between(text, "<tool_call>", "</tool_call>"):
        keys, values = list(between(part, "<arg_key>", "</arg_key>")), list(between(part, "<arg_value>", "</arg_value>"))
        if len(keys) != len(values):
            raise Broken
        yield part.split("<arg_key>")[0].strip(), {k: loose(v) for k, v in zip(keys, values)}


def _functions(text: str) -> Iterator[Call]:
    for part in between(text, "<seed:tool_call>", "</seed:tool_call>"):
        for body in between(part, "<function=", "</function>"):
            name, _, rest = body.partition(">")
            pairs = (p.partition(">") for p in between(rest, "<parameter=", "</parameter>"))
            yield name.strip(), {k: loose(v) for k, _, v in pairs}


def _one_or_list(arguments: str, always_list: bool) -> Callable[[list[Call]], str]:
    def write(calls: list[Call]) -> str:
        objects = [{"name": n, arguments: a} for n, a in calls]
        return dump(objects if always_list or len(objects) > 1 else objects[0])

    return write


#: Users add their own.
DIALECTS: dict[str, Dialect] = {
    "default": Dialect(lambda calls: "\n".join(f"Action: {n}\nAction Input: {dump(a)}" for n, a in calls), _actions),
    "glm4": Dialect(lambda calls: f"{calls[0][0]}\n{dump(calls[0][1])}", _two_lines),
    "llama3": Dialect(_one_or_list("parameters", False), _whole("parameters")),
    "mistral": Dialect(_one_or_list("arguments", True), _whole("arguments")),
    "qwen": Dialect(lambda calls: "\n".join(f"<tool_call>\n{dump({'name': n, 'arguments': a})}\n</tool_call>" for n, a in calls), _tagged),
    "glm4_moe": Dialect(lambda calls: "\n".join(f"<tool_call>{n}" + "".join(f"\n<arg_key>{k}</arg_key>\n<arg_value>{v if isinstance(v, str) else dump(v)}</arg_value>" for k, v in a.items()) + "\n</tool_call>" for n, a in calls), _keyed),
    "seed_oss": Dialect(lambda calls: "\n".join(f"<seed:tool_call>\n<function={n}>\n" + "\n".join(f"<parameter={k}>{v if isinstance(v, str) else dump(v)}</parameter>" for k, v in a.items()) + "\n</function>\n</seed:tool_call>" for n, a in calls), _functions),
}


def extract_calls(dialect: str):
    """A column function: a text's calls as array of (name, arguments as JSON); NULL where it is ordinary content."""
    d = DIALECTS[dialect]
    kind = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())]))

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None or (c := d.read(t)) is None else [{"name": n, "arguments": dump(a)} for n, a in c])

    return run


def write_calls(dialect: str):
    """A column function: calls given as JSON (one object with name and arguments, or a list) in a dialect's text."""
    d = DIALECTS[dialect]

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            x = json.loads(t)
            return d.write([(c["name"], c["arguments"]) for c in (x if isinstance(x, list) else [x])])

        return s.map(one)

    return run


def described(tools: list[dict], names_only: bool = False) -> str:
    """The tools as lines of JSON schema, or their names."""
    bare = [t.get("function", t) if t.get("type") == "function" else t for t in tools]
    return ", ".join(t["name"] for t in bare) if names_only else "\n".join(dump({"type": "function", "function": t}) for t in bare)
