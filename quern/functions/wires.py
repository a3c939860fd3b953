"""Wire formats: how models write their calls, beside the plain lists of calls.

A format is a row of a table: what is cut out of a text, how it is taken apart, how a piece is read, and where a piece has
its name and arguments. One decoder works through any row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from quern.functions import calls as C


def _json(piece: str):
    return json.loads(piece)


def _literal(piece: str):
    return C.literal(piece.strip())


def _relaxed(piece: str):
    """JSON whose strings may stand in single quotes."""
    return json.loads(piece.replace("'", '"'))


def _heading(piece: str):
    """A name, and JSON arguments after the end of its line or tag."""
    name, rest = (re.split(r"\s*[>\n]\s*", piece, maxsplit=1) + [""])[:2]
    return {"name": name, "arguments": json.loads(rest) if rest else {}}


def _stream(piece: str) -> list:
    """JSON values one after the other, divided by semicolons, commas or white space; else a Python literal."""
    out, at, read = [], 0, json.JSONDecoder().raw_decode
    try:
        while at < len(piece):
            value, at = read(piece, at)
            out += value if isinstance(value, list) else [value]
            at += len(piece[at:]) - len(piece[at:].lstrip(";, \t\n\r"))
        return out
    except ValueError:
        return C.literal(piece)


def _python(piece: str) -> C.Calls:
    return C.decode_prompted(piece)


@dataclass(frozen=True)
class Wire:
    """One format.

    ``cut`` is a pattern whose first group is what counts (all of them with ``every``); without a match the calls are
    ``missing`` (an empty list, the whole text, or an error). ``drop`` is taken out of it, ``split`` divides it. ``read``
    makes values of a piece; ``name`` and ``args`` are the keys of an entry: without a name an entry is {name: arguments}.
    ``inside`` is a key under which an entry has these, ``none`` a name that says that nothing is called.
    """

    read: Callable = _json
    name: str | None = "name"
    args: str = "arguments"
    cut: str | None = None
    every: bool = False
    missing: str = "error"
    drop: tuple[str, ...] = ()
    split: str | None = None
    inside: str | None = None
    none: str | None = None
    unreadable: str = "error"

    def pieces(self, text: str) -> list[str]:
        found = [text]
        if self.cut:
            found = [m if isinstance(m, str) else m[0] for m in re.findall(self.cut, text, re.S)][: None if self.every else 1]
            if not found and self.missing == "error":
                raise ValueError("no calls are marked in the text")
            found = found or ([text] if self.missing == "text" else [])
        out = []
        for piece in found:
            for d in self.drop:
                piece = piece.replace(d, "")
            out += re.split(self.split, piece) if self.split else [piece]
        return [p.strip() for p in out if p.strip()]

    def calls(self, piece: str) -> C.Calls:
        got = self.read(piece)
        if self.read is _python:
            return got
        out = []
        for entry in got if isinstance(got, list) else [got]:
            if self.inside and isinstance(entry, dict):
                entry = entry.get(self.inside, entry)
            if not isinstance(entry, dict) or not entry or self.name and self.name not in entry:
                raise ValueError(f"not a call: {str(entry)[:60]}")
            pairs = [(entry[self.name], entry.get(self.args, {}))] if self.name else list(entry.items())
            for name, args in pairs:
                args = json.loads(args) if isinstance(args, str) else args
                if not isinstance(args, dict):
                    raise ValueError(f"arguments of {name} are no object")
                if name != self.none:
                    out.append({name: args})
        return out

    def decode(self, text: str) -> C.Calls:
        """The calls of a text; a ValueError if it isn't of this format."""
        out: C.Calls = []
        for piece in self.pieces(text):
            try:
                out += self.calls(piece)
            except (ValueError, SyntaxError, TypeError, RecursionError) as e:
                if self.unreadable == "error":
                    raise ValueError(str(e)) from None
        return out


FENCE = r"```(?:json|python|tool_code)?"
#: Formats by what they look like; models of one family write one of them.
WIRES: dict[str, Wire] = {
    "map_of_json_text": Wire(name=None),  # [{"f": "{\"a\": 1}"}], as function-calling services return
    "map_of_arguments": Wire(read=_literal, name=None),  # [{'f': {'a': 1}}]
    "nested_function": Wire(inside="function"),  # [{"type": "function", "function": {"name": ..., "arguments": "..."}}]
    "tool_name_parameters": Wire(name="tool_name", args="parameters"),
    "name_arguments": Wire(),
    "name_arguments_or_nothing": Wire(drop=("```",), unreadable="skip"),
    "objects_by_semicolon": Wire(read=_stream),
    "tagged_parameters": Wire(read=_stream, args="parameters", drop=("<|python_tag|>",)),
    "tagged_json_parameters": Wire(read=_stream, args="parameters", drop=("<|python_tag|>",)),
    "function_call_marks": Wire(split=r"<function_call>", none="no_function", unreadable="skip"),
    "name_line": Wire(read=_heading),
    "toolcall_block": Wire(read=_python, cut=r"<TOOLCALL>(.*?)</TOOLCALL>", missing="none"),
    "fenced_code": Wire(read=_python, cut=rf"{FENCE}\n?(.*?)\n?```", missing="text"),
    "open_fence": Wire(read=_python, cut=rf"^\s*{FENCE}(.*?)(?:```\s*)?$", missing="text"),
    "chained_calls": Wire(read=_python, split=r";\s*(?=[A-Za-z_][\w.]*\()"),
    "tool_call_tag": Wire(cut=r"<tool_call>(.*?)(?:</tool_call>|\Z)", every=True, drop=("```json", "```")),
    "thought_then_list": Wire(read=_relaxed, cut=r"(\[.*\]|\{.*\})"),
    "thought_then_code": Wire(read=_python, cut=r"<\|tool_call_start\|>\s*```(?:python)?\n?(.*?)\n?```\s*<\|tool_call_end\|>", missing="none"),
    "after_thinking": Wire(read=_python, cut=r"(?:</think>|\A(?!.*</think>))(.*)\Z"),
    "bracket_tag": Wire(cut=r"\[TOOL_CALLS\]\s*(\[.*\])"),
    "function_tag": Wire(read=_heading, cut=r"<function=([\w.]+>.*?)</function>", every=True),
}


def decode_wire(text: str, wire: str) -> C.Calls:
    return WIRES[wire].decode(text)
