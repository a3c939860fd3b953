"""Function calls written by models: parsed from Python, Java, JavaScript, JSON and XML, without ever running them.

A call is ``{name: {parameter: value}}``. Every parser raises ValueError if a text isn't a list of calls.
"""

from __future__ import annotations

import ast
import json
import keyword
import operator
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass

Calls = list[dict]
KEYWORDS = frozenset(keyword.kwlist)

ARITHMETIC = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv,
    ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow,
}
#: Largest exponent, and largest number of characters or items made by repetition, that constants are folded to.
MAX_POWER, MAX_REPEATED = 1000, 10_000


def fold(node: ast.expr):
    """The value of arithmetic on literals."""
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, complex, str)):
        return node.value
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        value = fold(node.operand)
        return -value if isinstance(node.op, ast.USub) else value
    if isinstance(node, ast.BinOp) and type(node.op) in ARITHMETIC:
        a, b = fold(node.left), fold(node.right)
        if isinstance(a, str) and isinstance(node.op, ast.Mod) or isinstance(node.op, ast.Pow) and abs(b) > MAX_POWER:
            raise ValueError("arithmetic that isn't folded")
        if isinstance(node.op, ast.Mult) and any(isinstance(x, str) for x in (a, b)) and len(str(a)) * len(str(b)) and max((x for x in (a, b) if isinstance(x, int)), default=0) > MAX_REPEATED:
            raise ValueError("arithmetic that isn't folded")
        return ARITHMETIC[type(node.op)](a, b)
    raise ValueError(f"not a constant: {ast.unparse(node)}")


def _value(node: ast.expr):
    match node:
        case ast.Constant(value=v):
            return "..." if v is Ellipsis else v
        case ast.UnaryOp(operand=ast.Constant(value=v)):
            return -v  # whatever the sign
        case ast.List(elts=items):
            return [_value(x) for x in items]
        case ast.Tuple(elts=items):
            return tuple(_value(x) for x in items)
        case ast.Dict(keys=keys, values=values):
            return {_value(k): _value(v) for k, v in zip(keys, values)}
        case ast.BinOp():
            return fold(node)
        case ast.Name(id=name):
            return name
        case ast.Call(keywords=[]) | ast.Subscript():
            return ast.unparse(node)
        case ast.Call():
            return _call(node)
    raise ValueError(f"unsupported value: {ast.unparse(node)}")


def _call(node: ast.Call) -> dict:
    """Positional arguments are left out; a name that isn't a dotted path is the empty one."""
    path, at = [], node.func
    while isinstance(at, ast.Attribute):
        path.append(at.attr)
        at = at.value
    if isinstance(at, ast.Name):
        path.append(at.id)
    return {".".join(path[::-1]): {k.arg: _value(k.value) for k in node.keywords}}


_STRING, _NUMBER = r"'[^'\\\n\r\0]*'|\"[^\"\\\n\r\0]*\"", r"-?(?:0|[1-9][0-9]{0,17})(?:\.[0-9]{1,17})?"
_SCALAR = rf"({_STRING})|({_NUMBER})|(True|False|None)(?![A-Za-z0-9_])"
PLAIN_HEAD = re.compile(r"[ \t]*([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)\(")
PLAIN_ARG = re.compile(rf"[ \t]*([A-Za-z_][A-Za-z0-9_]*)[ \t]*=[ \t]*(?:(?:{_SCALAR})[ \t]*([,)]))?")
PLAIN_VALUE = re.compile(rf"[ \t]*(?:{_SCALAR}|([\[({{]))[ \t]*")
PLAIN_ITEM = re.compile(rf"[ \t]*(?:([\[({{])[ \t]*|(?:{_SCALAR})[ \t]*([,:\])}}]))")
ENDS = {"[": "]", "(": ")", "{": "}"}
BLANK = re.compile(r"[ \t]*")
WORDS = {"True": True, "False": False, "None": None}
#: How deep lists are read without Python's own parser.
MAX_DEPTH = 50


class _NotPlain(Exception):
    """The text holds more than the plain forms: Python's own parser has to read it."""


def _scalar(string: str | None, number: str | None, word: str | None):
    if string is not None:
        return string[1:-1]
    if number is not None:
        return float(number) if "." in number else int(number)
    return WORDS[word]


def _plain_value(text: str, at: int, depth: int = 0) -> tuple[object, int]:
    """A literal of plain texts, numbers, lists, tuples and dicts, and the place behind it and its white space."""
    m = PLAIN_VALUE.match(text, at)
    if not m:
        raise _NotPlain
    string, number, word, opening = m.groups()
    if opening is None:
        return _scalar(string, number, word), m.end()
    return _plain_items(text, m.end(), opening, depth + 1)


def _plain_items(text: str, at: int, opening: str, depth: int) -> tuple[object, int]:
    """What stands behind an opening bracket, up to the closing one."""
    if depth > MAX_DEPTH:
        raise _NotPlain
    closing = ENDS[opening]
    if opening != "(" and text[at : at + 1] == closing:
        return ([] if opening == "[" else {}), BLANK.match(text, at + 1).end()
    items: list = []
    keys: list = []
    match = PLAIN_ITEM.match
    while True:
        m = match(text, at)
        if not m:
            raise _NotPlain
        inner, string, number, word, after = m.groups()
        at = m.end()
        if inner is not None:
            value, at = _plain_items(text, at, inner, depth + 1)
            after = text[at : at + 1]
            at += 1
        elif string is not None:
            value = string[1:-1]
        else:
            value = _scalar(None, number, word)
        if opening == "{" and len(keys) == len(items):
            if after != ":" or inner is not None:
                raise _NotPlain
            keys.append(value)
            continue
        items.append(value)
        if after == closing:
            break
        if after != ",":
            raise _NotPlain
    at = BLANK.match(text, at).end()
    if opening == "[":
        return items, at
    if opening == "{":
        return dict(zip(keys, items)), at
    if len(items) < 2:
        raise _NotPlain
    return tuple(items), at


def _plain_call(text: str, at: int) -> tuple[dict, int]:
    m = PLAIN_HEAD.match(text, at)
    if not m or not KEYWORDS.isdisjoint(m[1].split(".")):
        raise _NotPlain
    args: dict = {}
    at = m.end()
    if text[at : at + 1] == ")":
        return {m[1]: args}, BLANK.match(text, at + 1).end()
    while True:
        a = PLAIN_ARG.match(text, at)
        if not a:
            raise _NotPlain
        name, string, number, word, after = a.groups()
        at = a.end()
        if name in args or name in KEYWORDS:
            raise _NotPlain
        if after is None:
            args[name], at = _plain_value(text, at)
            after = text[at : at + 1]
            at += 1
        else:
            args[name] = _scalar(string, number, word)
        if after == ")":
            return {m[1]: args}, BLANK.match(text, at).end()
        if after != ",":
            raise _NotPlain


def _plain(text: str) -> Calls:
    """Calls of dotted names with literals as arguments, which most texts are: a tenth of the work of a syntax tree.
    What else Python allows raises _NotPlain."""
    if text[:1] in (" ", "\t"):  # an indent
        raise _NotPlain
    if text[:1] != "[":
        call, at = _plain_call(text, 0)
        if at != len(text):
            raise _NotPlain
        return [call]
    out: Calls = []
    at = BLANK.match(text, 1).end()
    if text[at:] == "]":
        return out
    while True:
        call, at = _plain_call(text, at)
        out.append(call)
        c = text[at : at + 1]
        if c == "]" and at + 1 == len(text):
            return out
        if c != ",":
            raise _NotPlain
        at += 1


def literal(text: str):
    """ast.literal_eval, plain values without a syntax tree."""
    try:
        value, at = _plain_value(text, 0)
        if at == len(text):
            return value
    except _NotPlain:
        pass
    return ast.literal_eval(text)


def python(text: str) -> Calls:
    """One call, or a list or tuple of calls, in Python syntax."""
    text = text.strip().strip("'")
    try:
        return _plain(text)
    except _NotPlain:
        return parsed(text)


def parsed(text: str) -> Calls:
    """The same by Python's own parser."""
    try:
        body = ast.parse(text, mode="eval").body
        nodes = [body] if isinstance(body, ast.Call) else body.elts
        if not all(isinstance(n, ast.Call) for n in nodes):
            raise ValueError("a member of the list isn't a call")
        return [_call(n) for n in nodes]
    except ValueError:
        raise
    except (SyntaxError, AttributeError, TypeError, ArithmeticError, RecursionError, MemoryError) as e:
        raise ValueError(str(e)) from e


QUOTED = re.compile(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`", re.S)
#: A pattern between slashes, where a value can begin.
SLASHED = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
NAME = r"[A-Za-z_$][\w$]*"
CALL = re.compile(rf"\s*((?:new\s+)?{NAME}(?:\s*\.\s*{NAME})*)\s*\(")
ASSIGNED = re.compile(rf"\s*({NAME})\s*=(?![=>])")
CLOSERS = {")": "(", "]": "[", "}": "{"}


#: What matters for brackets and commas, with and without generics.
STOPS = {True: re.compile(r"[,()\[\]{}'\"`<]"), False: re.compile(r"[,()\[\]{}'\"`/]")}
GENERICS = re.compile(r"<[\w\s,.?<>\[\]]*>")
BRACKETS = re.compile(r"[()\[\]{}'\"`/]")


def _commas(text: str, generics: bool) -> list[int]:
    """Positions of the commas outside of quotes and brackets; brackets must match."""
    stack: list[str] = []
    out: list[int] = []
    at, find = 0, STOPS[generics].search
    while m := find(text, at):
        at = m.start()
        c = text[at]
        if c in "'\"`":
            m = QUOTED.match(text, at)
            if not m:
                raise ValueError("a quote without an end")
            at = m.end()
            continue
        if c == "/" and (end := _skipped(text, at)) > at:
            at = end
            continue
        if c in "([{":
            stack.append(c)
        elif c in ")]}":
            if not stack or stack.pop() != CLOSERS[c]:
                raise ValueError("brackets don't match")
        elif c == "<":
            if m := GENERICS.match(text, at):
                at = m.end()
                continue
        elif c == "," and not stack:
            out.append(at)
        at += 1
    if stack:
        raise ValueError("brackets don't match")
    return out


def split_top(text: str, generics: bool = False) -> list[str]:
    """``text`` cut at the commas outside of quotes and brackets."""
    cuts = _commas(text, generics)
    parts = [text[a:b] for a, b in zip([0, *(p + 1 for p in cuts)], [*cuts, len(text)])]
    return [p.strip() for p in parts] if text.strip() else []


def _skipped(text: str, at: int) -> int:
    """Where a quoted text or a pattern between slashes that begins here ends; the same place if none does."""
    if text[at] in "'\"`" and (m := QUOTED.match(text, at)):
        return m.end()
    if text[at] == "/":
        before = at - 1
        while before >= 0 and text[before].isspace():
            before -= 1
        if (before < 0 or text[before] in "=,([:") and (m := SLASHED.match(text, at)):
            return m.end()
    return at


def _end_of(text: str, start: int) -> int:
    """Position of the bracket that closes the one at ``start``."""
    depth, at, find = 0, start, BRACKETS.search
    while m := find(text, at):
        at = m.start()
        if (end := _skipped(text, at)) > at:
            at = end
            continue
        depth += (text[at] in "([{") - (text[at] in ")]}")
        if not depth:
            return at
        at += 1
    raise ValueError("brackets don't match")


def _bare(text: str) -> str:
    return "".join(text.split())


def _squeezed(text: str) -> str:
    """Without white space outside of quotes."""
    out, at = [], 0
    for m in QUOTED.finditer(text):
        out += [_bare(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, _bare(text[at:])]) if at else _bare(text)


NEW = re.compile(r"new\s+([\w.]+\s*(?:<[^()]*?>)?)\s*(\(|\[)")
#: What a value has that isn't returned as it is.
SPECIAL = re.compile(r"[\s'\"`(\[{]")


def java_text(value: str, inner: bool = False) -> str:
    """A Java expression in the spelling that the type converters read; quotes around a whole value go."""
    value = value.strip()
    if not SPECIAL.search(value):
        return value
    if value[0] in "'\"`" and QUOTED.fullmatch(value):
        return value if inner else value[1:-1]
    if m := NEW.match(value):
        kind, at = _squeezed(m[1]), m.end() - 1
        if m[2] == "(":
            args = [java_text(a, True) for a in _arguments(value, at, True)[0]]
            return f"new {kind}({', '.join(args)})"
        if "{" in value:
            start = value.index("{", at)
            return f"new {kind}[]{_squeezed(value[start : _end_of(value, start) + 1])}"
    if m := CALL.match(value):
        if _end_of(value, m.end() - 1) == len(value) - 1:
            return value
    return _squeezed(value)


#: Quoted texts, generics without brackets, and single marks, with and without generics.
MARKS = {True: re.compile(rf"{QUOTED.pattern}|<[\w\s,.?<>\[\]]*>|[,()\[\]{{}}'\"`/]", re.S), False: re.compile(rf"{QUOTED.pattern}|[,()\[\]{{}}'\"`/]", re.S)}
OPENERS = {v: k for k, v in CLOSERS.items()}


def _arguments(text: str, start: int, generics: bool, whole: bool = False) -> tuple[list[str], int]:
    """What stands between the bracket at ``start`` and the one that closes it, cut at its commas, and the place of that
    one. ``whole``: the brackets of all the text must match; its first is the one at ``start``.

    One scan, if no slash or bracket has a meaning that depends on what is around it.
    """
    wanted: list[str] = []
    cuts, end = [start], -1
    for m in MARKS[generics].finditer(text, start):
        c = m[0]
        if len(c) > 1:
            if c[0] == "<" and ("[" in c or "]" in c):
                break
        elif c == ",":
            if len(wanted) == 1 and end < 0:
                cuts.append(m.start())
        elif c in OPENERS:
            wanted.append(OPENERS[c])
        elif c in CLOSERS:
            if not wanted or wanted.pop() != c:
                break
            if not wanted and end < 0:
                end = m.start()
                if not whole:
                    break
        else:  # a slash, or a quote without an end
            break
    else:
        whole = whole and bool(wanted)  # read to its end
    if end < 0 or whole:
        return _arguments_by_steps(text, start, generics, whole)
    args = [text[a + 1 : b].strip() for a, b in zip(cuts, [*cuts[1:], end])]
    return (args if len(args) > 1 or args[0] else []), end


def _arguments_by_steps(text: str, start: int, generics: bool, whole: bool) -> tuple[list[str], int]:
    if whole:
        _commas(text, generics)
    end = _end_of(text, start)
    return split_top(text[start + 1 : end], generics), end


def _single_call(text: str, value: Callable[[str], str], bare: Callable[[str], bool], generics: bool) -> Calls:
    text = text.strip().rstrip(";").rstrip()
    m = CALL.match(text)
    if not m or m[1].startswith("new "):
        _commas(text, generics)  # brackets and quotes must match
        raise ValueError("no function call")
    args: dict = {}
    for arg in _arguments(text, m.end() - 1, generics, whole=True)[0]:
        if not arg:
            raise ValueError("an empty argument")
        a = ASSIGNED.match(arg)
        if a:
            key, got = a[1], value(arg[a.end() :])
        elif bare(arg):
            key, got = None, arg
        else:
            continue
        if key in args:
            raise ValueError("two arguments of the same name")
        args[key] = got
    return [{_bare(m[1]): args}]


def java(text: str) -> Calls:
    """A Java method call with named arguments; values stay source text."""
    return _single_call(text, java_text, lambda a: bool(re.fullmatch(NAME, a)) and a not in ("true", "false", "null"), True)


def javascript(text: str) -> Calls:
    """A JavaScript call with named arguments; values stay source text, without quotes around the whole of them."""

    def value(v: str) -> str:
        v = v.strip()
        return v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v

    return _single_call(text, value, lambda a: bool(re.fullmatch(NAME, a)) and a not in ("false", "null", "undefined"), False)


JSON_ARRAY = re.compile(r"\[\s*\{.*?\}\s*(?:,\s*\{.*?\}\s*)*\]", re.S)


def from_json(text: str) -> Calls:
    """``[{"function": name, "parameters": {...}}]`` somewhere in a text; no calls if it isn't JSON."""
    if m := re.search(r"\[.*\]", text, re.S):
        text = m[0]
    if m := JSON_ARRAY.search(text):
        text = m[0]
    try:
        got = json.loads(text)
    except ValueError:
        return []
    try:
        return [{c["function"]: c["parameters"]} for c in got if isinstance(c, dict)]
    except (KeyError, TypeError) as e:
        raise ValueError(f"a call without {e}") from e


#: The type attribute of an XML parameter -> its value; other types are text.
XML_TYPES: dict[str, Callable[[str], object]] = {
    "integer": int, "float": float, "boolean": lambda v: v.lower() == "true", "null": lambda v: None,
    "array": literal, "tuple": literal, "object": literal, "dict": literal,
}


def _xml(text: str, params: Callable[[ET.Element], Iterator[tuple[str, str, str]]]) -> Calls:
    m = re.search(r"<functions>.*?</functions>", text, re.S)
    if not m:
        raise ValueError("no <functions> element")
    try:
        return [{f.attrib["name"]: {n: XML_TYPES.get(t, str)(v) for n, v, t in params(f)}} for f in ET.fromstring(m[0]).findall("function")]
    except (ET.ParseError, KeyError, SyntaxError, TypeError) as e:
        raise ValueError(str(e)) from e


def verbose_xml(text: str) -> Calls:
    """Parameters with name, value and type as attributes, in <params> or right in the <function>."""

    def params(f: ET.Element) -> Iterator[tuple]:
        inside = f.find("params")
        for p in (f if inside is None else inside).findall("param"):
            yield p.attrib.get("name"), p.attrib.get("value", ""), p.attrib.get("type", "string")

    return _xml(text, params)


def concise_xml(text: str) -> Calls:
    """Parameters with their value as text."""
    return _xml(text, lambda f: ((p.attrib["name"], (p.text or "").strip(), p.attrib.get("type", "string")) for p in f.findall("param")))


def tool_call(text: str) -> str:
    """What stands between the tags <TOOLCALL> and </TOOLCALL>."""
    m = re.search(r"<TOOLCALL>(.*?)</TOOLCALL>", text, re.S)
    if not m:
        raise ValueError("no <TOOLCALL>")
    return m[1].strip()


LANGUAGES: dict[str, Callable[[str], Calls]] = {
    "python": python, "java": lambda t: java(t[1:-1]), "javascript": lambda t: javascript(t[1:-1]),
    "json": from_json, "verbose_xml": verbose_xml, "concise_xml": concise_xml,
}


def decode(text: str, language: str = "python", tagged: bool = False) -> Calls:
    """The calls in a model's text; for Java and JavaScript it is in square brackets."""
    return LANGUAGES[language](tool_call(text) if tagged else text)


def bracketed(text: str) -> str:
    """Without back quotes and white space around it, in square brackets."""
    text = text.strip("`\n ")
    return ("" if text.startswith("[") else "[") + text + ("" if text.endswith("]") else "]")


def decode_prompted(text: str, language: str = "python", tagged: bool = False) -> Calls:
    """For models that are asked in the prompt to answer with a list of calls."""
    return decode(bracketed(text), language, tagged)


def decode_any(text: str) -> Calls | None:
    """Python, or else Java, or else JavaScript; None if it is none of them."""
    for parse in (python, java, javascript):
        try:
            if got := parse(text):
                return got
        except ValueError:
            continue
    return None


RAW = json.JSONDecoder().raw_decode


def json_value(text: str):
    """json.loads; a text without white space around it isn't searched for some."""
    try:
        value, end = RAW(text)
        if end == len(text):
            return value
    except ValueError:
        pass
    return json.loads(text)


@dataclass(frozen=True)
class Style:
    """How a family of models marks its calls: pattern of a block, all blocks or the first, keys of name and arguments."""

    pattern: str
    every: bool = True
    name: str = "name"
    args: str = "arguments"
    quotes: bool = False

    def decode(self, text: str) -> Calls:
        blocks = re.findall(self.pattern, text, re.S)
        out: Calls = []
        for block in blocks if self.every else blocks[:1]:
            try:
                got = json_value(block.replace("'", '"') if self.quotes else block)
            except ValueError:
                continue
            for c in got if isinstance(got, list) else [got]:
                if isinstance(c, dict) and self.name in c:
                    args = c.get(self.args, {})
                    out.append({c[self.name]: json_value(args) if isinstance(args, str) else args})
        return out


STYLES = {
    "tool_call_lines": Style(r"<tool_call>\n(.*?)\n</tool_call>"),
    "tool_call_pipes": Style(r"<\|tool_call\|>(.*?)(?:<\|/tool_call\|>|\Z)"),
    "tool_call_rest": Style(r"<(?:\|)?tool_call(?:\|)?>(.*)", every=False),
    "tool_calls_block": Style(r"<tool_calls>\n(.*?)\n</tool_calls>", every=False, quotes=True),
}


def decode_style(text: str, style: str) -> Calls:
    return STYLES[style].decode(text)


def _argument(value) -> str:
    if isinstance(value, dict) and value and all(isinstance(v, dict) for v in value.values()):
        name, args = next(iter(value.items()))
        return f"{name}({', '.join(f'{k}={_argument(v)}' for k, v in args.items())})"
    if isinstance(value, dict) and value:
        return "{" + ", ".join(f"'{k}': {_argument(v)}" for k, v in value.items()) + "}"
    return repr(value)


def to_source(calls: Calls) -> list[str]:
    """Each call as Python source, with keyword arguments."""
    return [f"{name}({', '.join(f'{k}={_argument(v)}' for k, v in args.items())})" for call in calls for name, args in call.items()]


def well_formed(decoded) -> bool:
    """A list of dicts of one name each, with a dict of parameters; an empty list too."""
    return isinstance(decoded, list) and all(isinstance(c, dict) and len(c) == 1 and isinstance(next(iter(c.values())), dict) for c in decoded)


def is_empty(decoded) -> bool:
    """No calls, or nothing that is one."""
    return not well_formed(decoded) or not decoded


ENCODE = json.JSONEncoder(ensure_ascii=False).encode


def dumps(value) -> str:
    """JSON that keeps tuples, and dicts with keys that aren't strings."""
    kind = type(value)
    if kind is str or kind is float:
        return ENCODE(value)
    if kind is int:
        return str(value)
    if value is None or kind is bool:
        return WORDS_JSON[value]
    if isinstance(value, tuple):
        return '{"()": [' + ", ".join(map(dumps, value)) + "]}"
    if isinstance(value, list):
        return "[" + ", ".join(map(dumps, value)) + "]"
    if isinstance(value, dict):
        if all(isinstance(k, str) for k in value) and set(value) not in MARKED:
            return "{" + ", ".join([f"{ENCODE(k)}: {dumps(v)}" for k, v in value.items()]) + "}"
        return '{"{}": [' + ", ".join([f"[{dumps(k)}, {dumps(v)}]" for k, v in value.items()]) + "]}"
    return ENCODE(value if isinstance(value, (str, int, float)) else repr(value))


WORDS_JSON = {True: "true", False: "false", None: "null"}
#: Keys that mark a tuple and a dict of other keys.
MARKED = ({"()"}, {"{}"})


def _untagged(x):
    if isinstance(x, list):
        return [_untagged(v) for v in x]
    if isinstance(x, dict):
        if set(x) == {"()"}:
            return tuple(_untagged(v) for v in x["()"])
        if set(x) == {"{}"}:
            return {_untagged(k): _untagged(v) for k, v in x["{}"]}
        return {k: _untagged(v) for k, v in x.items()}
    return x


def loads(text: str):
    """What dumps() wrote. Only a text that can hold one of its marks is searched for them."""
    got = json.loads(text)
    return _untagged(got) if '"()"' in text or '"{}"' in text or "\\" in text else got
