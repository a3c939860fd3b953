"""Documentation of functions (name, description, parameters as a JSON schema): lint, repair, rendering, schemas."""

from __future__ import annotations

import copy
import json
import keyword
import re
from collections.abc import Iterator

TYPES = ("boolean", "array", "string", "integer", "float", "tuple", "any", "dict")
#: Python types of declared types, for defaults and enumerations.
VALUES = {"boolean": bool, "string": str, "integer": int, "float": float, "array": list, "tuple": tuple, "dict": dict}


def problems(doc) -> Iterator[str]:
    """What is wrong with a function's documentation, in the order of the rules."""
    yield from _keys(doc, ("name", "description", "parameters"), "the function")
    p = doc["parameters"]
    yield from _keys(p, ("type", "properties", "required"), "'parameters'")
    yield from parameter_problems(p["properties"])
    if type(p["required"]) is not list:
        yield "'required' is no list"
    for name in p["required"]:
        if name not in p["properties"]:
            yield f"required parameter {name!r} isn't described"
        elif "default" in p["properties"][name]:
            yield f"required parameter {name!r} has a default"
    for name, spec in p["properties"].items():
        if name not in p["required"] and "default" not in spec:
            yield f"optional parameter {name!r} has no default"


def _keys(x, names: tuple, what: str) -> Iterator[str]:
    if type(x) is not dict:
        yield f"{what} is no dict"
    for n in names:
        if n not in x:
            yield f"{what} has no {n!r}"
    if len(x) != len(names):
        yield f"{what} has other fields than {', '.join(names)}"


def parameter_problems(specs) -> Iterator[str]:
    if type(specs) is not dict:
        yield "'properties' is no dict"
    for name, spec in specs.items():
        if keyword.iskeyword(name):
            yield f"{name!r} is a Python keyword"
        if type(spec) is not dict:
            yield f"{name!r} is no dict"
        for field in ("type", "description"):
            if field not in spec:
                yield f"{name!r} has no {field!r}"
        kind = spec["type"]
        if kind not in TYPES:
            yield f"{name!r} has the unknown type {kind!r}"
        yield from _shape_problems(name, kind, spec)
        if "enum" in spec:
            if type(spec["enum"]) is not list:
                yield f"the enumeration of {name!r} is no list"
            for v in spec["enum"]:
                if type(v) is not VALUES.get(kind):
                    yield f"{v!r} in the enumeration of {name!r} is no {kind}"
        if "default" in spec and kind != "any" and spec["default"] is not None and type(spec["default"]) is not VALUES[kind]:
            yield f"the default of {name!r} is no {kind}"


def _shape_problems(name: str, kind: str, spec: dict) -> Iterator[str]:
    if kind == "dict":
        if "properties" in spec:
            for inner in parameter_problems(spec["properties"]):
                yield f"in {name!r}: {inner}"
            if "items" in spec:
                yield f"{name!r} is a dict and has items"
        elif "additionalProperties" not in spec:
            yield f"{name!r} is a dict without properties or additionalProperties"
        elif type(spec["additionalProperties"]) is not dict or "type" not in spec["additionalProperties"]:
            yield f"additionalProperties of {name!r} have no type"
        return
    if kind in ("array", "tuple"):
        items = spec.get("items")
        if type(items) is not dict or "type" not in items:
            yield f"{name!r} has no items with a type"
        if items["type"] not in TYPES:
            yield f"items of {name!r} have the unknown type {items['type']!r}"
    elif "items" in spec:
        yield f"{name!r} is no array and has items"
    if "properties" in spec:
        yield f"{name!r} is no dict and has properties"


def lint(doc) -> str | None:
    """The first problem, or None."""
    return next(problems(doc), None)


def rename_keywords(params: dict) -> tuple[dict, list[str]]:
    """Parameters that are Python keywords get a leading underscore; which ones did."""
    bad = [n for n in params if keyword.iskeyword(n)]
    return {f"_{n}" if n in bad else n: v for n, v in params.items()}, bad


# --- rendering


def _described(spec: dict) -> str:
    return spec.get("description", "") + (f" Enum values: {spec['enum']}." if "enum" in spec else "")


def to_xml(docs: list[dict]) -> str:
    def kind(spec: dict) -> str:
        outer = spec.get("type", "string")
        if "type" in spec.get("items", {}):
            return f"{outer}[{spec['items']['type']}]"
        return f"{outer}[{spec['additionalProperties'].get('type', 'string')}]" if "additionalProperties" in spec else outer

    def param(name: str, spec: dict, required: list | None, depth: int) -> list[str]:
        pad = "  " * depth
        must = str(required is None or name in required).lower()
        default = f" default=\"{spec['default']!r}\"".replace(",", "") if "default" in spec else ""
        head = f'{pad}<param name="{name}" type="{kind(spec)}" required="{must}"'.replace(",", "")
        lines = [f"{head}{default}>", f"{pad}  <desc>{_described(spec)}</desc>"]
        if "properties" in spec:
            inner = [x for n, s in spec["properties"].items() for x in param(n, s, spec.get("required"), depth + 2)]
            lines += [f"{pad}  <params>", *inner, f"{pad}  </params>"]
        return [*lines, f"{pad}</param>"]

    out = []
    for d in docs:
        p = d["parameters"]
        inner = [x for n, s in p.get("properties", {}).items() for x in param(n, s, p.get("required"), 2)]
        out.append("\n".join([f'<function name="{d["name"]}">', f"  <desc>{d.get('description', '')}</desc>", "  <params>", *inner, "  </params>", "</function>", ""]))
    return "\n".join(out)


PYTHON_NAMES = {"string": "str", "number": "float", "integer": "int", "boolean": "bool"}


def to_python(docs: list[dict]) -> str:
    def kind(spec: dict) -> str:
        t = spec.get("type", "string")
        if t in ("array", "list", "tuple") and "items" in spec:
            return f"list[{kind(spec['items'])}]"
        if t in ("object", "dict"):
            return f"dict[str, {kind(spec['additionalProperties'])}]" if "additionalProperties" in spec else "dict"
        return PYTHON_NAMES.get(t, t)

    def param(name: str, spec: dict, depth: int) -> list[str]:
        default = f", default={spec['default']!r}" if "default" in spec else ""
        line = f"{' ' * (8 + 4 * depth)}{name} ({kind(spec)}{default}): {_described(spec)}\n"
        return [line, *(x for n, s in spec.get("properties", {}).items() for x in param(n, s, depth + 1))]

    parts = []
    for d in docs:
        args = [x for n, s in d.get("parameters", {}).get("properties", {}).items() for x in param(n, s, 0)]
        head = [f"# Function: {d['name']}\n", '    """\n', f"    {d.get('description', '')}\n\n"]
        parts += ["".join([*head, *(["    Args:\n", *args] if args else []), '    """\n']), "\n"]
    return "\n\n".join(parts)


RENDERERS = {"xml": to_xml, "python": to_python, "json": lambda docs: json.dumps(docs, indent=4)}


def render(docs: list[dict], form: str) -> str:
    return RENDERERS[form](docs)


# --- system prompts: fixed texts

OUTPUT_FORMATS = {
    "python": "[func_name1(params_name1=params_value1, params_name2=params_value2...), func_name2(params)]",
    "json": '```json\n[{"function":"func_name1","parameters":{"param1":"value1","param2":"value2"...}},{"function":"func_name2","parameters":{"param":"value"}}]\n```',
    "verbose_xml": '<functions><function name="func_name1"><params><param name="param1" value="value1" type="type1"/><param name="param2" value="value2" type="type2"/>...</params></function><function name="func_name2"><param name="param3" value="value3" type="type3"/></function></functions>',
    "concise_xml": '<functions><function name="func_name1"><param name="param1" type="type1">value1</param><param name="param2" type="type2">value2</param>...</function><function name="func_name2"><param name="param3" type="type3">value</param></function></functions>',
}
XML_TYPES_NOTE = "The type fields of the parameters in your function calls must be one of: string, integer, float, boolean, array, dict, or tuple."
STYLES = {
    "classic": {
        "persona": "You are an expert in composing functions.",
        "task": "You are given a question and a set of possible functions. Based on the question, you will need to make one or more function/tool calls to achieve the purpose. If none of the functions can be used, point it out. If the given question lacks the parameters required by the function, also point it out.",
        "plain": "You should only return the function calls in your response.\n\nIf you decide to invoke any of the function(s), you MUST put it in the format of {output}. {types} You SHOULD NOT include any other text in the response.",
        "tagged": "You should only return the function calls in the <TOOLCALL> section. If you decide to invoke any of the function(s), you MUST put it in the format of <TOOLCALL>{output}</TOOLCALL>. {types} You SHOULD NOT include any other text in the response.",
        "turns": "At each turn, you should try your best to complete the tasks requested by the user within the current turn. Continue to output functions to call until you have fulfilled the user's request to the best of your ability. Once you have no more functions to call, the system will consider the current turn complete and proceed to the next turn or task.",
        "tools": "Here is a list of functions in {form} format that you can invoke.\n{docs}\n",
    },
    "experimental": {
        "persona": "You are an expert in generating structured function calls.",
        "task": "You are given a user query and a set of available functions. Your task is to produce one or more function/tool calls to fulfill the user's request. If no suitable function exists, or required parameters are missing, clearly indicate this.",
        "plain": "Respond with only the function calls.\n\nYou MUST format it exactly as {output}. {types} Do NOT include any other text.",
        "tagged": "Return only the function calls enclosed in <TOOLCALL> tags.\n\nYou MUST format it exactly as <TOOLCALL>{output}</TOOLCALL>. {types} Do NOT include any other text.",
        "turns": "At every turn, aim to complete the user's tasks within that turn. Continue emitting function calls until the request is satisfied to the best of your ability. Once no more calls are needed, the system will proceed to the next turn.",
        "tools": "Below is a list of callable functions in the {form} style:\n{docs}\n",
    },
}
LAYOUTS = {
    "plaintext": "{persona}{task}\n\n{calls}\n\n{turns}\n\n{tools}",
    "markdown": "{persona}\n\n## Task\n{task}\n\n## Tool Call Format\n{calls}\n\n## Multi-turn Behavior\n{turns}\n\n## Available Tools\n{tools}",
}
#: name of the field -> allowed values, in the order in which they stand in a prompt id.
PROMPT_FIELDS = {
    "ret_fmt": ("python", "json", "verbose_xml", "concise_xml"), "tool_call_tag": ("True", "False"), "func_doc_fmt": ("python", "xml", "json"),
    "prompt_fmt": ("plaintext", "markdown"), "style": ("classic", "experimental"),
}
PROMPT_PATTERN = "^" + "&".join(f"{k}=({'|'.join(v)})" for k, v in PROMPT_FIELDS.items()) + "$"


def system_prompt(prompt_id: str, docs: list[dict]) -> str:
    m = re.match(PROMPT_PATTERN, prompt_id)
    if not m:
        raise ValueError(f"no prompt id: {prompt_id!r}")
    returns, tagged, form, layout, style = m.groups()
    s = STYLES[style]
    calls = s["tagged" if tagged == "True" else "plain"].format(output=OUTPUT_FORMATS[returns], types=XML_TYPES_NOTE if "xml" in returns else "")
    return LAYOUTS[layout].format(persona=s["persona"], task=s["task"], calls=calls, turns=s["turns"], tools=s["tools"].format(form=form, docs=render(docs, form)))


# --- hints and schemas

HINTS = {"java": "Java 8 SDK", "javascript": "JavaScript", "python": "Python 3"}
NAMES = {"java": "Java", "javascript": "JavaScript"}


def with_hints(docs: list[dict], language: str) -> list[dict]:
    """Descriptions that say which language is meant; parameters of Java and JavaScript become strings."""
    docs = copy.deepcopy(docs)
    for d in docs:
        d["description"] += f" Note that the provided function is in {HINTS[language]} syntax."
        if language == "python":
            continue
        for spec in d["parameters"]["properties"].values():
            kind, name = spec["type"], NAMES[language]
            spec["description"] += f" This parameter can be of any type of {name} object in string representation." if kind == "any" else f" This is {name} {kind} type parameter in string representation."
            if kind in (("ArrayList", "Array") if language == "java" else ("array",)):
                spec["description"] += f" The list elements are of type {spec.pop('items')['type']}; they are not in string representation."
            if language == "javascript" and kind == "dict" and "properties" in spec:
                spec["description"] += f" The dictionary entries have the following schema; they are not in string representation. {json.dumps(spec.pop('properties'))}"
            spec["type"] = "string"
    return docs


#: Declared types -> JSON schema types.
OPENAPI = {
    "integer": "integer", "number": "number", "float": "number", "string": "string", "boolean": "boolean", "bool": "boolean", "array": "array", "list": "array",
    "dict": "object", "object": "object", "tuple": "array", "any": "string", "byte": "integer", "short": "integer", "long": "integer", "double": "number",
    "char": "string", "ArrayList": "array", "Array": "array", "HashMap": "object", "Hashtable": "object", "Queue": "array", "Stack": "array", "Any": "string",
    "String": "string", "Bigint": "integer",
}


def open_types(specs: dict) -> dict:
    """Parameters with JSON schema types, in all levels that a schema may have."""

    def one(spec: dict) -> dict:
        spec = dict(spec)
        declared = spec.get("type")
        if declared == "float":
            spec |= {"format": "float", "description": spec.get("description", "") + " This is a float type value."}
        spec["type"] = OPENAPI.get(declared, "string")
        if spec["type"] in ("array", "object"):
            if "properties" in spec:
                spec["properties"] = open_types(spec["properties"])
            elif "items" in spec:
                spec["items"] = items(spec["items"])
        return spec

    def items(inner: dict) -> dict:
        inner = inner | {"type": OPENAPI[inner["type"]]}
        if inner["type"] == "array" and "items" in inner:
            inner["items"] = inner["items"] | {"type": OPENAPI[inner["items"]["type"]]}
        elif inner["type"] == "object" and "properties" in inner:
            inner["properties"] = open_types(inner["properties"])
        return inner

    return {n: one(s) for n, s in specs.items()}


#: Kinds of providers: can't take dots in names; take no response schema; take few schema fields.
NO_DOTS = {"openai", "openai_responses", "mistral", "google", "oss", "anthropic", "cohere", "amazon", "novita"}
NO_RESPONSE = {"anthropic", "google", "fireworks", "writer", "amazon", "novita"}
FEW_FIELDS = {"google", "writer"}
#: Schema fields that go into the description instead, and how they are called there.
TOLD = {"default": "Default is", "optional": "Optional", "required": "Required", "maximum": "Maximum value", "minItems": "Minimum number of items", "maxItems": "Maximum number of items", "additionalProperties": "Additional properties"}


def tool(doc: dict, provider: str) -> dict:
    """The documentation as a provider's tool definition."""
    d = copy.deepcopy(doc)
    if provider in NO_DOTS:
        d["name"] = d["name"].replace(".", "_")
    params = d["parameters"] | {"type": "object", "properties": open_types(d["parameters"]["properties"])}
    if provider in FEW_FIELDS:
        params.pop("optional", None)
        for spec in params["properties"].values():
            _tell(spec, provider)
    d["parameters"] = params
    if "response" in d and provider in NO_RESPONSE:
        d["description"] += f" The response field has the following schema: {json.dumps(d.pop('response'))}"
    if provider == "anthropic":
        return {k: v for k, v in d.items() if k != "parameters"} | {"input_schema": params}
    if provider == "amazon":
        return {"toolSpec": {k: v for k, v in d.items() if k != "parameters"} | {"inputSchema": {"json": params}}}
    if provider in ("google", "oss"):
        return d
    if provider == "openai_responses":
        return {"type": "function", **{k: d[k] for k in ("name", "description", "parameters")}}
    return {"type": "function", "function": d}


def _tell(spec: dict, provider: str) -> None:
    text = spec.get("description", "")
    for field, said in TOLD.items():
        if field in spec:
            text += f" {said}: {spec.pop(field)}."
    if "enum" in spec and (provider == "writer" or spec["type"] != "string"):
        text += f" Enum values: {spec.pop('enum')}."
    if "format" in spec and spec["type"] == "string":
        text += f" Format: {spec.pop('format')}."
    spec["description"] = text


# --- docstrings

DOCSTRING_TYPES = {"str": "string", "int": "integer", "float": "float", "bool": "boolean", "any": "any", "dict": "dict", "list": "array", "tuple": "tuple"}
ENTRY = re.compile(r"(-?)\s*(\w+)\s*\(([^)]+)\):\s*(.+)")


def type_of(text: str) -> dict:
    """The schema of a type annotation."""
    if m := re.fullmatch(r"Optional\[(.+)\]", text):
        text = m[1]
    if m := re.fullmatch(r"Union\[(.+)\]", text):
        kinds = [t for t in m[1].split(", ") if t not in ("NoneType", "None")]
        return type_of(kinds[0]) if len(kinds) == 1 else {"type": "any"}
    if m := re.match(r"[Ll]ist\[(.+)\]", text):
        return {"type": "array", "items": type_of(m[1])}
    if m := re.match(r"[Tt]uple\[(.+)\]", text):
        return {"type": "array", "items": [type_of(t.strip()) for t in m[1].split(",")]}
    if m := re.match(r"[Dd]ict\[(.+),\s*(.+)\]", text):
        return {"type": "dict", "additionalProperties": type_of(m[2])}
    return {"type": DOCSTRING_TYPES.get(text.lower(), "any")}


def from_docstring(name: str, docstring: str, required: list[str] | None = None) -> dict:
    """The documentation of a function from its docstring with the sections Args and Returns.

    A line ``name (type): text`` opens an entry, ``- name (type): text`` one inside the last dict, and any other line
    goes on with the entry before. Entries of Returns are nested by their indentation, four spaces a level.
    """
    section, head, params, returns = "", [], {}, {}
    parent: dict | None = None
    levels: list[tuple[int, dict]] = []
    for line in docstring.strip().split("\n"):
        bare = line.strip()
        if bare.startswith(("Args:", "Returns:")):
            section = bare.split(":")[0]
        elif not section:
            head.append(bare)
        elif section == "Args":
            m = ENTRY.match(bare)
            if m and not (m[1] and parent is None):
                spec = type_of(m[3]) | {"description": re.sub(r"\[(?:Required|Optional)\]", "", m[4]).strip()}
                if m[1]:
                    parent["properties"][m[2]] = spec
                    continue
                params[m[2]] = spec
                if spec["type"] == "dict":
                    spec["properties"] = {}
                    parent = spec
            elif params:
                list(params.values())[-1]["description"] += f" {bare}"
        elif bare:
            _returned(returns, levels, line, bare)
    return {
        "name": name,
        "description": " ".join(head).strip(),
        "parameters": {"type": "dict", "properties": params, "required": list(params) if required is None else required},
        "response": {"type": "dict", "properties": returns},
    }


def _returned(returns: dict, levels: list, line: str, bare: str) -> None:
    m = ENTRY.match(bare)
    if not m:
        at = levels[-1][1] if levels else returns
        at["description"] = f"{at['description']} {bare}" if "description" in at else bare
        return
    spec = {k: v for k, v in type_of(m[3]).items() if k in ("type", "items", "properties", "additionalProperties")} | {"description": m[4].strip()}
    indent = len(line.rstrip()) - len(line.strip())
    depth = (indent - levels[0][0]) // 4 if levels else 0
    del levels[max(depth, 0) :]
    if levels:
        parent = levels[-1][1]
        holder = parent.setdefault("items", {}) if parent.get("type") == "array" else parent
        holder.setdefault("properties", {})[m[2]] = spec
    else:
        returns[m[2]] = spec
    levels.append((indent, spec))
