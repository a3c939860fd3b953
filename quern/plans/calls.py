"""Decoders, converters and checks of calls; the calls are written from ``events``, so SQL knows what must come out."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from quern.functions import literals
from quern.operators import decoding as D
from quern.operators.joins import bag_contains, is_subsequence
from quern.plans.registry import query
from quern.session import spread

K = "CAST(props->>'k' AS BIGINT)"


def told(t, template: str, *more):
    """events with ``text``: the template with {e} event type, {u} user, {k} and {v} filled in."""
    return spread(t.events).select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), text_of(template).alias("text"), *more)


def text_of(template: str):
    """A template of filled() as a column of events."""
    parts, fill = [], {"e": F.col("event_type"), "u": F.col("user_id").cast("string"), "k": F.get_json_object("props", "$.k"), "i": F.col("event_id").cast("string")}
    for piece in template.split("\x00"):
        parts.append(fill[piece] if piece in fill else F.lit(piece))
    return F.concat(*parts)


def filled(template: str) -> str:
    """``{e}`` and the like as the pieces that told() fills in."""
    for name in "euki":
        template = template.replace("<" + name + ">", f"\x00{name}\x00")
    return template


def shown(df, calls):
    """One row per decoded call: name and arguments as JSON text, in the order of their names."""
    x = df.select("event_id", F.posexplode(calls["calls"]).alias("pos", "c"))
    args = F.array_join(F.transform(F.array_sort(F.map_entries("c.args")), lambda a: F.concat(a["key"], F.lit("="), a["value"])), "; ")
    return x.select("event_id", F.col("pos").cast("long").alias("pos"), F.col("c.name").alias("name"), args.alias("args"))


@query("dec_python", f"SELECT event_id, pos, name, args FROM (SELECT event_id, unnest([0, 1]) AS pos, unnest(['api.' || event_type, 'log']) AS name, unnest(['neg=' || (0 - {K}) || '; of={{\"get\": {{\"k\": ' || {K} || '}}}}; sum=' || (2 * {K} + 1) || '; tags=[\"a\", \"' || event_type || '\"]; user=' || user_id, 'at={{\"()\": [1, 2.5]}}; ok=true']) AS args FROM events)")
def dec_python(t):
    x = told(t, filled("[api.<e>(user=<u>, neg=-<k>, sum=<k>*2+1, tags=['a', '<e>'], of=get(k=<k>)), log(7, at=(1, 2.5), ok=True)]"))
    return shown(x, D.decoded(F.col("text")))


@query("dec_default", "SELECT event_id, 0::BIGINT AS pos, event_type AS name, 'x=' || user_id AS args FROM events")
def dec_default(t):
    return shown(told(t, filled("```\n<e>(x=<u>)\n```")), D.decoded(F.col("text"), prompted=True))


@query("dec_java", "SELECT event_id, 0::BIGINT AS pos, 'Db.' || event_type AS name, 'ids=\"new int[]{' || user_id || ',2}\"; items=\"new ArrayList<String>(Arrays.asList(\\\"a\\\", \\\"b, c\\\"))\"; size=\"' || user_id || 'L\"; title=\"' || event_type || ' (x)\"' AS args FROM events")
def dec_java(t):
    x = told(t, filled('[Db.<e>(title="<e> (x)", size=<u>L, ids=new int[] { <u>, 2 }, items=new ArrayList<String>(Arrays.asList("a", "b, c")))]'))
    return shown(x, D.decoded(F.col("text"), "java"))


@query("dec_js", "SELECT event_id, 0::BIGINT AS pos, 'app.' || event_type AS name, 'big=\"' || user_id || 'n\"; o=\"{a: [1, 2], b: ''x''}\"; s=\"it, is\"' AS args FROM events")
def dec_js(t):
    return shown(told(t, filled("[app.<e>(s='it, is', o={a: [1, 2], b: 'x'}, big=<u>n)]")), D.decoded(F.col("text"), "javascript"))


#: Expressions that hold commas, brackets and quotes of their own, and their text as an argument (SQL): what an event makes of them.
JAVA_VALUES = (
    ("new HashMap<String, List<Map<Integer, <e>>>>(<u>, <k>)", "'new HashMap<String,List<Map<Integer,' || event_type || '>>>(' || user_id || ', ' || {K} || ')'"),
    ("(a, b) -> a.<e>(<u>, b)", "'(a,b)->a.' || event_type || '(' || user_id || ',b)'"),
    ('builder.append("<e>, (<u>").build( <k> )', "'builder.append(\"' || event_type || ', (' || user_id || '\").build(' || {K} || ')'"),
    ("new <e>[] { <u>, <k> }", "'new ' || event_type || '[]{{' || user_id || ',' || {K} || '}}'"),
    ("<u> + <k> * 2", "user_id || '+' || {K} || '*2'"),
    ('List.<String>of("<e> ]", 1)', "'List.<String>of(\"' || event_type || ' ]\",1)'"),
    ("flag && !items.contains(<u>)", "'flag&&!items.contains(' || user_id || ')'"),
)
JS_VALUES = (
    ("`<e>, ${g(<u>, 'b')} y`", "'`' || event_type || ', ${{g(' || user_id || ', ''b'')}} y`'"),
    ("(e, i) => { return [<u>, <k>]; }", "'(e, i) => {{ return [' || user_id || ', ' || {K} || ']; }}'"),
    ("{k: [<u>, {m: '}<e>'}], n: <k>}", "'{{k: [' || user_id || ', {{m: ''}}' || event_type || '''}}], n: ' || {K} || '}}'"),
    ("new Map([[<u>, '<e>'], [<k>, 2]])", "'new Map([[' || user_id || ', ''' || event_type || '''], [' || {K} || ', 2]])'"),
    ("/<e>,[(,/]<u>/gi", "'/' || event_type || ',[(,/]' || user_id || '/gi'"),
    ("async () => await x(<u>, <k>)", "'async () => await x(' || user_id || ', ' || {K} || ')'"),
    ("a?.<e>(<u>) ?? b[<k>]", "'a?.' || event_type || '(' || user_id || ') ?? b[' || {K} || ']'"),
)


def values_sql(values) -> str:
    return " UNION ALL ".join(f"SELECT event_id, {n}::BIGINT AS n, 'm.' || event_type AS name, {want.format(K=K)} AS v, event_type || '; )' AS w FROM events" for n, (_, want) in enumerate(values))


def decoded_values(t, values, language: str):
    """A call with each expression between two plain arguments."""
    cases = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), text_of(filled(f'[m.<e>(first=1, v={v}, w="<e>; )")]')).alias("text")) for n, (v, _) in enumerate(values)])
    x = spread(t.events).select("event_id", F.explode(cases).alias("c")).select("event_id", "c.*").withColumn("d", D.decoded(F.col("text"), language))
    call = F.get("d.calls", F.lit(0))
    text = lambda name: F.from_json(F.concat(F.lit('{"x": '), call["args"][name], F.lit("}")), "x string")["x"]
    return x.select("event_id", "n", call["name"].alias("name"), text("v").alias("v"), text("w").alias("w"))


@query("dec_java_values", values_sql(JAVA_VALUES))
def dec_java_values(t):
    return decoded_values(t, JAVA_VALUES, "java")


@query("dec_js_values", values_sql(JS_VALUES))
def dec_js_values(t):
    return decoded_values(t, JS_VALUES, "javascript")


@query("dec_json", f"SELECT event_id, 0::BIGINT AS pos, event_type AS name, 'a=' || user_id || '; b=[' || {K} || ', null]' AS args FROM events WHERE user_id % 3 <> 0")
def dec_json(t):
    good = told(t, filled('so: ```json\n[{"function": "<e>", "parameters": {"a": <u>, "b": [<k>, null]}}]\n```'))
    bad = told(t, filled('[{"function": "<e>", "parameters": {"a": }}]'))
    x = good.filter("user_id % 3 <> 0").unionByName(bad.filter("user_id % 3 = 0"))
    return shown(x, D.decoded(F.col("text"), "json"))


XML_ARGS = f"'f=' || {K} || '.5; n=' || user_id || '; on=true; s=\"' || event_type || '\"; t={{\"()\": [1, 2]}}'"


@query("dec_xml_v", f"SELECT event_id, 0::BIGINT AS pos, event_type AS name, {XML_ARGS} AS args FROM events")
def dec_xml_v(t):
    p = '<param name="n" value="<u>" type="integer"/><param name="s" value="<e>"/><param name="f" value="<k>.5" type="float"/><param name="on" value="True" type="boolean"/><param name="t" value="(1, 2)" type="tuple"/>'
    return shown(told(t, filled(f'ok <functions><function name="<e>"><params>{p}</params></function></functions>')), D.decoded(F.col("text"), "verbose_xml"))


@query("dec_xml_c", f"SELECT event_id, 0::BIGINT AS pos, event_type AS name, {XML_ARGS} AS args FROM events")
def dec_xml_c(t):
    p = '<param name="n" type="integer"> <u> </param><param name="s"><e></param><param name="f" type="float"><k>.5</param><param name="on" type="boolean">true</param><param name="t" type="tuple">(1, 2)</param>'
    return shown(told(t, filled(f'<functions><function name="<e>">{p}</function></functions>')), D.decoded(F.col("text"), "concise_xml"))


@query("dec_any", "SELECT event_id, 0::BIGINT AS pos, event_type AS name, CASE user_id % 3 WHEN 0 THEN 'a=' || user_id WHEN 1 THEN 'a=\"new int[]{1}\"' ELSE 'a=\"[`x`]\"' END AS args FROM events")
def dec_any(t):
    u = F.col("user_id") % 3
    x = told(t, filled("<e>(a=<u>)")).filter(u == 0).unionByName(told(t, filled("<e>(a=new int[]{1})")).filter(u == 1)).unionByName(told(t, filled("<e>(a=[`x`])")).filter(u == 2))
    return shown(x, D.decoded_any(F.col("text")))


@query("dec_toolcall", "SELECT event_id, user_id % 2 = 0 AS ok, CASE WHEN user_id % 2 = 0 THEN event_type END AS name FROM events")
def dec_toolcall(t):
    x = told(t, filled("sure <TOOLCALL>[<e>(x=1)]</TOOLCALL>")).filter("user_id % 2 = 0").unionByName(told(t, filled("[<e>(x=1)]")).filter("user_id % 2 <> 0"))
    c = D.decoded(F.col("text"), tagged=True)
    return x.select("event_id", c.alias("c")).select("event_id", F.col("c.ok").alias("ok"), F.get("c.calls", F.lit(0))["name"].alias("name"))


WIRE_TEXTS = {
    "map_of_json_text": '[{"<e>": <quoted>}]', "map_of_arguments": "[{'<e>': <python>}]", "nested_function": '[{"type": "function", "function": {"name": "<e>", "arguments": <quoted>}}]',
    "tool_name_parameters": '[{"tool_name": "<e>", "parameters": <json>}]', "name_arguments": '{"name": "<e>", "arguments": <json>}', "name_arguments_or_nothing": '```[{"name": "<e>", "arguments": <json>}]```',
    "objects_by_semicolon": '{"name": "<e>", "arguments": <json>}; {"name": "second", "arguments": {}}', "tagged_parameters": "<|python_tag|>[{'name': '<e>', 'parameters': <python>}]",
    "tagged_json_parameters": '<|python_tag|>{"name": "<e>", "parameters": <json>};{"name": "second", "parameters": {}}', "function_call_marks": '<function_call> {"name": "<e>", "arguments": <json>} <function_call> {"name": "no_function"} <function_call> sorry',
    "name_line": "<e>\n<json>", "toolcall_block": "so <TOOLCALL>[<e>(<plain>)]</TOOLCALL>", "fenced_code": "here:\n```tool_code\n[<e>(<plain>)]\n```", "open_fence": "```json\n[<e>(<plain>)]", "chained_calls": "<e>(<plain>); second()",
    "tool_call_tag": 'x <tool_call>```json\n[{"name": "<e>", "arguments": <json>}]```</tool_call> y <tool_call>{"name": "second", "arguments": {}}', "thought_then_list": "I'd call [{'name': '<e>', 'arguments': <json>}] now",
    "thought_then_code": "<|thought_start|>no(x=1)<|thought_end|><|tool_call_start|>\n```python\n<e>(<plain>)\n```\n<|tool_call_end|>", "after_thinking": "<think>no(x=1)</think>\n[<e>(<plain>), second()]",
    "bracket_tag": '[TOOL_CALLS] [{"name": "<e>", "arguments": <json>}]', "function_tag": "<function=<e>><json></function> <function=second>{}</function>", "not_json": "name_arguments",
}


@query("dec_wires", f"""SELECT event_id, wire, unnest(CASE WHEN wire = 'not_json' THEN [NULL] WHEN wire IN ({", ".join(repr(k) for k, v in WIRE_TEXTS.items() if "second" in v)}) THEN [event_type, 'second'] ELSE [event_type] END) AS name,
unnest(CASE WHEN wire = 'not_json' THEN [NULL] ELSE ['a=' || user_id || '; l=[' || {K} || ', null, {{"x": [' || event_id || ']}}]; s="' || event_type || '; {{x, é"'] || CASE WHEN wire IN ({", ".join(repr(k) for k, v in WIRE_TEXTS.items() if "second" in v)}) THEN [''] ELSE [] END END) AS args
FROM events, (SELECT unnest([{", ".join(map(repr, WIRE_TEXTS))}]) AS wire)""")
def dec_wires(t):
    """Arguments are made of the event: numbers, a text with marks that formats use, a list with null and an object."""
    e, u, k, i = F.col("event_type"), F.col("user_id").cast("string"), F.get_json_object("props", "$.k"), F.col("event_id").cast("string")
    text = F.concat(e, F.lit("; {x, é"))
    as_json = F.concat(F.lit('{"a": '), u, F.lit(', "l": ['), k, F.lit(', null, {"x": ['), i, F.lit(']}], "s": "'), text, F.lit('"}'))
    as_python = F.concat(F.lit("{'a': "), u, F.lit(", 'l': ["), k, F.lit(", None, {'x': ["), i, F.lit("]}], 's': '"), text, F.lit("'}"))
    plain = F.concat(F.lit("a="), u, F.lit(", l=["), k, F.lit(", None, {'x': ["), i, F.lit("]}], s='"), text, F.lit("'"))
    quoted = F.concat(F.lit('"'), F.replace(as_json, F.lit('"'), F.lit('\\"')), F.lit('"'))
    holes = {"<e>": e, "<json>": as_json, "<python>": as_python, "<plain>": plain, "<quoted>": quoted}

    def fill(template: str):
        pieces = re.split("(" + "|".join(holes) + ")", template)
        return F.concat(*[holes.get(p, F.lit(p)) for p in pieces])

    cases = F.array(*[F.struct(F.lit(w).alias("wire"), fill(x).alias("text")) for w, x in WIRE_TEXTS.items()])
    x = spread(t.events).select("event_id", F.explode(cases).alias("c")).select("event_id", "c.*")
    x = x.withColumn("d", D.decoded_wire(F.col("text"), F.when(F.col("wire") == "not_json", "name_arguments").otherwise(F.col("wire"))))
    calls = F.when(F.col("d.ok"), F.col("d.calls")).otherwise(F.array(F.lit(None)))
    args = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c["args"])), lambda a: F.concat(a["key"], F.lit("="), a["value"])), "; ")
    return x.select("event_id", "wire", F.explode(calls).alias("c")).select("event_id", "wire", F.col("c.name").alias("name"), args(F.col("c")).alias("args"))


@query("dec_vendor", "SELECT event_id, style, unnest(CASE WHEN style IN ('tool_call_lines', 'tool_call_pipes') THEN [event_type, 'second'] ELSE [event_type] END) AS name FROM events, (VALUES ('tool_call_lines'), ('tool_call_pipes'), ('tool_call_rest'), ('tool_calls_block')) v(style)")
def dec_vendor(t):
    one, two = '{"name": "<e>", "arguments": {"a": <u>}}', '{"name": "second", "arguments": {}}'
    texts = {
        "tool_call_lines": f"<tool_call>\n{one}\n</tool_call> and <tool_call>\n{two}\n</tool_call>", "tool_call_pipes": f"<|tool_call|>[{one}]<|/tool_call|><|tool_call|>{two}",
        "tool_call_rest": f"<tool_call>[{one}]", "tool_calls_block": "<tool_calls>\n[" + one.replace('"', "'") + "]\n</tool_calls>",
    }
    named = lambda style, text: F.transform(D.decoded_style(text_of(filled(text)), style)["calls"], lambda c: F.struct(F.lit(style).alias("style"), c["name"].alias("name")))
    x = spread(t.events).select("event_id", F.explode(F.concat(*[named(style, text) for style, text in texts.items()])).alias("c"))
    return x.select("event_id", "c.*")


@query("txt_calls", f"SELECT event_id, [event_type || '(a=' || user_id || ', b=''x y'', c={{''k'': ' || {K} || '}}, d=g(h=[1, ''z'']))', 'stop()'] AS source FROM events")
def txt_calls(t):
    return told(t, filled("[<e>(a=<u>, b='x y', c={'k': <k>}, d=g(h=[1,'z'])), stop()]")).select("event_id", D.source_of(F.col("text")).alias("source"))


JAVA_CASES = (
    ("integer", None, "<u>", "user_id::VARCHAR"), ("long", None, "<u>L", "user_id::VARCHAR"), ("double", None, "<k>.5", f"{K} || '.5'"), ("float", None, "<k>.5f", f"{K} || '.5'"), ("boolean", None, "true", "'true'"),
    ("integer", None, "<u>x", "'\"' || user_id || 'x\"'"), ("any", None, "<e>", "'\"' || event_type || '\"'"), ("Array", "integer", "new int[]{<u>, 2}", "'[' || user_id || ', 2]'"), ("ArrayList", "String", 'new ArrayList<>(Arrays.asList("<e>", "b"))', "'[\"' || event_type || '\", \"b\"]'"),
    ("HashMap", None, 'new HashMap<String, Integer>() {{ put("<e>", <u>); }}', "'{\"' || event_type || '\": ' || user_id || '}'"), ("Array", None, "new int[]{}", "'[]'"),
)
JS_CASES = (
    ("integer", None, "<u>", "user_id::VARCHAR"), ("Bigint", None, "<u>n", "user_id::VARCHAR"), ("float", None, "<k>.5", f"{K} || '.5'"), ("Boolean", None, "false", "'false'"), ("String", None, "'<e>'", "'\"' || event_type || '\"'"), ("integer", None, "<e>", "'\"' || event_type || '\"'"),
    ("array", "integer", "[<u>, 2]", "'[' || user_id || ', 2]'"), ("array", None, "[[<u>, 2], [3]]", "'[[' || user_id || ', 2], [3]]'"), ("dict", None, "{a: <u>, b: '<e>'}", "'{\"a\": ' || user_id || ', \"b\": \"' || event_type || '\"}'"), ("array", None, "[]", "'[]'"),
)


def cases_sql(cases) -> str:
    return " UNION ALL ".join(f"SELECT event_id, {n} AS n, {want} AS value FROM events" for n, (_, _, _, want) in enumerate(cases))


def converted(t, cases, convert):
    out = None
    for n, (kind, nested, template, _) in enumerate(cases):
        x = told(t, filled(template)).select("event_id", F.lit(n).alias("n"), D.converted(F.col("text"), convert, kind, nested).alias("value"))
        out = x if out is None else out.unionByName(x)
    return out


@query("cnv_java", cases_sql(JAVA_CASES))
def cnv_java(t):
    return converted(t, JAVA_CASES, literals.java)


@query("cnv_js", cases_sql(JS_CASES))
def cnv_js(t):
    return converted(t, JS_CASES, literals.javascript)


@query("std_ast", "SELECT doc_id, md5(replace(lower(regexp_replace(text, '[ ,./_*^-]', '', 'g')), '''', '\"')) AS digest FROM documents")
def std_ast(t):
    return t.documents.select("doc_id", F.md5(D.standard(F.col("text"))).alias("digest"))


@query("std_agentic", "SELECT doc_id, md5(replace(lower(regexp_replace(text, '[,./_*^()-]', '', 'g')), '''', '\"')) AS digest FROM documents")
def std_agentic(t):
    return t.documents.select("doc_id", F.md5(D.standard_agentic(F.col("text"))).alias("digest"))


def verdicts(df, verdict, *keys):
    return df.select(*keys, verdict.alias("v")).select(*keys, F.col("v.valid").alias("valid"), F.col("v.error_type").alias("error_type"))


def json_of(value) -> str:
    return filled(json.dumps(value))


@query("chk_string", "SELECT event_id, event_type IN ('click', 'view') AS valid, CASE WHEN event_type IN ('click', 'view') THEN '' ELSE 'value_error:string' END AS error_type FROM events")
def chk_string(t):
    x = told(t, '"' + filled("<e>").upper().replace("\x00E\x00", "\x00e\x00") + ',"')
    return verdicts(x, D.checked_value("string", F.col("text"), F.lit('["Click", "vi-ew", ""]')), "event_id")


@query("chk_list", "SELECT event_id, user_id % 4 = 0 AS valid, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'value_error:list/tuple' END AS error_type FROM events")
def chk_list(t):
    x = told(t, filled('["A b", <u>]'), F.concat(F.lit('[["ab", '), ((F.col("user_id") / 4).cast("long") * 4).cast("string"), F.lit("], [1]]")).alias("allowed"))
    return verdicts(x, D.checked_value("list", F.col("text"), F.col("allowed")), "event_id")


DICT_CASES = "CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN 'value_error:dict_key' WHEN 'error' THEN 'value_error:dict_value' WHEN 'signup' THEN '' ELSE 'value_error:dict_key' END"
DICT_VALUES = {"click": '{"a": "X y", "n": 1}', "view": '{"a": "xy", "z": 1}', "error": '{"a": "other", "n": 1}', "signup": '{"a": "xy"}', "purchase": '{"n": 1}'}


def dict_values():
    return F.create_map(*[F.lit(x) for kv in DICT_VALUES.items() for x in kv])[F.col("event_type")]


@query("chk_dict", f"SELECT event_id, {DICT_CASES} = '' AS valid, {DICT_CASES} AS error_type FROM events")
def chk_dict(t):
    x = t.events.select("event_id", dict_values().alias("text"))
    return verdicts(x, D.checked_value("dict", F.col("text"), F.lit('["", {"a": ["xy"], "n": [1, ""]}]')), "event_id")


LIST_DICT_CASES = f"CASE WHEN user_id % 2 = 0 THEN 'value_error:list_dict_count' ELSE {DICT_CASES} END"


@query("chk_listdict", f"SELECT event_id, {LIST_DICT_CASES} = '' AS valid, {LIST_DICT_CASES} AS error_type FROM events")
def chk_listdict(t):
    many = F.when(F.col("user_id") % 2 == 0, F.lit("")).otherwise(F.lit(', {"q": 2}'))
    x = t.events.select("event_id", F.concat(F.lit("["), dict_values(), many, F.lit("]")).alias("text"))
    return verdicts(x, D.checked_value("list_dict", F.col("text"), F.lit('[[{"a": ["xy"], "n": [1, ""]}, {"q": [2]}]]')), "event_id")


DOCS = [
    {"name": "api.find", "description": "", "parameters": {"type": "dict", "required": ["user"], "properties": {"user": {"type": "integer"}, "rate": {"type": "float"}, "tags": {"type": "array", "items": {"type": "string"}}, "how": {"type": "string"}, "ok": {"type": "boolean"}}}},
    {"name": "stop", "description": "", "parameters": {"type": "dict", "required": [], "properties": {"n": {"type": "integer"}}}},
]
TRUTH = '[{"api.find": {"user": [<u>], "rate": [1.0, ""], "tags": [["x", "y z"], ""], "how": ["<e>", ""], "ok": [true, ""]}}]'
#: what the model wrote -> error type
SIMPLE = {
    "[api.find(user=<u>, rate=1, tags=['X', 'y-z'], how='<e>!'.replace)]": "ast_decoder:decoder_failed",
    "[api.find(user=<u>, rate=1, tags=['X', 'y-z'], how='-<e>', ok=True)]": "",
    "[find(user=<u>)]": "simple_function_checker:wrong_func_name",
    "[api.find(rate=1.0)]": "simple_function_checker:missing_required",
    "[api.find(user=<u>, x=1)]": "simple_function_checker:unexpected_param",
    "[api.find(user='<u>')]": "type_error:simple",
    "[api.find(user=<u>, ok=1)]": "type_error:simple",
    "[api.find(user=<u>, tags=[1])]": "value_error:list/tuple",
    "[api.find(user=<u>, tags=['q'])]": "value_error:list/tuple",
    "[api.find(user=<u>, how='none')]": "value_error:string",
    "[api.find(user=<u>, rate=2.5)]": "value_error:others",
    "[api.find(user=<u>), stop()]": "simple_function_checker:wrong_count",
}


def case_sql(cases: dict) -> str:
    return " UNION ALL ".join(f"SELECT event_id, {n} AS n, '{want}' = '' AS valid, '{want}' AS error_type FROM events" for n, want in enumerate(cases.values()))


def checked(t, cases: dict, category: str, truth: str = TRUTH, **how):
    """All cases of an event in one row, then one row each: events are read once and nothing is joined."""
    texts = F.array(*[F.struct(F.lit(n).alias("n"), text_of(filled(text)).alias("text")) for n, text in enumerate(cases)])
    x = spread(t.events).select("event_id", text_of(filled(truth)).alias("truth"), F.explode(texts).alias("c")).select("event_id", "truth", "c.*")
    return verdicts(x, D.checked(F.col("text"), F.lit(json.dumps(DOCS)), F.col("truth"), F.lit(category), **how), "event_id", "n")


@query("chk_simple", case_sql(SIMPLE))
def chk_simple(t):
    return checked(t, SIMPLE, "simple_python")


TYPES = {"[api.find(user=<u>, tags=('x', 'y z'))]": "type_error:simple", "[api.find(user=True)]": "type_error:simple", "[api.find(user=<u>.0)]": "type_error:simple", "[api.find(user=<u>, rate=1)]": ""}


@query("chk_type", case_sql(TYPES))
def chk_type(t):
    return checked(t, TYPES, "simple_python")


MULTIPLE = {"[stop(n=<u>)]": "", "[stop(n=-1)]": "value_error:others", "[api.find(user=<u>)]": "simple_function_checker:wrong_func_name", "[stop(n=<u>), stop(n=<u>)]": "multiple_function_checker:wrong_count"}


@query("chk_multiple", case_sql(MULTIPLE))
def chk_multiple(t):
    return checked(t, MULTIPLE, "multiple", '[{"stop": {"n": [<u>]}}]')


TWO = '[{"stop": {"n": [<u>]}}, {"api.find": {"user": [<u>]}}]'
PARALLEL = {"[api.find(user=<u>), stop(n=<u>)]": "", "[stop(n=<u>), stop(n=<u>)]": "parallel_function_checker_no_order:cannot_find_match", "[stop(n=<u>)]": "parallel_function_checker_no_order:wrong_count"}
ORDERED = {"[api.find(user=<u>), stop(n=<u>)]": "simple_function_checker:wrong_func_name", "[stop(n=<u>), api.find(user=<u>)]": "", "[]": "parallel_function_checker_enforce_order:wrong_count"}


@query("chk_parallel", case_sql(PARALLEL))
def chk_parallel(t):
    return checked(t, PARALLEL, "parallel_multiple", TWO)


@query("chk_parallel_ord", case_sql(ORDERED))
def chk_parallel_ord(t):
    return checked(t, ORDERED, "parallel", TWO, ordered=True)


@query("chk_dispatch", "SELECT category, count(*) AS n, bool_and(valid) AS valid FROM (SELECT event_id, unnest(['simple_python', 'multiple', 'parallel', 'live_parallel_multiple', 'simple_javascript']) AS category, unnest([true, true, true, true, true]) AS valid FROM events) GROUP BY category")
def chk_dispatch(t):
    out = None
    for category in ("simple_python", "multiple", "parallel", "live_parallel_multiple", "simple_javascript"):
        v = checked(t, {"[api.find(user=<u>)]": ""}, category, '[{"api.find": {"user": [<u>]}}]').groupBy(F.lit(category).alias("category")).agg(F.count("*").alias("n"), F.bool_and("valid").alias("valid"))
        out = v if out is None else out.unionByName(v)
    return out


@query("chk_relevance", "SELECT event_id, CASE user_id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE false END AS relevant, NOT CASE user_id % 4 WHEN 0 THEN true ELSE false END AS irrelevant FROM events")
def chk_relevance(t):
    u = F.col("user_id") % 4
    text = F.when(u == 0, "f(a=1)").when(u == 1, "I can't do that.").when(u == 2, "[]").otherwise("f(a=1")
    x = t.events.select("event_id", D.decoded(text, prompted=True).alias("c"))
    return x.select("event_id", D.relevant(F.col("c"), F.lit(True)).alias("relevant"), D.relevant(F.col("c"), F.lit(False)).alias("irrelevant"))


@query("chk_agentic", "SELECT event_id, user_id % 3 <> 2 AS valid FROM events")
def chk_agentic(t):
    u = F.col("user_id")
    message = F.concat(F.lit("It is "), F.when(u % 3 == 0, F.concat(F.lit("(No. "), u.cast("string"), F.lit(")"))).when(u % 3 == 1, "the Owl's nest!").otherwise(F.concat(F.lit("x"), u.cast("string"), F.lit("y owls nests"))))
    x = t.events.select("event_id", message.alias("m"), F.array(F.concat(F.lit("no "), u.cast("string")), F.lit("OWL'S nest")).alias("a"))
    return x.select("event_id", D.agentic(F.col("m"), F.col("a")).alias("valid"))


APIS = ["torch.hub.load(repo_or_dir='a/one', model='small')", "torch.hub.load(repo_or_dir='b/two', model='big')", "not a call", "tf.load('x/y')"]


@query("ext_apicall", "SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'hub.load(model=''' || event_type || ''')' END AS call, CASE user_id % 3 WHEN 0 THEN 'hub.load(model=''' || event_type || ''')' WHEN 1 THEN 'plain ' || event_type || '()' ELSE 'none' END AS loose FROM events")
def ext_apicall(t):
    u, e = F.col("user_id") % 3, F.col("event_type")
    text = F.when(u == 0, F.concat(F.lit("<<<domain>>>: x, <<<api_call>>>: hub.load(model='"), e, F.lit("')\n, <<<api_provider>>>: p"))).when(u == 1, F.concat(F.lit("plain "), e, F.lit("()"))).otherwise("none")
    x = t.events.select("event_id", F.replace(text, F.lit("api_call>>>"), F.lit("api_call")).alias("text"))
    return x.select("event_id", D.api_call_of(F.col("text")).alias("call"), D.api_call_of(F.col("text"), strict=False).alias("loose"))


@query("chk_api_ast", "SELECT event_id, CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS api, CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 3 ELSE -1 END AS api_all FROM events")
def chk_api_ast(t):
    u = F.col("user_id") % 4
    call = F.when(u == 0, "m = torch.hub.load(repo_or_dir='a/one', model='small', pretrained=True)").when(u == 1, 'f(torch.hub.load(repo_or_dir="b/two", model="big"))').when(u == 2, "torch.hub.load(repo_or_dir='c', model='small')").otherwise("tf.load('x/y', 1)")
    x = t.events.select("event_id", call.alias("call"))
    return x.select("event_id", D.api_match(F.col("call"), APIS).alias("api"), D.api_match(F.col("call"), APIS, "all").alias("api_all"))


@query("hist_exec", "SELECT event_id, user_id = floor(value) AS exact, abs(user_id - value) <= 0.2 * abs(value) AS near, json_keys(props) = ['k'] AS same_shape FROM events")
def hist_exec(t):
    u, v = F.col("user_id"), F.col("value")
    same = F.array_sort(F.json_object_keys("props")) == F.array(F.lit("k"))
    return t.events.select("event_id", (u == F.floor(v)).alias("exact"), (F.abs(u - v) <= 0.2 * F.abs(v)).alias("near"), same.alias("same_shape"))


@query("ast_subtrees", "SELECT event_id, count(*) AS n, max(depth) AS depth FROM (SELECT event_id, unnest(CASE WHEN user_id % 2 = 0 THEN [1, 2, 3] ELSE [1, 2, 3, 4] END) AS depth FROM events) GROUP BY event_id")
def ast_subtrees(t):
    x = told(t, filled("<e>")).withColumn("text", F.when(F.col("user_id") % 2 == 0, F.concat("text", F.lit("()"))).otherwise(F.concat("text", F.lit("(a=b)"))))
    return D.subtree_rows(x, "event_id", "text").groupBy("event_id").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


# --- the tools, replayed

FILES = json.dumps({"files": {"root": {"home": {"type": "directory", "contents": {"a.txt": {"type": "file", "content": "one\ntwo\n"}, "docs": {"type": "directory", "contents": {}}}}}}})


@query("exec_call", "SELECT event_id, ['None', '{\"current_working_directory\": \"docs\"}', '{\"error\": \"cat: ''' || event_type || ''': No such file or directory\"}', 'Error during execution: Function call quit is not allowed.'] AS outcomes FROM events")
def exec_call(t):
    calls = F.array(F.concat(F.lit("mkdir(dir_name='d"), F.col("user_id").cast("string"), F.lit("')")), F.lit("cd(folder='docs')"), F.concat(F.lit("cat(file_name='"), F.col("event_type"), F.lit("')")), F.lit("quit()"))
    return t.events.select("event_id", D.replayed(["files"], F.lit(FILES), calls).alias("outcomes"))


@query("fs_mutate", "SELECT event_id, '{\"files\": {\"root\": {\"a.txt\": \"' || event_type || '\", \"docs\": {\"b.txt\": \"one\\ntwo\\n\", \"x' || user_id || '\": {}}}}}' AS state FROM events")
def fs_mutate(t):
    e, u = F.col("event_type"), F.col("user_id").cast("string")
    calls = F.array(
        F.lit("cp(source='a.txt', destination='b.txt')"), F.concat(F.lit("mkdir(dir_name='x"), u, F.lit("')")), F.lit("mv(source='b.txt', destination='docs')"), F.concat(F.lit("mv(source='x"), u, F.lit("', destination='docs')")),
        F.concat(F.lit("echo(content='"), e, F.lit("', file_name='a.txt')")), F.lit("touch(file_name='t')"), F.lit("rm(file_name='t')"), F.lit("mkdir(dir_name='gone')"), F.lit("rmdir(dir_name='gone')"), F.lit("pwd()"), F.lit("ls(a=True)"),
    )
    return t.events.select("event_id", D.state_after(["files"], F.lit(FILES), calls).alias("state"))


ACCOUNT = json.dumps({"trading": {"account_info": {"balance": 100.0}, "stocks": {"AAA": {"price": 2.0}}, "authenticated": True}})


@query("trd_orders", "SELECT event_id, user_id % 60 <= 50 AS placed, CASE WHEN user_id % 60 <= 50 THEN 'Cancelled' END AS status, 100.0 + 5 - 1 AS balance, ['AAA'] AS watch FROM events")
def trd_orders(t):
    n = (F.col("user_id") % 60).cast("string")
    calls = F.array(F.concat(F.lit("place_order(order_type='Buy', symbol='AAA', price=2.0, amount="), F.greatest(n, F.lit("1")), F.lit(")")), F.lit("cancel_order(order_id=1)"), F.lit("fund_account(amount=5)"), F.lit("withdraw_funds(amount=1)"), F.lit("add_to_watchlist(stock='AAA')"), F.lit("add_to_watchlist(stock='ZZZ')"))
    calls = F.transform(calls, lambda c: F.replace(c, F.lit("amount=0)"), F.lit("amount=1)")))
    s = t.events.select("event_id", D.state_after(["trading"], F.lit(ACCOUNT), calls).alias("s"))
    get = lambda p: F.get_json_object("s", f"$.trading.{p}")
    return s.select("event_id", get("orders.1.id").isNotNull().alias("placed"), get("orders.1.status").alias("status"), get("account_info.balance").cast("double").alias("balance"), F.from_json(get("watch_list"), "array<string>").alias("watch"))


CAR = json.dumps({"vehicle": {"fuelLevel": 5.0}})
DOORS = "['driver', 'passenger', 'rear_left', 'rear_right']"


@query("replay_vehicle", """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '{"engineState": "running", "fuelLevel": 5.0, "batteryVoltage": 12.6}' WHEN user_id % 3 = 1 THEN '{"error": "Must press the brake fully before starting the engine."}' ELSE '{"error": "All doors must be locked before starting the engine. Here are the unlocked doors: passenger"}' END AS engine,
CASE WHEN user_id % 60 > 45 THEN '{"error": "Cannot fill gas above the tank capacity."}' ELSE '{"fuelLevel": ' || (5 + user_id % 60) || '.0}' END AS fuel, CASE WHEN user_id % 3 = 0 THEN 'active' ELSE 'inactive' END AS cruise, (CASE WHEN user_id % 60 > 45 THEN 5 ELSE 5 + user_id % 60 END) * 20 >= 300 AS far FROM events""")
def replay_vehicle(t):
    """Doors, brake, engine, fuel and cruise control of a car; a third of the drivers leave a door open, a third press too weakly."""
    u = F.col("user_id")
    calls = F.array(
        F.lit(f"lockDoors(unlock=False, door={DOORS})"), F.when(u % 3 == 2, "lockDoors(unlock=True, door=['passenger'])").otherwise("releaseBrakePedal()"), F.when(u % 3 == 1, "pressBrakePedal(pedalPosition=0.5)").otherwise("pressBrakePedal(pedalPosition=1)"),
        F.lit("startEngine(ignitionMode='START')"), F.concat(F.lit("fillFuelTank(fuelAmount="), (u % 60).cast("string"), F.lit(")")), F.lit("setCruiseControl(speed=65, activate=True, distanceToNextVehicle=20)"), F.lit("estimate_drive_feasibility_by_mileage(distance=300)"),
    )
    x = spread(t.events).select("event_id", D.replayed_with_state(["vehicle"], F.lit(CAR), calls).alias("r")).select("event_id", F.col("r.outcomes").alias("o"), F.col("r.state").alias("s"))
    return x.select("event_id", F.col("o")[3].alias("engine"), F.col("o")[4].alias("fuel"), F.get_json_object("s", "$.vehicle.cruiseStatus").alias("cruise"), (F.get_json_object(F.col("o")[6], "$.canDrive") == "true").alias("far"))


TRIP = json.dumps({"travel": {"access_token": "tok", "token_expires_in": 2, "credit_card_list": {"c": {"balance": 2500.0}}}})
TRIP_COST = "400.0 * CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END * CASE WHEN (2 + 0 + 2 + 4 + 1 + 1 + (user_id % 9 + 1)) % 2 = 0 THEN 2 ELSE 1 END"


@query("replay_travel", f"""SELECT event_id, cost <= 2500 AS booked, 2500 - CASE WHEN cost <= 2500 AND event_id % 2 = 0 THEN cost ELSE 0 END - CASE WHEN cost <= 2500 THEN 30 ELSE 0 END AS balance, CASE WHEN cost <= 2500 AND event_id % 2 = 0 THEN 1 ELSE 0 END AS bookings,
CASE WHEN cost > 2500 THEN 'Insufficient funds' END AS error FROM (SELECT event_id, {TRIP_COST} AS cost FROM events)""")
def replay_travel(t):
    """Flights booked and insured; those of odd events are cancelled. The booking's number is drawn from the seed."""
    import random

    u, i = F.col("user_id"), F.col("event_id")
    number = str(random.Random(141053).randint(1000000, 9999999))
    flight = F.concat(F.lit("book_flight(access_token='tok', card_id='c', travel_date='2024-11-0"), (u % 9 + 1).cast("string"), F.lit("', travel_from='SFO', travel_to='ORD', travel_class='"), F.element_at(F.array(*map(F.lit, ("economy", "business", "first"))), (u % 3 + 1).cast("int")), F.lit("')"))
    calls = F.array(
        flight, F.lit(f"purchase_insurance(access_token='tok', insurance_type='all', booking_id='{number}', insurance_cost=30, card_id='c')"),
        F.when(i % 2 == 1, f"cancel_booking(access_token='tok', booking_id='{number}')").otherwise("get_booking_history(access_token='other')"),
    )
    x = spread(t.events).select("event_id", D.replayed_with_state(["travel"], F.lit(TRIP), calls).alias("r"))
    x = x.select("event_id", F.col("r.outcomes").alias("o"), F.from_json(F.get_json_object("r.state", "$.travel"), "credit_card_list map<string, struct<balance:double>>, booking_record map<string,string>").alias("s"))
    return x.select("event_id", (F.get_json_object(F.col("o")[0], "$.booking_status") == "true").alias("booked"), F.col("s.credit_card_list")["c"]["balance"].alias("balance"), F.size("s.booking_record").alias("bookings"), F.get_json_object(F.col("o")[0], "$.error").alias("error"))


TURN_CASES = "CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'multi_turn:instance_state_mismatch' WHEN 2 THEN 'multi_turn:empty_turn_model_response' ELSE 'multi_turn:execution_response_mismatch' END"


def dialogue(t):
    u = F.col("user_id") % 4
    step = lambda *c: F.array(*map(F.lit, c))
    truth = F.array(step("mkdir(dir_name='x')"), step("cat(file_name='a.txt')"))
    good = F.array(step("ls()", "mkdir(dir_name='x')"))
    model = F.when(u == 0, F.array(good, F.array(step("cat(file_name='a.txt')")))).when(u == 1, F.array(F.array(step("mkdir(dir_name='y')")), F.array(step("cat(file_name='a.txt')"))))
    model = model.when(u == 2, F.array(good, F.array(step()))).otherwise(F.array(good, F.array(step("wc(file_name='a.txt')"))))
    return t.events.select("event_id", model.alias("model"), truth.alias("truth"))


@query("chk_multiturn", f"SELECT event_id, {TURN_CASES} = '' AS valid, {TURN_CASES} AS error_type, CASE user_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS turn FROM events")
def chk_multiturn(t):
    x = dialogue(t)
    return x.select("event_id", D.checked_turns(["files"], F.lit(FILES), F.col("model"), F.col("truth")).alias("v")).select("event_id", "v.*")


@query("chk_state", "SELECT event_id, user_id % 2 = 0 AS same FROM events")
def chk_state(t):
    one = F.array(F.lit("touch(file_name='n')"), F.lit("rm(file_name='a.txt')"))
    two = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("rm(file_name='a.txt')"), F.lit("touch(file_name='n')"))).otherwise(F.array(F.lit("touch(file_name='n')")))
    x = spread(t.events).select("event_id", D.state_after(["files"], F.lit(FILES), one).alias("a"), D.state_after(["files"], F.lit(FILES), two).alias("b"))
    return x.select("event_id", (F.col("a") == F.col("b")).alias("same"))


@query("chk_mt_irrel", "SELECT event_id, user_id % 2 = 0 AS valid, CASE WHEN user_id % 2 = 0 THEN '' ELSE 'multi_turn:irrelevance_error:decoder_success' END AS error_type, CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END AS turn FROM events")
def chk_mt_irrel(t):
    calls, none = F.array(F.array(F.lit("ls()"))), F.array(F.array().cast("array<string>"))
    model = F.when(F.col("user_id") % 2 == 0, F.array(calls, none)).otherwise(F.array(calls, calls))
    truth = F.array(F.array(F.lit("ls()")), F.array().cast("array<string>"))
    return t.events.select("event_id", D.checked_silence(model, truth).alias("v")).select("event_id", "v.*")


@query("chk_response", "SELECT event_id, user_id % 3 <> 1 AS holds FROM events")
def chk_response(t):
    """All true outcomes among those seen, as often: the model lists once, twice or reads another file."""
    once, other = F.lit("ls()"), F.lit("wc(file_name='a.txt')")
    model = F.when(F.col("user_id") % 3 == 0, F.array(once, other, once)).when(F.col("user_id") % 3 == 1, F.array(once, other)).otherwise(F.array(other, once, once))
    x = t.events.select("event_id", D.replayed(["files"], F.lit(FILES), model).alias("seen"), D.replayed(["files"], F.lit(FILES), F.array(once, once)).alias("wanted"))
    return x.select("event_id", bag_contains(F.col("seen"), F.col("wanted")).alias("holds"))


@query("chk_order", "SELECT event_id, user_id % 2 = 0 AS holds FROM events")
def chk_order(t):
    called = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("login"), F.lit("ls"), F.lit("post"))).otherwise(F.array(F.lit("post"), F.lit("login")))
    return t.events.select("event_id", is_subsequence(called, F.array(F.lit("login"), F.lit("post"))).alias("holds"))


@query("udf_handler", "SELECT event_id, style, event_type AS name FROM events, (VALUES ('python'), ('json'), ('tool_call_lines')) v(style)")
def udf_handler(t):
    """Handlers by name: a registry of decoders that users add to."""
    texts = {"python": "[<e>(a=1)]", "json": '[{"function": "<e>", "parameters": {}}]', "tool_call_lines": '<tool_call>\n{"name": "<e>", "arguments": {}}\n</tool_call>'}
    out = None
    for style, text in texts.items():
        x = told(t, filled(text)).select("event_id", F.lit(style).alias("style"), D.handled(F.col("text"), style).alias("c")).select("event_id", "style", F.get("c.calls", F.lit(0))["name"].alias("name"))
        out = x if out is None else out.unionByName(x)
    return out
