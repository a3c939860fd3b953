"""Function documentation and prompts: lint, repair, rendering, schemas; written from ``part``, ``supplier`` and ``events``."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quern.operators import dataset as S
from quern.operators import decoding as D
from quern.plans.registry import query

PLAIN = '{"name": "f<i>", "description": "d", "parameters": {"type": "dict", "required": ["a"], "properties": {"a": {"type": "integer", "description": "x"}}}}'
#: change of the documentation by p_partkey % 6 -> first problem
LINT = {
    0: (("", ""), ""), 1: (('"required": ["a"]', '"required": ["a", "b"]'), "required parameter 'b' isn't described"), 2: (('"required": ["a"]', '"required": []'), "optional parameter 'a' has no default"),
    3: (('"integer"', '"number"'), "'a' has the unknown type 'number'"), 4: (('"a": {', '"class": {'), "'class' is a Python keyword"), 5: (('"description": "x"', '"description": "x", "items": {"type": "integer"}'), "'a' is no array and has items"),
}


def by_case(c, cases: dict):
    out = F.lit(None).cast("string")
    for k, v in cases.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def sql_case(c: str, cases: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in cases.items()) + " END"


@query("val_doc", f"SELECT p_partkey, {sql_case('p_partkey % 6', {k: v for k, (_, v) in LINT.items()})} AS problem FROM part")
def val_doc(t):
    docs = {k: PLAIN.replace(*change) if change[0] else PLAIN for k, (change, _) in LINT.items()}
    doc = F.replace(by_case(F.col("p_partkey") % 6, docs), F.lit("<i>"), F.col("p_partkey").cast("string"))
    return t.part.select("p_partkey", D.linted(doc).alias("problem"))


@query("val_kwname", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['_class', 'size'] WHEN 1 THEN ['_from', 'size'] ELSE ['kind', 'size'] END AS params, p_partkey % 3 < 2 AS repaired FROM part")
def val_kwname(t):
    import keyword

    name = F.when(F.col("p_partkey") % 3 == 0, "class").when(F.col("p_partkey") % 3 == 1, "from").otherwise("kind")
    params = F.create_map(name, F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    bad = lambda k: k.isin(*keyword.kwlist)
    fixed = F.transform_keys(params, lambda k, v: F.when(bad(k), F.concat(F.lit("_"), k)).otherwise(k))
    return t.part.select("p_partkey", F.array_sort(F.map_keys(fixed)).alias("params"), F.exists(F.map_keys(params), bad).alias("repaired"))


@query("val_fmt", "SELECT event_id, user_id % 4 = 0 AS well_formed, user_id % 4 <> 0 AS empty FROM events")
def val_fmt(t):
    u = F.col("user_id") % 4
    text = F.when(u == 0, '[{"f": {"a": 1}}, {"g": {}}]').when(u == 1, '[{"f": {"a": 1}, "g": {}}]').when(u == 2, '[{"f": 1}]').otherwise('{"f": {}}')
    v = F.try_parse_json(text)
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    items = F.from_json(text, "array<map<string,string>>")
    good = is_list & F.forall(items, lambda m: (F.size(F.map_keys(m)) == 1) & F.get(F.map_values(m), F.lit(0)).startswith("{"))
    good = F.coalesce(good, F.lit(False))
    return t.events.select("event_id", good.alias("well_formed"), (~good | (F.size(items) == 0)).alias("empty"))


DOC = [{"name": "shop.find", "description": "Finds <n>.", "parameters": {"type": "dict", "required": ["q"], "properties": {"q": {"type": "string", "description": "Query."}, "max": {"type": "integer", "description": "Most.", "default": 5}, "kinds": {"type": "array", "items": {"type": "string"}, "description": "Kinds.", "enum": ["a", "b"]}, "where": {"type": "dict", "description": "Place.", "properties": {"city": {"type": "string", "description": "City."}}}}}}]
DOC_JSON = json.dumps(DOC)


def named(t):
    """suppliers with documentation that names each of them."""
    return t.supplier.select("s_suppkey", F.replace(F.lit(DOC_JSON), F.lit("<n>"), F.col("s_name")).alias("docs"))


def sql_text(text: str) -> str:
    """A text with <n> as SQL over supplier."""
    return "||".join(f"'{p.replace(chr(39), chr(39) * 2)}'" if p != "<n>" else "s_name" for p in text.replace("<n>", "\x00<n>\x00").split("\x00"))


XML = (
    '<function name="shop.find">\n  <desc>Finds <n>.</desc>\n  <params>\n    <param name="q" type="string" required="true">\n      <desc>Query.</desc>\n    </param>\n'
    '    <param name="max" type="integer" required="false" default="5">\n      <desc>Most.</desc>\n    </param>\n    <param name="kinds" type="array[string]" required="false">\n      <desc>Kinds. Enum values: [\'a\', \'b\'].</desc>\n    </param>\n'
    '    <param name="where" type="dict" required="false">\n      <desc>Place.</desc>\n      <params>\n        <param name="city" type="string" required="true">\n          <desc>City.</desc>\n        </param>\n      </params>\n    </param>\n  </params>\n</function>\n'
)
PY = (
    '# Function: shop.find\n    """\n    Finds <n>.\n\n    Args:\n        q (str): Query.\n        max (int, default=5): Most.\n        kinds (list[str]): Kinds. Enum values: [\'a\', \'b\'].\n'
    '        where (dict): Place.\n            city (str): City.\n    """\n\n\n\n'
)


@query("txt_doc_xml", f"SELECT s_suppkey, {sql_text(XML)} AS text FROM supplier")
def txt_doc_xml(t):
    return named(t).select("s_suppkey", D.rendered(F.col("docs"), "xml").alias("text"))


@query("txt_doc_py", f"SELECT s_suppkey, {sql_text(PY)} AS text FROM supplier")
def txt_doc_py(t):
    return named(t).select("s_suppkey", D.rendered(F.col("docs"), "python").alias("text"))


@query("txt_doc_json", f"SELECT s_suppkey, {sql_text(json.dumps(DOC, indent=4))} AS text FROM supplier")
def txt_doc_json(t):
    return named(t).select("s_suppkey", D.rendered(F.col("docs"), "json").alias("text"))


PROMPT_ID = "ret_fmt={r}&tool_call_tag={t}&func_doc_fmt=json&prompt_fmt={p}&style={s}"


def prompt_ids(t):
    k = F.col("p_partkey")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), ((F.floor(k / n) % len(v)) + 1).cast("int"))
    x = F.concat(F.lit("ret_fmt="), pick(1, "python", "json", "verbose_xml", "yaml"), F.lit("&tool_call_tag="), pick(4, "True", "False"), F.lit("&func_doc_fmt=xml&prompt_fmt="), pick(8, "plaintext", "markdown"), F.lit("&style="), pick(16, "classic", "experimental"))
    return t.part.select("p_partkey", x.alias("prompt_id"))


@query("txt_prompt_id", "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 THEN ['python', 'json', 'verbose_xml'][(p_partkey % 4 + 1)::INT] END AS ret_fmt, CASE WHEN p_partkey % 4 <> 3 THEN (p_partkey // 4) % 2 = 0 END AS tagged, CASE WHEN p_partkey % 4 <> 3 THEN ['plaintext', 'markdown'][((p_partkey // 8) % 2 + 1)::INT] END AS prompt_fmt, CASE WHEN p_partkey % 4 <> 3 THEN ['classic', 'experimental'][((p_partkey // 16) % 2 + 1)::INT] END AS style FROM part")
def txt_prompt_id(t):
    x = prompt_ids(t).select("p_partkey", S.prompt_fields(F.col("prompt_id")).alias("f"))
    return x.select("p_partkey", F.col("f.ret_fmt").alias("ret_fmt"), (F.col("f.tool_call_tag") == "True").alias("tagged"), F.col("f.prompt_fmt").alias("prompt_fmt"), F.col("f.style").alias("style"))


@query("txt_sysprompt", "SELECT p_partkey, p_partkey % 2 = 0 AS tagged, p_partkey % 3 = 0 AS headed, true AS has_docs, p_partkey % 5 = 0 AS classic FROM part")
def txt_sysprompt(t):
    k = F.col("p_partkey")
    x = F.concat(F.lit("ret_fmt=json&tool_call_tag="), F.when(k % 2 == 0, "True").otherwise("False"), F.lit("&func_doc_fmt=python&prompt_fmt="), F.when(k % 3 == 0, "markdown").otherwise("plaintext"), F.lit("&style="), F.when(k % 5 == 0, "classic").otherwise("experimental"))
    s = t.part.select("p_partkey", D.prompted(x, F.lit(DOC_JSON)).alias("s"))
    has = lambda p: F.col("s").contains(p)
    return s.select("p_partkey", has("<TOOLCALL>```json").alias("tagged"), has("\n\n## Task\n").alias("headed"), has("kinds (list[str]): Kinds.").alias("has_docs"), has("You are an expert in composing functions.").alias("classic"))


@query("txt_hint", "SELECT s_suppkey, 'Finds ' || s_name || '. Note that the provided function is in Java 8 SDK syntax.' AS description, 'string' AS kind, 'Kinds. This is Java ArrayList type parameter in string representation. The list elements are of type String; they are not in string representation.' AS told FROM supplier")
def txt_hint(t):
    docs = F.replace(F.replace(F.col("docs"), F.lit('"array", "items": {"type": "string"}'), F.lit('"ArrayList", "items": {"type": "String"}')), F.lit("<n>"), F.lit(""))
    h = named(t).select("s_suppkey", D.hinted(docs, "java").alias("h"))
    get = lambda p: F.get_json_object("h", f"$[0].{p}")
    return h.select("s_suppkey", get("description").alias("description"), get("parameters.properties.kinds.type").alias("kind"), get("parameters.properties.kinds.description").alias("told"))


@query("txt_schema", "SELECT s_suppkey, provider, 'Finds ' || s_name || '.' AS description, CASE WHEN provider = 'fireworks' THEN 'shop.find' ELSE 'shop_find' END AS name, 'integer' AS max_type, provider <> 'google' AS has_default FROM supplier, (VALUES ('openai'), ('anthropic'), ('google'), ('amazon'), ('fireworks')) v(provider)")
def txt_schema(t):
    where = {"openai": ("$.function", "parameters"), "anthropic": ("$", "input_schema"), "google": ("$", "parameters"), "amazon": ("$.toolSpec", "inputSchema.json"), "fireworks": ("$.function", "parameters")}
    out = None
    for p, (root, params) in where.items():
        one = F.regexp_replace("docs", r"^\[|\]$", "")
        x = named(t).select("s_suppkey", F.lit(p).alias("provider"), D.tool_schema(one, p).alias("x"))
        get = lambda path, root=root: F.get_json_object("x", f"{root}.{path}")
        x = x.select("s_suppkey", "provider", get("description").alias("description"), get("name").alias("name"), get(f"{params}.properties.max.type").alias("max_type"), get(f"{params}.properties.max.default").isNotNull().alias("has_default"))
        out = x if out is None else out.unionByName(x)
    return out


@query("txt_docstring", "SELECT s_suppkey, 'Finds ' || s_name || '.' AS description, 'array' AS kind, 'integer' AS items, 'Numbers to look for.' AS told, 'string' AS inner_kind FROM supplier")
def txt_docstring(t):
    text = F.concat(F.lit("Finds "), F.col("s_name"), F.lit(".\n\n    Args:\n        ids (List[int]): [Required] Numbers to\n            look for.\n        where (dict): [Optional] Place.\n            - city (str): City.\n    Returns:\n        found (List[str]): Names."))
    x = t.supplier.select("s_suppkey", D.documented(F.lit("find"), text).alias("d"))
    get = lambda p: F.get_json_object("d", f"$.{p}")
    p = "parameters.properties"
    return x.select("s_suppkey", get("description").alias("description"), get(f"{p}.ids.type").alias("kind"), get(f"{p}.ids.items.type").alias("items"), get(f"{p}.ids.description").alias("told"), get(f"{p}.where.properties.city.type").alias("inner_kind"))


@query("txt_comments", "SELECT event_id, 'def ' || event_type || '(x):' || chr(10) || '    y = \"#\" + x ' || chr(10) || '    return y' AS py, 'int ' || event_type || ' = \"//\";' AS c FROM events")
def txt_comments(t):
    e = F.col("event_type")
    py = F.concat(F.lit("def "), e, F.lit('(x):\n    """Says."""\n    # first\n    y = "#" + x # then\n\n    return y\n'))
    c = F.concat(F.lit("int "), e, F.lit(' = "//";\n/* a\n b */\n// c'))
    return t.events.select("event_id", D.uncommented(py, "python").alias("py"), F.trim(D.uncommented(c, "java")).alias("c"))


@query("txt_imports", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN ['sklearn', 'yaml'] ELSE ['yaml'] END AS modules, CASE WHEN user_id % 2 = 0 THEN ['PyYAML', 'scikit-learn'] ELSE ['PyYAML'] END AS packages, CASE WHEN user_id % 2 = 0 THEN [] ELSE ['scikit-learn'] END AS unused FROM events")
def txt_imports(t):
    source = F.concat(F.lit("import os, yaml\nfrom . import here\n"), F.when(F.col("user_id") % 2 == 0, "from sklearn.svm import SVC\n").otherwise(""))
    x = t.events.select("event_id", D.imported(source).alias("modules"), D.imported(source, packages=True).alias("packages"))
    return x.withColumn("unused", F.array_except(F.array(F.lit("scikit-learn"), F.lit("PyYAML")), "packages"))


@query("txt_env", "SELECT key, value, CASE WHEN contains(key, 'KEY') THEN repeat('.', greatest(length(value) - 4, 0)::INT) || right(value, 4) ELSE value END AS shown FROM (SELECT 'OPENAI_' || CASE WHEN s_suppkey % 2 = 0 THEN 'KEY' ELSE 'URL' END || s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'own' ELSE s_name END AS value FROM supplier)")
def txt_env(t):
    key = F.concat(F.lit("OPENAI_"), F.when(F.col("s_suppkey") % 2 == 0, "KEY").otherwise("URL"), F.col("s_suppkey").cast("string"))
    s = t.supplier.select(key.alias("key"), F.col("s_name").alias("value"), "s_suppkey")
    own = s.filter("s_suppkey % 3 = 0").select(F.concat(F.lit("COMPLETION_"), "key").alias("key"), F.lit("own").alias("value"))
    other = s.select(F.concat(F.lit("HOME_"), "key").alias("key"), "value")
    return S.overlay(s.select("key", "value").unionByName(own).unionByName(other), ["OPENAI", "AZURE_OPENAI"], "COMPLETION")
