"""Columns of decoded calls and of verdicts. The functions work on Arrow batches; a batch is all they hold."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import backends as B
from quern.functions import calls as C
from quern.functions import docs as D
from quern.functions import match as M
from quern.functions import similarity as S
from quern.functions import wires as W

CALLS = "struct<ok:boolean,error:string,calls:array<struct<name:string,args:map<string,string>>>>"
CALLS_ARROW = pa.struct([("ok", pa.bool_()), ("error", pa.string()), ("calls", pa.list_(pa.struct([("name", pa.string()), ("args", pa.map_(pa.string(), pa.string()))])))])
VERDICT = "struct<valid:boolean,error_type:string,error:string>"
VERDICT_ARROW = pa.struct([("valid", pa.bool_()), ("error_type", pa.string()), ("error", pa.string())])


#: Rows, and bytes of their results, that a task remembers of the batches before, at most.
REMEMBERED, REMEMBERED_BYTES = 20_000, 16 << 20


def rowwise(f: Callable, ddl: str, kind: pa.DataType) -> Callable[..., Column]:
    """A column function of ``f``, called row by row on Arrow data; a row with a null in it gives null.

    ``f`` depends on nothing but its arguments, so rows that have the same ones share one call: those of a batch, and
    those of the batches of a task before it as far as they are remembered.
    """
    seen: dict = {}
    known = [pa.array([], kind)]

    @F.arrow_udf(ddl)
    def run(*columns: pa.Array) -> pa.Array:
        if len(seen) > REMEMBERED or known[0].nbytes > REMEMBERED_BYTES:
            seen.clear()
            known[0] = known[0].slice(0, 0)
        values, places, before = [], [], len(known[0])
        nested = [k for k, c in enumerate(columns) if pa.types.is_nested(c.type) or pa.types.is_floating(c.type)]
        coded = columns[0].dictionary_encode(null_encoding="encode") if len(columns) == 1 and pa.types.is_string(columns[0].type) else None
        for row in zip(*(c.to_pylist() for c in ([coded.dictionary] if coded is not None else columns))):
            key = row
            if nested:
                key = [*row]
                for k in nested:
                    key[k] = repr(row[k])
                key = tuple(key)
            at = seen.get(key)
            if at is None:
                values.append(None if None in row else f(*row))
                at = seen[key] = before + len(values) - 1
            places.append(at)
        if values:
            new = pa.array(values, kind)
            known[0] = pa.concat_arrays([known[0], new]) if before else new
            if coded is None and len(values) == len(places):
                return new
        at = pa.array(places, pa.int64())
        return known[0].take(at if coded is None else at.take(coded.indices))

    return run


def _calls(parse: Callable[..., C.Calls | None]) -> Callable:
    def one(*args) -> dict:
        try:
            got = parse(*args)
        except ValueError as e:
            return {"ok": False, "error": str(e), "calls": []}
        return {"ok": True, "error": None, "calls": [{"name": n, "args": [(k or "", C.dumps(v)) for k, v in a.items()]} for c in got or [] for n, a in c.items()]}

    return one


def decoded(text: Column, language: str = "python", tagged: bool = False, prompted: bool = False) -> Column:
    """struct(ok, error, calls) of a model's text; argument values are JSON, a value without a name is under ''."""
    parse = C.decode_prompted if prompted else C.decode
    return rowwise(_calls(lambda t: parse(t, language, tagged)), CALLS, CALLS_ARROW)(text)


def decoded_any(text: Column) -> Column:
    return rowwise(_calls(C.decode_any), CALLS, CALLS_ARROW)(text)


def decoded_style(text: Column, style: str) -> Column:
    return rowwise(_calls(lambda t: C.decode_style(t, style)), CALLS, CALLS_ARROW)(text)


def decoded_wire(text: Column, wire: Column) -> Column:
    """struct(ok, error, calls) of a model's text, in the wire format that a column names."""
    return rowwise(_calls(W.decode_wire), CALLS, CALLS_ARROW)(text, wire)


#: Decoders of model families by name; ``HANDLERS[name] = function of a text`` adds one.
HANDLERS: dict[str, Callable[[str], C.Calls]] = {**C.LANGUAGES, **{name: style.decode for name, style in C.STYLES.items()}, **{name: wire.decode for name, wire in W.WIRES.items()}}


def handled(text: Column, name: str) -> Column:
    """struct(ok, error, calls) by the handler of that name."""
    return rowwise(_calls(HANDLERS[name]), CALLS, CALLS_ARROW)(text)


def source_of(text: Column) -> Column:
    """The calls in a model's Python text as an array of sources; null if it has none."""

    def one(t: str) -> list[str] | None:
        try:
            return C.to_source(C.decode_prompted(t))
        except ValueError:
            return None

    return rowwise(one, "array<string>", pa.list_(pa.string()))(text)


def converted(value: Column, convert: Callable, kind: str, nested: str | None = None) -> Column:
    """JSON of Java or JavaScript source as a declared type."""
    return rowwise(lambda v: C.dumps(convert(v, kind, nested)), "string", pa.string())(value)


def _verdict(test: Callable) -> Callable:
    def one(*args) -> dict:
        try:
            return M.verdict(test, *args)
        except (KeyError, TypeError, ValueError, AttributeError, IndexError) as e:
            return {"valid": False, "error_type": "checker:bad_entry", "error": f"{type(e).__name__}: {e}"}

    return one


def checked_value(kind: str, value: Column, allowed: Column) -> Column:
    """A value against its allowed values, both JSON: string, list, dict or list of dicts."""
    test = {"string": M.check_string, "list": M.check_list, "dict": M.check_dict, "list_dict": M.check_dicts}[kind]
    return rowwise(_verdict(lambda v, a: test("value", C.loads(v), C.loads(a))), VERDICT, VERDICT_ARROW)(value, allowed)


@lru_cache(maxsize=256)
def _read(text: str):
    """Documentation and ground truth, which come again and again; checks don't change them."""
    return C.loads(text)


def checked(text: Column, docs: Column, truth: Column, category: Column, ordered: bool = False, underscores: bool = False) -> Column:
    """struct(valid, error_type, error) of a model's text, with documentation and ground truth as JSON.

    A text that can't be decoded, and one without calls, have error types of their own.
    """

    def one(t: str, d: str, g: str, c: str) -> None:
        language = "javascript" if "javascript" in c else "java" if "java" in c else "python"
        try:
            calls = C.decode_prompted(t, language)
        except ValueError as e:
            raise M.Wrong("ast_decoder:decoder_failed", str(e)) from e
        if not C.well_formed(calls):
            raise M.Wrong("ast_decoder:decoder_wrong_output_format", "not a list of calls")
        if ordered:
            M.check_ordered(_read(d), calls, _read(g), language, underscores)
        else:
            M.check(_read(d), calls, _read(g), c, underscores)

    return rowwise(_verdict(one), VERDICT, VERDICT_ARROW)(text, docs, truth, category)


def relevant(decoded_calls: Column, wanted: Column) -> Column:
    """Whether there are calls, where there should be; none, where there should be none."""
    return (decoded_calls["ok"] & (F.size(decoded_calls["calls"]) > 0)) == wanted


def standard(text: Column) -> Column:
    """Without spaces and ``,./-_*^``, lower case, single quotes as double ones."""
    return F.replace(F.lower(F.regexp_replace(text, r"[ ,./\-_*^]", "")), F.lit("'"), F.lit('"'))


def standard_agentic(text: Column) -> Column:
    return F.replace(F.lower(F.regexp_replace(text, r"[,./\-_*^()]", "")), F.lit("'"), F.lit('"'))


def agentic(message: Column, answers: Column) -> Column:
    """Whether any of the answers stands in the message as whole words."""
    quoted = lambda a: F.regexp_replace(standard_agentic(a), r"([\\\[\]{}()+*?.^$|#\s&~-])", r"\\$1")
    return F.exists(answers, lambda a: F.regexp_like(standard_agentic(message), F.concat(F.lit(r"(?U)\b"), quoted(a), F.lit(r"\b"))))


def api_call_of(text: Column, strict: bool = True) -> Column:
    """The call between the marks api_call and api_provider; without them null if ``strict``, else the whole text."""
    part = F.split_part(F.get(F.split(text, "api_call"), F.lit(1)), F.lit("api_provider"), F.lit(1))
    start = F.greatest(F.locate(":", part), F.lit(1))
    last = F.length(part) - F.locate(")", F.reverse(part)) + 1
    end = F.when(part.contains(")"), last).otherwise(F.length(part) - 1)
    return F.when(text.contains("api_call"), F.substring(part, start + 2, F.greatest(end - start - 1, F.lit(0)))).otherwise(None if strict else text)


def api_match(call: Column, table: Iterable[str], variant: str = "keywords") -> Column:
    """Number of the first API of a table of calls that a call agrees with, or -1. The table is part of the task."""
    apis = [S.api_literals(c, variant) for c in table]
    return rowwise(lambda c: S.api_index(c, apis), "int", pa.int32())(call)


def replayed(tools: list[str], config: Column, sources: Column) -> Column:
    """Outcomes of an array of calls on fresh tools."""

    def one(c: str, calls: list[str]) -> list[str]:
        made = B.make(tools, json.loads(c))
        return [B.execute(made, s) for s in calls]

    return rowwise(one, "array<string>", pa.list_(pa.string()))(config, sources)


def state_after(tools: list[str], config: Column, sources: Column) -> Column:
    """JSON of the tools' states after an array of calls."""

    def one(c: str, calls: list[str]) -> str:
        made = B.make(tools, json.loads(c))
        for s in calls:
            B.execute(made, s)
        return json.dumps({t: x.state for t, x in made.items()}, sort_keys=True, default=str)

    return rowwise(one, "string", pa.string())(config, sources)


def replayed_with_state(tools: list[str], config: Column, sources: Column) -> Column:
    """struct(outcomes, state) of one replay: what replayed() and state_after() give."""

    def one(c: str, calls: list[str]) -> dict:
        made = B.make(tools, json.loads(c))
        outcomes = [B.execute(made, s) for s in calls]
        return {"outcomes": outcomes, "state": json.dumps({t: x.state for t, x in made.items()}, sort_keys=True, default=str)}

    return rowwise(one, "struct<outcomes:array<string>,state:string>", pa.struct([("outcomes", pa.list_(pa.string())), ("state", pa.string())]))(config, sources)


def checked_turns(tools: list[str], config: Column, model: Column, truth: Column) -> Column:
    """Verdict on a dialogue: ``model`` is array (turns) of arrays (steps) of calls, ``truth`` array (turns) of calls."""
    kind = pa.struct([("valid", pa.bool_()), ("error_type", pa.string()), ("turn", pa.int32())])
    return rowwise(lambda c, m, t: B.check_turns(tools, json.loads(c), m, t), "struct<valid:boolean,error_type:string,turn:int>", kind)(config, model, truth)


def checked_silence(model: Column, truth: Column) -> Column:
    kind = pa.struct([("valid", pa.bool_()), ("error_type", pa.string()), ("turn", pa.int32())])
    return rowwise(B.check_turns_silent, "struct<valid:boolean,error_type:string,turn:int>", kind)(model, truth)


def linted(doc: Column) -> Column:
    """The first problem of a function's documentation (JSON); empty if there is none."""
    return rowwise(lambda d: D.lint(json.loads(d)) or "", "string", pa.string())(doc)


def rendered(docs: Column, form: str) -> Column:
    return rowwise(lambda d: D.render(json.loads(d), form), "string", pa.string())(docs)


def prompted(prompt_id: Column, docs: Column) -> Column:
    return rowwise(lambda p, d: D.system_prompt(p, json.loads(d)), "string", pa.string())(prompt_id, docs)


def hinted(docs: Column, language: str) -> Column:
    return rowwise(lambda d: json.dumps(D.with_hints(json.loads(d), language)), "string", pa.string())(docs)


def tool_schema(doc: Column, provider: str) -> Column:
    return rowwise(lambda d: json.dumps(D.tool(json.loads(d), provider)), "string", pa.string())(doc)


def documented(name: Column, docstring: Column) -> Column:
    return rowwise(lambda n, d: json.dumps(D.from_docstring(n, d)), "string", pa.string())(name, docstring)


def uncommented(source: Column, language: str) -> Column:
    """Comments (in Python docstrings as well) and empty lines gone."""
    return rowwise(lambda s: S.without_comments(s, language), "string", pa.string())(source)


def imported(source: Column, packages: bool = False) -> Column:
    return rowwise(S.packages if packages else S.imports, "array<string>", pa.list_(pa.string()))(source)


def syntax_matched(candidate: Column, reference: Column) -> Column:
    """Share of the subtrees of a reference (Python) that the candidate has. Trees of recent programs are remembered."""
    return rowwise(lambda c, r: S.syntax_match([r], c), "double", pa.float64())(candidate, reference)


def syntax_checked(candidate: Column) -> Column:
    """0 for Python code that can be read, -1 for other code."""
    return rowwise(S.syntax_errors, "int", pa.int32())(candidate)


def flow_matched(candidate: Column, reference: Column) -> Column:
    """Share of the data flow of a reference (Python) that the candidate has. Flows of recent programs are remembered."""
    return rowwise(lambda c, r: S.flow_match([r], c), "double", pa.float64())(candidate, reference)


def subtree_rows(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, pos, shape, depth, first) for each subtree of Python code."""
    kind = pa.list_(pa.struct([("shape", pa.string()), ("depth", pa.int32()), ("first", pa.string())]))
    got = rowwise(lambda s: [dict(zip(("shape", "depth", "first"), x)) for x in S.subtrees(s)], "array<struct<shape:string,depth:int,first:string>>", kind)
    return df.select(key, F.posexplode(got(F.col(source))).alias("pos", "t")).select(key, "pos", "t.*")


def flow_rows(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, pos, name, kind, sources) for each edge of the data flow of Python code."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("sources", pa.list_(pa.string()))]))
    got = rowwise(lambda s: [{"name": a, "kind": b, "sources": list(c)} for a, b, c in S.data_flow(s)], "array<struct<name:string,kind:string,sources:array<string>>>", kind)
    return df.select(key, F.posexplode(got(F.col(source))).alias("pos", "f")).select(key, "pos", "f.*")
