"""Decoders, literals, checks, documentation, backends and metrics without a session."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions import backends as B
from quern.functions import calls as C
from quern.functions import docs as D
from quern.functions import literals as L
from quern.functions import match as M
from quern.functions import similarity as S


def test_python_calls():
    assert C.python("f(a=1)") == [{"f": {"a": 1}}]
    assert C.python("'[m.f(a=-2, b=[1, \"x\"], c={\"k\": (1, 2)}, d=name, e=g(1), h=g(k=2), i=...)]'") == [
        {"m.f": {"a": -2, "b": [1, "x"], "c": {"k": (1, 2)}, "d": "name", "e": "g(1)", "h": {"g": {"k": 2}}, "i": "..."}}
    ]
    assert C.python("[]") == []


@pytest.mark.parametrize("text", ["", "f(a=", "1", "[1]", "f(a=1+x)", "f(a=lambda: 1)", "f(a=2**99999)", "f(a='x'*10**9)", "f(a=__import__('os').system('x') + 1)"])
def test_python_refuses(text):
    with pytest.raises(ValueError):
        C.python(text)


@given(st.dictionaries(st.from_regex(r"[a-z]{1,8}", fullmatch=True).filter(lambda k: not __import__("keyword").iskeyword(k)), st.recursive(st.integers(-99, 99) | st.text("abc '\"\\\n", max_size=5) | st.booleans(), lambda x: st.lists(x, max_size=3), max_leaves=4), max_size=4))
@settings(max_examples=50, deadline=None)
def test_calls_round_trip(args):
    call = [{"api.run": args}]
    assert C.python("[" + ", ".join(C.to_source(call)) + "]") == call
    assert C.loads(C.dumps(call)) == call


def test_other_languages():
    assert C.java('A.f(x="a, b", y=new HashMap<String, Integer>(), z=true, w=1 + 2)') == [{"A.f": {"x": "a, b", "y": "new HashMap<String,Integer>()", "z": "true", "w": "1+2"}}]
    assert C.javascript("f(a=[1, 2], b={c: 'x, y'}, d=\"q\")") == [{"f": {"a": "[1, 2]", "b": "{c: 'x, y'}", "d": "q"}}]
    for parse in (C.java, C.javascript):
        for bad in ("f(a=1", "no call", "f(a=1, a=2)", "f(a='x)"):
            with pytest.raises(ValueError):
                parse(bad)
    assert C.from_json("[{]") == []
    with pytest.raises(ValueError):
        C.from_json('[{"function": "f"}]')
    with pytest.raises(ValueError):
        C.verbose_xml("<functions><function></function></functions>")
    assert C.decode_any("???") is None


@pytest.mark.parametrize(
    ("text", "kind", "nested", "want"),
    [
        ("true", "boolean", None, True), ("-123", "integer", None, -123), ("3.14f", "float", None, 3.14), ("3e3F", "float", None, 3e3), ("3.14e-2", "double", None, 3.14e-2), ("123L", "long", None, 123), ("a", "char", None, "a"),
        ("abc", "String", None, "abc"), ("123", "any", None, "123"), ("12x", "integer", None, "12x"), ("new int[]{1, 2, 3}", "Array", None, [1, 2, 3]), ('new Object[]{1, "abc", true}', "Array", None, [1, "abc", True]),
        ('new ArrayList<>(Arrays.asList("a", "b"))', "ArrayList", None, ["a", "b"]), ("new ArrayList<>() {{ add(1); add(2); }}", "ArrayList", "integer", [1, 2]), ("new ArrayList<>()", "ArrayList", None, []),
        ("new int[] { }", "Array", None, []), ("new HashMap<>() {{}}", "HashMap", None, {}), ("new HashMap<>() {}", "HashMap", None, {}), ('new HashMap<String, String>() { {put("key", "value");} }', "HashMap", None, {"key": "value"}),
        ("new long[]{1L, 2.0, 3L}", "Array", "long", [1, "2.0", 3]), ("new ArrayList<Character>() {{ add('a'); add('b'); }}", "ArrayList", "char", ["a", "b"]), ("new ArrayList<Float>() {{ add(1.0f); }}", "ArrayList", "float", [1.0]),
        ("-9223372036854775808L", "long", None, -9223372036854775808), ("3.14", "float", None, "3.14"), ("3.14f", "double", None, "3.14f"), ("yes", "boolean", None, "yes"), ("new ArrayList<>(", "ArrayList", None, "new ArrayList<>("),
        ('new HashMap<String, List<Map<String, Integer>>>() {{ put("a, (b", new ArrayList<>(Arrays.asList("x;y", 2))); put("c", new int[]{1}); put("d", f(1, "}")); }}', "HashMap", None, {"a, (b": ["x;y", 2], "c": [1], "d": 'f(1, "}")'}),
        ('new HashMap<String, String>() {{ put("key", "value"); }}', "HashMap", None, {"key": "value"}), ("new HashMap<>()", "HashMap", None, {}), ("x", "HashMap", None, "x"),
    ],
)
def test_java_literals(text, kind, nested, want):
    assert L.java(text, kind, nested) == want


PLAIN = st.integers(-99, 99) | st.booleans() | st.text("ab ,;(){}[]:é", max_size=6) | st.floats(-9, 9).map(lambda x: round(x, 3) + 0.0005)


@given(st.recursive(PLAIN, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab, :", min_size=1, max_size=4), x, max_size=3), max_leaves=8).filter(lambda x: isinstance(x, list | dict)))
@settings(max_examples=150, deadline=None)
def test_literals_round_trip(value):
    quoted = lambda x: f'"{x}"' if isinstance(x, str) else str(x).lower()

    def js(x):
        if isinstance(x, list):
            return "[" + ", ".join(map(js, x)) + "]"
        return "{" + ",".join(f"'{k}': {js(v)}" for k, v in x.items()) + "}" if isinstance(x, dict) else quoted(x)

    def java(x):
        if isinstance(x, list):
            return "new ArrayList<Map<String, Object>>(Arrays.asList(" + ", ".join(map(java, x)) + "))"
        return "new HashMap<>() {{ " + "".join(f'put("{k}", {java(v)}); ' for k, v in x.items()) + "}}" if isinstance(x, dict) else quoted(x)

    assert L.javascript(js(value), "array" if isinstance(value, list) else "dict") == value
    assert L.java(java(value), "ArrayList" if isinstance(value, list) else "HashMap") == value


@given(st.text("[]{}()<>,;:\"'\\ab1 ", max_size=30))
@settings(max_examples=200, deadline=None)
def test_literals_never_fail(text):
    for convert, kinds in ((L.java, ("Array", "ArrayList", "HashMap")), (L.javascript, ("array", "dict"))):
        for kind in kinds:
            convert("new " + text, kind)
            convert(text, kind)


def test_java_sets_have_no_conversion():
    with pytest.raises(ValueError):
        L.java("x", "Set")


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [("true", "Boolean", True), ("123n", "Bigint", 123), ("1.5", "float", 1.5), ("'x'", "String", "x"), ("[1, 'a', true]", "array", [1, "a", True]), ("[[1, 2], [3]]", "array", [[1, 2], [3]]), (" [ [ 1, 2 ], [ 3,   4]]", "array", [[1, 2], [3, 4]]), ("new Array([1], {'k, l': [true, 'a]']})", "array", [[1], {"k, l": [True, "a]"]}]), ("123", "Bigint", "123"), ("1e3", "float", "1e3"),
     ('{"a": stateObject, "m": ["x", f(1, 2)], c: {d: -1.5}}', "dict", {"a": "stateObject", "m": ["x", "f(1, 2)"], "c": {"d": -1.5}}), ("[1, 2", "array", "[1, 2"), ("{a}", "dict", "{a}"), ("[1, 2,]", "array", [1, 2]), ("{a: 1, 'b': 'x'}", "dict", {"a": 1, "b": "x"}), ("{}", "dict", {}), ("new Array(1, 2)", "array", [1, 2]), ("q", "array", "q")],
)
def test_javascript_literals(text, kind, want):
    assert L.javascript(text, kind) == want


DOC = {"name": "a.f", "description": "", "parameters": {"type": "dict", "required": ["n"], "properties": {"n": {"type": "integer"}, "d": {"type": "dict"}, "l": {"type": "array", "items": {"type": "dict"}}}}}


def test_checks():
    truth = {"a.f": {"n": [1, 2], "d": [{"k": ["x", ""]}, ""], "l": [[{"k": ["y"]}], ""]}}
    ok = lambda args, **k: M.verdict(M.check_call, DOC, {"a.f": args}, truth, **k)["error_type"]
    assert ok({"n": 2}) == "" and ok({"n": 2, "d": {}, "l": [{"k": "Y"}]}) == ""
    assert ok({"n": True}) == "type_error:simple" and ok({"n": 3}) == "value_error:others"
    assert ok({"n": 1, "d": {"z": 1}}) == "value_error:dict_key" and ok({"n": 1, "d": {"k": "q"}}) == "value_error:dict_value"
    assert ok({"n": 1, "l": [{"k": "y"}, {"k": "y"}]}) == "value_error:list_dict_count"
    assert M.verdict(M.check_call, DOC, {"a_f": {"n": 1}}, truth, underscores=True)["valid"]
    assert M.agentic("The answer is: 42.", ["42"]) and not M.agentic("142", ["42"])


def test_parallel_is_greedy():
    doc = [{"name": "f", "parameters": {"properties": {"a": {"type": "integer"}}, "required": []}}]
    truths = [{"f": {"a": [1, 2]}}, {"f": {"a": [1]}}]
    assert not M.verdict(M.check_parallel, doc, [{"f": {"a": 1}}, {"f": {"a": 2}}], truths)["valid"]
    assert M.verdict(M.check_parallel, doc, [{"f": {"a": 2}}, {"f": {"a": 1}}], truths)["valid"]


def test_api_call_of():
    assert M.api_call_of("x api_call: f(a) , api_provider: y") == "f(a)"
    assert M.api_call_of("f(a)") is None and M.api_call_of("f(a)", strict=False) == "f(a)"


def test_docs():
    good = {"name": "f", "description": "", "parameters": {"type": "dict", "required": [], "properties": {"a": {"type": "dict", "description": "", "default": {}, "properties": {"b": {"type": "string", "description": ""}}}}}}
    assert D.lint(good) is None
    assert D.lint({**good, "x": 1}) and D.lint([]) and D.rename_keywords({"from": 1, "b": 2}) == ({"_from": 1, "b": 2}, ["from"])
    assert D.type_of("Optional[List[int]]") == {"type": "array", "items": {"type": "integer"}}
    assert D.type_of("Union[int, str]") == {"type": "any"} and D.type_of("Dict[str, float]") == {"type": "dict", "additionalProperties": {"type": "float"}}
    with pytest.raises(ValueError):
        D.system_prompt("ret_fmt=yaml", [])


def test_nested_return_values():
    d = D.from_docstring("f", "Does.\n\nArgs:\n    a (int): One.\n\nReturns:\n    x (dict): Outer.\n        y (int): Inner\n            goes on.\n    z (str): Last.\n")
    props = d["response"]["properties"]
    assert props["x"]["properties"]["y"]["description"] == "Inner goes on." and props["z"]["type"] == "string"


def test_tools():
    t = B.make(["files", "kv_memory", "math", "messages"], {"messages": {"user_map": {"A": "U1"}, "current_user": "U1"}})
    run = lambda s: B.execute(t, s)
    assert run("touch(file_name='a')") == "None" and json.loads(run("touch(file_name='a')"))["error"].endswith("File exists")
    assert run("du(human_readable=True)") == '{"disk_usage": "0.00 B"}'
    assert json.loads(run("cd(folder='..')"))["error"].startswith("Current directory is already")
    for k in range(7):
        assert "added" in run(f"core_memory_add(key='k{chr(97 + k)}', value='v')")
    assert "full" in run("core_memory_add(key='z', value='v')") and "snake_case" in run("archival_memory_add(key='A b', value='v')")
    assert json.loads(run("core_memory_key_search(query='ka', k=1)"))["ranked_results"][0][1] == "ka"
    assert run("divide(a=1, b=0)") == '{"error": "Cannot divide by zero"}' and run("standard_deviation(numbers=[1, 3])") == '{"result": 1.0}'
    assert json.loads(run("send_message(receiver_id='U1', message='Hi')"))["sent_status"] and json.loads(run("get_message_stats()"))["stats"]["received_count"] == 1
    for bad in ("exit()", "_need(ok=1)", "nothing()", "__class__()", "cat(", "cat(a=1)"):
        assert run(bad).startswith("Error during execution")


def test_turns():
    config = {"files": {"root": {"r": {"type": "directory", "contents": {}}}}}
    good = B.check_turns(["files"], config, [[["touch(file_name='a')"]], [["ls()"]]], [["touch(file_name='a')"], []])
    assert good["valid"]
    assert B.check_turns(["files"], config, [[[]]], [["ls()"]])["error_type"] == "multi_turn:empty_turn_model_response"
    assert B.is_ordered([1, 3], [1, 2, 3]) and not B.is_ordered([3, 1], [1, 2, 3]) and B.bag_missing([1, 1], [1]) == [1]


def test_bleu():
    assert S.brevity(28, 12) == pytest.approx(0.2635971381157267) and S.brevity(11, 12) == 1
    assert S.precision(["the cat is on the mat".split(), "there is a cat on the mat".split()], ["the"] * 7, 1) == (2, 7)
    assert S.bleu([([list("abcd")], list("abcd"))]) == pytest.approx(1) and S.bleu([([list("abcd")], list("xyz"))]) == 0
    assert S.closest_length([[1] * 13, [1] * 11], 12) == 11
    assert 0 < S.weighted_recall([([(list("abcd"), {"a": 2.0})], list("abxd"))]) < 1
    for m in range(8):
        assert 0 <= S.bleu([([list("abcdefgh")], list("abcdxfgh"))], method=m) <= 1.1 or m == 7


@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.lists(st.sampled_from("abc"), min_size=1, max_size=12))
@settings(max_examples=50, deadline=None)
def test_bleu_is_bounded(a, b):
    assert 0 <= S.bleu([([a], b)]) <= 1 + 1e-9
    n, d = S.precision([a], b, 2)
    assert 0 <= n <= d


def test_code():
    assert S.flow_match(["x = 1\ny = x"], "p = 2\nq = p") == 1 and S.flow_match(["x = 1\ny = x"], "p(") == 0
    assert S.without_comments("a = 1 // x\n/* b */\ns = \"//\"", "java").split("\n")[-1] == 's = "//"'
    assert S.imports("import numpy.linalg, os\nfrom . import x") == ["numpy"] and S.imports("import (") == []
    assert S.api_index("g(f('m'))", [S.api_literals("f('m')", "all")]) == 0 and S.api_index("f(", [("f", ["x"])]) == -1
    assert math.isclose(sum(v * v for v in B.embed("a b a").values()), 1)


def test_journeys():
    car = {"vehicle": B.TOOLS["vehicle"]({"fuelLevel": 10.0})}
    run = lambda tools, call: B.execute(tools, call)
    assert "unlocked doors: driver, passenger" in run(car, "startEngine(ignitionMode='START')")
    run(car, "lockDoors(unlock=False, door=['driver', 'passenger', 'rear_left', 'rear_right'])")
    assert run(car, "pressBrakePedal(pedalPosition=1.0)") == '{"brakePedalStatus": "pressed", "brakePedalForce": 1000.0}'
    assert json.loads(run(car, "startEngine(ignitionMode='START')"))["engineState"] == "running"
    assert run(car, "startEngine(ignitionMode='STOP')") == '{"error": "Invalid ignition mode."}' and car["vehicle"]["engineState"] == "stopped"
    assert run(car, "activateParkingBrake(mode='engage')") == '{"parkingBrakeStatus": "engaged", "_parkingBrakeForce": 500.0, "_slopeAngle": 10.0}'
    assert run(car, "displayCarStatus(option='parkingBrake')") == '{"parkingBrakeStatus": "engaged", "parkingBrakeForce": 500.0, "slopeAngle": 10.0}'
    assert run(car, "adjustClimateControl(temperature=68, unit='fahrenheit')").startswith('{"currentACTemperature": 68') and car["vehicle"]["acTemperature"] == 20
    assert run(car, "get_zipcode_based_on_city(city='Rivermist')") == '{"zipcode": "83214"}' and run(car, "estimate_distance(cityA='74532', cityB='83214')") == '{"distance": 750.0}'
    assert json.loads(run(car, "check_tire_pressure()"))["healthy_tire_pressure"] is True
    trip = {"travel": B.TOOLS["travel"]({})}
    token = json.loads(run(trip, "authenticate_travel(client_id='i', client_secret='s', refresh_token='r', grant_type='read_write', user_first_name='A', user_last_name='B')"))["access_token"]
    card = json.loads(run(trip, f"register_credit_card(access_token='{token}', card_number='1', expiration_date='01/2030', cardholder_name='A B', card_verification_number=1)"))["card_id"]
    before = trip["travel"]["credit_card_list"][card]["balance"]
    assert len(token) == 6 and len(card) == 12 and 10000 <= before <= 99999
    booked = json.loads(run(trip, f"book_flight(access_token='{token}', card_id='{card}', travel_date='2024-11-11', travel_from='SFO', travel_to='RMS', travel_class='business')"))
    assert booked["booking_status"] and trip["travel"]["credit_card_list"][card]["balance"] == before - 1200.0
    assert json.loads(run(trip, f"retrieve_invoice(access_token='{token}', booking_id='{booked['booking_id']}')"))["invoice"]["travel_cost"] == 1200.0
    assert run(trip, f"cancel_booking(access_token='{token}', booking_id='0')") == '{"cancel_status": false, "error": "Booking not found"}'
    assert run(trip, f"cancel_booking(access_token='{token}', booking_id='{booked['booking_id']}')") == '{"cancel_status": true}' and trip["travel"]["credit_card_list"][card]["balance"] == before
    assert run(trip, "book_flight(access_token='no', card_id='c', travel_date='x', travel_from='SFO', travel_to='RMS', travel_class='first')") == '{"booking_status": false, "error": "Invalid access token"}'
    assert run(trip, "compute_exchange_rate(base_currency='RMB', target_currency='USD', value=10)") == '{"exchanged_value": 1.43}' and "No available exchange rate" in run(trip, "compute_exchange_rate(base_currency='RMB', target_currency='EUR', value=1)")
    assert run(trip, "verify_traveler_information(first_name='A', last_name='B', date_of_birth='1990-01-01', passport_number='US1')") == '{"verification_status": true}'


def test_wires():
    from quern.functions import wires as W

    assert len(W.WIRES) >= 15
    with pytest.raises(ValueError):
        W.decode_wire("no calls here", "name_arguments")
    with pytest.raises(ValueError):
        W.decode_wire('{"name": "f", "arguments": [1]}', "name_arguments")
    assert W.decode_wire("nothing", "toolcall_block") == [] and W.decode_wire("not json", "name_arguments_or_nothing") == []
    assert W.decode_wire("[f(a=1)]", "fenced_code") == [{"f": {"a": 1}}] and W.decode_wire("f", "name_line") == [{"f": {}}]


def test_plain_calls_read_like_pythons():
    import random

    from quern.functions import calls as C

    rng = random.Random(5)
    pieces = "f g.h ( ) [ ] { } , = : ' \" 1 -2 3.5 00 1. True None class a= b= 'it' \"q\" '' \\ \n # + 1e3 [1] {1:2} {'a':[1,(2,3)]} (1) (1,2) f(a=1) g()".split(" ")

    def outcome(read, text):
        try:
            return repr(read(text))
        except (ValueError, SyntaxError) as e:
            return type(e).__name__

    plain = 0
    for k in range(20_000):
        text = "".join(rng.choice(pieces) + rng.choice(("", " ")) for _ in range(rng.randint(1, 8)))
        text = f"f({rng.choice('ab')}={text}, c=1)" if k % 2 else f"[f(a={text}), g()]"
        assert outcome(C.python, text) == outcome(lambda t: C.parsed(t.strip().strip("'")), text), text
        try:
            plain += bool(C._plain(text))
        except C._NotPlain:
            pass
    assert plain > 500
    assert C.literal("{'a': [1, (2, -3.5)], 'b': None}") == {"a": [1, (2, -3.5)], "b": None}


def test_java_arguments_are_found_in_one_scan():
    import time

    from quern.functions import calls as C

    text = "m.f(" + ", ".join(f'a{k}=new Box<String, Integer>("x, (", {k})' for k in range(300)) + ")"
    assert C.java(text)[0]["m.f"]["a7"] == 'new Box<String,Integer>("x, (", 7)'
    assert C._arguments("f(a, g(b, c), 'x,)') y", 1, True) == (["a", "g(b, c)", "'x,)'"], 19)
    for bad in ("m.f(a=1]", "m.f(a='1)", "m.f(a=(1)", "m.f(a=1))"):
        with pytest.raises(ValueError):
            C.java(bad)
    started = time.process_time()
    C.java("m.f(v=" + "a / " * 20_000 + "b)")  # what is before a slash is not copied
    assert time.process_time() - started < 2
