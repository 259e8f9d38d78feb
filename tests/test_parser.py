"""Parsing: trees as JSON, error texts, limits, and the odd corners of the grammar."""

import pytest

import siftwright as S
from siftwright.errors import ParseError, SchemeError, UnknownField
from siftwright.plans import nodes
from siftwright.plans.nodes import BytesLit, Glob, IntSpan, IpSpan, Pattern, Rewriter, Visitor

FIELDS = {
    "num": S.INT, "str": S.BYTES, "ip": S.IP, "ssl": S.BOOL, "arr": S.Array(S.BOOL), "aat": S.Array(S.Array(S.BOOL)), "ports": S.Array(S.INT), "cookies": S.Array(S.BYTES),
    "headers": S.Map(S.BYTES), "parts": S.Array(S.Array(S.BYTES)), "mba": S.Map(S.Array(S.BOOL)), "http.host": S.BYTES, "notes": S.BOOL, "abc": S.BYTES,
}


@pytest.fixture(scope="module")
def scheme():
    b = S.SchemeBuilder(FIELDS).add_functions(S.standard_functions())
    return b.add_list(S.INT, S.SetList({"even": [2]})).build()


def error(scheme, text, **settings):
    with pytest.raises(ParseError) as e:
        scheme.parse(text, S.Settings(**settings))
    return e.value


# Error texts are part of the language's contract.
@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("xyz", "Filter parsing error (1:1):\nxyz\n^^^ unknown identifier\n"),
        ("xyz\n", "Filter parsing error (1:1):\nxyz\n^^^ unknown identifier\n"),
        ("\n\n    xyz", "Filter parsing error (3:5):\n    xyz\n    ^^^ unknown identifier\n"),
        ("num == 10 or\nnum == true or\nnum == 20\n", "Filter parsing error (2:8):\nnum == true or\n       ^^^^^^^ expected digit\n"),
        ("arr and arr", "Filter parsing error (1:12):\narr and arr\n           ^ expected value of type Bool, but got Array<Bool>\n"),
        ("str in {", "Filter parsing error (1:9):\nstr in {\n        ^ unrecognised input\n"),
        ('str in {"a"', 'Filter parsing error (1:12):\nstr in {"a"\n           ^ unrecognised input\n'),
        ("num in {", "Filter parsing error (1:9):\nnum in {\n        ^ expected digit\n"),
        ("concat(0, 0) == 0", "Filter parsing error (1:8):\nconcat(0, 0) == 0\n       ^ invalid type of argument #0: expected value of type Bytes or Array<_>, but got Int\n"),
    ],
)
def test_error_texts(scheme, text, shown):
    assert str(error(scheme, text)) == shown


def test_value_expressions_reject_map_each(scheme):
    with pytest.raises(ParseError) as e:
        scheme.parse_value(" arr[*] ")
    assert str(e.value) == "Filter parsing error (1:2):\n arr[*] \n ^^^^^^ expected value of type Bool, but got Array<Bool>\n"
    assert str(scheme.parse_value("concat(cookies[*], \"x\")").type) == "Array<Bytes>"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("ssl == true", "EOF"), ("at.t", "UnknownIdentifier"), ("num\t== 1", "ExpectedName"), ("num == 10fe", "ParseInt"), ("num == 09", "ParseInt"), ("num == 9223372036854775808", "ParseInt"),
        ("num in {5..1}", "IncompatibleRangeBounds"), ("ip in {10.0.0.9..10.0.0.1}", "IncompatibleRangeBounds"), ("ip in {::1..10.0.0.1}", "IncompatibleRangeBounds"), ("ip in {10.0.0.1/8}", "ParseNetwork"),
        ("ip == 1.2.3", "ParseNetwork"), (r'str == "\n"', "InvalidCharacterEscape"), ('str == "a', "MissingEndingQuote"), ('str == r##"a"#', "MissingEndingQuote"), ("str < 12", "CountMismatch"),
        ("str == 0x", "ParseInt"), ("str ~ 12:34", "ExpectedName"), ("str wildcard 12:34", "ExpectedName"), ('str wildcard "a**b"', "ParseWildcard"), (r'str wildcard r"a\b"', "ParseWildcard"),
        ('str ~ "(?=a)"', "ParseRegex"), ('str ~ "(a"', "ParseRegex"), ("arr == 1", "TypeMismatch"), ("cookies == 1", "UnsupportedOp"), ('num contains "a"', "UnsupportedOp"), ("str & 1", "UnsupportedOp"),
        ("str in $even", "UnsupportedOp"), ("num in $.even", "InvalidListName"), ("num in $", "ExpectedName"), ("aat[*]", "UnsupportedOp"), ("any(arr[*])", "TypeMismatch"), ("any(ssl)", "TypeMismatch"),
        ('any("x")', "TypeMismatch"), ("ssl and arr", "TypeMismatch"), ("num[0] == 1", "InvalidIndexAccess"), ('cookies["a"] == "b"', "InvalidIndexAccess"), ("headers[0] == 1", "InvalidIndexAccess"),
        ("cookies[-1] == 1", "ExpectedLiteral"), ('headers[r"a"] == "b"', "ExpectedName"), ("len(cookies[0], cookies[*]) == 1", "InvalidMapEachAccess"), ("len() == 1", "InvalidArgumentsCount"),
        ("len(str, str) == 1", "InvalidArgumentsCount"), ("len(num) == 1", "InvalidArgumentType"), ('echo("a") == "a"', "InvalidArgumentKind"), ("echo(str, num) == str", "InvalidArgumentKind"),
        ("concat(str, 1) == str", "InvalidArgumentType"), ("len(str", "ExpectedLiteral"), ("any(ports[*] == 1 or ports[*] == 2)", "ExpectedLiteral"), ("(ssl", "ExpectedLiteral"), ("", "ExpectedName"),
        ("len(1) == 2", "InvalidArgumentType"), ("len(]) == 2", "EOF"), ("notes", "UnknownIdentifier"), ("unknown(str) == 1", "UnknownIdentifier"), ('str == "\\xZZ"', "ParseInt"), ('str == "\\777"', "ParseInt"),
        ('str == r' + "#" * 256 + '"a"', "InvalidRawStringHashCount"), ("num in {1, 2}", "ExpectedName"),
    ],
)
def test_error_kinds(scheme, text, kind):
    assert error(scheme, text).kind == kind


def tree(scheme, text):
    return scheme.parse(text).to_json()


def test_json_shapes(scheme):
    assert tree(scheme, "num > 3") == {"lhs": "num", "op": "GreaterThan", "rhs": 3}
    assert tree(scheme, "ssl") == {"lhs": "ssl", "op": "IsTrue"}
    assert tree(scheme, "num & 0x0f") == {"lhs": "num", "op": "BitwiseAnd", "rhs": 15}
    assert tree(scheme, "num in {80 443..444}")["rhs"] == [{"start": 80, "end": 80}, {"start": 443, "end": 444}]
    assert tree(scheme, "ip in {127.0.0.0/8 ::1 10.0.0.0..10.0.255.255}")["rhs"] == ["127.0.0.0/8", "::1", {"start": "10.0.0.0", "end": "10.0.255.255"}]
    assert tree(scheme, 'str strict wildcard "a*"') == {"lhs": "str", "op": "Strict Wildcard", "rhs": "a*"}
    assert tree(scheme, "str == 61:62") == {"lhs": "str", "op": "Equal", "rhs": [97, 98]}
    assert tree(scheme, r'str == "\xff"')["rhs"] == [255]
    assert tree(scheme, "num in $even") == {"lhs": "num", "op": "InList", "rhs": "even"}
    assert tree(scheme, 'headers["a b"] == "x"')["lhs"] == ["headers", {"kind": "MapKey", "value": "a b"}]
    assert tree(scheme, "any(ports[*] == 1)") == {"op": "Any", "arg": {"kind": "SimpleExpr", "value": {"lhs": ["ports", {"kind": "MapEach"}], "op": "Equal", "rhs": 1}}}
    assert tree(scheme, "all(arr)") == {"op": "All", "arg": {"kind": "IndexExpr", "value": "arr"}}
    assert tree(scheme, "not ssl") == {"op": "Not", "arg": {"lhs": "ssl", "op": "IsTrue"}}
    call = {"name": "concat", "args": [{"kind": "IndexExpr", "value": "str"}, {"kind": "Literal", "value": "x"}]}
    assert tree(scheme, 'concat(str, "x") == "ax"')["lhs"] == call


def test_precedence_and_flattening(scheme):
    got = tree(scheme, "ssl or ssl xor ssl and ssl or ssl")
    t = {"lhs": "ssl", "op": "IsTrue"}
    assert got == {"op": "Or", "items": [t, {"op": "Xor", "items": [t, {"op": "And", "items": [t, t]}]}, t]}
    assert len(tree(scheme, "ssl and ssl && ssl")["items"]) == 3
    assert tree(scheme, "(ssl or ssl) or ssl")["items"][0]["op"] == "Or"
    assert tree(scheme, "not ssl and ssl")["op"] == "And"
    assert tree(scheme, "!!ssl")["arg"]["op"] == "Not"


def test_literals(scheme):
    right = lambda text: scheme.parse(text).right
    assert right(r'str == "\x41\102\"\\é"') == BytesLit("AB\"\\é".encode())
    assert right('str == r#"a"b\\"#') == BytesLit(b'a"b\\', "raw", 1)
    assert right("str == 0a:0B-0c.0D").data == bytes([10, 11, 12, 13])
    assert right("num == 0x1F").value == 31
    assert right("num == 017").value == 15 and right("num == -17").value == -17
    assert right("num in {1..3}") == (IntSpan(1, 3),)
    assert right("ip in {1.1.1.01}")[0] == IpSpan(b"\1\1\1\1", b"\1\1\1\1", "1.1.1.1")
    assert right(r'str ~ "a\"[\"\"]\d"').text == r'a"[\"\"]\d'
    assert right('str ~ "x[\\"]"').text == 'x[\\"]'
    assert right('str ~ r"a"') == Pattern("a") and hash(right('str ~ r"a"')) == hash(Pattern("a"))
    assert right('str wildcard r"a"') != right('str wildcard "a"')
    assert Glob(rb"foo?*\*\\").pieces() == [b"foo?", b"*\\"]
    assert scheme.parse("str in {}").right == ()


def test_odd_corners(scheme):
    assert scheme.parse("num==1&&ssl").type == S.BOOL  # no spaces are needed
    assert scheme.parse("\tnum == 1\t").type == S.BOOL  # tabs around the whole are
    assert scheme.parse("any(arr)").to_json() == scheme.parse("any  (  arr  )").to_json()
    assert scheme.parse("any((arr[*]))").type == S.BOOL
    assert str(scheme.parse_value("headers").type) == "Map<Bytes>"
    assert scheme.parse("len(abc) == 3").left.base.args[0].base.name == "abc"  # looks like hexadecimal digits
    assert scheme.parse("concat(abc, ab:cd) == \"x\"").left.base.args[1].data == b"\xab\xcd"
    deep = "lower(" * 100 + "str" + ")" * 100 + ' == "a"'
    assert scheme.parse(deep).type == S.BOOL


def test_limits(scheme):
    assert error(scheme, "(" * 200 + "ssl" + ")" * 200).kind == "NestingLimitExceeded"
    assert error(scheme, "lower(" * 200 + "str" + ")" * 200).kind == "NestingLimitExceeded"
    assert "limit: 3" in str(error(scheme, "not not not not ssl", max_nesting_depth=3))
    assert scheme.parse("not not not ssl", S.Settings(max_nesting_depth=3))
    assert error(scheme, 'str wildcard "a*b*c*"', wildcard_star_limit=2).kind == "ParseWildcard"
    assert error(scheme, 'str ~ ".{4079,65535}"', regex_compiled_size_limit=1 << 20).kind == "ParseRegex"


def test_tree_tools(scheme):
    node = scheme.parse('num in $even and len(headers["a"]) > 1 or not any(lower(cookies[*])[*] == "x")')
    assert nodes.uses(node, "cookies") and nodes.uses(node, "headers") and not nodes.uses(node, "ip")
    assert nodes.uses_list(node, "num") and not nodes.uses_list(node, "headers")
    same = [nodes.stable_hash(scheme.parse(t)) for t in ("num == 1 && ssl", "num   eq 0x1\nand ssl", "((num == 01) and (ssl))")]
    assert len(set(same)) == 1 and same[0] != nodes.stable_hash(scheme.parse("num == 2 && ssl"))
    assert scheme.parse("num==1") == scheme.parse("num  eq 1") and hash(scheme.parse("num==1")) == hash(scheme.parse("num eq 1"))

    class Names(Visitor):
        def __init__(self):
            self.seen = []

        def visit_fieldref(self, ref):
            self.seen.append(ref.name)

    names = Names()
    names.visit(node)
    assert names.seen == ["num", "headers", "cookies"]

    class Negate(Rewriter):
        def visit_not(self, n):
            return n.arg

    assert Negate().visit(scheme.parse("not ssl and not ssl")) == scheme.parse("ssl and ssl")


def test_schemes():
    b = S.SchemeBuilder({"a.b": S.INT})
    with pytest.raises(SchemeError):
        b.add_field("a.b", S.BYTES)
    with pytest.raises(SchemeError):
        b.add_function("a.b", S.standard_functions()["len"])
    b.add_list(S.INT, S.NeverList())
    with pytest.raises(SchemeError):
        b.add_list(S.INT, S.AlwaysList())
    with pytest.raises(SchemeError):
        b.add_field("no spaces", S.INT)
    b.add_optional_field("m", S.Map(S.Array(S.BYTES)))
    scheme = b.build()
    assert scheme.to_json() == {"a.b": {"type": "Int", "optional": False}, "m": {"type": {"Map": {"Array": "Bytes"}}, "optional": True}}
    again = S.Scheme.from_json(scheme.to_json())
    assert again.to_json() == scheme.to_json()
    assert S.Scheme.from_struct_type(scheme.to_struct_type()).field("m").type == S.Map(S.Array(S.BYTES))
    with pytest.raises(UnknownField):
        scheme.field("zzz")
    deep = S.BOOL
    for _ in range(32):
        deep = S.Array(deep)
    with pytest.raises(ValueError):
        S.Array(deep)
