import pytest

from quillspan.functions.analysis import NON_SPACE, Analyzer
from quillspan.plans import ir
from quillspan.plans import syntax as sx
from quillspan.plans.parser import FieldType, Options, Parser, QueryError


def one(text):
    (node,) = sx.parse_syntax(text).children
    return node


@pytest.mark.parametrize(("suffix", "ordered", "slop"), [("", None, None), ("~", False, None), ("~>", True, None), ("~3", False, 3), ("~>3", True, 3)])
def test_near(suffix, ordered, slop):
    for text in ('"a b"', "[a b]"):
        node = one(text + suffix)
        assert (node.ordered, node.slop, [c.text for c in node.children]) == (ordered, slop, ["a", "b"])


@pytest.mark.parametrize(
    ("text", "node"),
    [
        ("t~", sx.Fuzzy(text="t")), ("t~1", sx.Fuzzy(text="t", edits=1)), ("t~>2", sx.Fuzzy(text="t", edits=2, swaps=False)), ("t~2,3", sx.Fuzzy(text="t", edits=2, prefix=3)),
        ("apache^.4", sx.Term(text="apache", boost=0.4)), ("10-22+02", sx.Term(text="10-22+02")), ("@yahoo", sx.Term(text="@yahoo")), ("y@hoo", sx.Term(text="y@hoo")),
        ("y@..hoo", sx.Term(text="y@..hoo")), ("y@10.hoo", sx.Term(text="y@10.hoo")), ("foo@10..2", sx.Term(text="foo", start=2, end=10)), ("foo@3..", sx.Term(text="foo", start=3)),
        ("foo@..4^2", sx.Term(text="foo", end=4, boost=2.0)), ("foo^2@..4", sx.Term(text="foo", end=4, boost=2.0)), ("fo*", sx.Prefix(text="fo")), ("f*o", sx.Wildcard(text="f*o")), ("*", sx.Wildcard(text="*")),
        ("/a.c/", sx.Regex(text="a.c")), ("/a//b/", sx.Regex(text="a/b")), ("'it''s'", sx.Term(text="it's", quoted=True)), ("\\AND", sx.Term(text="AND")), ("a\\u0062c", sx.Term(text="abc")),
        ("[a TO b]", sx.Range(low="a", high="b")), ("{a TO b]", sx.Range(low="a", high="b", with_low=False)), ("[* TO '*']", sx.Range(low=None, high="*")), ("[\\* TO *]", sx.Range(low="*", high=None)),
    ],
)
def test_units(text, node):
    assert one(text) == node


@pytest.mark.parametrize("text", ["[abc to def]", "[abc TO def]~3", "[abc TO def]!~1,2"])
def test_no_range(text):
    assert isinstance(one(text), (sx.Near, sx.NotNear))


@pytest.mark.parametrize("text", ["[abc def ghi}", "[abc TO ghi}~2", "[a?c TO def]", "fox^-4", "fox^.", "[foo bar]@", "[foo bar]@2", "[foo bar]@2.", "[foo bar]@..", "y@10..hoo", "y@..20hoo", '"a', "[a [b]", "''", "a\\", "t~1.5", "f?o~1", "f:g:a", "[f:a]", "(a b)~2@1..3", "[(a b)~2]", "a NOT NOT b", ")"])
def test_errors(text):
    with pytest.raises(QueryError):
        sx.parse_syntax(text)


def test_terms_in_near():
    assert [c.text for c in one("[quick NOT nimble]").children] == ["quick", "NOT", "nimble"]
    assert one('"~2 quick"').children[0] == sx.Term(text="~2")
    assert one('"!~2 quick"').children[0] == sx.Fuzzy(text="!", edits=2)


def occurs(text, **options):
    return [(c.occur, c.query.term) for c in Parser(options=Options(**options)).parse(text).clauses]


def test_operators():
    assert occurs("cat dog AND elephant aardvark") == [("should", "cat"), ("must", "dog"), ("must", "elephant"), ("should", "aardvark")]
    assert occurs("cat dog NOT elephant aardvark") == [("should", "cat"), ("should", "dog"), ("not", "elephant"), ("should", "aardvark")]
    assert occurs("cat +dog -elephant +aardvark") == [("should", "cat"), ("must", "dog"), ("not", "elephant"), ("must", "aardvark")]
    assert occurs("cat && dog || !x") == [("must", "cat"), ("must", "dog"), ("not", "x")]
    assert occurs("a b", default_and=True) == [("must", "a"), ("must", "b")]
    assert occurs("a OR b", default_and=True) == [("should", "a"), ("should", "b")]
    for bad in ("AND a", "a AND", "a f:"):
        with pytest.raises(QueryError):
            Parser().parse(bad)


def test_rewrites():
    p = Parser({"f": FieldType(analyzer=Analyzer(stops=frozenset(["the", "of"])))}, Options("f"))
    a, b = ir.TermIs("f", "a"), ir.TermIs("f", "b")
    assert p.parse("-a").clauses[-1] == ir.Clause("must", ir.AllDocs())
    assert p.parse("   ") == p.parse("") == p.parse("the") == ir.NOTHING
    assert p.parse('"a the of b"~3') == ir.NearBy((a, b), 5, False)
    assert p.parse('"a the b"') == ir.NearBy((a, b), 1, True)
    assert p.parse("[[a b]~2]~5") == ir.NearBy((a, b), 5, False)
    assert p.parse('"a"~2') == a
    assert p.parse('"a the"!~2') == a and p.parse('"the a"!~2') == ir.NOTHING
    assert p.parse("[a b]~300").slop == 100 and p.parse("[a b]!~80,3") == ir.NotNearBy(a, b, 50, 3)
    assert Parser({"f": FieldType()}, Options.from_request({"df": "f"})).parse("[a b]~300").slop == 300
    assert p.parse("a^2") == ir.Boosted(a, 2.0) and p.parse("brown~0") == ir.TermIs("f", "brown")
    assert p.parse("'a b'") == ir.NearBy((a, b), 0, True) and p.parse("a-b") == ir.AnyOf((a, b))
    with pytest.raises(QueryError):
        p.parse("*og")
    with pytest.raises(QueryError):
        p.parse_spans("a AND b")


def test_synonyms_and_spans():
    p = Parser({"f": FieldType(analyzer=Analyzer(NON_SPACE, synonyms={"dogs": ("dog",)}))}, Options("f"))
    old, dogs = ir.TermIs("f", "old"), ir.AnyOf((ir.TermIs("f", "dogs"), ir.TermIs("f", "dog")))
    assert p.parse('"old dogs"') == ir.NearBy((old, dogs), 0, True)
    assert p.parse('"old dogs"~3^2') == ir.Boosted(ir.NearBy((old, dogs), 3, False), 2.0)
    q = p.parse("old AND x -y g:z")
    assert ir.as_spans(q, "f") == ir.AnyOf((old, ir.TermIs("f", "x")))
    assert ir.with_terms(q, "f") == ir.AnyOf((ir.AnyOf((old, ir.TermIs("f", "x"))), old, ir.TermIs("f", "x"), ir.TermIs("f", "y")))
