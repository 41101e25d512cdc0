import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.errors import EngineError
from quern.plans.parser import parse
from quern.plans.syntax import Aggregate, Both, Change, Compare, Either, Exists, Lookup, Member, Not, Order
from quern.plans.tokens import tokenize


def test_tokens():
    kinds = [(t.kind, t.text) for t in tokenize('FUNDEN users haar address.city $BG "x y" orange bi age LIME -2.5')]
    assert kinds == [("keyword", "funden"), ("name", "users"), ("keyword", "haar"), ("name", "address.city"), ("operator", "$bg"), ("string", "x y"), ("keyword", "orange bi"), ("name", "age"), ("keyword", "lime"), ("number", "-2.5"), ("end", "")]


@pytest.mark.parametrize("text, code", [("funden x haar a $nope 1", "TOKEN"), ("funden x haar a = 1", "TOKEN"), ("", "PARSE"), ("users", "PARSE"), ("funden", "PARSE"), ("funden x haar a", "PARSE"), ("funden x lime -1", "PARSE"), ("funden x lime 2 surplus", "PARSE"), ("vietinfo x {a 1}", "PARSE")])
def test_errors(text, code):
    with pytest.raises(EngineError) as e:
        parse(text)
    assert e.value.code == code


def test_conditions_from_the_left():
    where = parse('funden t haar a $bg 1 $vor $vnot b $tntt $vand c $ktg ["x", true]').where
    assert where == Both(Either(Compare("a", "$bg", 1.0), Not(Exists("b"))), Member("c", ("x", True), False))


def test_clauses_in_any_order():
    q = parse("funden t lime 5 skopan 2 orange bi a desc, b")
    assert (q.limit, q.offset, q.order) == (5, 2, (Order("a", True), Order("b")))


def test_group_and_changes():
    q = parse("gomail t haar a $bh 1 gremb bi k pou x, awr y orange bi pou_x desc")
    assert (q.group, q.aggregates) == ("k", (Aggregate("pou", "x"), Aggregate("awr", "y")))
    assert parse('cochin t haar id $bg 1 $quy a "x" $don tags vip $loi tags 3').changes == (Change("$quy", "a", "x"), Change("$don", "tags", "vip"), Change("$loi", "tags", 3.0))


@pytest.mark.parametrize("text", ["$rasoat e tu emp on a $bg b", "$rasoat e từ emp on a $bg emp.b", "$rasoat e from emp on a b"])
def test_lookup(text):
    assert parse(f"funden t {text}").lookup == Lookup("emp", "a", "b", "e")


def test_lookup_by_fields():
    assert parse("funden t $rasoat emp local_field a target_field b").lookup == Lookup("emp", "a", "b", "emp")


def test_explain_takes_a_statement():
    assert parse("exepanus funden t haar a $bg 1").inner.collection == "t"
    assert parse("exepanus t haar a $bg 1").where == Compare("a", "$bg", 1.0)


def test_documents():
    assert parse('vietinfo t [{a: 1, "b c": "x"}, {d: null, e: false}]').documents == ({"a": 1.0, "b c": "x"}, {"d": None, "e": False})


@given(st.text(max_size=60))
def test_any_text_parses_or_fails_cleanly(text):
    try:
        parse(text)
    except EngineError as e:
        assert e.code in ("TOKEN", "PARSE")
