"""The lowering against a plain evaluator, over documents with gaps and statements at random."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quern.plans.lower import condition
from quern.plans.syntax import Both, Compare, Either, Exists, Member, Not

NUMBERS, STRINGS = [0.0, 1.0, 2.5, -3.0], ["", "a", "ab", "b"]
DOCS = [(i, n, s, b) for i, (n, s, b) in enumerate((n, s, b) for n in [None, *NUMBERS] for s in [None, *STRINGS] for b in (None, True, False))]
FIELDS = ("n", "s", "b", "gone")
OPS = ("$bg", "$kc", "$lh", "$bh", "$lhb", "$bhb", "$xau")


def same(a, b):
    return type(a) is type(b)


def holds(doc, c):
    match c:
        case Both(x, y):
            return holds(doc, x) and holds(doc, y)
        case Either(x, y):
            return holds(doc, x) or holds(doc, y)
        case Not(x):
            return not holds(doc, x)
        case Exists(f):
            return doc.get(f) is not None
        case Member(f, values, wanted):
            v = doc.get(f)
            return v is not None and any(same(v, x) and v == x for x in values) == wanted
        case Compare(f, op, x):
            v = doc.get(f)
            if v is None or not same(v, x):
                return False
            if op == "$xau":
                return isinstance(v, str) and x in v
            return {"$bg": v == x, "$kc": v != x, "$lh": v < x, "$bh": v > x, "$lhb": v <= x, "$bhb": v >= x}[op]


values = st.sampled_from([*NUMBERS, *STRINGS])
simple = st.one_of(
    st.builds(Compare, st.sampled_from(FIELDS), st.sampled_from(OPS), values),
    st.builds(Member, st.sampled_from(FIELDS), st.lists(values, max_size=3).map(tuple), st.booleans()),
    st.builds(Exists, st.sampled_from(FIELDS)),
)
conditions = st.recursive(st.one_of(simple, st.builds(Not, simple)), lambda c: st.one_of(st.builds(Both, c, c), st.builds(Either, c, c)), max_leaves=5)


def test_lowering_follows_the_model(spark):
    df = spark.createDataFrame(DOCS, "id int, n double, s string, b boolean").cache()
    docs = [dict(zip(("id", "n", "s", "b"), d, strict=True)) for d in DOCS]

    @settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(conditions, min_size=6, max_size=6))
    def check(some):
        for c in some:
            want = sorted(d["id"] for d in docs if holds(d, c))
            assert sorted(r["id"] for r in df.filter(condition(df, c)).select("id").collect()) == want, c

    check()


def test_not_reaches_the_reader(spark, small):
    df = spark.read.parquet(f"{small}/orders.parquet")
    plan = df.filter(condition(df, Not(Compare("o_orderstatus", "$bg", "F"))))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan
