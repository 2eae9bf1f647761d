from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from vecgrove.config import Field, IndexConfig
from vecgrove.errors import IndexError_
from vecgrove.functions.predicate import And, Compare, In, IsNotNull, IsNull, Not, Or, classify, evaluate, to_column, truths, validate
from vecgrove.operators.build import synopses

CONFIG = IndexConfig(2, "l2", (Field("a", "i64", True), Field("s", "string", True, 64), Field("b", "bool"), Field("x", "f64", True)))

leaf = st.one_of(
    st.builds(Compare, st.just("a"), st.sampled_from(["eq", "ne", "lt", "le", "gt", "ge"]), st.integers(-3, 3)),
    st.builds(Compare, st.just("s"), st.sampled_from(["eq", "ne", "lt", "ge"]), st.sampled_from(["", "a", "b", "é"])),
    st.builds(Compare, st.just("x"), st.sampled_from(["lt", "ge"]), st.sampled_from([-1.5, -0.0, 0.0, 2.0])),
    st.builds(In, st.just("a"), st.lists(st.integers(-3, 3), max_size=3).map(tuple)),
    st.builds(IsNull, st.sampled_from(["a", "s", "b"])),
    st.builds(IsNotNull, st.sampled_from(["a", "s"])),
)
trees = st.recursive(leaf, lambda c: st.one_of(st.builds(Not, c), st.lists(c, max_size=3).map(tuple).map(And), st.lists(c, max_size=3).map(tuple).map(Or)), max_leaves=6)


@settings(max_examples=12, deadline=None)
@given(ps=st.lists(trees, min_size=8, max_size=8), rows=st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(-3, 3)), st.sampled_from([None, "", "a", "b", "é"]), st.booleans(), st.sampled_from([None, -1.5, 0.0, 2.0])), min_size=1, max_size=20))
def test_columns_and_leaf_classes_agree_with_plain_evaluation(spark, ps, rows):
    df = spark.createDataFrame([(0, *r) for r in rows], "tree_id long, leaf_id long, a long, s string, b boolean, x double")
    ps = [validate(p, CONFIG) for p in ps]
    got = df.select([to_column(p, CONFIG).alias(f"p{i}") for i, p in enumerate(ps)]).collect()
    for row, values in zip(rows, got, strict=True):
        record = dict(zip("asbx", row[1:], strict=True))
        for i, p in enumerate(ps):
            assert values[i] is evaluate(p, record)
    s = synopses(df, CONFIG)
    columns = [c for i, p in enumerate(ps) for c in (*[t.alias(f"{k}{i}") for k, t in zip("tfu", truths(p, CONFIG), strict=True)], classify(p, CONFIG, F.col("entries")).alias(f"c{i}"))]
    found = {r["leaf_id"]: r for r in s.select("leaf_id", *columns).collect()}
    for row in rows:
        for i, p in enumerate(ps):
            value, r = evaluate(p, dict(zip("asbx", row[1:], strict=True))), found[row[0]]
            assert r[f"{ {True: 't', False: 'f', None: 'u'}[value] }{i}"]
            assert not (r[f"c{i}"] == "NoMatch" and value) and not (r[f"c{i}"] == "AllMatch" and value is not True)


@pytest.mark.parametrize(
    "p",
    [Compare("a", "eq", 1.0), Compare("a", "eq", None), Compare("x", "lt", float("nan")), Compare("nope", "eq", 1), In("nope", ()), Compare("a", "like", 1), Compare("s", "eq", "x" * 1025), Compare("b", "eq", 1)],
)
def test_wrong_predicates(p):
    with pytest.raises(IndexError_) as e:
        validate(p, CONFIG)
    assert e.value.kind == "InvalidArgument"


def test_limits():
    deep = Compare("a", "eq", 1)
    for _ in range(64):
        deep = Not(deep)
    for p in (deep, And(tuple(Compare("a", "eq", 1) for _ in range(1024))), In("a", tuple(range(1025)))):
        with pytest.raises(IndexError_) as e:
            validate(p, CONFIG)
        assert e.value.kind == "LimitExceeded"
    assert validate(Compare("x", "eq", -0.0), CONFIG).value == 0.0
