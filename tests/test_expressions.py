"""Set expressions in one pass against Python sets and the step-by-step functions."""

import random

import pytest

from tandemlake.operators import sets as st

SAMPLE = "sample_id bigint, batch string, country string, level1 string, recurrent boolean"
ALLELE = "sample_id bigint, marker_id bigint, value int"


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(7)
    people = [(i, rng.choice(["b1", "B2", None]), rng.choice(["X", "Y", None]), rng.choice(["p", "q"]), i % 9 == 0) for i in range(80)]
    facts = [(rng.randrange(90), rng.randrange(4), rng.randrange(200, 240)) for _ in range(300)]
    saved = [(i,) for i in range(70, 100)]
    return people, facts, saved, spark.createDataFrame(people, SAMPLE), spark.createDataFrame(facts, ALLELE), spark.createDataFrame(saved, "sample_id bigint")


LEAVES = [
    ({"country": "X"}, lambda p, f: p[2] == "X"),
    ({"batch": "b%", "level1": "q"}, lambda p, f: (p[1] or "").lower().startswith("b") and p[3] == "q"),
    ({"allele": "210-220"}, lambda p, f: any(210 <= v <= 220 for _, v in f)),
    ({"country": "Y", "allele": ">230", "marker": [1, 2]}, lambda p, f: p[2] == "Y" and any(v > 230 and m in (1, 2) for m, v in f)),
    ({"marker": 3}, lambda p, f: any(m == 3 for m, _ in f)),
    ({"location": "anywhere"}, lambda p, f: True),
]


def grow(rng, world, depth):
    """A random expression and its set."""
    people, facts, saved, *_, frame = world
    known = {p[0] for p in people}
    if depth == 0 or rng.random() < 0.2:
        kind = rng.randrange(9)
        if kind == 8:
            return frame, {i for (i,) in saved}
        if kind > 5:
            return (("all",), known) if kind == 6 else (("none",), set())
        fields, test = LEAVES[kind]
        return dict(fields), {p[0] for p in people if not p[4] and test(p, [(m, v) for s, m, v in facts if s == p[0]])}
    verb = rng.choice(["union", "intersection", "exclusive", "not"])
    parts = [grow(rng, world, depth - 1) for _ in range({"not": 1, "exclusive": 2}.get(verb, rng.randint(1, 3)))]
    found = [x for _, x in parts]
    got = {"not": lambda: known - found[0], "exclusive": lambda: found[0] ^ found[-1], "union": lambda: set().union(*found), "intersection": lambda: set.intersection(*found)}[verb]()
    return (verb, *[t for t, _ in parts]), got


def test_random_expressions_equal_sets(world):
    rng = random.Random(11)
    *_, samples, alleles, _ = world
    made = [grow(rng, world, 1 + i % 4) for i in range(40)]
    members, dim = st.expression_sets({f" {i} ": t for i, (t, _) in enumerate(made)}, samples, alleles)
    got = {}
    for r in members.collect():
        got.setdefault(r["set_id"], []).append(r["sample_id"])
    for i, (_, want) in enumerate(made):
        assert sorted(got.get(i, [])) == sorted(want), made[i][0]
    assert [(r["set_id"], r["label"]) for r in dim.orderBy("set_id").collect()] == [(i, str(i)) for i in range(40)]


def test_equal_to_the_steps_with_one_shuffle(spark, world):
    *_, samples, alleles, _ = world
    a, b, c = {"country": "X"}, {"allele": "<215"}, {"batch": "b2"}
    found = st.select_expression(("union", ("exclusive", a, b), ("not", ("intersection", b, c))), samples, alleles)
    x, y, z = (st.select_samples(samples, alleles, **f) for f in (a, b, c))
    want = st.union(st.exclusive(x, y), st.complement(st.intersection(y, z), samples))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = [df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (found, want)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plans[0] == 1 < plans[1]


def test_wrong_expressions(world):
    *_, samples, alleles, _ = world
    for bad in (("minus", {}), ("not", {}, {}), ("exclusive", {}), ("union",), {"planet": 3}, ("not", ("all", {}))):
        with pytest.raises(ValueError):
            st.select_expression(bad, samples, alleles)
    with pytest.raises(ValueError):
        st.select_expression({"allele": "3"}, samples)
    assert st.select_expression({"allele": "3"}, samples.limit(0), alleles).count() == 0
