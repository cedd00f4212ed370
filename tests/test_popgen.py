import itertools
import random

import numpy as np
import pytest

from tandemlake.operators import popgen as pop


def table(spark, n=60, seed=1, shift=1):
    rng = random.Random(seed)
    rows = [(("x", "y", "z")[i % 3], i, float(rng.randint(1, 3) + shift * (i % 3 == 1)), float(rng.randint(1, 2)), float(rng.randint(1, 4))) for i in range(n)]
    return spark.createDataFrame([*rows, ("x", 999, None, 1.0, 1.0)], "set_id string, sample_id bigint, m1 double, m2 double, m3 double"), rows


def test_linkage_p_of_independent_and_linked_loci(spark):
    free, _ = table(spark, 90)
    p = {r["set_id"]: r["p"] for r in pop.linkage_pvalue(free, [1, 2, 3], rounds=600).collect()}
    assert set(p) == {"x", "y", "z"} and all(0.01 < v <= 1 for v in p.values())
    tied = spark.createDataFrame([("x", i, float(i % 4), float(i % 4), float(i % 3)) for i in range(48)], "set_id string, sample_id bigint, m1 double, m2 double, m3 double")
    got = pop.linkage_pvalue(tied, [1, 2, 3], rounds=999).first()
    assert got["p"] == pytest.approx(1 / 1000) and got["n"] == 48
    assert pop.linkage_pvalue(free.filter("false"), [1, 2, 3], rounds=5).count() == 0


def test_linkage_p_equals_all_orders(spark):
    """With four samples every shuffle can be listed."""
    rows = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 2.0)]
    agree = lambda a, b: sum(a[i] == a[j] and b[i] == b[j] for i in range(4) for j in range(i))
    a, b = zip(*rows)
    exact = np.mean([agree(a, q) >= agree(a, b) for q in itertools.permutations(b)])
    df = spark.createDataFrame([("x", i, *r) for i, r in enumerate(rows)], "set_id string, sample_id bigint, m1 double, m2 double")
    assert pop.linkage_pvalue(df, [1, 2], rounds=4000).first()["p"] == pytest.approx(exact, abs=0.03)


@pytest.mark.parametrize("part_rows", [1, 2, 3])
def test_linkage_p_in_parts_equals_all_orders(spark, part_rows):
    """A set that is dealt in parts has the distribution of the whole set's shuffles."""
    rows = [(1.0, 1.0, 5.0), (1.0, 2.0, 5.0), (2.0, 2.0, 6.0), (2.0, 2.0, 6.0)]
    columns = list(zip(*rows))
    agree = lambda cs: sum(a[i] == a[j] and b[i] == b[j] for k, a in enumerate(cs) for b in cs[:k] for i in range(4) for j in range(i))
    exact = np.mean([agree([columns[0], q, r]) >= agree(columns) for q in itertools.permutations(columns[1]) for r in itertools.permutations(columns[2])])
    df = spark.createDataFrame([("x", i, *r) for i, r in enumerate(rows)], "set_id string, sample_id bigint, m1 double, m2 double, m3 double")
    got = pop.linkage_pvalue(df, [1, 2, 3], rounds=3000, part_rows=part_rows).first()
    assert got["n"] == 4 and got["p"] == pytest.approx(exact, abs=0.035)


def test_linkage_p_from_tables_equals_all_orders(spark):
    """Six samples and four combinations of values: the combinations' counts are drawn."""
    a, b = (1.0, 1.0, 1.0, 2.0, 2.0, 2.0), (1.0, 1.0, 2.0, 2.0, 2.0, 1.0)
    agree = lambda q: sum(a[i] == a[j] and q[i] == q[j] for i in range(6) for j in range(i))
    exact = np.mean([agree(q) >= agree(b) for q in itertools.permutations(b)])
    df = spark.createDataFrame([("x", i, *r) for i, r in enumerate(zip(a, b))], "set_id string, sample_id bigint, m1 double, m2 double")
    assert pop.linkage_pvalue(df, [1, 2], rounds=4000).first()["p"] == pytest.approx(exact, abs=0.03)


def test_tables_of_shuffles_follow_the_values_not_the_samples():
    every = [np.array([400_000_000, 300_000_000]), np.array([500_000_000, 200_000_000]), np.array([1, 699_999_999])]
    got = pop._tables(every, 50, np.random.default_rng(1))
    assert got.shape == (50, 2, 2, 2) and (got >= 0).all()
    for axis, counts in enumerate(every, 1):
        assert (got.sum(axis=tuple(k for k in (1, 2, 3) if k != axis)) == counts).all()


def test_colours_of_deep_and_wide_trees(spark):
    rng = random.Random(9)
    for n, near in ((60, 60), (200, 2), (40, 1)):
        up = {i: rng.randrange(max(0, i - near), i) for i in range(1, n)}
        inner = set(up.values())
        colour = {str(i): rng.choice(["red", "blue"]) for i in range(n) if i not in inner and rng.random() < 0.9}
        below = {i: set() for i in range(n)}
        for i in range(n):
            if i not in inner:
                at = i
                while at is not None:
                    below[at].add(colour.get(str(i), "black"))
                    at = up.get(at)
        edges = spark.createDataFrame([(str(c), str(p), rng.uniform(-1, 1)) for c, p in up.items()], "child string, parent string, length double")
        got = {r["child"]: r["colour"] for r in pop.coloured_tree(edges, spark.createDataFrame(list(colour.items()), "tip string, colour string")).collect()}
        assert got == {str(i): next(iter(below[i])) if len(below[i]) == 1 else "black" for i in up}
    assert pop.coloured_tree(edges.limit(0), spark.createDataFrame([("1", "red")], "tip string, colour string")).count() == 0


def test_fst_p_tells_sets_apart(spark):
    df, _ = table(spark, 90, shift=2)
    got = {(r["set_i"], r["set_j"]): (r["fst"], r["p"]) for r in pop.fst_table(df, [1, 2, 3], 200).collect()}
    assert got["x", "y"][1] == pytest.approx(1 / 201) and got["x", "z"][1] > 0.02 and got["x", "y"][0] > got["x", "z"][0]


def test_components_of_the_distance_matrix(spark):
    df, rows = table(spark, 40, 3)
    x = np.array([r[2:] for r in rows])
    d = (x[:, None, :] != x[None, :, :]).mean(axis=2)
    centred = d - d.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / (len(d) - 1))
    want = centred @ vectors[:, ::-1][:, :3]
    got = pop.distance_components(df, [1, 2, 3], 3).orderBy("sample_id").toPandas()
    assert len(got) == 40 and [got[f"value{q}"][0] for q in (1, 2, 3)] == pytest.approx(values[::-1][:3])
    for q in range(3):
        assert np.abs(got[f"pc{q + 1}"].to_numpy()) == pytest.approx(np.abs(want[:, q]), abs=1e-8)
    assert pop.distance_components(df.filter("false"), [1, 2, 3]).count() == 0


def test_components_by_products_equal_the_dense_ones(spark):
    rng = random.Random(12)
    rows = [(i, float(rng.randrange(9) + 10 * (i % 2)), float(rng.randrange(12)), float(rng.randrange(5) + i % 3)) for i in range(70)]
    df = spark.createDataFrame([*rows, (999, None, 1.0, 1.0)], "sample_id bigint, m1 double, m2 double, m3 double")
    a, b = (pop.distance_components(df, [1, 2, 3], 3, dense=d).orderBy("sample_id").toPandas() for d in (5_000, 0))
    assert len(a) == len(b) == 70
    for q in (1, 2, 3):
        assert b[f"value{q}"][0] == pytest.approx(a[f"value{q}"][0], rel=1e-9)
        assert b[f"pc{q}"].to_numpy() == pytest.approx(a[f"pc{q}"].to_numpy(), abs=1e-5)
    one = spark.createDataFrame([(i, 1.0, 2.0, 3.0) for i in range(4)], "sample_id bigint, m1 double, m2 double, m3 double")
    assert [r["pc1"] for r in pop.distance_components(one, [1, 2, 3], 1, dense=0).collect()] == pytest.approx([0.0] * 4, abs=1e-6)


def test_block_lanczos_of_a_large_matrix():
    """Against numpy's solver, with more columns than the space it needs."""
    rng = np.random.default_rng(4)
    z = np.hstack([np.eye(60)[rng.integers(0, 60, 500)] for _ in range(5)])
    z = z[:, z.sum(axis=0) > 0]
    g, n = z.T @ z, 500
    share = g.diagonal() / n
    s = g - n * np.outer(share, share)
    calls = []
    values, x = pop.krylov_components(lambda y: calls.append(y.shape[1]) or g @ y, share, n, 3)
    want = np.sort(np.linalg.eigvals(g @ s).real)[::-1][:3]
    assert values == pytest.approx(want, rel=1e-9)
    assert np.allclose(g @ s @ x, x * values, atol=1e-4 * values.max() * np.abs(x).max()) and np.allclose(np.diag(x.T @ s @ x), 1, atol=1e-6)
    assert max(calls) == 7


def test_jitter_scale_and_seed(spark):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 2, 5, 5, 9])], "i int, v double").coalesce(1)
    a, b = (sorted(map(tuple, pop.jittered(rows, "v", 4).collect())) for _ in range(2))
    noise = np.array([x[1] for x in a]) - np.array([1, 1, 2, 5, 5, 9])
    assert a == b and 0 < np.abs(noise).max() < 5 * (1 / 8 * 6 / 2)
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "i int, v double")
    assert [r["v"] for r in pop.jittered(same, "v").collect()] == [2.0, 2.0]


def test_order_and_slices_of_a_matrix(spark):
    df, rows = table(spark, 30)
    dim = spark.createDataFrame([("x", "X", "red"), ("y", "Y", "green"), ("z", "Z", "blue")], "set_id string, label string, colour string")
    index = pop.distance_index(df, dim, [1, 2, 3])
    got = sorted(tuple(r) for r in index.collect())
    want = sorted((r[0], r[1]) for r in rows)
    assert [(g[1], g[4]) for g in got] == want and [g[0] for g in got] == list(range(30)) and got[0][2:4] == ("X", "red")
    assert sorted(tuple(r) for r in pop.distance_slices(index).collect()) == [("x", 0, 10), ("y", 10, 10), ("z", 20, 10)]


def test_tree_of_samples_and_its_colours(spark):
    rows = [("x", i, *map(float, v)) for i, v in enumerate([(1, 1, 1, 1), (1, 1, 1, 2), (5, 5, 1, 1), (5, 5, 1, 3), (5, 5, 1, 3)])]
    df = spark.createDataFrame(rows, "set_id string, sample_id bigint, m1 double, m2 double, m3 double, m4 double")
    edges = pop.sample_tree(df, [1, 2, 3, 4])
    got = [tuple(r) for r in edges.collect()]
    assert {c for c, _, _ in got} >= {"0", "1", "2", "3", "4"}
    parent = {c: p for c, p, _ in got}
    assert parent["3"] == parent["4"] and parent["0"] == parent["1"] != parent["3"]
    text = pop.newick(got)
    assert text.endswith(";") and all(f"{i}:" in text for i in range(5)) and text.count("(") == text.count(")")
    classes = spark.createDataFrame([("0", "red"), ("1", "red"), ("2", "blue"), ("3", "blue"), ("4", "blue")], "tip string, colour string")
    colour = {r["child"]: r["colour"] for r in pop.coloured_tree(edges, classes).collect()}
    assert colour["0"] == "red" and colour["3"] == "blue" and all(r["length"] >= 0 for r in pop.coloured_tree(edges, classes).collect())
    assert pop.newick([]) == ";"
