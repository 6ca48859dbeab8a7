"""The forest as a table of nodes: scores, importances, pruning, persistence."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from qforge.operators import forest as FO
from qforge.operators import forest_nodes as FN


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(4)
    rows = [(i, r.gauss(0, 1), r.choice([1.0, 2.0, 5.0]), r.random(), None) for i in range(600)]
    rows = [(i, a, b, c, int(a + b * c > 2) if r.random() > 0.1 else r.randint(0, 1), "x") for i, a, b, c, _ in rows]
    return spark.createDataFrame(rows, "id long, `a.b` double, n double, c double, error int, feature string").repartition(3)


@pytest.fixture(scope="module")
def model(data):
    return FO.fit_forest(data, ["a.b", "n", "c"], "error", n_trees=7, partitions=2)


def walk(nodes, x, bound=0):
    """Class shares of one tree's leaf, and whether a split under the bound was cut on the way."""
    at = nodes[0]
    while at["left"] >= 0:
        if at["n"] < bound:
            return [c / sum(at["counts"]) for c in at["counts"]], True
        at = nodes[at["left"] if x[at["feature"]] <= at["threshold"] else at["right"]]
    return [c / sum(at["counts"]) for c in at["counts"]], False


def by_tree(table):
    trees = {}
    for r in table.nodes.collect():
        trees.setdefault(r["tree"], {})[r["node"]] = r
    return trees


def test_nodes_equal_the_model(data, model, monkeypatch):
    table = model.as_nodes()
    want = {r["id"]: (r["y_score"], r["y_pred"]) for r in model.score(data).collect()}
    for limit in (FN.MAX_NODES, 0):                       # in place, and by joins
        monkeypatch.setattr(FN, "MAX_NODES", limit)
        scored = table.score(data)
        assert scored.columns == [*data.columns, "y_score", "y_pred"]
        got = {r["id"]: (r["y_score"], r["y_pred"]) for r in scored.collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[i][0] - s) < 1e-9 and (got[i][1] == y or abs(s - 0.5) < 1e-9) for i, (s, y) in want.items())
    ours, theirs = ([tuple(r) for r in m.importance().collect()] for m in (table, model))
    assert [f for f, _ in ours] == [f for f, _ in theirs] and all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(ours, theirs))
    assert table.importance(1).count() == 1


@pytest.mark.parametrize("bound", [2, 3, 25, 10_000])
def test_pruned_trees(data, model, bound):
    table = model.as_nodes()
    small = table.pruned(bound)
    full, cut = by_tree(table), by_tree(small)
    for tree, nodes in cut.items():
        reached, stack = set(), [0]
        while stack:
            n = stack.pop()
            reached.add(n)
            if nodes[n]["left"] >= 0:
                assert nodes[n]["n"] >= bound
                stack += [nodes[n]["left"], nodes[n]["right"]]
        assert reached == set(nodes)                      # nothing hangs loose
    scaled = model.scaler.transform(data).collect()
    got = {r["id"]: r["y_score"] for r in small.score(data).collect()}
    for r in scaled[:80]:
        x = (r["a.b"], r["n"], r["c"])
        paths = [walk(t, x, bound) for t in full.values()]
        assert abs(got[r["id"]] - sum(p[1] for p, _ in paths) / 7) < 1e-9
    if bound == 2:
        assert {t: sorted(n) for t, n in full.items()} == {t: sorted(n) for t, n in cut.items()}


def test_min_samples_split_is_kept(spark, data, tmp_path):
    made = FO.fit_forest(data, ["a.b", "n", "c"], "error", n_trees=3, partitions=2, min_samples_split=30)
    made.save(str(tmp_path / "m"))
    back = FO.ForestModel.load(spark, str(tmp_path / "m"))
    assert back.min_samples_split == 30 and back.nodes.where("left >= 0 AND n < 30").isEmpty()
    key = lambda df: sorted((r["id"], r["y_score"], r["y_pred"]) for r in df.collect())
    assert key(made.score(data)) == key(back.score(data))


def test_missing_feature_raises(spark, model, monkeypatch):
    df = spark.createDataFrame([(1, None, 1.0, 1.0)], "id long, `a.b` double, n double, c double")
    table = model.as_nodes()
    for limit in (FN.MAX_NODES, 0):
        monkeypatch.setattr(FN, "MAX_NODES", limit)
        with pytest.raises(PySparkException, match="missing"):
            table.score(df).collect()
    assert table.score(df.limit(0)).count() == 0


def test_fitting_deals_rows_evenly(spark, data, monkeypatch):
    """The splits of a file with one row group are many, and all but one are empty."""
    class Stop(Exception):
        pass

    def fit(self, rows, params=None):
        seen.append([len(x) for x in rows.rdd.glom().collect()])
        raise Stop

    monkeypatch.setattr(FO.Pipeline, "fit", fit)
    empty = data.where("id < 0").repartition(spark.sparkContext.defaultParallelism)
    one, seen = data.coalesce(1).union(empty), []
    for bound, tasks in ((10_000_000, spark.sparkContext.defaultParallelism), (70, 60)):
        monkeypatch.setattr(FO, "ROW_TREES_PER_TASK", bound, raising=False)
        with pytest.raises(Stop):
            FO.fit_forest(one, ["a.b", "n", "c"], "error", n_trees=7)
        assert len(seen[-1]) == tasks and sum(seen[-1]) == 600 and max(seen[-1]) <= 600 // tasks + 1


def test_every_row_is_fitted_on(spark):
    """A table of more than two million rows is fitted on as a whole."""
    n = 2_100_000
    rows = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    made = FO.fit_forest(rows.withColumn("error", (F.col("a") > 600).cast("int")), ["a", "b"], "error", n_trees=1, max_depth=2)
    drawn = made.as_nodes().nodes.where("node = 0").first()["n"]          # a bootstrap draws as many rows as there are
    assert made.n_train_rows == n and abs(drawn - n) < 20_000
