import shutil

from larkspur.plans import steps
from larkspur.plans.steps import Node, Step, drop, exists, key_of, resolve, shared_folder


def graph(calls, more="1"):
    bump = lambda: calls.append("b")

    def counted(x):
        bump()
        return x.selectExpr("r_regionkey + 1 as k")

    return {
        "a": Node(Step(("region",), lambda d: f"select r_regionkey, r_name, {more} as one from {{region}}"), {"region": "region"}, True),
        "b": Node(Step(("x",), None, counted), {"x": "a"}, True),
        "c": Node(Step(("y",), lambda d: "select count(*) as n from {y}"), {"y": "nation"}, True),
    }


def test_kept_nodes_follow_their_inputs(spark, tmp_path):
    for t in ("region", "nation"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    sf, calls = str(tmp_path), []
    g = graph(calls)
    assert resolve(g, "b", spark, sf).count() == 5 and resolve(g, "b", spark, sf).count() == 5 and calls == ["b"]
    keys = {n: key_of(g, n, spark, sf) for n in g}
    assert exists(spark, f"{shared_folder(spark)}/nodes/{keys['b']}/_SUCCESS")
    # Another session finds what this one has made.
    steps._KEPT.clear()
    assert resolve(g, "b", spark, sf).count() == 5 and calls == ["b"]
    # A changed file changes what depends on it, and only that.
    few = spark.read.parquet(f"{sf}/region.parquet").limit(2).toPandas()
    few.to_parquet(tmp_path / "region.parquet")
    again = {n: key_of(g, n, spark, sf) for n in g}
    assert again["a"] != keys["a"] and again["b"] != keys["b"] and again["c"] == keys["c"]
    assert resolve(g, "b", spark, sf).count() == 2 and calls == ["b", "b"]
    # So does a changed step.
    assert key_of(graph([], more="2"), "b", spark, sf) != again["b"]
    # What was not finished is made anew.
    steps._KEPT.clear()
    (path := __import__("pathlib").Path(f"{shared_folder(spark)}/nodes/{again['b']}".removeprefix("file://")) / "_SUCCESS").unlink()
    assert resolve(g, "b", spark, sf).count() == 2 and len(calls) == 3 and path.exists()
    drop(g, "b", spark, sf)
    assert not path.exists() and resolve(g, "b", spark, sf).count() == 2 and len(calls) == 4


def test_parameters_of_a_build_are_part_of_its_key():
    def make(n):
        return Step(("x",), None, lambda x: x.limit(n))

    assert make(1).recipe() != make(2).recipe() and make(1).recipe() == make(1).recipe()


def test_what_is_kept_is_read_by_column(spark):
    df = steps.checkpointed(spark.range(10).selectExpr("id", "id * 2 as twice"))
    plan = df.select("id").where("id > 3")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in plan
    assert df.count() == 10
