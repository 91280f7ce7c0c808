import hashlib
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from larkspur.operators import parity
from larkspur.operators.features import FEATURES, add_time_features
from larkspur.sources import retail, runs
from larkspur.sources.archive import ArchiveReader, ArchiveSource


def panel(spark, days=40):
    rng = random.Random(1)
    rows = [(f"s{s}", d, float(rng.choice([0, 1, 4, 9])), rng.choice([1.0, 2.0, 0.0])) for s in range(5) for d in range(days)]
    return spark.createDataFrame(rows, "series_id string, date_idx int, sales double, price double").selectExpr(
        "*", "sales as demand", "0 as stockout", "0 as promo", "'c' as category", "'t' as store", "date_idx % 7 as dow", "sales as recovered_demand_mean"
    )


def test_both_statements_agree_and_a_planted_difference_does_not(spark, tmp_path):
    p, root = panel(spark), f"file://{tmp_path}/features"
    first = add_time_features(p)
    got = parity.feature_parity(first, parity.features_by_arrays(p)).collect()
    assert [r.column_name for r in got] == FEATURES and all(r.agrees and r.n == 200 and r.max_difference < 1e-9 for r in got)
    run = parity.publish_features(p, root)
    assert runs.current(spark, root) == run and runs.read_table(spark, root, "features").count() == 200
    planted = first.withColumn("roll_std_14", F.when((F.col("series_id") == "s3") & (F.col("date_idx") == 33), F.col("roll_std_14") + 1e-6).otherwise(F.col("roll_std_14")))
    with pytest.raises(ValueError, match="roll_std_14"):
        parity.publish_features(p, root, features=planted)
    for wrong in (first.where("date_idx != 7"), first.withColumn("lag_7", F.expr("if(date_idx = 9, null, lag_7)"))):
        with pytest.raises(ValueError):
            parity.publish_features(p, root, features=wrong)
    assert runs.current(spark, root) == run
    assert not any(r.agrees for r in parity.feature_parity(first.limit(0), first.limit(0)).collect())


def test_a_killed_run_leaves_the_old_one(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/runs"
    assert runs.current(spark, root) is None
    one = runs.publish_run(spark, root, {"a": spark.range(10), "b": spark.range(3)}, {"k": 1})
    for lost in ("file_digests", "_write_text"):
        with monkeypatch.context() as m:
            m.setattr(runs, lost, lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError):
                runs.publish_run(spark, root, {"a": spark.range(99)})
        assert runs.current(spark, root) == one and runs.read_table(spark, root, "a").count() == 10
    unfinished = next(d.name for d in (tmp_path / "runs" / "runs").iterdir() if d.name != one)
    with pytest.raises(ValueError, match="no finished run"):
        runs.read_table(spark, root, "a", unfinished)
    with pytest.raises(ValueError, match="no finished run"):
        runs.publish_marts(spark, root, {"m": ("select count(*) as n from {a}", ["n"])}, unfinished)
    with pytest.raises(ValueError, match="no finished run"):
        runs.rollback(spark, root, unfinished)
    two = runs.publish_run(spark, root, {"a": spark.range(20)})
    assert runs.read_table(spark, root, "a").count() == 20 and runs.describe(spark, root)["previous"] == one
    assert runs.rollback(spark, root) == one and runs.read_table(spark, root, "b").count() == 3
    assert runs.rollback(spark, root, two) == two and not list((tmp_path / "runs").glob("CURRENT.*"))


def test_digests_and_marts(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    run = runs.publish_run(spark, root, {"a": spark.range(100).selectExpr("id", "id % 3 as k").repartition(3)})
    files = {r.path: r for r in spark.read.parquet(f"{root}/runs/{run}/manifest").collect()}
    on_disk = sorted((tmp_path / "runs" / "runs" / run / "tables" / "a").glob("part-*"))
    assert len(files) == len(on_disk) == 3
    for f in on_disk:
        r = next(r for path, r in files.items() if path.endswith(f.name))
        assert (r.bytes, r.sha256) == (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest())
    marts = {"by_k": ("select k, count(*) as n from {a} group by k", ["k"])}
    runs.publish_marts(spark, root, marts)
    said = runs.describe(spark, f"{root}/marts")
    assert said["document"] == {"of_run": run, "rows": {"by_k": 3}} and [r.n for r in runs.read_table(spark, f"{root}/marts", "by_k").collect()] == [34, 33, 33]
    assert runs.verify(spark, root).count() == 0
    (on_disk[0].parent / f".{on_disk[0].name}.crc").unlink()
    on_disk[0].write_bytes(on_disk[1].read_bytes())
    assert [r.path.rsplit("/", 1)[-1] for r in runs.verify(spark, root).collect()] == [on_disk[0].name]
    with pytest.raises(ValueError, match="has changed"):
        runs.publish_marts(spark, root, marts)


def archive(path, members, kind=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", kind) as z:
        for name, text in members:
            z.writestr(name, text)
    return str(path)


@pytest.mark.parametrize("kind", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
@pytest.mark.parametrize("split", [1, 13, 100, 1 << 20])
def test_ranges_bring_each_line_once(spark, tmp_path, kind, split):
    text = "id,name,x,unused\n" + "".join(f'{k},"é, {k}",{k / 2},{"y" * (k % 9)}\n' for k in range(4 if split == 1 else 12 if split < 100 else 500))
    a = archive(tmp_path / "a.zip", [("in/t.csv", text), ("u.csv", "a\n1")], kind)
    spark.dataSource.register(ArchiveSource)
    read = lambda m, s=None: (spark.read.format("csv_archive").schema(s) if s else spark.read.format("csv_archive")).option("member", m).option("splitBytes", split).load(a)
    df = read("t.csv", "x double, name string, id int")
    assert sorted(tuple(r) for r in df.collect()) == [(k / 2, f"é, {k}", k) for k in range(text.count("\n") - 1)]
    assert read("u.csv").collect() == [("1",)]
    if split == 100:
        assert df.rdd.getNumPartitions() > 50


def test_only_named_columns_are_parsed(tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    a = archive(tmp_path / "a.zip", [("t.csv", "a,b,c\n1,no number,3\n")])
    reader = ArchiveReader({"path": a, "member": "t.csv"}, StructType([StructField("c", LongType())]))
    assert [b.to_pydict() for p in reader.partitions() for b in reader.read(p)] == [{"c": [3]}]


def test_bad_archives_are_refused(tmp_path):
    from pyspark.sql.types import StructType

    for members, text in (([("../t.csv", "a\n")], "leaves"), ([("/t.csv", "a\n")], "leaves"), ([("c:\\t.csv", "a\n")], "leaves"), ([("x/t.csv", "a\n"), ("y/t.csv", "a\n")], "several"), ([("u.csv", "a\n")], "no t.csv")):
        a = archive(tmp_path / f"{hashlib.md5(str(members).encode()).hexdigest()}.zip", members)
        with pytest.raises((ValueError, FileNotFoundError), match=text):
            ArchiveReader({"path": a, "member": "t.csv"}, StructType([])).partitions()


def test_the_retail_panel_from_its_archive(spark, tmp_path):
    """Against the panel from the unpacked files, and by hand."""
    days = 40
    sales = "id,item_id,dept_id,cat_id,store_id,state_id," + ",".join(f"d_{d}" for d in range(1, days + 1)) + "\n"
    for k in range(8):
        sales += f"i{k}_S{k % 2},i{k},d,c{k % 3},S{k % 2},{'CA' if k % 2 else 'TX'}," + ",".join(str((k + d) % 5) for d in range(days)) + "\n"
    calendar = "date,wm_yr_wk,weekday,wday,month,year,d,event_name_1,event_type_1,event_name_2,event_type_2,snap_CA,snap_TX,snap_WI\n"
    calendar += "".join(f"x,{100 + d // 7},w,{d % 7 + 1},1,2020,d_{d + 1},{'fest' if d == 30 else ''},,,,{int(d == 35)},0,0\n" for d in range(days))
    prices = "store_id,item_id,wm_yr_wk,sell_price\n" + "".join(f"S{k % 2},i{k},{w},{1 + k + w / 1000}\n" for k in range(8) for w in range(101, 106) if k != 5)
    a = archive(tmp_path / "m.zip", [(f"data/{n}", t) for n, t in zip(retail.FILES, (sales, calendar, prices))])
    (tmp_path / "out").mkdir()
    files = retail.unpack(a, str(tmp_path / "out"))
    plain = retail.load_retail(spark, *(f"file://{files[n]}" for n in retail.FILES), n_series=5, history_days=21)
    own = retail.load_archive(spark, a, n_series=5, history_days=21, split_bytes=300)
    rows = {(r.series_id, r.date_idx): r for r in own.collect()}
    assert sorted(map(str, rows.values())) == sorted(map(str, plain.collect())) and len(rows) == 5 * 21
    for (s, d), r in rows.items():
        k, day = int(s[1]), d + 19
        assert r.sales == (k + day) % 5 and r.dow == day % 7 and r.promo == int(day == 30 or (day == 35 and k % 2 == 1))
        assert r.price > 0 and (k == 5 or abs(r.price - (1 + k + (100 + day // 7) / 1000)) < 1e-9)


