"""Result sets, the stage ledger of the pipeline, and the upload ledger."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from qforge.operators import forest as FO
from qforge.plans import pipeline as P
from qforge.plans import results as RS
from qforge.sources import csv_ingest as CI
from qforge.sources import fixture_files as FF


def test_readers_see_whole_versions(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    P.write_result(spark.range(3), out, "a")
    P.write_result(spark.range(5), out, "b", fmt="json")
    assert (P.read_result(spark, out, "a").count(), P.read_result(spark, out, "b").count()) == (3, 5)

    def killed(*args):
        raise KeyboardInterrupt
    with monkeypatch.context() as m:
        m.setattr(RS, "publish", killed)                   # the driver is lost between the data and the commit
        with pytest.raises(KeyboardInterrupt):
            P.write_result(spark.range(99), out, "a")
    assert P.read_result(spark, out, "a").count() == 3
    with monkeypatch.context() as m:
        m.setattr(RS, "write_table", lambda df, path, fmt="parquet": (df.limit(1).write.parquet(path), killed()))
        with pytest.raises(KeyboardInterrupt):             # and in the middle of the data
            P.write_result(spark.range(99), out, "a")
    assert P.read_result(spark, out, "a").count() == 3
    with pytest.raises(FileNotFoundError):
        P.read_result(spark, out, "missing")
    P.write_result(spark.range(7), out, "a", fmt="csv")
    assert P.read_result(spark, out, "a").select("id").count() == 7
    results = RS.ResultSet(spark, out)
    assert results.commits() == [f"{i:012d}.json" for i in (1, 2, 3)]
    gone = results.vacuum(keep=1)
    assert len(gone) == 3 and P.read_result(spark, out, "b").count() == 5 and len(results.commits()) == 1


def test_two_writers_keep_both_tables(spark, tmp_path, monkeypatch):
    one, two = (RS.ResultSet(spark, str(tmp_path / "out")) for _ in range(2))
    real, raced = RS.publish, []

    def race(s, path, value):
        if not raced:
            raced.append(1)
            two.write(spark.range(2), "second")
        return real(s, path, value)
    monkeypatch.setattr(RS, "publish", race)
    one.write(spark.range(1), "first")
    assert set(one.current()) == {"first", "second"} and len(one.commits()) == 2


def test_rerun_goes_on_after_the_last_stage(spark, tmp_path, monkeypatch):
    data = FF.write_sensor_csvs(spark, SF_SMALL, str(tmp_path / "csv"))
    out = str(tmp_path / "out")
    run = lambda **kw: P.run_full_pipeline(spark, data, out, num_files=None, n_trees=4, max_depth=4, **kw).first()
    calls = []
    for module, name in ((CI, "land_csv_files"), (P.C, "clean"), (P, "column_stats"), (P.E, "eda_tables"), (FO, "train_and_evaluate")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, _r=real, _n=name, **kw: (calls.append(_n), _r(*a, **kw))[1])
    with monkeypatch.context() as m:
        def lost(*a, **kw):
            raise RuntimeError("driver lost")
        m.setattr(P.FO, "train_and_evaluate", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            run()
    assert calls == ["land_csv_files", "clean", "column_stats", "eda_tables"]
    with pytest.raises(FileNotFoundError):                 # nothing is visible of a set that is not complete
        P.read_result(spark, out, "cleaned")
    row = run()
    assert row.stages_skipped == 4 and calls[4:] == ["train_and_evaluate"]
    assert P.read_result(spark, out, "split_sizes").first().asDict() == {"train_size": row.train_rows, "test_size": row.test_rows}
    model = P.read_result(spark, out, "metrics").where("metric = 'model'").first()
    assert model.text == "RandomForest" and model.value is None
    again = run()
    assert again.stages_skipped == 7 and again[:-1] == row[:-1] and len(calls) == 5
    assert run(prob_threshold=0.2).stages_skipped == 0     # other parameters: another run
    assert run(resume=False).stages_skipped == 0


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder / name)


def test_upload_ledger(spark, tmp_path, monkeypatch):
    landing = str(tmp_path / "landing")
    a = put(tmp_path / "x", "a.csv", "temp,humid,note\n1.5,2,p\n2.5,,p\nNA,4,q\n")
    twin = put(tmp_path / "y", "twin.csv", "temp,humid,note\n1.5,2,p\n2.5,,p\nNA,4,q\n")
    log = put(tmp_path / "x", "Error_b.csv", "temp\n7\n")
    bad = put(tmp_path / "x", "bad.csv", "temp,humid\n1,2,3\n")
    first = {r.file_name: r for r in CI.land_uploads(spark, [a, twin, log, bad], landing, batch="one").collect()}
    assert {n: r.status for n, r in first.items()} == {"a.csv": "success", "twin.csv": "duplicate", "Error_b.csv": "success", "bad.csv": "failed"}
    assert (first["a.csv"].is_sensor_file, first["Error_b.csv"].is_sensor_file) == (True, False)
    prof = {c.column: c for c in first["a.csv"].profile}
    assert (prof["temp"].null_count, prof["temp"]["count"], prof["temp"].p50, prof["note"].dtype, prof["note"].mean) == (1, 2, 2.0, "string", None)
    assert CI.read_landed(spark, landing).count() == 4
    new = put(tmp_path / "z", "new.csv", "temp,humid,note\n9,9,z\n")
    for _ in range(2):                                     # a retry changes nothing
        second = {r.file_name: r.status for r in CI.land_uploads(spark, [twin, new], landing, batch="two").collect()}
        assert second == {"twin.csv": "duplicate", "new.csv": "success"}
        assert CI.read_landed(spark, landing).count() == 5 and CI.read_ledger(spark, landing).count() == 3
    assert {r.file_name: r.status for r in CI.land_uploads(spark, [a, log], landing, batch="one").collect()} == {"a.csv": "success", "Error_b.csv": "success"}
    assert CI.read_landed(spark, landing).count() == 5
    # rows without their record (a driver lost in between) are not read
    spark.range(3).select(F.lit(1.0).alias("temp")).write.parquet(f"{landing}/_batch=lost")
    assert CI.read_landed(spark, landing).count() == 5
    monkeypatch.setattr(CI, "WHOLE_FILE", 10)              # large files: a digest of lines
    mixed = put(tmp_path / "z", "mixed.csv", "temp,humid,note\nNA,4,q\n1.5,2,p\n2.5,,p\n")
    one, other, third = CI.content_digests(spark, [a, mixed, new]).values()
    assert one == other != third
