"""CSV ingest on hand-made files: encodings, BOM, NA tokens, name rules."""

import os
import time

import pytest

from qforge.plans import pipeline as P
from qforge.sources import csv_ingest as CI
from qforge.sources import manifest as MF

HEADER_KO = "온도,습도,압력,불량여부"


def _write(path, text, enc="utf-8", mtime=None):
    with open(path, "wb") as f:
        f.write(text.encode(enc))
    if mtime:
        os.utime(path, (mtime, mtime))


@pytest.fixture()
def folder(tmp_path):
    t0 = time.time() - 1000
    _write(tmp_path / "a.csv", HEADER_KO + "\n10.5,40,100,0\n20.5,50,110,1\n", mtime=t0 + 1)
    _write(tmp_path / "b.csv", HEADER_KO + "\n30.5,60,120,0\n", "utf-8-sig", mtime=t0 + 2)
    _write(tmp_path / "c.csv", HEADER_KO + ",메모\n40.5,70,130,1,뷁\n", "cp949", mtime=t0 + 3)
    _write(tmp_path / "d.csv", HEADER_KO + "\nNA,NaN,140,0\nnull,N/A,,1\n", mtime=t0 + 4)
    _write(tmp_path / "Error_log.csv", "x\n1\n", mtime=t0 + 9)
    _write(tmp_path / "f.csv", HEADER_KO + "\n", mtime=t0 + 5)
    _write(tmp_path / "notes.txt", "hello\n", mtime=t0 + 6)
    return str(tmp_path)


def test_read_mixed_encodings(spark, folder):
    paths = [r.path for r in MF.sensor_files(MF.file_manifest(spark, folder)).collect()]
    assert sorted(p.rsplit("/", 1)[-1] for p in paths) == ["a.csv", "b.csv", "c.csv", "d.csv", "f.csv"]
    infos = {i.file_name: i for i in CI.inspect_files(spark, paths)}
    assert infos["c.csv"].charset == "cp949" and infos["b.csv"].charset == "utf-8"
    assert infos["c.csv"].columns == ["temp", "humid", "press", "error", "메모"]
    df = CI.read_csv_files(spark, paths, infos=list(infos.values()))
    types = dict(df.dtypes)
    assert types["temp"] == "double" and types["error"] == "bigint" and types["press"] == "double"
    rows = {r.temp: r for r in df.collect() if r.temp is not None}
    assert rows[40.5]["메모"] == "뷁"
    assert rows[10.5]["메모"] is None
    assert df.count() == 6
    assert df.where("temp is null").count() == 2 and df.where("humid is null").count() == 2
    assert df.where("press is null").count() == 1


def test_file_summary_and_report(spark, folder):
    paths = [r.path for r in MF.file_manifest(spark, folder, "*").collect()]
    rep = {r.file_name: r for r in CI.ingest_report(spark, paths).collect()}
    assert rep["notes.txt"].status == "failed"
    assert rep["f.csv"].rows == 0 and rep["f.csv"].cols == 4
    assert rep["c.csv"].cols == 5 and rep["a.csv"].rows == 2


def test_latest_and_missing(spark, folder, tmp_path):
    top = [r.file_name for r in MF.latest_files(MF.sensor_files(MF.file_manifest(spark, folder)), 2).collect()]
    assert top == ["f.csv", "d.csv"]
    assert MF.file_manifest(spark, str(tmp_path / "nope")).count() == 0
    with pytest.raises(FileNotFoundError):
        P.merge_sensor_files(spark, str(tmp_path / "nope"))


def test_merge_latest_two(spark, folder, tmp_path):
    res = P.merge_sensor_files(spark, folder, 2, str(tmp_path / "out"))
    s = res.summary.first()
    assert (s.sensor_file_count, s.processed_file_count, s.combined_rows, s.combined_cols) == (5, 2, 2, 4)
    assert s.all_files_rows == 6


def test_land_uploads_and_text_profile(spark, folder, tmp_path):
    paths = [r.path for r in MF.file_manifest(spark, folder, "*").collect()]
    landing = str(tmp_path / "landing")
    rep = CI.land_uploads(spark, [p for p in paths if "Error" not in p], landing)
    assert rep.where("status = 'failed'").count() == 1          # notes.txt
    landed = spark.read.parquet(landing)
    assert landed.count() == 6 and "_source_file" in landed.columns and "_ingested_at" in landed.columns
    prof = {r.column: r for r in CI.dataset_profile(landed.drop("_ingested_at")).collect()}
    assert prof["메모"].unique == 1 and prof["메모"].top == "뷁" and prof["메모"].freq == 1
    assert prof["temp"].unique is None and prof["temp"]["count"] == 4


def test_cp949_decided_by_python_codec(spark, tmp_path):
    from qforge.sources import encoding as enc
    p = tmp_path / "odd.csv"
    with open(p, "wb") as f:
        f.write("온도,비고\n1.0,".encode("cp949") + b"\xfe\xfe\n")
    ok = tmp_path / "ok.csv"
    with open(ok, "wb") as f:
        f.write("온도,비고\n1.0,뷁\n".encode("cp949"))
    paths = [str(p), str(ok)]
    got = {r.path.rsplit("/", 1)[-1]: r.charset for r in enc.detect(spark, paths, enc.ANALYSIS_CHAIN).collect()}
    assert got == {"odd.csv": None, "ok.csv": "cp949"}
    up = {r.path.rsplit("/", 1)[-1]: r.charset for r in enc.detect(spark, paths, enc.UPLOAD_CHAIN).collect()}
    assert up == {"odd.csv": "latin-1", "ok.csv": "cp949"}


def test_type_inference_shapes(spark):
    rows = [("1", "1.5", "1e3", "12345678901234567890", "1.5d", "True", "a"),
            ("-2", " 2 ", "inf", "1", "2.0", "false", "3"),
            (None, "-.5", "-Infinity", "2", "3", None, None)]
    cols = ["i", "f", "e", "big", "javafloat", "b", "mixed"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    types = CI.infer_types(df, cols)
    assert types == {"i": "double", "f": "double", "e": "double", "big": "double",
                     "javafloat": "string", "b": "boolean", "mixed": "string"}
    full = spark.createDataFrame([("1",), ("-2",), ("+3",)], "i string")
    assert CI.infer_types(full, ["i"]) == {"i": "bigint"}
    typed = CI.apply_types(df, types).collect()
    assert typed[1]["e"] == float("inf") and typed[2]["f"] == -0.5 and typed[0]["big"] == 1.2345678901234567e19


def test_select_latest_errors(spark, folder, tmp_path):
    with pytest.raises(FileNotFoundError):
        MF.select_latest_sensor_files(spark, str(tmp_path / "missing"))
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(ValueError):
        MF.select_latest_sensor_files(spark, str(empty))
    _, chosen = MF.select_latest_sensor_files(spark, folder, 2)
    assert [c.rsplit("/", 1)[-1] for c in chosen] == ["f.csv", "d.csv"]


def test_clashing_header_fails_alone(spark, folder, tmp_path):
    bad = tmp_path / "clash.csv"
    with open(bad, "wb") as f:
        f.write("온도,temp\n1,2\n".encode("utf-8"))
    paths = [str(tmp_path / "a.csv"), str(bad)]
    rep = {r.file_name: r for r in CI.ingest_report(spark, paths).collect()}
    assert rep["a.csv"].status == "success"
    assert rep["clash.csv"].status == "failed" and "normalise" in rep["clash.csv"].error


def test_korean_file_name_with_space(spark, tmp_path):
    d = tmp_path / "kr"
    d.mkdir()
    _write(d / "센서 데이터.csv", "온도,비고\n1.5,뷁\n", "cp949")
    paths = [r.path for r in MF.file_manifest(spark, str(d)).collect()]
    infos = CI.inspect_files(spark, paths)
    assert infos[0].charset == "cp949" and infos[0].file_name == "센서 데이터.csv"
    assert [tuple(r) for r in CI.read_csv_files(spark, paths, infos=infos).collect()] == [(1.5, "뷁")]


def test_crlf_quoted_header_and_trailing_comma(spark, tmp_path):
    d = tmp_path / "shapes"
    d.mkdir()
    _write(d / "crlf.csv", '"온도","습도",압력,불량여부,\r\n1.5,40,100,0,\r\n2.5,NA,110,1,\r\n')
    paths = [r.path for r in MF.file_manifest(spark, str(d)).collect()]
    df = CI.read_csv_files(spark, paths)
    assert df.columns == ["temp", "humid", "press", "error", "unnamed__4"]
    assert [tuple(r)[:4] for r in df.orderBy("temp").collect()] == [(1.5, 40.0, 100, 0), (2.5, None, 110, 1)]


def test_multiline_records(spark, tmp_path):
    d = tmp_path / "ml"
    d.mkdir()
    _write(d / "m.csv", '온도,메모\n1.5,"first line\nsecond line"\n2.5,plain\n')
    res = P.merge_sensor_files(spark, str(d), None, str(tmp_path / "out"), multiline=True)
    rows = sorted(tuple(r) for r in res.combined.select("temp", "메모").collect())
    assert rows == [(1.5, "first line\nsecond line"), (2.5, "plain")]
    s = res.summary.first()
    assert s.combined_rows == 2 and s.all_files_rows == 2
    assert res.file_summary.first().rows == 2


def test_batch_with_no_good_file_fails(spark, tmp_path):
    d = tmp_path / "bad"
    d.mkdir()
    _write(d / "notes.txt", "hello\n")
    _write(d / "empty.csv", "")
    paths = [str(d / "notes.txt"), str(d / "empty.csv")]
    rep = {r.file_name: r.status for r in CI.ingest_report(spark, paths).collect()}
    assert rep == {"notes.txt": "failed", "empty.csv": "failed"}
    with pytest.raises(ValueError):
        CI.land_uploads(spark, paths, str(tmp_path / "landing"))


def test_csv_quotes_and_backslashes(spark, tmp_path):
    """Doubled quotes belong to the cell and a backslash is plain text, as in pandas."""
    from qforge.sources import csv_ingest as CI
    p = tmp_path / "q.csv"
    p.write_text('temp,note,humid\n1.5,"a ""b"", c",2\n2.5,"x\\",3\n', encoding="utf-8")
    got = CI.read_group(spark, [str(p)], "utf-8", ["temp", "note", "humid"]).select("temp", "note", "humid").collect()
    assert [tuple(r) for r in got] == [("1.5", 'a "b", c', "2"), ("2.5", "x\\", "3")]
