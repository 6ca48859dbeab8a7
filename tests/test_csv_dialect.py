"""CSV dialect: quoted line breaks, ragged rows, whole-line charset check, 64-bit integers."""

import pytest
from pyspark.errors import PySparkException

from qforge.sources import csv_ingest as CI
from qforge.sources import encoding as enc


def put(folder, name, data):
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder / name)


def test_quoted_line_breaks_are_found_by_file(spark, tmp_path):
    many = put(tmp_path, "many.csv", 'temp,note,humid\n1.5,"a\nb, ""c""",2\n2.5,x\\,3\n')
    flat = put(tmp_path, "flat.csv", 'temp,note,humid\n3.5,"p, q",4\n')
    infos = CI.inspect_files(spark, [many, flat])
    assert [(i.multiline, i.rows, i.error) for i in infos] == [(True, 2, None), (False, 1, None)]
    rows = CI.read_csv_files(spark, [many, flat], infos=infos).orderBy("temp").collect()
    assert [tuple(r) for r in rows] == [(1.5, 'a\nb, "c"', 2), (2.5, "x\\", 3), (3.5, "p, q", 4)]


def test_ragged_file_fails_by_name(spark, tmp_path):
    good = put(tmp_path, "good.csv", 'temp,humid\n1.5,2\n"2,5",\n3\n')
    long = put(tmp_path, "long.csv", "temp,humid\n1.5,2\n2.5,3,999,888\n")
    both = put(tmp_path, "both.csv", 'temp,humid\n"a\nb",2\n2.5,,3\n')
    report = {r.file_name: (r.status, r.rows) for r in CI.ingest_report(spark, [good, long, both]).collect()}
    assert report == {"good.csv": ("success", 3), "long.csv": ("failed", None), "both.csv": ("failed", None)}
    with pytest.raises(ValueError, match="long.csv"):
        CI.read_csv_files(spark, [good, long])
    with pytest.raises(PySparkException, match="more cells"):
        CI.read_group(spark, [long], "utf-8", ["temp", "humid"]).collect()
    assert CI.read_group(spark, [good], "utf-8", ["temp", "humid"]).count() == 3


def test_charset_check_sees_whole_lines(spark, tmp_path):
    p = put(tmp_path, "k.csv", "temp,note\n1,x\x01".encode() + "한글".encode("cp949") + b"\n")
    (row,) = enc.detect(spark, [p]).collect()
    assert row.charset == "cp949"
    assert CI.read_csv_files(spark, [p]).first().note == "x\x01한글"


def test_64_bit_integers_are_kept(spark, tmp_path):
    p = put(tmp_path, "i.csv", "a,b\n9223372036854775807,1\n-9223372036854775806,9223372036854775808\n")
    rows = CI.read_csv_files(spark, [p]).collect()
    assert {r.a for r in rows} == {9223372036854775807, -9223372036854775806}
    assert isinstance(rows[0].b, float)
