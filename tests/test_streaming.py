"""Streaming landing: each file once, NA tokens, error logs skipped, replay-safe."""


import pytest

from qforge.sources import csv_ingest as CI
from qforge.streaming import sensor_stream, start_landing


def _write(path, text, enc="utf-8"):
    with open(path, "wb") as f:
        f.write(text.encode(enc))


def test_landing_available_now(spark, tmp_path):
    src = tmp_path / "incoming"
    src.mkdir()
    _write(src / "a.csv", "온도,습도,압력,불량여부\n10.5,40,100,0\nNA,50,110,1\n")
    _write(src / "Error_log.csv", "온도,습도,압력,불량여부\n1,1,1,1\n")
    out = str(tmp_path / "landing")
    ckpt = str(tmp_path / "ckpt")
    q = start_landing(spark, str(src), out, checkpoint=ckpt, available_now=True)
    q.awaitTermination(120)
    rows = spark.read.parquet(f"{out}/rows")
    assert rows.count() == 2
    assert rows.where("temp is null").count() == 1
    assert dict(rows.dtypes)["temp"] == "double"
    # a new file arrives: only it is read on the next run
    _write(src / "b.csv", "온도,습도,압력,불량여부\n30.5,60,120,0\n")
    q = start_landing(spark, str(src), out, columns=["temp", "humid", "press", "error"], charset="utf-8",
                      checkpoint=ckpt, available_now=True)
    q.awaitTermination(120)
    assert spark.read.parquet(f"{out}/rows").count() == 3
    counters = spark.read.parquet(f"{out}/batches").groupBy().sum("rows", "missing_temp").first()
    assert tuple(counters) == (3, 1)


HEADER = "온도,습도,압력,불량여부,비고\n"
COLUMNS = ["temp", "humid", "press", "error", "비고"]


def test_landing_of_probe_files(spark, tmp_path):
    """Ragged records and unfit values name their file, quoted line breaks and '1.0' are read; nothing is lost unseen."""
    src, out = tmp_path / "incoming", str(tmp_path / "landing")
    src.mkdir()
    files = {"plain": "1.5,40,100,0,ok\n2.5,41,101,1,\n", "float": "3.5,42,102,1.0,x\n4.5,43,103,,y\n5.5,44,104,0.0,z\n",
             "lines": '6.5,45,105,1,"a\nb, ""c"""\n7.5,46,106,0,d\n', "ragged": "8.5,47,107,1,e\n9.5,48,108,0,f,g\n",
             "half": "10.5,49,109,0.5,h\n11.5,50,110,1,i\n"}
    for name, text in files.items():
        _write(src / f"{name}.csv", HEADER + text)
    q = start_landing(spark, str(src), out, columns=COLUMNS, charset="utf-8", checkpoint=str(tmp_path / "ckpt"), available_now=True)
    q.awaitTermination(120)
    assert q.exception() is None
    got = sorted((r["temp"], r["error"], r["비고"]) for r in spark.read.parquet(f"{out}/rows").collect())
    assert got == [(1.5, 0, "ok"), (2.5, 1, None), (3.5, 1, "x"), (4.5, None, "y"), (5.5, 0, "z"), (6.5, 1, 'a\nb, "c"'), (7.5, 0, "d")]
    counters = spark.read.parquet(f"{out}/batches")
    assert tuple(counters.groupBy().sum("rows", "missing_error").first()) == (7, 1)
    said = {r[CI.SOURCE_COL].split("/")[-1]: (r["error"], r["rows"]) for r in spark.read.parquet(f"{out}/rejected").collect()}
    assert said == {"ragged.csv": (f"{CI.RAGGED}; first cell: 9.5", 2), "half.csv": ("a value of error is not bigint: 0.5", 2)}


@pytest.mark.parametrize("line", ["1,2,3,0,a,b", "1,2,3,0.5,a", "1,2,x,0,a"])
def test_stream_raises_by_name(spark, tmp_path, line):
    src = tmp_path / "incoming"
    src.mkdir()
    _write(src / "bad.csv", f"{HEADER}{line}\n")
    q = (sensor_stream(spark, str(src), COLUMNS).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ckpt"))
         .trigger(availableNow=True).start())
    with pytest.raises(Exception, match="bad.csv"):
        q.awaitTermination(120)
