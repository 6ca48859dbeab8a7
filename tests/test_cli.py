"""Command line: merge and result read-back over CSV files derived from the small tables."""

from conftest import SF_SMALL
from qforge.__main__ import main
from qforge.plans import pipeline as P
from qforge.sources import fixture_files as FF


def test_cli_merge_and_result(spark, tmp_path, capsys):
    data = FF.write_sensor_csvs(spark, SF_SMALL, str(tmp_path / "csv"))
    out = str(tmp_path / "out")
    assert main(["merge", "--data", data, "--out", out, "--num-files", "all"]) == 0
    assert P.read_result(spark, out, "combined").count() == 1000
    assert main(["files", "--data", data]) == 0
    assert main(["result", "--out", out, "combined"]) == 0
    printed = capsys.readouterr().out
    assert "combined_rows" in printed and "sensor_file_count" in printed
