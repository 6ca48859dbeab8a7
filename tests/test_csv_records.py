"""Records that span lines, read by block: against Python's csv module and at every block size."""

import csv
import io
import random

import pytest

from qforge.sources import csv_ingest as CI
from qforge.sources import csv_records as REC


@pytest.fixture
def blocks(spark):
    """Set the block size (and no cost of opening a file, so that blocks are that small)."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def hostile(seed, rows):
    r = random.Random(seed)
    bits = ["a", "b,", '"', '""', "\n", "\n\n", "x\ny", " ", "한", ",", "\r\n", "'", "\\"]
    return [[f"{i}", "k" + "".join(r.choice(bits) for _ in range(r.randint(0, 9))) + "z", r.choice(["", "7", "q\"q"])] for i in range(rows)]


def written(path, rows, newline="\n", codec="utf-8"):
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=newline)
    w.writerow(["id", "note", "extra"])
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode(codec))
    return str(path)


@pytest.mark.parametrize("size,newline,codec,charset", [(150, "\n", "utf-8", "utf-8"), (300, "\r\n", "utf-8", "utf-8"),
                                                        (200, "\n", "cp949", "cp949"), (1 << 20, "\n", "utf-8", "utf-8")])
def test_records_are_those_of_the_csv_module(spark, tmp_path, blocks, size, newline, codec, charset):
    data = {f"f{k}.csv": hostile(k, 60) for k in range(2)}
    paths = [written(tmp_path / name, rows, newline, codec) for name, rows in data.items()]
    blocks(size)
    got = CI.read_group(spark, paths, charset, ["id", "note", "extra"], multiline=True)
    found = {}
    for r in got.collect():
        found.setdefault(r[CI.SOURCE_COL].rsplit("/", 1)[-1], []).append((r["id"], r["note"], r["extra"] or ""))
    for name, rows in data.items():
        assert sorted(found[name]) == sorted((a, b, c) for a, b, c in rows)
    if size < 1000:
        effects = REC.block_effects(spark, paths)
        assert effects.groupBy("path").count().where("count < 3").isEmpty()        # several parse tasks a file
        assert not REC.block_starts(effects).where("start").isEmpty()


def test_blocks_beyond_the_broadcast(spark, tmp_path, blocks, monkeypatch):
    rows = hostile(9, 60)
    path = written(tmp_path / "f.csv", rows)
    blocks(100)
    monkeypatch.setattr(REC, "MAX_BLOCKS", 0)
    got = CI.read_group(spark, [path], "utf-8", ["id", "note", "extra"], multiline=True).collect()
    assert sorted((r["id"], r["note"]) for r in got) == sorted((a, b) for a, b, _ in rows)


def test_a_cell_longer_than_many_blocks(spark, tmp_path, blocks):
    long = "\n".join(f'line {i} "quoted", and' for i in range(300))
    path = written(tmp_path / "f.csv", [["1", long, ""], ["2", "b\nc", ""], ["3", "d", ""]])
    blocks(128)
    got = {r["id"]: r["note"] for r in CI.read_group(spark, [path], "utf-8", ["id", "note", "extra"], multiline=True).collect()}
    assert got == {"1": long, "2": "b\nc", "3": "d"}


def test_quotes_inside_bare_cells_and_open_ends(spark, tmp_path, blocks):
    p = tmp_path / "f.csv"
    p.write_text('id,note\n1,5" pipe\n\n2,"a\nb"\n   \n3,say "x" now\n4,"never closed\n5,tail\n')
    for size in (1 << 20, 16):
        blocks(size)
        got = {r["id"]: r["note"] for r in CI.read_group(spark, [str(p)], "utf-8", ["id", "note"], multiline=True).collect()}
        assert got == {"1": '5" pipe', "2": "a\nb", "3": 'say "x" now', "4": "never closed\n5,tail"}
    empty = tmp_path / "e.csv"
    empty.write_text("id,note\n")
    assert CI.read_group(spark, [str(empty)], "utf-8", ["id", "note"], multiline=True).count() == 0


def test_state_machine():
    after = REC.inside_after
    assert [after(x, False) for x in (b"", b"a,b", b'"a', b'"a"', b'"a""', b'"a"",b"', b'x"y', b'a,"b', b'""', b'"",""', b'a "b,c"')] == [
        False, False, True, False, True, False, False, True, False, False, False]
    assert [after(x, True) for x in (b"", b'a"', b'a""', b'",b', b'","', b'"""', b'"" "')] == [True, False, True, False, True, False, False]
