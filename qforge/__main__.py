"""Command line: the workflows a user triggers, on any Spark master.

  python -m qforge analyze  --data DIR [--out DIR] [--num-files N|all] [--threshold 0.05] [--trees 200]
  python -m qforge merge    --data DIR --out DIR [--num-files N|all]
  python -m qforge upload   --landing DIR FILE [FILE ...]
  python -m qforge result   --out DIR NAME [--format parquet|json]
  python -m qforge files    --data DIR

Results are printed as small tables; everything else stays in the output folder.
"""

from __future__ import annotations

import argparse
import sys


def _num(v: str):
    return None if v == "all" else int(v)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="qforge")
    p.add_argument("--master", default=None, help="Spark master (default: the environment's)")
    sub = p.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("analyze", help="full pipeline: merge, clean, quality, EDA, model, safe region")
    a.add_argument("--data", required=True)
    a.add_argument("--out", default=None)
    a.add_argument("--num-files", type=_num, default=2)
    a.add_argument("--threshold", type=float, default=0.05)
    a.add_argument("--trees", type=int, default=200)
    a.add_argument("--min-samples-split", type=int, default=2)
    a.add_argument("--no-resume", action="store_true", help="do every stage again")
    a.add_argument("--missing", choices=["drop", "fill"], default="drop")
    a.add_argument("--multiline", action="store_true", help="quoted fields may contain line breaks")
    m = sub.add_parser("merge", help="latest N sensor files -> one typed Parquet table")
    m.add_argument("--data", required=True)
    m.add_argument("--out", required=True)
    m.add_argument("--num-files", type=_num, default=2)
    m.add_argument("--multiline", action="store_true", help="quoted fields may contain line breaks")
    u = sub.add_parser("upload", help="ingest offered files; append the good ones to a landing table")
    u.add_argument("--landing", required=True)
    u.add_argument("files", nargs="+")
    r = sub.add_parser("result", help="read a result table back")
    r.add_argument("--out", required=True)
    r.add_argument("name")
    r.add_argument("--format", default=None, help="default: the format it was written in")
    f = sub.add_parser("files", help="sensor file count and names")
    f.add_argument("--data", required=True)
    args = p.parse_args(argv)

    from qforge.session import get_session
    spark = get_session(args.master)
    from qforge.plans import pipeline as P
    if args.cmd == "analyze":
        P.run_full_pipeline(spark, args.data, args.out, num_files=args.num_files,
                            prob_threshold=args.threshold, n_trees=args.trees,
                            missing_method=args.missing, multiline=args.multiline,
                            min_samples_split=args.min_samples_split, resume=not args.no_resume
                            ).show(truncate=False, vertical=True)
    elif args.cmd == "merge":
        res = P.merge_sensor_files(spark, args.data, args.num_files, args.out, args.multiline)
        P.ResultSet(spark, args.out).commit({"combined": {"path": "combined", "format": "parquet"}})
        res.summary.show(truncate=False, vertical=True)
        res.file_summary.show(truncate=False)
    elif args.cmd == "upload":
        from qforge.sources import csv_ingest as CI
        CI.land_uploads(spark, args.files, args.landing).show(truncate=False)
    elif args.cmd == "result":
        P.read_result(spark, args.out, args.name, args.format).show(50, truncate=False)
    elif args.cmd == "files":
        from qforge.sources import manifest as MF
        MF.sensor_file_info(spark, args.data).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
