"""Command line: ``python -m ledgerloom.cli --table1 FILE [--table2 FILE] [--table3-fields FILE] --out FOLDER``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ledgerloom import config
from ledgerloom.pipeline import run_pipeline


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--table1", required=True, help="report metadata export")
    p.add_argument("--table2", help="execution log export")
    p.add_argument("--table3-fields", help="data dictionary export")
    p.add_argument("--config", help="JSON or YAML settings")
    p.add_argument("--out", required=True)
    p.add_argument("--zone", default="UTC", help="zone of times that are written without one")
    p.add_argument("--date-order", default="MDY", choices=["MDY", "DMY", "YMD"])
    p.add_argument("--sensitive", action="store_true", help="mask people in the results")
    a = p.parse_args(argv)
    cfg = config.load(a.config)
    if a.sensitive:
        cfg = config.Settings(**{**vars(cfg), "sensitive": True})
    spark = SparkSession.builder.appName("ledgerloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    res = run_pipeline(spark, a.table1, a.table2, a.table3_fields, a.out, cfg, zone=a.zone, date_order=a.date_order)
    print({k: df.count() for k, df in res.tabs().items()})
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
