"""Run reports from the command line.

    python -m cartwheel list
    python -m cartwheel show  --path DIR s03_gsearch_cvr [more keys]
    python -m cartwheel write --path DIR --out OUT [--stage] [keys]   # parquet per report

``DIR`` holds the five shop tables as parquet or an ``events.parquet``
to derive them from; ``--stage`` derives and writes the tables once
before the reports run.
"""

from __future__ import annotations

import argparse
import os

from cartwheel.plans.catalog import REPORTS
from cartwheel.session import build_session
from cartwheel.sources import open_shop, stage_shop


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="cartwheel")
    ap.add_argument("command", choices=["list", "show", "write"])
    ap.add_argument("keys", nargs="*")
    ap.add_argument("--path", default="/root/testdata/sf0.01")
    ap.add_argument("--out")
    ap.add_argument("--stage", action="store_true")
    args = ap.parse_intermixed_args(argv)
    if args.command == "list":
        print("\n".join(REPORTS))
        return
    keys = args.keys or list(REPORTS)
    unknown = [k for k in keys if k not in REPORTS]
    if unknown:
        ap.error(f"unknown report(s): {unknown}")
    spark = build_session()
    if args.stage:
        stage_shop(spark, args.path)
    shop = open_shop(spark, args.path)
    for key in keys:
        df = REPORTS[key](shop)
        if args.command == "show":
            print(f"== {key}")
            df.show(50, truncate=False)
        else:
            if not args.out:
                ap.error("write needs --out")
            df.write.mode("overwrite").parquet(os.path.join(args.out, f"{key}.parquet"))


if __name__ == "__main__":
    main()
