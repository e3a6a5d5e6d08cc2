"""Write PLANS.md: the final (post-AQE) physical plan trees of
representative reports at $BENCH_SF_DIR (default sf0.1) over the staged
tables, plus the plan that derives the page views from the click stream.

    python scripts/show_plans.py > PLANS.md
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cartwheel.plans.catalog import REPORTS  # noqa: E402
from cartwheel.session import build_session  # noqa: E402
from cartwheel.sources import derive_shop, open_shop, stage_shop  # noqa: E402

SHOWN = [
    "s03_gsearch_cvr",
    "s08_entry_pages",
    "s15_bounce_rate",
    "s22_ab_bounce",
    "s29_session_flags",
    "s56_billing_revenue",
    "s68_next_pageview",
    "s76_cart_metrics",
    "s81_repeat_histogram",
    "s89_quarter_channel_cvr",
    "s92_products_ctr",
    "s94_cross_sell_matrix",
]


LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
}
LARGE_SHOWN = ["s03_gsearch_cvr", "s68_next_pageview", "s79_repeat_pairs", "s92_products_ctr"]


def tree(df) -> str:
    df.collect()  # run it, so the adaptive plan is final
    text = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), "formatted"
    )
    lines = []
    for line in text.splitlines():
        if line.startswith("+- == Initial Plan =="):
            break
        lines.append(line)
    return "\n".join(lines).rstrip()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session()
    print("# Physical plans\n")
    print(f"Final adaptive plans at `{sf}` on local[8], staged tables (generated by `scripts/show_plans.py`).")
    print("At this size AQE broadcasts most filtered sides; at scale the same plans fall back to shuffled joins.\n")
    print("## Deriving the page views from the click stream\n")
    print("```\n" + tree(derive_shop(spark.read.parquet(f"{sf}/events.parquet")).pageviews) + "\n```\n")
    stage_shop(spark, sf)
    shop = open_shop(spark, sf)
    for key in SHOWN:
        print(f"## {key}\n")
        print("```\n" + tree(REPORTS[key](shop)) + "\n```\n")
    # the shape on large tables: nothing fits a broadcast, joins are
    # shuffled, and a hot session's partition is split by AQE
    print("# With broadcasts off and every partition treated as skewed\n")
    print("The same reports as a large cluster plans them: shuffled sort-merge joins, skew splits (`skew=true`).\n")
    for k, v in LARGE.items():
        spark.conf.set(k, v)
    for key in LARGE_SHOWN:
        print(f"## {key} (large-table shape)\n")
        print("```\n" + tree(REPORTS[key](shop)) + "\n```\n")


if __name__ == "__main__":
    main()
