"""cartwheel: web-shop analytics as Spark DataFrame jobs.

Sessions, page views, orders, order items and refunds go in as
DataFrames; every report is a DataFrame -> DataFrame function whose
dates, pages and channels are parameters (the defaults are the values
the original analysis used).
"""

from cartwheel.session import build_session, checkpoint_dir
from cartwheel.sources.tables import ShopTables, open_shop, stage_shop

__all__ = ["ShopTables", "build_session", "checkpoint_dir", "open_shop", "stage_shop"]
