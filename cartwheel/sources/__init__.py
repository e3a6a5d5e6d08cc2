"""Inputs: the five shop tables, stored or derived from a click stream."""

from cartwheel.sources.tables import SCHEMAS, ShopTables, catalog_shop, derive_shop, open_shop, stage_shop

__all__ = ["SCHEMAS", "ShopTables", "catalog_shop", "derive_shop", "open_shop", "stage_shop"]
