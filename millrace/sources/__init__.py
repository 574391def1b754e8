"""Tables that the jobs read."""

from .layout import SkewedKey, save_bucketed
from .tables import SCHEMAS, CatalogTables, Tables

__all__ = ["SCHEMAS", "CatalogTables", "SkewedKey", "Tables", "save_bucketed"]
