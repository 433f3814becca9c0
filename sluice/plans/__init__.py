"""Named queries on the star-schema tables, each beside its SQL."""

from . import account, activity, browse, catalog, decode, ingest, library, listing, maintenance, orphans, writes
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "account", "activity", "browse", "catalog", "decode", "ingest", "library", "listing", "maintenance", "orphans", "writes"]
