"""Every query of the ledger operators on the driver's tables, with the SQL it must agree with."""

from __future__ import annotations

from ledgerweave.plans import amounts, bound, chain, flows, history, holdings, inscribed, lookups, names, protocols, ranges, views
from ledgerweave.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "amounts", "bound", "chain", "flows", "history", "holdings", "inscribed", "lookups", "names", "protocols", "ranges", "views"]
