"""slotledger: warehouse-operations analytics as Spark DataFrame jobs."""

from slotledger.session import build_session
from slotledger.sources.warehouse import Warehouse

__all__ = ["Warehouse", "build_session"]
