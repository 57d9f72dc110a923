"""etaforge: delivery-time analytics as Spark DataFrame, SQL, ML and Structured Streaming jobs."""

from etaforge.session import get_spark, scratch_dir
from etaforge.sources.tables import DeliveryTables

__all__ = ["DeliveryTables", "get_spark", "scratch_dir"]
