"""Document analytics on Spark: DataFrame-first operators over document collections."""

from folioframe.session import session, table

__all__ = ["session", "table"]
