"""Report-style analytics on Spark: SQL notebooks, fan-out with child reports,
JSON columns, layered settings and published archives."""
