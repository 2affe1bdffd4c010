"""Partition metadata synchronisation on Spark: DataFrame operators, sources, plans and streams."""
