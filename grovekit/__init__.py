"""grovekit: DataFrame operators for large point-and-polygon inventories."""
