"""Works-coordination analytics on PySpark: all sites in one distributed pass."""
