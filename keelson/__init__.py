"""keelson: keyed table comparison, copying, change-log replay and corpus preparation on PySpark."""
