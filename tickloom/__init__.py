"""tickloom: market-bar and signal analytics as plain PySpark DataFrame jobs."""
