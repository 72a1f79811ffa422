"""coffer: ledger analytics and corpus preparation on PySpark."""
