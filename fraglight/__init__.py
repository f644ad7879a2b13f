"""Program-fragment and crash-triage analytics on PySpark."""
