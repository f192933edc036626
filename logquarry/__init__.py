"""Log analytics on Spark: parse, query, redact, diagnose and report."""
