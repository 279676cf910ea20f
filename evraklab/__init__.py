"""Set-oriented processing of recognised business documents on Spark."""
