"""ledgerlark: lead and entity intelligence analytics as Spark DataFrame operators."""
