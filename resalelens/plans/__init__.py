"""The stand-in view over the test tables, written intermediate tables and
the query catalogue behind ``__spark_entry__``."""
