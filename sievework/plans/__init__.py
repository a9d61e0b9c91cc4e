"""Registered queries: what __spark_entry__ hands to the driver."""
