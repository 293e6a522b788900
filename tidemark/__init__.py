"""Operational data products on Spark: snapshot reconciliation, retention and savings, environment refresh and masking."""
