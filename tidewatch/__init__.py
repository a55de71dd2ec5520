"""Tidewatch: network event analytics on Spark."""
