"""Registered queries: each pairs a Spark plan with equivalent SQL."""
