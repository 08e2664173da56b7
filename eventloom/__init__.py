"""Coded event records on Spark: encoding, profiling, sequences and classification."""
