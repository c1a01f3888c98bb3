"""Ledgerloom: document and receipt analytics as Spark DataFrame operators."""
