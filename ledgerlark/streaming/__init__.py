"""Structured Streaming forms of the keyed ledger writes."""
