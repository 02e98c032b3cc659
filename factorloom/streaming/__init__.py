"""Streaming forms of event bars, sessions and ledgers."""
