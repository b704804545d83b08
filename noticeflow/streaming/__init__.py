"""Structured Streaming forms: events, ledgers and budgets."""
