"""Structured Streaming forms of resumable collection, budgets, rate limits and plateaus."""
