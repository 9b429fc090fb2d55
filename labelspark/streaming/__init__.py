"""Structured Streaming runner for the stateless, row-local operators."""
