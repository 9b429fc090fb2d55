"""Spark Column expressions: text (F-1..F-6, F-15), rand (F-21), vector
(F-9..F-12) and activation (F-7, F-8, F-20)."""
