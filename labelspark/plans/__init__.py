"""Registered queries: each binds operators to the given tables and carries
the equivalent DuckDB SQL used as the correctness oracle (see ``catalog``)."""
