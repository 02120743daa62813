"""Registered queries, each with DuckDB SQL where SQL can express it."""
