"""Relational building blocks: every function takes DataFrames and returns one."""
