"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  Each module holds one operator with
its own general interface; :mod:`pulsegrid.llm.queries` applies the operators
to whole tables.
"""
