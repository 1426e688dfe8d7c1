"""Operators for preparing training corpora at scale.

Nothing outside this folder imports it.  Each module holds one operator as plain functions over DataFrames;
``queries.py`` binds them to the test tables.
"""
