"""Registered queries of the weftline engine: each a DataFrame plan with the SQL that it is held against."""
