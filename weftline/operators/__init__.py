"""Operators of the weftline engine."""
