"""Streaming of the weftline engine."""
