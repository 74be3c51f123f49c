"""Functions of the weftline engine."""
