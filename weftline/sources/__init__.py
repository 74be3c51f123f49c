"""Sources of the weftline engine."""
