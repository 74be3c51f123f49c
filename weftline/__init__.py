"""weftline: a DataFrame-first analytics engine for language-model data, evaluation and rollouts."""

__version__ = "0.1.0"
