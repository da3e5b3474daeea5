"""Operators that prepare large document collections for language-model training."""
