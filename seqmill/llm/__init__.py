"""Operators for language-model training data; optional, imported by no other part."""
