"""Operators for preparing language-model training data; nothing else in thalweg imports this subpackage."""
