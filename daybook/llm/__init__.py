"""Operators for preparing language-model training data; nothing else in daybook imports them."""
