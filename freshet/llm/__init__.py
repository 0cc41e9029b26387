"""Operators for preparing large text corpora, one module each; nothing else in the library imports them."""
