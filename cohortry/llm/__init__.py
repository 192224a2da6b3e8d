"""Operators for training corpora. Nothing outside this folder imports them."""
