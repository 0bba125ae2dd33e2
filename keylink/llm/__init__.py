"""Operators for the preparation of training text; nothing else in keylink imports them."""
