"""Operators for preparing training text: each stands alone, and nothing outside imports them."""
