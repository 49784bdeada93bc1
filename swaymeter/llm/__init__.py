"""Operators for preparing training text: capture archives, filters, near-duplicates, classifiers, mixing."""
