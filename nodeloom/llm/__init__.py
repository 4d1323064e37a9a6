"""Operators for preparing training text: quality, contamination, secrets, archives, near copies, personal data, URL rules, page extraction, weak labels, packing."""
