"""Relational operators over series, pages and reviews."""
