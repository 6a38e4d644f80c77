"""Operators for preparing training text at scale; see the README for the methods."""
