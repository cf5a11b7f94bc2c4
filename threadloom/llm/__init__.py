"""Operators for preparing training text at corpus scale."""
