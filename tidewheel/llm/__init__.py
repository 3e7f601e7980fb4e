"""Operators for preparing training data: ten operators, each usable by itself, and their queries."""
