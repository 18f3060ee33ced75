"""Operators: tables in, a DataFrame out."""
