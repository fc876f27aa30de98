"""Codebase analytics on PySpark."""
