"""Governed analytics and knowledge-graph operators as PySpark DataFrame functions."""
