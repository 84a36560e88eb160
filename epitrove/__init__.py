"""Batch analytics for aligned protein sequences, peptides and binding predictions on PySpark."""
