"""Ordered-data analytics on PySpark: symbol streams, numeric fields, grammars, motifs, governance."""
