"""Queries over the given tables, one or more for each operator."""

from . import fields, further, latest, models, more, motifs, streams, structure
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "fields", "further", "latest", "models", "more", "motifs", "streams", "structure"]
