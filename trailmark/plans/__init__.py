"""Registered queries of the sighting engine, each with the SQL that it has to agree with."""

from . import analysis, evaluation, joins, lists, motion, pictures, retention, scalars, species, stateful, station, tensors
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analysis", "evaluation", "joins", "lists", "motion", "pictures", "retention", "scalars", "species", "stateful", "station", "tensors"]
