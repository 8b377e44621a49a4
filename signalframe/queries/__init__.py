"""Registered queries: name -> callable(spark, sf_dir), and the DuckDB SQL of each."""

from . import plans, signal, streams, text

QUERIES = signal.QUERIES | text.QUERIES | plans.QUERIES | streams.QUERIES
ORACLES = signal.ORACLES | text.ORACLES | plans.ORACLES | streams.ORACLES
