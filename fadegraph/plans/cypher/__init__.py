"""A Cypher dialect compiled to DataFrame plans."""
from fadegraph.plans.cypher.compiler import run, update
from fadegraph.plans.cypher.parser import CypherError, parse

__all__ = ["CypherError", "parse", "run", "update"]
