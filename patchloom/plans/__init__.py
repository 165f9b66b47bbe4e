"""Named queries over the driver tables and their DuckDB counterparts.

The tables stand in for code: orders are methods, line items statements, customers groups. Pairs of
code are generated from the orders by one SQL text that both engines evaluate.
"""

from patchloom.plans import code, forests, metrics, relational, tables, text, trees
from patchloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "code", "forests", "metrics", "relational", "tables", "text", "trees"]
