"""All queries over the driver's tables, with SQL of equal meaning where there is one."""

from placelake.plans import checks, locations, markup, plain, runs, sites  # noqa: F401 (they register their queries)
from placelake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
