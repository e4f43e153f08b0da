"""All queries of the library outside the corpus operators."""

from piiguard.plans import budget, contexts, elements, evaluation, geometry, pages, records, reports, results, text
from piiguard.plans.text import flagship

_MODULES = (text, elements, geometry, contexts, evaluation, pages, records, budget, results, reports)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

__all__ = ["ORACLES", "QUERIES", "flagship"]
