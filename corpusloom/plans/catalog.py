"""All registered queries."""

from corpusloom.plans import catalog_files, catalog_iterative, catalog_tables, catalog_text, catalog_vectors  # noqa: F401
from corpusloom.plans.registry import QUERIES  # noqa: F401
