"""All registered queries of the core and the SQL that checks them."""

from __future__ import annotations

from tidemark.plans import checks, models, problems, series

FLAGSHIP = "p4_found"
QUERIES = problems.QUERIES | series.QUERIES | models.QUERIES | checks.QUERIES
ORACLE: dict[str, str] = problems.ORACLE | series.ORACLE | models.ORACLE | checks.ORACLE
