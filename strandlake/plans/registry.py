"""All registered queries; importing a module of queries adds them."""

from strandlake.plans import example_queries as _examples  # noqa: F401
from strandlake.plans import further_queries as _further  # noqa: F401
from strandlake.plans import more_queries as _more  # noqa: F401
from strandlake.plans import queries as _pileup  # noqa: F401
from strandlake.plans import site_queries as _sites  # noqa: F401
from strandlake.plans import variant_queries as _variants  # noqa: F401
from strandlake.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
