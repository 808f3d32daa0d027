from ledgerlens.plans.registry import QUERIES, SQL  # noqa: F401
from ledgerlens.plans import cohorts, filings, finance, records, search  # noqa: F401  (each registers its queries)
