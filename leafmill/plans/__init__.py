"""Every query of this library by name, and its SQL."""

from leafmill.plans import docs, formulas, layout, more, pageset, paging, series, sheets  # noqa: F401
from leafmill.plans.series import O as ORACLES
from leafmill.plans.series import Q as QUERIES

__all__ = ["ORACLES", "QUERIES"]
