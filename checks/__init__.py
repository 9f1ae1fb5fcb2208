"""Every operator bound to the test tables, with the same result stated in plain SQL."""

from checks import aggregation, cleaning, domain, displacement, joining, scans, sheets, windows  # noqa: F401
from checks.views import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
