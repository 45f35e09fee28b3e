"""All registered queries."""

from spectraline.plans import features, signal  # noqa: F401
from spectraline.plans.registry import ORACLE, QUERIES  # noqa: F401
