"""Queries over the given tables; importing the package registers all of them."""

from riskloom.plans import activity, learning, messaging, preparation, quality  # noqa: F401
from riskloom.plans.registry import ORACLES, QUERIES  # noqa: F401
