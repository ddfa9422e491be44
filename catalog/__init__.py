"""Every operator of the inventory as a query over the test tables, with its SQL where SQL can say it."""

from . import acquire, evaluate, features, loop, pool, prepare, scores, sinks, sources  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
