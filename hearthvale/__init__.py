"""hearthvale — a PySpark-native analytics engine for the village-simulation
data model: normalising ETL, constraint audits, 25 parametrised analytic
queries and four incremental (micro-batch) stock/relationship updates.

Everything is a plain DataFrame function; Catalyst/AQE choose the physical plan.
"""

from hearthvale.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
