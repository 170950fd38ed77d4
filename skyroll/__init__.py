"""skyroll: on-time flight analytics as Spark DataFrame jobs.

Raw flight files in two historical layouts are standardised into one typed
fact table; carrier, airport, month and network-wide measures are computed
from it, and ranking / share / insight queries run on top of those
aggregates. Everything is expressed with the DataFrame API so Catalyst
plans the scans, partial aggregations and shuffles.
"""

from skyroll.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
