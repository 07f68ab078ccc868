"""Retail analytics on Spark: shop queries, data-quality checks and bulk table maintenance.

Every public operator takes DataFrames (or a :class:`~boutique.sources.tables.Tables` bundle)
and returns a lazy DataFrame; nothing is collected to the driver.
"""

from boutique.session import build_session, materialize, ensure_checkpoint_dir
from boutique.sources.tables import Tables

__all__ = ["Tables", "build_session", "materialize", "ensure_checkpoint_dir"]
