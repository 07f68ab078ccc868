"""Money arithmetic: exact decimals inside, double only for the final output column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boutique.sources.schemas import MONEY


def line_total(
    price: str = "price", quantity: str = "quantity", freight: str = "freight_value"
) -> Column:
    """price * quantity + freight, with missing quantity 1, price 0, freight 0."""
    q = F.coalesce(F.col(quantity), F.lit(1))
    p = F.coalesce(F.col(price).cast(MONEY), F.lit(0).cast(MONEY))
    f = F.coalesce(F.col(freight).cast(MONEY), F.lit(0).cast(MONEY))
    return p * q + f


def as_amount(c: Column) -> Column:
    """Final presentation of an exact decimal sum."""
    return c.cast("double")
