"""Small column functions that several operators share."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def attribute(id_: Column) -> Column:
    """A vertex's attribute: its id mod 100."""
    return (id_ % 100).cast("int")


def clean(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)
