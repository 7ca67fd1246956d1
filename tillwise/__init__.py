"""Business analytics on Spark DataFrames: typing, cleaning, aggregates, labels, models, text."""

from tillwise.session import get_session

__all__ = ["get_session"]
