"""pagemill: corpus cleaning as Spark jobs.

Every public operator is a function ``DataFrame -> DataFrame`` (or a ``Column -> Column``
expression builder) built on Spark's own expressions, joins, aggregates and windows.
"""

from pagemill.config import Config

__all__ = ["Config"]
