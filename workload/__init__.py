"""Every operator as a query over the given tables, with its SQL twin where SQL can say it."""

from workload.registry import ORACLE, QUERIES  # noqa: F401
from workload import (  # noqa: F401
    aggregates, columns, composites, evaluation, ordering, sources, spans, streams, text,
)
