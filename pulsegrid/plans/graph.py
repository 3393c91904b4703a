"""The analysis graph: named analyses that are functions of other analyses' results."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

Analysis = tuple[Callable[..., DataFrame], tuple[str, ...]]


def planned(analyses: Mapping[str, Analysis], inputs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The result of each analysis, a function and the names of the inputs and analyses before it that it reads.

    Each is planned once, however many read it; Spark runs what is asked for.
    """
    out = dict(inputs)
    for name, (run, upstream) in analyses.items():
        if name in out or any(u not in out for u in upstream):
            raise ValueError(f"{name} is there already, or what it reads is not")
        out[name] = run(*[out[u] for u in upstream])
    return {name: out[name] for name in analyses}
