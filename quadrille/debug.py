"""Solutions as a table of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.sources.ntriples import term_text


def tabulate(keys: DataFrame, order: tuple[str, ...] = (), most: int = 1000) -> str:
    """The first `most` solutions (one column of term keys a variable), numbered, a row a line; columns named in `order` come first.
    Unbound cells are blank."""
    names = [n for n in order if n in keys.columns] + [n for n in keys.columns if n not in order]
    rows = [[v or "" for v in r] for r in keys.select(*(F.when(F.col(f"`{n}`").isNotNull(), term_text(F.col(f"`{n}`"))).alias(n) for n in names)).limit(most).collect()]
    first = len(str(len(rows)))
    widths = [max([len(n), *(len(r[i]) for r in rows)]) for i, n in enumerate(names)]
    line = lambda head, cells: " | ".join([head.ljust(first), *(c.ljust(w) for c, w in zip(cells, widths))])
    return "\n".join([line("#", names), *(line(str(k + 1), r) for k, r in enumerate(rows))])
