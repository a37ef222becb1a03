"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_IRREGULAR = r"^\s|\s$|\\|//|^/|/$|(^|/)\.\.?(/|$)"


def canonical_path(path: Column) -> Column:
    """One spelling per path: outer blanks, slash direction, repeated slashes, ``.`` and ``..`` steps.

    Null stays null. A ``..`` above the root is kept. Letter case is kept. Regular paths take the
    cheap branch, so the fold only runs for the few that need it.
    """
    trimmed = F.regexp_replace(path, r"^\s+|\s+$", "")
    steps = F.filter(F.split(F.translate(trimmed, "\\", "/"), "/"), lambda s: (s != "") & (s != "."))

    def step(done: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("..")) != "..")
        return F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s))

    folded = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/")
    return F.when(path.rlike(_IRREGULAR), folded).otherwise(path)
