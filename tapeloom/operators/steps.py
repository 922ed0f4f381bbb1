"""Rule tables as steps of SQL expressions over a bar: projections that Catalyst folds into one, and that move no row."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounded values that lie midway are nudged up, so that engines don't part there.
NUDGE = 1e-9


def doubles(said: str) -> str:
    """Fractions as doubles: without an exponent they would be decimals, with decimal arithmetic."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", said)


@dataclass(frozen=True)
class Rules:
    """steps: columns by expression, each step sees those before it; out: what is kept, with digits where it is rounded; where: a last filter."""

    steps: tuple[dict[str, str], ...]
    out: dict[str, int | None]
    where: str = "true"

    def apply(self, df: DataFrame, *keys: str) -> DataFrame:
        for step in self.steps:
            df = df.selectExpr("*", *(f"{doubles(said)} AS {name}" for name, said in step.items()))
        columns = (F.col(c) if digits is None else F.round(F.col(c) + NUDGE, digits).alias(c) for c, digits in self.out.items())
        return df.filter(doubles(self.where)).select(*keys, *columns)

    def sql(self, source: str, *keys: str) -> str:
        """The same for a table or subquery."""
        for step in self.steps:
            source = "(SELECT *, " + ", ".join(f"{doubles(said)} AS {name}" for name, said in step.items()) + f" FROM {source})"
        columns = (c if digits is None else f"round({c} + 1e-9, {digits}) AS {c}" for c, digits in self.out.items())
        return f"SELECT {', '.join([*keys, *columns])} FROM {source} WHERE {doubles(self.where)}"


def rules(*steps: dict[str, str], out: str | None = None, where: str = "true") -> Rules:
    """out: names, with a colon and the digits where a value is rounded; all columns of the last step if not given."""
    named = out.split() if out else list(steps[-1])
    return Rules(steps, {n.partition(":")[0]: int(n.partition(":")[2]) if ":" in n else None for n in named}, where)


def ladder(value: str, *bands: tuple[float, str], rest: str, above: bool = True) -> str:
    """The name of the first band that the value is above (or below)."""
    sign = ">" if above else "<"
    return "CASE " + " ".join(f"WHEN {value} {sign} {bound} THEN '{name}'" for bound, name in bands) + f" ELSE '{rest}' END"


def named(**conditions: str) -> str:
    """The names whose condition holds, in order, joined by commas."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {said} THEN '{name}' END" for name, said in conditions.items()) + ")"


def points(base: float, *given: tuple[str, float]) -> str:
    return f"({base} + " + " + ".join(f"CASE WHEN {said} THEN {n} ELSE 0 END" for said, n in given) + ")"
