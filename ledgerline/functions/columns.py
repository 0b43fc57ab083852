"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grown(ret: str | Column, over=None) -> Column:
    """Product of 1 + ret, as an aggregate or over a window: 0 from a total loss on, null without values.  A return below -1 raises."""
    value = F.col(ret) if isinstance(ret, str) else ret
    log = F.when(value > -1, F.log1p(value)).when(value < -1, F.raise_error(F.lit("a return below -1")).cast("double"))
    total, lost = F.sum(log), F.max((value == -1).cast("int"))
    if over is not None:
        total, lost = total.over(over), lost.over(over)
    return F.when(lost == 1, 0.0).otherwise(F.exp(total))


def elapsed_years(first: Column, last: Column) -> Column:
    """Calendar time in years of 365.2425 days, at least a day."""
    return F.greatest(F.datediff(last, first), F.lit(1)) / 365.2425


def uniform(*parts) -> Column:
    """A whole number below 2^32 from text, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def millis(at: str | Column) -> Column:
    """Milliseconds since 1970 of an instant, to the nearest one (halves away from zero) as DuckDB's ``epoch_ms`` has them; ``unix_millis`` cuts."""
    micros = F.unix_micros(at)
    away = micros + F.when(micros < 0, -500).otherwise(500)
    return ((away - away % 1000) / 1000).cast("long")
