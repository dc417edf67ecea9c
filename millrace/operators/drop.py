"""``drop``: keep the records whose condition fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.plans.frame import Frame


def drop(frame: Frame, props: dict, cond: Column | None) -> Frame:
    return frame.with_df(frame.df.filter(F.lit(False) if cond is None else ~cond))
