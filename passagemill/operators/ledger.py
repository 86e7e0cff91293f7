"""Credit ledgers: usage by cycle and day, and the decisions that depend on earlier ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import PACK_CAP


def cycle_start(start, now):
    """The last monthly anniversary of start that is not after now; month ends are clamped."""
    whole = F.floor(F.months_between(now, start)).cast("int")
    return start + F.make_interval(months=whole)


def decide_in_order(requests: DataFrame, monthly: int, daily: int, pack: int) -> DataFrame:
    """Each request (user, day, seq) gets plan, pack or none, by what the user's earlier ones took.

    The caps interact, so the decision is a state carried in order.  A user's
    requests lie sorted in one partition and stream through batches; the state
    is a few numbers, however long the user's history is.
    """

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user = day = None
        cycle = used_plan = used_pack = 0
        left = pack
        for rows in batches:
            out = []
            for row in rows.itertuples():
                if row.user != user:
                    user, day, cycle, left = row.user, None, 0, pack
                if row.day != day:
                    day, used_plan, used_pack = row.day, 0, 0
                if cycle < monthly and used_plan < daily:
                    cycle, used_plan, source = cycle + 1, used_plan + 1, "plan"
                elif left > 0 and used_pack < PACK_CAP:
                    left, used_pack, source = left - 1, used_pack + 1, "pack"
                else:
                    source = "none"
                out.append(source)
            yield rows.assign(source=out)

    dealt = requests.select("user", "day", "seq").repartition("user").sortWithinPartitions("user", "day", "seq")
    return dealt.mapInPandas(decide, "user long, day string, seq long, source string")
