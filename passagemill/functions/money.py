"""Money and credits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dollars per credit, pesos per dollar, sales tax, payment fee, caps.
USD_PER_CREDIT, CLP_PER_USD, VAT, FEE, PACK_CAP = 0.001, 1000, 0.19, 0.035, 300
# Dollars per million tokens, in and out, for rows without a stored cost.
TOKEN_IN, TOKEN_OUT = 0.15, 0.60
# Credits a month, credits a day, members and price of each plan.
PLANS = {"gratis": (65, 10, 1, 0), "profesional": (2000, 150, 1, 10000), "director_tecnico": (40000, 2000, 10, 100000)}


def credits_for_cost(usd: Column) -> Column:
    """Whole credits that pay a cost: one at least, a rounding error above a whole number forgiven."""
    return F.greatest(F.lit(1), F.ceil(usd / USD_PER_CREDIT - 1e-9)).cast("long")


def net_clp(gross: Column) -> Column:
    """What is left of a price after tax and fee."""
    return gross / (1 + VAT) - gross * FEE


def cost_usd(stored: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """The stored cost, or else that of the tokens at the old prices."""
    return F.coalesce(stored, tokens_in * TOKEN_IN / 1e6 + tokens_out * TOKEN_OUT / 1e6)


def source_of_credit(cycle_used: Column, day_plan: Column, day_pack: Column, balance: Column, monthly: int, daily: int) -> Column:
    """plan while its cycle and day caps last, then pack while its balance and cap last, else why not."""
    return (
        F.when((cycle_used < monthly) & (day_plan < daily), "plan")
        .when((balance > 0) & (day_pack < PACK_CAP), "pack")
        .when(balance <= 0, F.when(cycle_used >= monthly, "no credits").otherwise("day cap"))
        .otherwise("pack cap")
    )
