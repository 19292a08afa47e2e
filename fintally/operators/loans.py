"""Loan amortization (exact integer fixed point) and pro-forma projection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fintally.functions.money import decimal_ratio, half_even

#: Fixed-point unit of rates and growth factors.
UNIT = 10**18
#: Loans whose schedules are one batch.
LOANS = 256
#: Principals and monthly rates below these run through the months together, in 64-bit halves of their products.
MOST_PRINCIPAL, MOST_RATE = 10**15, 10**17


def round_half_even(n: int, d: int) -> int:
    """n / d to the nearest integer, halves to even, for integers of any size."""
    whole, rest = divmod(abs(n), abs(d))
    whole += 2 * rest > abs(d) or (2 * rest == abs(d) and whole % 2 == 1)
    return -whole if (n < 0) != (d < 0) else whole


@lru_cache(maxsize=1 << 14)
def compound(rate: int, periods: int) -> int:
    """(1 + rate) to a power, in units of UNIT, each product rounded half to even; by squaring."""
    out, base = UNIT, UNIT + rate
    while periods:
        if periods & 1:
            out = round_half_even(out * base, UNIT)
        periods >>= 1
        if periods:
            base = round_half_even(base * base, UNIT)
    return out


def level_payment(balance: int, rate: int, periods: int) -> int:
    """The payment that retires a balance in equal instalments at a monthly rate."""
    if rate == 0:
        return round_half_even(balance, periods)
    factor = compound(rate, periods)
    return round_half_even(balance * rate * factor, UNIT * (factor - UNIT))


def checked(principal: int, term: int, steps: list[tuple[int, int]], interest_only: int) -> None:
    """Raises on a term or principal below one, no step, a first step after month 1, steps out of order, a negative rate
    or an interest-only period outside of the term."""
    months = [m for m, _ in steps]
    if term < 1 or principal < 1:
        raise ValueError("principal and term must be positive")
    if not steps or months[0] != 1 or any(b <= a for a, b in zip(months, months[1:], strict=False)):
        raise ValueError("rate steps must start at month 1 and rise")
    if any(r < 0 for _, r in steps) or not 0 <= interest_only < term:
        raise ValueError("rates must not be negative, and the interest-only period must be shorter than the term")


def schedule(principal: int, term: int, steps: list[tuple[int, int]], interest_only: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(month, payment, interest, principal, balance) of a loan; steps: (first month, annual rate in bps), re-amortized at each.

    Raises as checked() does.
    """
    checked(principal, term, steps, interest_only)
    rate_at, out, balance, payment = dict(steps), [], principal, None
    rate = 0
    for month in range(1, term + 1):
        if month in rate_at:
            rate, payment = round_half_even(rate_at[month] * UNIT, 120_000), None
        interest = round_half_even(balance * rate, UNIT)
        if month <= interest_only:
            out.append((month, interest, interest, 0, balance))
            continue
        if payment is None or month == interest_only + 1:
            payment = level_payment(balance, rate, term - month + 1)
        paid = payment if month < term else balance + interest
        down = min(paid - interest, balance)
        balance -= down
        out.append((month, down + interest, interest, down, balance))
    return out


SCHEDULE = "loan_id long, month int, payment_cents long, interest_cents long, principal_cents long, balance_cents long"


def amortize(loans: DataFrame) -> DataFrame:
    """The schedule of each loan: loan_id, principal_cents, term_months, steps array<struct<month, bps>>, interest_only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), LOANS):
                rows = []
                for loan in batch.iloc[at : at + LOANS].itertuples(index=False):
                    steps = [(int(s["month"]), int(s["bps"])) for s in loan.steps]
                    rows += [(loan.loan_id, *r) for r in schedule(int(loan.principal_cents), int(loan.term_months), steps, int(loan.interest_only))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEDULE.split(", ")])

    return loans.mapInPandas(run, SCHEDULE)


def debt_service(schedules: DataFrame, loans: DataFrame) -> DataFrame:
    """Annual debt service (twelve first amortizing payments) and total interest of each loan."""
    first = schedules.join(loans.select("loan_id", "interest_only"), "loan_id")
    return first.groupBy("loan_id").agg((F.min(F.when(F.col("month") == F.col("interest_only") + 1, F.col("payment_cents"))) * 12).alias("annual_debt_service"), F.sum("interest_cents").alias("total_interest"))


def interests(balance: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """balance * rate / UNIT for each pair of numbers from 0 to below UNIT, halves to even; exact, by halves of nine digits."""
    half = 10**9
    b1, b0 = np.divmod(balance, half)
    r1, r0 = np.divmod(rate, half)
    low = b0 * r0
    middle = b0 * r1 + b1 * r0 + low // half
    whole = b1 * r1 + middle // half
    twice = 2 * (middle % half * half + low % half)
    return whole + ((twice > UNIT) | ((twice == UNIT) & (whole % 2 == 1)))


def summarized(loans: list[tuple[int, int, list[tuple[int, int]], int]]) -> list[tuple[int, int]]:
    """(twelve first amortizing payments, total interest) of each loan (principal, term, steps, interest_only).

    All loans go through a month together, those of the longest terms first. Only level payments are computed loan by
    loan, one for each rate step. Loans beyond the bounds of interests() go through their own schedule.
    """
    out = [(0, 0)] * len(loans)
    small = []
    for i, (principal, term, steps, free) in enumerate(loans):
        checked(principal, term, steps, free)
        if principal < MOST_PRINCIPAL and all(r * UNIT < MOST_RATE * 120_000 for _, r in steps):
            small.append(i)
        else:
            months = schedule(principal, term, steps, free)
            out[i] = (12 * months[free][1], sum(m[2] for m in months))
    small.sort(key=lambda i: -loans[i][1])
    balance, terms, free = (np.array([loans[i][k] for i in small], np.int64) for k in (0, 1, 3))
    rate, payment, total, service = (np.zeros(len(small), np.int64) for _ in range(4))
    changes: dict[int, dict[int, int]] = {}
    due: dict[int, set[int]] = {}
    for at, i in enumerate(small):
        for month, bps in loans[i][2]:
            changes.setdefault(month, {})[at] = round_half_even(bps * UNIT, 120_000)
            due.setdefault(max(month, loans[i][3] + 1), set()).add(at)
        due.setdefault(loans[i][3] + 1, set()).add(at)
    for month in range(1, int(terms.max(initial=0)) + 1):
        n = int(np.searchsorted(-terms, -month, side="right"))
        for at, new in changes.get(month, {}).items():
            rate[at] = new
        for at in due.get(month, ()):
            if at < n:
                payment[at] = level_payment(int(balance[at]), int(rate[at]), int(terms[at]) - month + 1)
        interest = interests(balance[:n], rate[:n])
        total[:n] += interest
        paid = np.where(terms[:n] > month, payment[:n], balance[:n] + interest)
        down = np.where(free[:n] < month, np.minimum(paid - interest, balance[:n]), 0)
        balance[:n] -= down
        service[:n] = np.where(free[:n] + 1 == month, 12 * (down + interest), service[:n])
    for at, i in enumerate(small):
        out[i] = (int(service[at]), int(total[at]))
    return out


def summaries(loans: DataFrame) -> DataFrame:
    """Annual debt service and total interest of each loan, from its months in the task that makes them: no row for a month leaves it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            steps = [[(int(s["month"]), int(s["bps"])) for s in each] for each in batch["steps"]]
            rows = zip(batch["principal_cents"].tolist(), batch["term_months"].tolist(), steps, batch["interest_only"].tolist(), strict=True)
            found = summarized([(int(p), int(t), s, int(f)) for p, t, s, f in rows])
            yield pd.DataFrame({"loan_id": batch["loan_id"], "annual_debt_service": [a for a, _ in found], "total_interest": [b for _, b in found]})

    return loans.select("loan_id", "principal_cents", "term_months", "steps", "interest_only").mapInPandas(run, "loan_id long, annual_debt_service long, total_interest long")


def project(base: DataFrame) -> DataFrame:
    """Revenue, expense and cash flow of each projected year.

    base: entity_id, months_covered, revenue_cents, ratio_cents, fixed_cents, growth_bps array<int>. The base year is annualized;
    revenue compounds, rounded each year; ratio lines follow revenue, fixed lines stay.
    """
    annual = lambda c: half_even(F.col(c).cast("decimal(38,0)") * 12, F.col("months_covered")).cast("long")
    b = base.select("entity_id", "growth_bps", *(annual(c).alias(c) for c in ("revenue_cents", "ratio_cents", "fixed_cents")))
    grow = lambda acc, g: F.array_append(acc, half_even(F.element_at(acc, -1).cast("decimal(38,0)") * (g + 10_000), F.lit(10_000)).cast("long"))
    years = F.aggregate("growth_bps", F.array(F.col("revenue_cents")), grow)
    out = b.select("entity_id", "ratio_cents", "fixed_cents", F.col("revenue_cents").alias("base"), F.posexplode(years).alias("year", "revenue_cents")).where("year > 0")
    ratio = half_even(F.col("ratio_cents").cast("decimal(38,0)") * F.col("revenue_cents"), F.col("base")).cast("long")
    out = out.withColumn("opex_cents", F.when(F.col("base") == 0, 0).otherwise(ratio) + F.col("fixed_cents"))
    noi = F.col("revenue_cents") - F.col("opex_cents")
    margin = F.when(F.col("revenue_cents") > 0, decimal_ratio(noi, F.when(F.col("revenue_cents") > 0, F.col("revenue_cents")), 4))
    return out.select("entity_id", "year", "revenue_cents", "opex_cents", noi.alias("noi_cents"), margin.alias("margin_mantissa"))
