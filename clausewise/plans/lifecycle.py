"""Findings' states from their log of events.

An event is a function from each state to the next one, and the number of events refused on the way. Functions
compose associatively: events of a range of numbers fold to one function, ranges of ranges to one, and so on, so
that no task has a finding's whole log, however long it is.

Rules: a finding is created once, and only on evidence that is current; one that waits for review is reviewed once;
changed evidence makes any finding stale; a stale one may be submitted again on current evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States in the order of their numbers, the first is that of a finding that isn't there.
STATES = ("NONE", "PENDING_REVIEW", "CONFIRMED", "DISMISSED", "STALE")
#: Numbers of one range of a log.
RANGE = 4096


def _moves(**to: str) -> Column:
    """For each state the next and whether the event is refused; states that aren't named refuse it."""
    return F.array(*[F.struct(F.lit(STATES.index(to.get(s, s))).alias("to"), F.lit(0 if s in to else 1).cast("long").alias("refused")) for s in STATES])


def event(kind: Column, current: Column) -> Column:
    """The function of an event CREATE, CONFIRM, DISMISS, CHANGE or RESUBMIT; `current`: its evidence is current, null counts as not."""
    refused, live = _moves(), F.coalesce(current, F.lit(False))
    change = {s: "STALE" for s in STATES[1:]}
    return (
        F.when((kind == "CREATE") & live, _moves(NONE="PENDING_REVIEW"))
        .when((kind == "CONFIRM") & live, _moves(PENDING_REVIEW="CONFIRMED"))
        .when(kind == "DISMISS", _moves(PENDING_REVIEW="DISMISSED"))
        .when(kind == "CHANGE", _moves(**change))
        .when((kind == "RESUBMIT") & live, _moves(STALE="PENDING_REVIEW"))
        .otherwise(refused)
    )


def composed(first: Column, then: Column) -> Column:
    """One function after the other."""
    return F.transform(first, lambda x: F.struct(then[x.to].to.alias("to"), (x.refused + then[x.to].refused).alias("refused")))


def _identity() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("to"), F.lit(0).cast("long").alias("refused")) for i in range(len(STATES))])


def states(log: DataFrame, key: str, order: str, kind: str, current: str) -> DataFrame:
    """(key, status, refused) of a log (key, order: whole numbers from 0 without repeats, kind, current).

    Repeated numbers are in no set order. A finding whose events were all refused is NONE.
    """
    rows = log.select(key, F.col(order).cast("long").alias("at"), event(F.col(kind), F.col(current)).alias("f"))
    most = rows.agg(F.max("at")).first()[0] or 0
    while True:
        folded = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "f"))), _identity(), lambda a, x: composed(a, x.f))
        rows = rows.groupBy(key, F.floor(F.col("at") / RANGE).alias("range")).agg(folded.alias("f")).select(key, F.col("range").alias("at"), "f")
        most //= RANGE
        if not most:
            break
    last = F.col("f")[0]
    return rows.select(key, F.element_at(F.array(*map(F.lit, STATES)), last.to + 1).alias("status"), last.refused.alias("refused"))
