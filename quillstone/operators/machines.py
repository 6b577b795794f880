"""Ordered state machines over logs of facts, as merged transition tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Machine:
    """``steps`` maps (state, fact) to the next state. A fact without a step leaves the state and is out of order."""

    start: str
    steps: dict[tuple[str, str], str] = field(default_factory=dict)

    @property
    def states(self) -> list[str]:
        return sorted({self.start, *(s for s, _ in self.steps), *self.steps.values()})


#: A bounded extraction: the model is called, its output archived, parsed and published; each may fail, and a run that has ended may be begun again.
EXTRACTION = Machine(
    "planned",
    {
        ("planned", "called"): "running",
        ("planned", "failed"): "runtime_failed",
        ("running", "archived"): "archived",
        ("running", "failed"): "archive_failed",
        ("archived", "parsed"): "parsed",
        ("archived", "abstained"): "abstained",
        ("archived", "failed"): "invalid_output",
        ("parsed", "published"): "succeeded",
        ("parsed", "failed"): "publish_failed",
        **{(ended, "called"): "running" for ended in ("runtime_failed", "archive_failed", "invalid_output", "publish_failed", "abstained")},
    },
)


def final_states(facts: DataFrame, machine: Machine, run: str, order: list[str], fact: str, stretch: Column) -> DataFrame:
    """``run, state, n_facts, n_out_of_order`` of each run of ``facts`` taken in ``order``.

    A stretch of a run comes to a small table: for each state it may be entered in, the state it is left in and the facts out of order. Tables of stretches are
    merged in order, so a run of any length is folded in many tasks. ``stretch`` must rise with ``order`` and bounds what is gathered into one row. Null facts are out of order.
    """
    states = machine.states
    table = F.create_map(*[F.lit(x) for (s, f), to in machine.steps.items() for x in (f"{s}>{f}", to)])

    def through(listed: Column, begin: str) -> Column:
        def step(done: Column, x: Column) -> Column:
            to = F.try_element_at(table, F.concat_ws(">", done["state"], F.coalesce(x["fact"], F.lit(""))))
            return F.struct(F.coalesce(to, done["state"]).alias("state"), (done["off"] + F.when(to.isNull(), 1).otherwise(0)).cast("long").alias("off"))

        return F.aggregate(listed, F.struct(F.lit(begin).alias("state"), F.lit(0).cast("long").alias("off")), step)

    rows = facts.select(run, stretch.alias("stretch"), F.struct(*[F.col(c) for c in order], F.col(fact).alias("fact")).alias("x"))
    listed = rows.groupBy(run, "stretch").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    tables = listed.select(run, "stretch", F.size("xs").cast("long").alias("n"), F.create_map(*[c for s in states for c in (F.lit(s), through(F.col("xs"), s))]).alias("leads"))
    merged = tables.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("stretch", "n", F.map_entries("leads").alias("leads")))).alias("ts"))

    def onward(done: Column, t: Column) -> Column:
        to = F.element_at(F.map_from_entries(t["leads"]), done["state"])
        return F.struct(to["state"].alias("state"), (done["off"] + to["off"]).alias("off"), (done["n"] + t["n"]).alias("n"))

    zero = F.lit(0).cast("long")
    end = F.aggregate("ts", F.struct(F.lit(machine.start).alias("state"), zero.alias("off"), zero.alias("n")), onward)
    return merged.select(run, end.alias("end")).select(run, "end.state", F.col("end.n").alias("n_facts"), F.col("end.off").alias("n_out_of_order"))
