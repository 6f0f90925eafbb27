"""Plan commands as a stream: the batch fold's state kept by plan."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame

from docloom.operators.plan import Plan

OUTPUT = "plan_id string, seq long, status string, error string"


def plan_updates(commands: DataFrame) -> DataFrame:
    """The outcome of each command of a stream (plan_id, seq, op, medication_id,
    args). ``create`` begins a plan, its args ``medication=field,field``; a second
    one fails, and so does any other before it. Commands of one batch are applied
    by seq."""

    def run(key: tuple, frames, state):
        plan = None
        if state.exists:
            held = json.loads(state.get[0])
            plan = Plan({m: (ok, held["left"][m]) for m, ok in held["verified"].items()})
            plan.times, plan.status = held["times"], held["status"]
        out = []
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for r in rows.itertuples():
            args = list(r.args) if r.args is not None else []
            if r.op == "create":
                error = None if plan is None else "plan exists"
                if plan is None:
                    parts = [a.partition("=") for a in args]
                    plan = Plan({m: (False, [f for f in fields.split(",") if f]) for m, _, fields in parts})
            else:
                error = "plan does not exist" if plan is None else plan.apply(r.op, r.medication_id, args)
            out.append((key[0], r.seq, plan.status if plan else None, error))
        if plan is not None:
            held = {"left": plan.left, "verified": plan.verified, "times": plan.times, "status": plan.status}
            state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["plan_id", "seq", "status", "error"])

    return commands.groupBy("plan_id").applyInPandasWithState(run, OUTPUT, "state string", "append", "NoTimeout")
