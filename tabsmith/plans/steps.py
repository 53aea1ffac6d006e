"""Step specs -> ``pyspark.ml.Pipeline`` (S9, U3, PR24-PR26, M5).

A spec is a JSON list of ``{"name", "operation", "params"}``.  Fitting and
transforming are separate: fit on one table (e.g. the training split),
transform any other.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame

from tabsmith.operators.preprocess import OPERATIONS, Step, StepError


def load_spec(text: str) -> list[dict]:
    spec = json.loads(text)
    if not isinstance(spec, list):
        raise StepError("a step spec must be a JSON list of steps")
    for s in spec:
        if not isinstance(s, dict) or "operation" not in s:
            raise StepError(f"bad step {s!r}")
    return spec


def dump_spec(spec: list[dict]) -> str:
    return json.dumps(spec, indent=2, sort_keys=True)


def build(spec: list[dict]) -> Pipeline:
    return Pipeline(stages=[Step.from_spec(s) for s in spec])


def validate(df: DataFrame, spec: list[dict]) -> list[str]:
    """PR24: problems found from the schema alone (no job runs)."""
    errs = []
    cols = set(df.columns)
    for i, s in enumerate(spec):
        op = s.get("operation")
        p = s.get("params", {}) or {}
        if op not in OPERATIONS:
            errs.append(f"step {i} ({s.get('name', op)}): unknown operation '{op}'")
            continue
        if op == "feature_selection" and p.get("method") in ("select_k_best", "rfe"):
            t = p.get("target")
            if not t or t not in cols:
                errs.append(f"step {i} ({s.get('name', op)}): {p.get('method')} needs an existing target column")
        if op == "rename_columns":
            cols = {(p.get("mapping") or {}).get(x, x) for x in cols}
        if op == "drop_columns":
            cols -= set(p.get("columns") or [])
    return errs


def apply(df: DataFrame, spec: list[dict]) -> tuple[PipelineModel, DataFrame]:
    """PR26: fit each step on the output of the previous one and transform.

    A failing step is named in the raised error.
    """
    fitted = []
    cur = df
    for i, s in enumerate(spec):
        try:
            m = Step.from_spec(s).fit(cur)
            cur = m.transform(cur)
        except Exception as e:  # noqa: BLE001
            raise StepError(f"step {i} ({s.get('name', s.get('operation'))}) failed: {e}") from e
        fitted.append(m)
    return PipelineModel(stages=fitted), cur


def preview(df: DataFrame, spec: list[dict], upto: int, n: int = 12, order_by=None):
    """PR25: apply steps 0..upto; return (first n rows, (rows, cols)).

    With ``order_by`` the preview is the first n rows in that order (top-n per
    task, then merged); without it, any n rows.
    """
    _, out = apply(df, spec[: upto + 1])
    head = out.orderBy(*order_by).limit(n) if order_by else out.limit(n)
    return head, (out.count(), len(out.columns))


def strategy_groups(per_column: dict[str, str]) -> list[dict]:
    """M5: ``{column: strategy}`` -> one impute step per strategy (columns sorted)."""
    groups: dict[str, list[str]] = {}
    for col, strat in per_column.items():
        groups.setdefault(strat, []).append(col)
    out = []
    for strat in sorted(groups):
        params = {"columns": sorted(groups[strat]), "strategy": strat}
        if strat == "constant":
            params["fill_value"] = 0
        out.append({"name": f"impute_{strat}", "operation": "impute", "params": params})
    return out
