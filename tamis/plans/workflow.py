"""Run a workflow definition: a short fold of its steps over DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import cache, cached_property

from pyspark.sql import DataFrame

from tamis.functions.scalars import readable, schema_table, spark_type
from tamis.operators import aggregate as agg
from tamis.operators import charts, drift, join, kpi, project, quality, reshape, window
from tamis.session import materialize
from tamis.sinks import outputs
from tamis.sources.tables import open_source

# The document kind and the limits on its lists.
KIND = "AnalyticsWorkflow"
VERSION_SUFFIX = "/v1"
LIMITS = {"pipeline": 64, "kpis": 32, "visualizations": 32, "outputs": 8}
# Outputs that services render or deliver, and the names of the drift policy.
RENDERED = ("pdf", "pptx", "metabase", "webhook", "email")
POLICY = {"onNewField": "on_new_field", "onRemovedField": "on_removed_field", "onTypeChange": "on_type_change", "onRenamed": "on_renamed"}
NO_KPIS = "kpi_id string, label string, value double, unit string"


def _window_step(df: DataFrame, s: dict) -> DataFrame:
    if "expression" in s:
        # an expression over the step's own window, named w; Spark runs it as one plain window, so without a
        # partition the whole table would pass through one task, and the function form is asked for
        if not s.get("partitionBy"):
            raise ValueError(f"step '{s.get('id')}': a window expression needs partitionBy; without one use function and field")
        names = ", ".join("`" + p.replace("`", "``") + "`" for p in s["partitionBy"])
        fields = [(o, "ASC") if isinstance(o, str) else (o["field"], o["direction"]) for o in s.get("orderBy") or ()]
        order = ", ".join("`" + f.replace("`", "``") + f"` {d} NULLS LAST" for f, d in fields)
        over = f"OVER (PARTITION BY {names}" + (f" ORDER BY {order})" if order else ")")
        return project.computed(df, s["alias"], re.sub(r"\bOVER\s+w\b", lambda _: over, s["expression"], flags=re.IGNORECASE), s.get("type"))
    return window.window(
        df,
        s["alias"],
        s["function"],
        s.get("partitionBy", ()),
        s.get("orderBy") or (),
        s.get("field"),
        s.get("offset", 1),
        s.get("default"),
        s.get("buckets", 4),
        s.get("frame"),
    )


STEPS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "filter": lambda df, s: project.filter_rows(df, s["expression"]),
    "computed": lambda df, s: project.computed(df, s["alias"], s["expression"], s.get("type")),
    "recode": lambda df, s: project.recode(df, s["field"], s["alias"], s["mapping"], s.get("default")),
    "aggregate": lambda df, s: agg.aggregate(df, s["aggregations"], s.get("groupBy") or ()),
    "group_by": lambda df, s: agg.distinct_fields(df, s["fields"]),
    "pivot": lambda df, s: reshape.pivot(
        df, s["rowFields"], s["columnField"], s["valueField"], s["aggregation"], s.get("values")
    ),
    "unpivot": lambda df, s: reshape.unpivot(
        df, s["ids"], s["values"], s.get("variable", "variable"), s.get("value", "value")
    ),
    "sort": lambda df, s: reshape.sort(df, s["orderBy"]),
    "window": _window_step,
    "outlier": lambda df, s: quality.outlier(
        df, s["field"], s["strategy"], s.get("lowerBound"), s.get("upperBound"), s.get("action"), s.get("partitionBy", ())
    ),
    "normalize": lambda df, s: quality.normalize(df, s["field"], s["method"], s.get("partitionBy", ())),
}


# Steps whose output is far smaller than their input.
REDUCING = ("aggregate", "group_by", "pivot")
# Steps that read their input more than once, and steps that are dear to run again.
PASSES = ("window", "outlier", "normalize", "pivot")
DEAR = ("join", "aggregate", "group_by", "pivot", "window", "normalize")


class DriftBlocked(ValueError):
    """The source differs from the snapshot in a way that the definition's policy does not allow."""


class Result:
    """Outputs of a run; KPIs and charts are built when they are asked for.

    ``drift`` holds the rated schema changes, if a snapshot was given.
    """

    def __init__(
        self, spec: Mapping, steps: dict[str, DataFrame], targets: DataFrame | None, row_limit: int | None, drift: DataFrame | None = None
    ):
        self.steps = steps
        self.drift = drift
        self._spec, self._targets, self._row_limit = spec, targets, row_limit

    @property
    def last(self) -> DataFrame:
        return self.steps[list(self.steps)[-1]]

    @property
    def output(self) -> DataFrame:
        return self.last if self._row_limit is None else self.last.limit(self._row_limit)

    @cached_property
    def kpis(self) -> DataFrame | None:
        return evaluate_kpis(self.steps, self._spec["kpis"], self._targets) if self._spec.get("kpis") else None

    def chart(self, chart_id: str) -> DataFrame:
        viz = next(v for v in self._spec["visualizations"] if v["id"] == chart_id)
        return charts.chart(self.last, viz["type"], viz["encoding"], **viz.get("options", {}))

    @cached_property
    def charts(self) -> dict[str, DataFrame]:
        return {v["id"]: self.chart(v["id"]) for v in self._spec.get("visualizations", [])}


    def publish(self, base: str) -> dict[str, str | dict[str, str] | None]:
        """Write the definition's outputs below ``base``; path or paths by output kind.

        Dashboards and sheets are tables and are written. Rendered or delivered kinds (documents,
        slides, mail, hooks, cards) are services' work: they give None.
        """
        done: dict[str, str | dict[str, str] | None] = {}
        for out in self._spec.get("outputs", []):
            kind = out["kind"]
            if kind == "dashboard":
                outputs.refresh_interval(out.get("refreshSec"))
                done[kind] = outputs.publish_dashboard(self.output, base, out["dashboardCode"])
            elif kind == "excel":
                folder = f"{base}/{out.get('objectKey') or 'sheets'}"
                kpis = self.kpis if self.kpis is not None else self.output.sparkSession.createDataFrame([], NO_KPIS)
                done[kind] = outputs.export_sheets(folder, {"steps": ", ".join(self.steps)}, kpis, self.charts)
            elif kind in RENDERED:
                done[kind] = None
            else:
                raise ValueError(f"output kind '{kind}' is not supported")
        return done


def check(definition: Mapping) -> None:
    """Refuse a document of another kind or version, oversized lists, and unknown or repeated steps."""
    version = str(definition.get("apiVersion", ""))
    if not version.endswith(VERSION_SUFFIX):
        raise ValueError(f"apiVersion '{version}' is not supported")
    if definition.get("kind") != KIND:
        raise ValueError(f"kind '{definition.get('kind')}' is not supported")
    spec = definition["spec"]
    for name, limit in LIMITS.items():
        if len(spec.get(name, [])) > limit:
            raise ValueError(f"'{name}' holds more than {limit} entries")
    seen = set()
    for step in spec.get("pipeline", []):
        if step["kind"] != "join" and step["kind"] not in STEPS:
            raise ValueError(f"step '{step['id']}': kind '{step['kind']}' is not supported")
        if step["id"] in seen:
            raise ValueError(f"step id '{step['id']}' is used twice")
        seen.add(step["id"])


def run_steps(
    source: DataFrame, steps: Sequence[dict], tables: Mapping[str, DataFrame] | None = None, store: str | None = None
) -> dict[str, DataFrame]:
    """Output of every step by id, in order; ``source`` is the input.

    The right side of a join is an earlier step or, if there is none of that name, a table. The
    step named by ``store`` is written once and read back by all that follows, and so is a joined or
    aggregated input of a step that reads it several times.
    """
    done: dict[str, DataFrame] = {"source": source}
    current = source
    dear = False
    for step in steps:
        if dear and step["kind"] in PASSES:
            current, dear = materialize(current, "input"), False
        if step["kind"] == "join":
            name = step["right"]
            right = done.get(name) if name in done else (tables or {}).get(name)
            if right is None:
                raise LookupError(f"step '{step['id']}': '{name}' is neither a step nor a table")
            current = join.join(current, right, step["on"], step["joinType"])
        else:
            current = STEPS[step["kind"]](current, step)
        dear = dear or step["kind"] in DEAR
        if step["id"] == store:
            current, dear = materialize(current, store), False
        done[step["id"]] = current
    return done


def shared_step(spec: Mapping) -> str | None:
    """The last reducing step, if KPIs and charts would otherwise compute it several times."""
    users = len(spec.get("visualizations", [])) + bool(spec.get("kpis")) + 1
    reducing = [s["id"] for s in spec.get("pipeline", []) if s["kind"] in REDUCING]
    return reducing[-1] if reducing and users > 1 else None


def bind_kpis(steps: Mapping[str, DataFrame], kpis: Sequence[dict]) -> dict[str, list[dict]]:
    """KPIs by the last step whose output has every column they name."""
    @cache
    def shape(name: str) -> DataFrame:
        """An empty frame of the same schema: it resolves names as well, without the step's plan."""
        return steps[name].sparkSession.createDataFrame([], steps[name].schema)

    bound: dict[str, list[dict]] = {}
    for entry in kpis:
        for name in reversed(list(steps)):
            if kpi.kpi_column(shape(name), entry["expression"]) is not None:
                bound.setdefault(name, []).append(entry)
                break
        else:
            raise ValueError(f"KPI '{entry['id']}': no step has all its columns")
    return bound


def evaluate_kpis(steps: Mapping[str, DataFrame], kpis: Sequence[dict], targets: DataFrame | None = None) -> DataFrame | None:
    """All KPIs of a run, one aggregate per step that carries some."""
    out = None
    for name, entries in bind_kpis(steps, kpis).items():
        rows = kpi.kpi_values(steps[name], entries, targets)
        out = rows if out is None else out.unionByName(rows)
    return out


def settle_drift(source: DataFrame, snapshot: Mapping[str, str], policy: Mapping) -> tuple[DataFrame, DataFrame]:
    """The source in the snapshot's schema, and the rated changes; raises where the policy blocks.

    A definition has few fields, so its changes are looked at on the driver.
    """
    fields = "workflow_id string, field string, type string"
    before = source.sparkSession.createDataFrame([("run", f, spark_type(t)) for f, t in snapshot.items()], fields)
    chosen = drift.DEFAULT_POLICY | {name: policy[key] for key, name in POLICY.items() if key in policy}
    changes = drift.detect(before, schema_table(source, "run"), float(policy.get("similarityThreshold", drift.THRESHOLD)))
    rated = materialize(drift.apply_policy(changes, None, chosen), "drift")
    blocked = [r["reason"] for r in rated.where("blocks").select("reason").collect()]
    if blocked:
        raise DriftBlocked("; ".join(sorted(str(b) for b in blocked)))
    if rated.isEmpty():
        return source, rated
    renamed, casts = drift.resolution(rated)
    return drift.resolve(source, {f: spark_type(t) for f, t in snapshot.items()}, renamed, casts), rated


def _at(value, as_of: str | None):
    """A definition with its expressions made readable, the clock set to ``as_of``."""
    if isinstance(value, Mapping):
        out = {k: _at(v, as_of) for k, v in value.items()}
        for name in ("expression", "sqlPredicate"):
            if isinstance(out.get(name), str):
                out[name] = readable(out[name], as_of)
        if out.get("source") == "computed" and isinstance(out.get("value"), str):
            out["value"] = readable(out["value"], as_of)
        return out
    return [_at(v, as_of) for v in value] if isinstance(value, (list, tuple)) else value


def run(
    definition: Mapping,
    readers: Mapping[str, Callable[[dict], DataFrame]] | None = None,
    source: DataFrame | None = None,
    tables: Mapping[str, DataFrame] | None = None,
    targets: DataFrame | None = None,
    row_limit: int | None = None,
    as_of: str | None = None,
    snapshot: Mapping[str, str] | None = None,
) -> Result:
    """Steps, KPIs and chart tables of a definition. Pass ``source``, or ``readers`` by source type
    (``tables.file_readers`` has one for each type that lands as files).

    With KPIs or charts, the result of the last aggregation is stored once and shared by them.
    ``as_of`` replaces the clock in all expressions. With ``snapshot``, the source schema that the
    definition was made for, drift is detected and the definition's ``driftPolicy`` decides on it.
    """
    check(definition)
    spec = _at(definition["spec"], as_of)
    data = source if source is not None else open_source(spec["source"], readers or {})
    rated = None
    if snapshot is not None:
        data, rated = settle_drift(data, snapshot, spec.get("driftPolicy") or {})
    return Result(spec, run_steps(data, spec.get("pipeline", []), tables, shared_step(spec)), targets, row_limit, rated)
