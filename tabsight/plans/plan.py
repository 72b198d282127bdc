"""Which views to make, and making them.

A view is a name in ``REGISTRY`` with a function that turns a ``Request``
(table, columns, parameters, target) into chart data.  ``RULES`` is a table:
each rule says when it holds, which view it asks for and over which columns;
the plan is the rules' answers in order.  User specs are read into ``Spec``
objects, which check themselves.  Nothing disappears silently: a spec that
cannot be read, is over the limit or fails while running is recorded with its
reason.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import profile, views
from ..operators.schema import categorical_columns, distinct_counts, existing, numeric_columns
from ..session import cut_lineage
from . import cluster_views

# Limits of the plan.
MAX_VIEWS = 20
TOP_NUMERIC = 6
VIOLIN_GROUPS = 15
SMALL_CATEGORY = 5


# ------------------------------------------------------------------ requests

@dataclass(frozen=True)
class Spec:
    """One wanted view.  ``plot_type`` must be registered."""
    plot_id: str
    plot_type: str
    columns: list[str] = field(default_factory=list)
    params: Mapping = field(default_factory=dict)
    title: str = ""
    description: str = ""

    def __post_init__(self):
        if self.plot_type not in REGISTRY:
            raise ValueError(f"unknown view type {self.plot_type!r}")
        if not self.title:
            object.__setattr__(self, "title", " ".join([self.plot_type.replace("_", " "), *self.columns]))

    @classmethod
    def read(cls, raw: "Spec | Mapping", known: list[str], fallback_id: str) -> "Spec":
        """A spec from user input: types in any case, columns that exist,
        parameters only as a mapping."""
        if isinstance(raw, Spec):
            return replace(raw, columns=[c for c in raw.columns if c in known])
        text = lambda k: str(raw.get(k) or "").strip()
        cols, params = raw.get("columns"), raw.get("params")
        return cls(text("plot_id") or fallback_id, text("plot_type").lower(),
                   [str(c) for c in cols if str(c) in known] if isinstance(cols, (list, tuple)) else [],
                   params if isinstance(params, Mapping) else {}, text("title"), text("description"))


@dataclass(frozen=True)
class Request:
    """What a view function sees."""
    df: DataFrame
    spec: Spec
    target: str | None
    context: dict

    @property
    def columns(self) -> list[str]:
        return list(self.spec.columns)

    @cached_property
    def numeric(self) -> list[str]:
        return existing(self.df.select(numeric_columns(self.df)), self.columns)

    @property
    def other(self) -> list[str]:
        return [c for c in self.columns if c not in self.numeric]

    def need(self, n: int, cols: list[str] | None = None) -> list[str]:
        cols = self.columns if cols is None else cols
        if len(cols) < n:
            raise views.ViewRefused(f"{self.spec.plot_type} needs {n} suitable column(s)")
        return cols

    def param(self, name: str, default):
        return self.spec.params.get(name, default)


def _violin(r: Request) -> DataFrame:
    value, groups = r.need(1, r.numeric)[0], r.other[:1]
    if groups and distinct_counts(r.df, groups)[groups[0]] > VIOLIN_GROUPS:
        groups = []
    return views.violin(r.df, value, groups[0] if groups else None)


def _grid(r: Request) -> DataFrame:
    return views.distribution_grid(r.df, (r.numeric or numeric_columns(r.df))[:int(r.param("max_cols", 8))])


def _clustered(kind: str) -> Callable[[Request], DataFrame]:
    return lambda r: cluster_views.run(kind, r.df, r.target, dict(r.spec.params), r.context)


# The names of the view types.
REGISTRY: dict[str, Callable[[Request], DataFrame]] = {
    "missingvalues": lambda r: profile.missing_values(r.df),
    "heatmap": lambda r: views.correlation(r.df, r.param("method", "pearson")),
    "feature_importance_proxy": lambda r: views.feature_variance(r.df, r.target),
    "histogram": lambda r: views.histogram(r.df, r.need(1)[:1], r.param("bins", "auto")),
    "kde": lambda r: views.kde(r.df, r.need(1)[0]),
    "distribution_grid": _grid,
    "boxplot": lambda r: views.box_stats(r.df, r.need(1)),
    "violinplot": _violin,
    "outlierdetection": lambda r: views.outlier_summary(r.df, r.columns),
    "barplot": lambda r: views.group_bar(r.df, r.need(1, r.other)[0], r.need(1, r.numeric)[0], r.param("estimator", "mean")),
    "countplot": lambda r: views.count_top(r.df, r.need(1)[0], int(r.param("top_n", 15))),
    "piechart": lambda r: views.pie(r.df, r.need(1)[0], int(r.param("top_n", 8))),
    "stackedbar": lambda r: views.crosstab(r.df, *r.need(2)[:2], bool(r.param("normalize", False))),
    "scatterplot": lambda r: views.scatter(r.df, *r.need(2)[:2], r.param("hue", None)),
    "lineplot": lambda r: views.line(r.df, *r.need(2)[:2], r.param("hue", None)),
    "pairplot": lambda r: views.pairplot(r.df, r.columns, r.param("hue", None), max_cols=int(r.param("max_cols", 5))),
    "target_vs_feature": lambda r: views.target_vs_feature(r.df, r.need(1)[0], r.target),
    "class_balance": lambda r: views.class_balance(r.df, r.target),
    "regression_residual": lambda r: views.residual_histogram(r.df, r.need(1)[0], r.target),
    "qq_plot": lambda r: views.qq_points(r.df, r.need(1)[0], r.target),
    "scale_location": lambda r: views.scale_location(r.df, r.need(1)[0], r.target),
    **{k: _clustered(k) for k in ("pca_scatter", "elbow_curve", "silhouette_plot", "cluster_size_bar")},
}


# ------------------------------------------------------------------ the rules

class Facts:
    """What the rules look at; each fact is computed once, when first asked for."""

    def __init__(self, df: DataFrame, target: str | None, problem_type: str):
        self.df, self.problem = df, problem_type
        self.target = target if target in df.columns else None

    @cached_property
    def numeric(self) -> list[str]:
        return numeric_columns(self.df)

    @cached_property
    def ranked(self) -> list[str]:
        """Numeric columns by D7, best first."""
        rows = profile.top_features(self.df, self.target, TOP_NUMERIC).orderBy("rank").collect()
        return [r["column_name"] for r in rows]

    @cached_property
    def predictors(self) -> list[str]:
        return [c for c in self.ranked if c != self.target]

    @cached_property
    def small_categories(self) -> list[str]:
        cols = [c for c in categorical_columns(self.df) if c != self.target]
        sizes = distinct_counts(self.df, cols)
        return [c for c in cols if sizes[c] <= SMALL_CATEGORY]

    def supervised(self, kind: str) -> bool:
        return self.problem == kind and self.target is not None


@dataclass(frozen=True)
class Rule:
    """Where ``when`` holds, one ``view`` for each column list of ``over``."""
    view: str
    when: Callable[[Facts], bool]
    over: Callable[[Facts], list[list[str]]] = lambda f: [[]]
    params: Callable[[Facts], dict] = lambda f: {}


def _each(cols: list[str], n: int) -> list[list[str]]:
    return [[c] for c in cols[:n]]


def _regression(f: Facts) -> bool:
    return f.supervised("Regression")


def _classes(f: Facts) -> bool:
    return f.supervised("Classification")


def _clusters(f: Facts) -> bool:
    return f.problem == "Clustering" and len(f.numeric) >= 2


RULES: tuple[Rule, ...] = (
    Rule("missingvalues", lambda f: True),
    Rule("heatmap", lambda f: len(f.numeric) >= 3, params=lambda f: {"method": "pearson"}),
    Rule("distribution_grid", lambda f: bool(f.ranked), lambda f: [f.ranked], lambda f: {"max_cols": TOP_NUMERIC}),
    Rule("boxplot", lambda f: bool(f.ranked), lambda f: [f.ranked[:5]]),
    Rule("histogram", _regression, lambda f: [[f.target]]),
    Rule("target_vs_feature", _regression, lambda f: _each(f.predictors, 3)),
    *[Rule(v, _regression, lambda f: _each(f.predictors or f.ranked, 1))
      for v in ("regression_residual", "qq_plot", "scale_location")],
    Rule("class_balance", _classes, lambda f: [[f.target]]),
    Rule("target_vs_feature", _classes, lambda f: _each(f.predictors, 4)),
    Rule("stackedbar", _classes, lambda f: [[c, f.target] for c in f.small_categories[:3]], lambda f: {"normalize": True}),
    Rule("pairplot", lambda f: _classes(f) and bool(f.predictors), lambda f: [f.predictors[:4]],
         lambda f: {"hue": f.target, "max_cols": 4}),
    *[Rule(v, _clusters) for v in ("pca_scatter", "elbow_curve", "silhouette_plot")],
)


def core_plan(df: DataFrame, target: str | None, problem_type: str) -> list[Spec]:
    """The specs of every rule that holds, in rule order."""
    facts = Facts(df, target, problem_type)
    return [Spec("/".join([rule.view, *cols]), rule.view, list(cols), rule.params(facts))
            for rule in RULES if rule.when(facts) for cols in rule.over(facts)]


@dataclass
class Reading:
    """Specs that can run, and what was left out with its reason."""
    specs: list[Spec] = field(default_factory=list)
    left_out: list[tuple[object, str]] = field(default_factory=list)


def read_specs(raw: list, df: DataFrame) -> Reading:
    """User specs; a repeated id gets its position as suffix."""
    out, used = Reading(), set()
    for position, item in enumerate(raw, start=1):
        try:
            spec = Spec.read(item, df.columns, f"plot_{position}")
        except (ValueError, AttributeError) as e:
            out.left_out.append((item, str(e)))
            continue
        if spec.plot_id in used:
            spec = replace(spec, plot_id=f"{spec.plot_id}_{position}")
        used.add(spec.plot_id)
        out.specs.append(spec)
    return out


def sanitize(raw: list, df: DataFrame) -> list[Spec]:
    """The readable specs of ``read_specs``."""
    return read_specs(raw, df).specs


def full_plan(core: list[Spec], extra: list | None, df: DataFrame, limit: int = MAX_VIEWS) -> Reading:
    """The core plan, then user specs with new ids; what is over the
    limit is left out and says so."""
    reading = read_specs(extra or [], df)
    have = {s.plot_id for s in core}
    wanted = [*core, *(s for s in reading.specs if s.plot_id not in have)]
    over = [(s, f"over the limit of {limit} views") for s in wanted[limit:]]
    return Reading(wanted[:limit], reading.left_out + over)


def plan_table(spark: SparkSession, specs: list[Spec]) -> DataFrame:
    """A plan as a table: position, view, columns (comma-joined)."""
    return spark.createDataFrame([(i, s.plot_type, ",".join(s.columns)) for i, s in enumerate(specs, 1)],
                                 "position int, view string, columns string")


# ------------------------------------------------------------------ running

def execute(spec: Spec, df: DataFrame, target: str | None, context: dict | None = None) -> DataFrame:
    """One spec -> the chart's data."""
    return REGISTRY[spec.plot_type](Request(df, spec, target, context if context is not None else {}))


def run_views(plan: Reading | list[Spec], df: DataFrame, target: str | None, context: dict | None = None):
    """Run every spec; [(spec, DataFrame or None, error or None)].  Each
    view is written to the checkpoint folder as it is made, so an error of
    the running job is recorded with its view too."""
    plan = plan if isinstance(plan, Reading) else Reading(list(plan))
    out = []
    for spec in plan.specs:
        try:
            out.append((spec, cut_lineage(execute(spec, df, target, context)), None))
        except Exception as e:  # noqa: BLE001  (recorded with the view)
            out.append((spec, None, f"{type(e).__name__}: {str(e)[:200]}"))
    return out + [(item, None, f"not run: {why}") for item, why in plan.left_out]
