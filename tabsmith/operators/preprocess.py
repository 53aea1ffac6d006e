"""Preprocessing steps (M*, C*, E*, O1-O3, K*, F1-F3, U3) as pyspark.ml stages.

A step is ``{"name", "operation", "params"}``.  :class:`Step` is an
``Estimator``; ``fit`` runs the aggregates the operation needs and returns a
:class:`FittedStep` whose small state (means, quantiles, kept columns ...)
is JSON, so ``Pipeline``/``PipelineModel`` save and load work unchanged.
Transform is a single projection with the fitted numbers inlined as
literals.  Category maps (encoders) are the one state that can grow with
the data: their ``HOT`` most frequent values are kept inline and
broadcast-joined, all others are Parquet that is joined by key and saved
with the step.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.columns import c, is_numeric, is_string, nan_to_null
from tabsmith.functions.stats import quantile_dict, value_counts
from tabsmith.session import checkpoint_dir

#: Most frequent values of a category map that stay inline.
HOT = 1_000
ONEHOT_LIMIT = 1_000
OTHER = "__OTHER__"
NAN = "nan"


class StepError(ValueError):
    pass


# ------------------------------------------------------------------ column choice

def numeric_plain(df: DataFrame, exclude=()) -> list[str]:
    """Numeric, not bool (the reference's scaler / selector predicate)."""
    ex = set(x for x in exclude if x)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in ex]


def _dtype(df, name):
    return df.schema[name].dataType


def as_text(col_name: str):
    """``str(x)`` of the reference: missing -> 'nan'."""
    return F.coalesce(c(col_name).cast("string"), F.lit(NAN))


# ------------------------------------------------------------------ fits

def _fit_drop_missing(df, p):
    return {}


def _tr_drop_missing(df, p, s):
    cols = [x for x in p.get("columns") or [] if x in df.columns]
    return df.dropna(how="any", subset=cols or None)


def _missing_columns(df):
    row = df.agg(*[F.count_if(c(x).isNull()).alias(f"m{i}") for i, x in enumerate(df.columns)]).first()
    return [x for i, x in enumerate(df.columns) if row[i] > 0]


def _mode_values(df, cols, value_type):
    """Most frequent non-null value per column, ties -> smallest (SimpleImputer)."""
    if not cols:
        return {}
    vc = value_counts(df, cols, value_type)
    best = vc.groupBy("column").agg(F.min(F.struct((-F.col("cnt")).alias("k"), F.col("value").alias("v")))
                                    .alias("m"))
    return {r["column"]: r["m"]["v"] for r in best.collect()}


def _fit_impute(df, p):
    strategy = p.get("strategy", "mean")
    if strategy == "most_frequent":
        strategy = "mode"
    cols = list(p.get("columns") or []) or _missing_columns(df)
    cols = [x for x in cols if x in df.columns]
    num = [x for x in cols if is_numeric(_dtype(df, x), include_bool=False)]
    txt = [x for x in cols if x not in num]
    explicit = bool(p.get("columns"))
    fills = {}
    if strategy == "constant":
        fv = p.get("fill_value", 0)
        for x in cols:
            fills[x] = fv if fv is not None else (0 if x in num else "missing_value")
        return {"fills": fills}
    if strategy in ("mean", "median") and explicit:
        bad = [x for x in txt if not isinstance(_dtype(df, x), T.BooleanType)]
        if bad:
            raise StepError(f"impute '{strategy}' needs numeric columns, got {bad}")
    if strategy == "mean" and num:
        row = df.agg(*[F.avg(c(x)).alias(f"a{i}") for i, x in enumerate(num)]).first()
        fills.update({x: row[i] for i, x in enumerate(num)})
    elif strategy == "median" and num:
        fills.update({x: v[0] for x, v in quantile_dict(df, num, [0.5]).items()})
    elif strategy == "mode" and num:
        fills.update(_mode_values(df, num, "double"))
    elif strategy not in ("mean", "median", "mode"):
        raise StepError(f"unknown impute strategy {strategy}")
    if txt:
        fills.update(_mode_values(df, txt, "string"))
    return {"fills": fills}


def _tr_impute(df, p, s):
    fills = s["fills"]
    out = []
    for x in df.columns:
        if x in fills and fills[x] is not None:
            dt = _dtype(df, x)
            v = fills[x]
            if is_numeric(dt):
                # SimpleImputer returns float columns
                out.append(F.coalesce(c(x).cast("double"), F.lit(float(v))).alias(x))
            else:
                out.append(F.coalesce(c(x), F.lit(v).cast(dt)).alias(x))
        else:
            out.append(c(x))
    return df.select(*out)


def _fit_interpolate(df, p):
    return {}


def _tr_interpolate(df, p, s):
    cols = list(p.get("columns") or []) or numeric_plain(df)
    order = p.get("order_by")
    if not order:
        raise StepError("interpolate needs params.order_by (Spark rows have no position)")
    from tabsmith.operators.ordered import interpolate_linear
    return interpolate_linear(df, cols, order, p.get("partition_by"))


# -------- scaling

def _scale_columns(df, p):
    cols = list(p.get("columns") or [])
    target = p.get("target")
    scope = p.get("scope", "numeric")
    if not cols:
        cols = numeric_plain(df, exclude=[target])
        if scope == "exclude_binary" and cols:
            cols = [x for x in cols if x not in _binary_columns(df, cols)]
    return [x for x in cols if x in df.columns and is_numeric(_dtype(df, x))]


def _binary_columns(df, cols):
    """Columns with exactly two distinct non-null values: two one-row aggregates, no count_distinct."""
    mm = df.agg(*[F.min(c(x)).alias(f"lo{i}") for i, x in enumerate(cols)],
                *[F.max(c(x)).alias(f"hi{i}") for i, x in enumerate(cols)]).first()
    cand = [(i, x) for i, x in enumerate(cols)
            if mm[f"lo{i}"] is not None and mm[f"lo{i}"] != mm[f"hi{i}"]]
    if not cand:
        return []
    other = df.agg(*[F.count_if((c(x) != F.lit(mm[f"lo{i}"])) & (c(x) != F.lit(mm[f"hi{i}"]))).alias(f"o{i}")
                     for i, x in cand]).first()
    return [x for i, x in cand if other[f"o{i}"] == 0]


def _fit_scale(df, p):
    df = nan_to_null(df)
    method = p.get("method", "standard")
    cols = _scale_columns(df, p)
    if not cols:
        return {"columns": [], "center": {}, "scale": {}}
    center, scale = {}, {}
    if method == "standard":
        row = df.agg(*[F.avg(c(x)).alias(f"m{i}") for i, x in enumerate(cols)],
                     *[F.stddev_pop(c(x)).alias(f"s{i}") for i, x in enumerate(cols)]).first()
        for i, x in enumerate(cols):
            center[x], scale[x] = row[f"m{i}"], row[f"s{i}"]
    elif method == "minmax":
        row = df.agg(*[F.min(c(x)).alias(f"m{i}") for i, x in enumerate(cols)],
                     *[F.max(c(x)).alias(f"M{i}") for i, x in enumerate(cols)]).first()
        for i, x in enumerate(cols):
            lo, hi = row[f"m{i}"], row[f"M{i}"]
            center[x] = lo
            scale[x] = None if lo is None else float(hi) - float(lo)
    elif method == "robust":
        qd = quantile_dict(df, cols, [0.25, 0.5, 0.75])
        for x in cols:
            q1, med, q3 = qd[x]
            center[x] = med
            scale[x] = None if q1 is None else q3 - q1
    elif method == "maxabs":
        row = df.agg(*[F.max(F.abs(c(x))).alias(f"a{i}") for i, x in enumerate(cols)]).first()
        for i, x in enumerate(cols):
            center[x], scale[x] = 0.0, row[f"a{i}"]
    else:
        raise StepError(f"Unknown scaling method: {method}")
    for x in cols:
        if scale[x] is None or scale[x] == 0 or (isinstance(scale[x], float) and math.isnan(scale[x])):
            scale[x] = 1.0
        center[x] = 0.0 if center[x] is None else float(center[x])
        scale[x] = float(scale[x])
    return {"columns": cols, "center": center, "scale": scale}


def _tr_scale(df, p, s):
    df = nan_to_null(df)
    cols = set(s["columns"])
    return df.select(*[((c(x).cast("double") - F.lit(s["center"][x])) / F.lit(s["scale"][x])).alias(x)
                       if x in cols else c(x) for x in df.columns])


# -------- encoding

def _encode_columns(df, p):
    cols = list(p.get("columns") or [])
    target = p.get("target")
    if not cols:
        cols = [f.name for f in df.schema.fields if is_string(f.dataType) and f.name != target]
    return [x for x in cols if x in df.columns]


def _keep_map(df_map: DataFrame) -> dict:
    """A category map (value, code, n) as state: the ``HOT`` most frequent values inline, all others as Parquet.

    The file lies in the checkpoint folder while the step lives; saving the step writes it beside the metadata.
    """
    hot = df_map.orderBy(F.col("n").desc(), F.col("value")).limit(HOT + 1).collect()                 # bounded
    state = {"hot": [[r["value"], r["code"]] for r in hot[:HOT]], "code": dict(df_map.dtypes)["code"]}
    if len(hot) > HOT:
        inline = df_map.sparkSession.createDataFrame([(r["value"],) for r in hot[:HOT]], "value string")
        rest = df_map.join(F.broadcast(inline), "value", "left_anti")
        path = f"{checkpoint_dir(df_map.sparkSession)}/tabsmith-maps/{uuid.uuid4().hex}"
        rest.select("value", "code").write.parquet(path)
        state["path"] = path
    return state


def _coded(df: DataFrame, key, m: dict) -> DataFrame:
    """Add ``__code``, the map's code of ``key``, null where it has none.

    Frequent values, and with them any value that many rows share, are answered from the inline part; only the other rows go to
    the join by key, and those that need no answer are spread over all tasks.
    """
    spark = df.sparkSession
    hot = F.broadcast(spark.createDataFrame([(v, x) for v, x in m["hot"] if v is not None], f"__val string, __hot {m['code']}"))  # at most HOT rows
    out = df.withColumn("__key", key).join(hot, F.col("__key") == F.col("__val"), "left").drop("__val")
    if "path" not in m:
        return out.withColumnRenamed("__hot", "__code")
    rest = spark.read.parquet(m["path"]).select(F.lit(True).alias("__asked"), F.col("value").alias("__val"), F.col("code").alias("__rest"))
    asked = F.col("__hot").isNull() & F.col("__key").isNotNull()
    spread = F.concat(F.lit("-"), F.xxhash64(*[c(x) for x in df.columns]).cast("string"))
    out = out.withColumn("__asks", asked).withColumn("__find", F.when(asked, F.col("__key")).otherwise(spread))
    out = out.join(rest, (F.col("__asks") == F.col("__asked")) & (F.col("__find") == F.col("__val")), "left")
    return out.withColumn("__code", F.coalesce("__hot", "__rest")).drop("__hot", "__rest", "__asks", "__asked", "__find", "__val")


def _capped_text(df, x, cap):
    """(E6) the column as text with values outside the top ``cap`` by count -> '__OTHER__'."""
    t = as_text(x)
    if not cap:
        return t, None
    counts = df.select(t.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), F.col("v")).limit(cap + 1).collect()  # bounded by cap
    if len(top) <= cap:
        return t, None
    keep = [r["v"] for r in top[:cap]]
    return F.when(t.isin(keep), t).otherwise(F.lit(OTHER)), keep


def _fit_encode(df, p):
    method = p.get("method", "label")
    cap = int(p.get("max_categories", 0) or 0)
    target = p.get("target")
    state = {"columns": {}}
    for x in _encode_columns(df, p):
        t, keep = _capped_text(df, x, cap)
        col_state = {"keep": keep}
        v = df.select(t.alias("value"))
        if method in ("label", "ordinal"):
            counts = v.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
            col_state["map"] = _keep_map(dense_rank_codes(counts))
        elif method == "frequency" or (method == "target" and not (target and target in df.columns)):
            counts = v.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
            col_state["map"] = _keep_map(counts.withColumn("code", F.col("n").cast("double")))
            col_state["kind"] = "frequency"
        elif method == "target":
            y = F.expr(f"try_cast(`{target}` as double)")
            tv = df.select(t.alias("value"), y.alias("y"))
            means = tv.groupBy("value").agg(F.avg("y").alias("code"), F.count(F.lit(1)).alias("n"))
            g = tv.agg(F.avg("y")).first()[0]
            col_state["map"] = _keep_map(means)
            col_state["global"] = 0.0 if g is None else float(g)
        else:  # onehot (and any other method name, as in the reference)
            cats = [r[0] for r in v.distinct().orderBy("value").limit(ONEHOT_LIMIT + 1).collect()]
            if len(cats) > ONEHOT_LIMIT:
                raise StepError(f"onehot of '{x}' would create > {ONEHOT_LIMIT} columns; set max_categories")
            col_state["categories"] = cats
        state["columns"][x] = col_state
    return state


def dense_rank_codes(values: DataFrame) -> DataFrame:
    """(value, n) with the 0-based ``code`` of the value in sorted order, distributed (no single-task window); nulls have none."""
    from tabsmith.functions.stats import prefix_sum
    return prefix_sum(values.where("value is not null"), [], "value", None, out="code").select("value", "code", "n")


def _tr_encode(df, p, s):
    method = p.get("method", "label")
    out = df
    for x, st in s["columns"].items():
        if x not in out.columns:
            continue
        t = as_text(x)
        if st.get("keep") is not None:
            t = F.when(t.isin(st["keep"]), t).otherwise(F.lit(OTHER))
        if "categories" in st:
            cats = st["categories"]
            others = [y for y in out.columns if y != x]
            out = out.select(*[c(y) for y in others], *[(t == F.lit(v)).alias(f"{x}_{v}") for v in cats])
            continue
        joined = _coded(out, t, st["map"])
        if method == "label":
            code = F.col("__code").cast("int")
        elif method == "ordinal":
            code = F.coalesce(F.col("__code").cast("double"), F.lit(-1.0))
        elif st.get("kind") == "frequency":
            code = F.coalesce(F.col("__code"), F.lit(0.0))
        else:  # target
            if p.get("handle_unknown") == "error":
                bad = joined.where(F.col("__code").isNull()).limit(1).count()
                if bad:
                    raise StepError(f"Unknown categories found in '{x}'")
            code = F.coalesce(F.col("__code"), F.lit(st["global"]))
        out = joined.select(*[code.alias(y) if y == x else c(y) for y in out.columns])
    return out


# -------- outliers (O1-O3)

def _outlier_columns(df, p):
    return numeric_plain(df, exclude=[p.get("target")])


def _fit_outliers(df, p):
    df = nan_to_null(df)
    method = p.get("method", "iqr")
    cols = _outlier_columns(df, p)
    bounds = {}
    if not cols:
        return {"bounds": bounds}
    if method == "zscore":
        thr = float(p.get("threshold", 3.0))
        row = df.agg(*[F.avg(c(x)).alias(f"m{i}") for i, x in enumerate(cols)],
                     *[F.stddev_pop(c(x)).alias(f"s{i}") for i, x in enumerate(cols)]).first()
        for i, x in enumerate(cols):
            m, sd = row[f"m{i}"], row[f"s{i}"]
            if sd is None or sd == 0 or math.isnan(sd):
                continue
            bounds[x] = [m - thr * sd, m + thr * sd]
    elif method == "iqr":
        mult = float(p.get("multiplier", 1.5))
        qd = quantile_dict(df, cols, [0.25, 0.75])
        for x in cols:
            q1, q3 = qd[x]
            if q1 is None or q3 - q1 == 0:
                continue
            bounds[x] = [q1 - mult * (q3 - q1), q3 + mult * (q3 - q1)]
    elif method == "winsorize":
        tail = float(p.get("tail", 0.01))
        qd = quantile_dict(df, cols, [tail, 1.0 - tail])
        for x in cols:
            if qd[x][0] is not None:
                bounds[x] = list(qd[x])
    elif method == "isolation_forest":
        from tabsmith.operators.isoforest import fit_isolation_forest
        return fit_isolation_forest(df, cols, p)
    else:
        raise StepError(f"unknown outlier method {method}")
    return {"bounds": bounds}


def clip(col, lo, hi):
    """Clip keeping nulls null (``least``/``greatest`` skip nulls)."""
    return F.when(col.isNull(), F.lit(None)).otherwise(F.least(F.greatest(col, F.lit(lo)), F.lit(hi)))


def _tr_outliers(df, p, s):
    df = nan_to_null(df)
    if p.get("method") == "isolation_forest":
        from tabsmith.operators.isoforest import filter_isolation_forest
        return filter_isolation_forest(df, p, s)
    b = s["bounds"]
    return df.select(*[clip(c(x).cast("double"), *b[x]).alias(x) if x in b else c(x) for x in df.columns])


# -------- simple column ops (F1, F2)

def _tr_drop_columns(df, p, s):
    return df.drop(*[x for x in p.get("columns") or [] if x in df.columns])


def _tr_rename(df, p, s):
    mapping = {k: v for k, v in (p.get("mapping") or {}).items() if k in df.columns}
    return df.withColumnsRenamed(mapping) if mapping else df


# -------- feature selection (K1-K8)

def _fit_select(df, p):
    from tabsmith.operators.select import fit_selection
    return fit_selection(df, p)


def _tr_select(df, p, s):
    return df.drop(*[x for x in s.get("drop", []) if x in df.columns])


NOFIT = lambda df, p: {}

OPERATIONS = {
    "drop_missing": (NOFIT, _tr_drop_missing),
    "impute": (_fit_impute, _tr_impute),
    "interpolate": (NOFIT, _tr_interpolate),
    "scale": (_fit_scale, _tr_scale),
    "encode": (_fit_encode, _tr_encode),
    "drop_columns": (NOFIT, _tr_drop_columns),
    "rename_columns": (NOFIT, _tr_rename),
    "feature_selection": (_fit_select, _tr_select),
    "outliers": (_fit_outliers, _tr_outliers),
}


# ------------------------------------------------------------------ ml stages

class _StepParams(Params):
    operation = Param(Params._dummy(), "operation", "step operation", typeConverter=TypeConverters.toString)
    paramsJson = Param(Params._dummy(), "paramsJson", "step params as JSON", typeConverter=TypeConverters.toString)
    stepName = Param(Params._dummy(), "stepName", "step name", typeConverter=TypeConverters.toString)


class Step(Estimator, _StepParams, DefaultParamsReadable, DefaultParamsWritable):
    """One preprocessing step; unknown operations raise."""

    @keyword_only
    def __init__(self, operation: str = "impute", paramsJson: str = "{}", stepName: str = ""):
        super().__init__()
        self._set(**self._input_kwargs)
        if self.getOrDefault(self.operation) not in OPERATIONS:
            raise StepError(f"unknown preprocessing operation '{operation}'")

    @classmethod
    def from_spec(cls, spec: dict) -> "Step":
        return cls(operation=spec["operation"], paramsJson=json.dumps(spec.get("params", {})),
                   stepName=spec.get("name", spec["operation"]))

    def spec(self) -> dict:
        return {"name": self.getOrDefault(self.stepName), "operation": self.getOrDefault(self.operation),
                "params": json.loads(self.getOrDefault(self.paramsJson))}

    def _fit(self, df: DataFrame) -> "FittedStep":
        sp = self.spec()
        fit, _ = OPERATIONS[sp["operation"]]
        state = fit(df, sp["params"])
        return FittedStep(operation=sp["operation"], paramsJson=json.dumps(sp["params"]),
                          stepName=sp["name"], stateJson=json.dumps(state, default=float))


def _paths(state) -> list[dict]:
    """The parts of a state that name a Parquet file."""
    if isinstance(state, dict):
        return ([state] if "path" in state else []) + [x for v in state.values() for x in _paths(v)]
    return [x for v in state for x in _paths(v)] if isinstance(state, list) else []


class _StepWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        state = self.instance.state()
        moved = []
        for i, part in enumerate(_paths(state)):
            moved.append(self.sparkSession.read.parquet(part["path"]))
            part["path"] = f"map-{i}"
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession,
                                         paramMap={"operation": self.instance.getOrDefault("operation"), "paramsJson": self.instance.getOrDefault("paramsJson"),
                                                   "stepName": self.instance.getOrDefault("stepName"), "stateJson": json.dumps(state)})
        for i, df in enumerate(moved):
            df.write.mode("overwrite").parquet(f"{path}/map-{i}")


class _StepReader(MLReader):
    def load(self, path: str) -> "FittedStep":
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = FittedStep()
        out._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(out, meta)
        state = out.state()
        for part in _paths(state):
            part["path"] = f"{path}/{part['path']}"
        out._set(stateJson=json.dumps(state))
        return out


class FittedStep(Model, _StepParams, MLWritable, MLReadable):
    """The fitted state; category maps that are files are saved beside the metadata and found there again."""

    stateJson = Param(Params._dummy(), "stateJson", "fitted state as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, operation: str = "impute", paramsJson: str = "{}", stepName: str = "",
                 stateJson: str = "{}"):
        super().__init__()
        self._set(**self._input_kwargs)

    def write(self):
        return _StepWriter(self)

    @classmethod
    def read(cls):
        return _StepReader()

    def state(self) -> dict:
        return json.loads(self.getOrDefault(self.stateJson))

    def _transform(self, df: DataFrame) -> DataFrame:
        op = self.getOrDefault(self.operation)
        _, tr = OPERATIONS[op]
        return tr(df, json.loads(self.getOrDefault(self.paramsJson)), self.state())


def fit_transform(df: DataFrame, spec: dict) -> DataFrame:
    return Step.from_spec(spec).fit(df).transform(df)
