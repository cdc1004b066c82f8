"""A fitted preparation: cleaning, bounds and transforms measured on training rows, replayable."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_of, is_numeric
from ..functions.lineage import cut_lineage
from ..operators import transform as tf
from ..operators.clean import CleaningPlan, apply_bounds, fit_clean, fit_quick_clean, outlier_bounds
from ..operators.profile import profile_columns
from .features import Feature, apply_features, fit_features, load_features, save_features
from .recommend import recommend_columns

DICTIONARIES = {"label": tf.LabelEncode, "target": tf.TargetEncode, "frequency": tf.FrequencyEncode}
PLAIN = {"impute": tf.Imputer, "onehot": tf.OneHot, "scale": tf.Scale}
# What a caller's plan may say about a column.
CHOICES = {
    "impute": ("mean", "median", "zero", "mode", "none", "drop"),
    "encode": ("label", "onehot", "target", "frequency", "none", "drop"),
    "log1p": (True, False),
    "scale": ("standard", "robust", "minmax", "none"),
}


@dataclass
class Preparation:
    """Everything needed to bring a new table into the training table's feature columns."""

    quick: CleaningPlan
    cleaning: CleaningPlan
    bounds: dict[str, tuple] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    steps: list = field(default_factory=list)
    features: list[str] = field(default_factory=list)
    log1p: list[str] = field(default_factory=list)
    actions: list[tuple] = field(default_factory=list)
    derived: list[Feature] = field(default_factory=list)

    def clean(self, df: DataFrame) -> DataFrame:
        """Cleaned, capped and freed of identifier and rejected columns; gaps still open."""
        df = apply_features(self.quick.transform(df), self.derived)
        df = apply_bounds(self.cleaning.transform(df), self.bounds)
        return df.drop(*[c for c in self.dropped if c in df.columns])

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """``keep`` columns plus one double column per feature."""
        held = {c: f"__kept_{i}" for i, c in enumerate(keep)}
        df = df.select(*[col_of(c) for c in df.columns], *[col_of(c).alias(h) for c, h in held.items()])
        df = self.clean(df)
        for step in self.steps:
            df = step.transform(df)
            if isinstance(step, tf.Imputer) and self.log1p:
                df = tf.log1p_feature(df, [c for c in self.log1p if c in df.columns])
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"the table lacks columns the model was trained on: {missing}")
        return df.select(*[F.col(h).alias(c) for c, h in held.items()],
                         *[col_of(c).cast("double").alias(c) for c in self.features if c not in held])

    def save(self, spark, folder: str) -> None:
        steps = []
        for i, s in enumerate(self.steps):
            entry = {"kind": s.kind}
            if isinstance(s, tf.Dictionary):
                entry.update(defaults=s.defaults, columns=list(s.tables))
                for j, c in enumerate(s.tables):
                    s.tables[c].write.mode("overwrite").parquet(f"{folder}/dictionaries/{i}_{j}")
            else:
                entry.update({k: v for k, v in vars(s).items() if k != "kind"})
            steps.append(entry)
        doc = {"quick": self.quick.to_dict(), "cleaning": self.cleaning.to_dict(), "bounds": self.bounds,
               "dropped": self.dropped, "features": self.features, "log1p": self.log1p, "actions": self.actions,
               "steps": steps, "derived": save_features(self.derived, f"{folder}/derived")}
        spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/preparation")

    @classmethod
    def load(cls, spark, folder: str) -> Preparation:
        doc = json.loads(spark.read.text(f"{folder}/preparation").first()["value"])
        steps = []
        for i, e in enumerate(doc["steps"]):
            kind = e.pop("kind")
            if kind in DICTIONARIES:
                tables = {c: spark.read.parquet(f"{folder}/dictionaries/{i}_{j}") for j, c in enumerate(e["columns"])}
                steps.append(DICTIONARIES[kind](tables, e["defaults"], kind))
            else:
                steps.append(PLAIN[kind](**e))
        return cls(CleaningPlan.from_dict(doc["quick"]), CleaningPlan.from_dict(doc["cleaning"]),
                   {c: tuple(b) for c, b in doc["bounds"].items()}, doc["dropped"], steps, doc["features"],
                   doc["log1p"], [tuple(a) for a in doc["actions"]],
                   load_features(spark, doc.get("derived", []), f"{folder}/derived"))


def _decisions(state: DataFrame, plan: dict[str, dict]) -> list[dict]:
    """Recommended decisions per column, overruled where the caller's plan says otherwise."""
    for c, wishes in plan.items():
        for what, choice in wishes.items():
            if choice not in CHOICES.get(what, ()):
                raise ValueError(f"plan for {c!r}: {what} cannot be {choice!r}")
    # At most one row per column reaches the driver. Sketched distinct counts will do, as columns near
    # a limit are counted exactly.
    rows = [r.asDict() for r in recommend_columns(profile_columns(state, approx=True)).orderBy("position").collect()]
    unknown = sorted(set(plan) - {r["column"] for r in rows})
    if unknown:
        raise ValueError(f"the plan names columns the cleaned table lacks: {unknown}")
    for r in rows:
        r.update(plan.get(r["column"], {}))
        text = not is_numeric(state.schema[r["column"]].dataType)
        if text and (r["impute"] in ("mean", "median", "zero") or r["log1p"] or r["scale"] in ("standard", "robust", "minmax")):
            raise ValueError(f"plan for {r['column']!r}: a text column has no numbers to impute, log or scale")
    return rows


def fit_preparation(
    train: DataFrame, target: str | None, key: list[str], label: str | None = None, feature_selection: bool = True,
    features: list[dict] = (), plan: dict[str, dict] | None = None,
) -> Preparation:
    """Measure every step on the training rows. ``label`` is the numeric target for target encoding.

    ``features`` asks for derived columns (see ``plans.features``). They are built once light cleaning
    has made numbers and dates of the texts, and from then on are columns like all others. ``plan``
    overrules decisions about cleaned columns: ``{column: {"impute" | "encode" | "log1p" | "scale": choice}}``.
    """
    aside = [c for c in [*key, target, label] if c is not None and c in train.columns]
    raw = train.drop(*aside)
    quick = fit_quick_clean(raw)
    derived, light = fit_features(quick.transform(raw), list(features))
    cleaning = fit_clean(light, native_dates=True)
    prep = Preparation(quick, cleaning, derived=derived)
    # A derived column means what it says: a rare flag is no outlier.
    prep.bounds = outlier_bounds(cleaning.transform(light).drop(*[f.new for f in derived]))
    prep.dropped = list(cleaning.ids)

    # The cleaned rows are written once; the passes below then read only the columns they need.
    labelled = train.select(*[col_of(c) for c in raw.columns], *([col_of(label).alias("__y")] if label else []))
    state = cut_lineage(prep.clean(labelled))
    decided = _decisions(state.drop("__y"), plan or {})
    prep.actions = [(f.new, f"derive {f.method}") for f in derived] + [(c, "drop (id)") for c in prep.dropped]
    rejected = [r["column"] for r in decided if r["impute"] == "drop" or r["encode"] == "drop"]
    prep.dropped += rejected
    decided = [r for r in decided if r["column"] not in rejected]
    impute = {r["column"]: r["impute"] for r in decided if r["impute"] in ("mean", "median", "zero", "mode")}
    encode = {m: [r["column"] for r in decided if r["encode"] == m] for m in ("label", "onehot", "target", "frequency")}
    scale = {m: [r["column"] for r in decided if r["scale"] == m] for m in ("standard", "robust", "minmax")}
    prep.log1p = [r["column"] for r in decided if r["log1p"]]
    prep.actions += [(c, "drop") for c in rejected] + [(c, f"impute {m}") for c, m in impute.items()]
    prep.actions += [(c, f"encode {m}") for m, cs in encode.items() for c in cs]
    prep.actions += [(c, "log1p") for c in prep.log1p] + [(c, f"scale {m}") for m, cs in scale.items() for c in cs]

    state = state.drop(*rejected)

    def add(step):
        prep.steps.append(step)
        return step.transform(state)

    # Columns without gaps get a mean too, in case a later table has some; only gaps seen here are flagged.
    spare = {c: "mean" for m in scale.values() for c in m if c not in impute}
    state = add(tf.Imputer.fit(state, {**impute, **spare}))
    if prep.log1p:
        state = tf.log1p_feature(state, prep.log1p)
    if encode["label"]:
        state = add(tf.LabelEncode.fit(state, encode["label"]))
    if encode["onehot"]:
        state = add(tf.OneHot.fit(state, encode["onehot"]))
    if encode["target"]:
        state = add(tf.TargetEncode.fit(state, encode["target"], "__y") if label
                    else tf.FrequencyEncode.fit(state, encode["target"]))
    if encode["frequency"]:
        state = add(tf.FrequencyEncode.fit(state, encode["frequency"]))
    for method, cols in scale.items():
        if cols:
            state = add(tf.Scale.fit(state, cols, method))
    numeric = state.select(*[col_of(f.name) for f in state.schema.fields if is_numeric(f.dataType) and f.name != "__y"])
    useless = set(tf.near_zero_variance(numeric)) if feature_selection else set()
    useless |= set(tf.constant_columns(numeric))
    prep.actions += [(c, "drop (constant)") for c in sorted(useless)]
    prep.features = [c for c in numeric.columns if c not in useless]
    return prep
