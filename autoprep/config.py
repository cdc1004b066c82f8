"""Thresholds, lookup values and the run configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

# Text that stands for "no value" (compared trimmed and lower-cased).
NULL_TOKENS = ("n/a", "na", "null", "none", "?", "-", "--", "nan", "")

# Spellings folded into one category (keys compared trimmed and lower-cased).
CATEGORY_VARIANTS = {
    "masculino": "masculino",
    "male": "masculino",
    "m": "masculino",
    "h": "masculino",
    "femenino": "femenino",
    "female": "femenino",
    "f": "femenino",
    "mujer": "femenino",
    "no binario": "otro",
    "nb": "otro",
    "prefiero no decirlo": "otro",
}

# What a date column looks like.
DATE_LOOKS = (
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\d{4}/\d{2}/\d{2}",
    r"\d{2}-[A-Za-z]{3}-\d{4}",
)

# Class-balance levels by minority/majority ratio, and the remedy per level.
BALANCE_LEVELS = (("balanced", 0.8), ("mild", 0.5), ("moderate", 0.2), ("severe", 0.1))
BALANCE_REMEDY = {
    "balanced": "none",
    "mild": "class_weight",
    "moderate": "smote",
    "severe": "smote_enn",
    "extreme": "adasyn",
}

# Metrics that count per task; with uneven classes accuracy says little.
TASK_METRICS = {
    "classification": ("accuracy", "f1", "precision", "recall", "roc_auc"),
    "classification_imbalanced": ("f1", "precision", "recall", "roc_auc"),
    "regression": ("r2", "mse", "mae", "rmse"),
    "clustering": ("silhouette", "davies_bouldin", "calinski_harabasz"),
    "dimensionality_reduction": ("explained_variance_ratio",),
    "anomaly_detection": ("silhouette",),
}

# Majority shares (percent) that make a target concentrated.
CONCENTRATION_LEVELS = (("extreme", 80.0), ("severe", 60.0), ("moderate", 40.0))

# Majority values that usually mean "no data was recorded".
SENTINELS = ("0", "0.0", "-1", "NaN", "None", "")

# Suffixes of the columns a date is expanded into (year, month, day, weekday).
DATE_PART_SUFFIXES = ("año", "mes", "dia", "diasemana")

CATEGORICAL_NUMERIC_MAX = 10
VALUE_LIST_MAX = 20
REGRESSION_MIN_UNIQUE = 16

# Dictionaries up to this many rows may be collected or broadcast; beyond it lookups shuffle.
SMALL_DICTIONARY_ROWS = 100_000


@dataclass(frozen=True)
class RunConfig:
    """Settings of an end-to-end run."""

    # The defaults.

    test_size: float = 0.2
    seed: int = 42
    smote_k: int = 5
    feature_selection: bool = True
    cv_folds: int = 5
    n_top_ensemble: int = 3
    ensemble_method: str = "weighted"
    output_dir: str | None = None
    save_report: bool = True
    save_model: bool = False
    parallelism: int = 4
    max_models: int = 4
    grids: dict = field(default_factory=dict)
