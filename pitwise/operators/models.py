"""Trained forecasters on Spark ML: design matrix, families, folds, tuning."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.functions import scoring as S
from pitwise.operators import evaluate as EV
from pitwise.operators import logistic
from pitwise.operators.boosting import BoostedFamily
from pitwise.operators.folds import Fold
from pitwise.operators.logistic import LogisticFamily
from pitwise.operators.neural import NeuralFamily
from pitwise.operators.quantiles import exact_quantiles
from pitwise.schema import (
    BLOCKS,
    CLASSES,
    DESIGN_COLUMNS,
    KEY,
    PROBS,
    TARGET,
    require_columns,
)

SEED = 20240601


def design_columns(
    blocks: Sequence[str] | None = None, without: Sequence[str] = ()
) -> tuple[str, ...]:
    """Design columns in order, for the chosen blocks."""
    chosen = list(BLOCKS) if blocks is None else list(blocks)
    unknown = sorted((set(chosen) | set(without)) - set(BLOCKS))
    if unknown:
        raise ValueError(f"unknown blocks: {unknown}")
    return tuple(c for b in BLOCKS if b in chosen and b not in without for c in BLOCKS[b])


def design_matrix(df: DataFrame, columns: Sequence[str] = DESIGN_COLUMNS) -> DataFrame:
    """Key and ordered design columns as doubles; nulls stay, a missing column is an error."""
    require_columns(df, columns)
    return df.select(KEY, *[F.col(c).cast("double").alias(c) for c in columns])


def target(column: str = TARGET):
    """H, D, A as 0, 1, 2; anything else is null."""
    c = F.col(column)
    return F.when(c == "H", 0.0).when(c == "D", 1.0).when(c == "A", 2.0)


@dataclass(frozen=True)
class Family:
    """A kind of classifier and its settings: a fresh fit per training half."""

    name: str
    estimator: Callable[[int, int], list]
    columns: tuple[str, ...] = DESIGN_COLUMNS
    settings: dict = field(default_factory=dict)

    def fit(self, train: DataFrame, middle: dict[str, float | None] | None = None) -> "Fitted":
        """Fit on the rows that have an outcome.

        Gaps are filled with exact medians, all found together unless ``middle`` has them; filling is
        a projection, so the matrix is never materialised outside Spark ML.
        """
        require_columns(train, self.columns)
        rows = train.filter(F.col(TARGET).isin(*CLASSES))
        n, width = rows.count(), len(self.columns)
        if not n:
            raise ValueError("nothing to train on")
        found = exact_quantiles(rows, self.columns) if middle is None else middle
        middle = {c: 0.0 if found[c] is None else found[c] for c in self.columns}
        fill = ", ".join(
            f"CAST(coalesce(`{c}`, {middle[c]!r}) AS DOUBLE) AS `_x_{c}`" for c in self.columns
        )
        prepare = [
            SQLTransformer(statement=f"SELECT *, {fill} FROM __THIS__"),
            VectorAssembler(inputCols=[f"_x_{c}" for c in self.columns], outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
        ]
        labelled = rows.withColumn("_label", target())
        shared = Pipeline(stages=prepare).fit(labelled)
        ready = shared.transform(labelled).select("_features", "_label")
        (stage,) = self.estimator(n, width)
        return Fitted(self.name, PipelineModel(shared.stages + [stage.fit(ready)]))


@dataclass(frozen=True)
class Fitted:
    """A fitted forecaster; a class its training never saw gets probability zero."""

    name: str
    model: PipelineModel

    def forecast(self, df: DataFrame) -> DataFrame:
        """``df`` with the three probability columns."""
        p = vector_to_array(F.col("probability"))
        raw = [F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i in range(3)]
        total = raw[0] + raw[1] + raw[2]
        return self.model.transform(df).select(
            *df.columns, *[(r / total).alias(c) for r, c in zip(raw, PROBS, strict=True)]
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(spark: SparkSession, path: str, name: str) -> "Fitted":
        return Fitted(name, PipelineModel.load(path))


# The shipped settings of each family, but for the network's rounds and decay, which are our own.
LOGISTIC = {"C": 0.1541, "max_iter": 1000}
FOREST = {"trees": 300, "depth": 13, "leaf": 60}
BOOSTED = {
    "rounds": 300, "depth": 5, "rate": 0.01927, "subsample": 0.6988, "columns": 0.6981, "leaf": 25,
    "l2": 0.06868,
}
NEURAL = {"hidden": 64, "rate": 0.004626, "alpha": 1.205e-05, "rounds": 12, "decay": 0.25}


def logistic_regression(columns=DESIGN_COLUMNS, **over) -> LogisticFamily:
    """Multinomial logistic regression; the penalty weight follows the row count."""
    return LogisticFamily("logistic_regression", tuple(columns), {**LOGISTIC, **over})


def random_forest(columns=DESIGN_COLUMNS, **over) -> Family:
    s = {**FOREST, **over}

    def make(*_):
        return [
            RandomForestClassifier(
                featuresCol="_features",
                labelCol="_label",
                numTrees=s["trees"],
                maxDepth=s["depth"],
                minInstancesPerNode=s["leaf"],
                seed=SEED,
            )
        ]

    return Family("random_forest", make, tuple(columns), settings=s)


def boosted_trees(columns=DESIGN_COLUMNS, **over) -> BoostedFamily:
    """Multinomial gradient boosting on binned columns; gaps have a bin of their own."""
    return BoostedFamily("boosted_trees", tuple(columns), {**BOOSTED, **over})


def mlp(columns=DESIGN_COLUMNS, **over) -> NeuralFamily:
    """One hidden layer, mini-batches with a falling rate, weights averaged over tasks."""
    return NeuralFamily("mlp", tuple(columns), {**NEURAL, **over})


FAMILIES = {
    "logistic_regression": logistic_regression,
    "random_forest": random_forest,
    "boosted_trees": boosted_trees,
    "mlp": mlp,
}


def build(name: str, columns=DESIGN_COLUMNS, **over) -> Family:
    if name not in FAMILIES:
        raise ValueError(f"not a model: {name!r}; there are {sorted(FAMILIES)}")
    return FAMILIES[name](columns, **over)


# ---- folds -----------------------------------------------------------------------


def fold_forecasts(
    df: DataFrame, folds: Sequence[Fold], families: Sequence[Family]
) -> DataFrame:
    """Every family refitted on every fold: one row per contest and forecaster."""
    parts = []
    linear = [family for family in families if isinstance(family, LogisticFamily)]
    together = logistic.fit_folds(linear, df, folds) if linear else {}
    for family in families:
        if family not in linear and hasattr(family, "fit_folds"):
            together[family.name] = family.fit_folds(df, folds)
    alone = [family for family in families if family.name not in together]
    columns = sorted({c for family in alone for c in family.columns})
    for fold in folds:
        train, rows = fold.train(df), fold.evaluate(df)
        # one search for the medians that all families of a fold fill their gaps with
        middle = exact_quantiles(train.filter(F.col(TARGET).isin(*CLASSES)), columns) if alone else {}
        for family in families:
            fits = together.get(family.name)
            stated = (fits[fold.index] if fits else family.fit(train, middle)).forecast(rows)
            parts.append(
                stated.select(
                    F.lit(fold.index).alias("fold"),
                    KEY,
                    "competition_id",
                    TARGET,
                    F.lit(family.name).alias("forecaster"),
                    *PROBS,
                )
            )
    return reduce(DataFrame.unionByName, parts)


def blended(forecasts: DataFrame, members: Sequence[str], name: str = "blend") -> DataFrame:
    """Mean of fixed members per contest; one missing member leaves it unpriced."""
    mine = forecasts.filter(F.col("forecaster").isin(*members))
    complete = F.count_if(S.is_priced(PROBS)) == len(members)
    return mine.groupBy("fold", KEY, "competition_id", TARGET).agg(
        F.lit(name).alias("forecaster"),
        *[F.when(complete, F.avg(p)).alias(p) for p in PROBS],
    )


def backtest(long: DataFrame, forecasters: int) -> DataFrame:
    """Score table of long forecasts: priced and common subsets, per competition and pooled."""
    return EV.score_table(EV.scored_terms(EV.to_wide(long), forecasters))


def ablation(
    df: DataFrame, folds: Sequence[Fold], make: Callable[..., Family], blocks=tuple(BLOCKS)
) -> DataFrame:
    """Pooled loss with each block withheld, against the full model on the same rows."""
    variants = [("full", design_columns())] + [
        (f"without_{b}", design_columns(without=[b])) for b in blocks
    ]
    families = [replace(make(columns), name=name) for name, columns in variants]
    scores = EV.pooled_table(backtest(fold_forecasts(df, folds, families), len(families)))
    control = scores.filter("forecaster = 'full'").select(
        F.col("log_loss").alias("control_loss"), F.col("rps").alias("control_rps")
    )
    loss, rps = (control.select(c).scalar() for c in ("control_loss", "control_rps"))
    return scores.select(
        "forecaster",
        F.regexp_replace("forecaster", "^without_", "").alias("block"),
        "n",
        "log_loss",
        (F.col("log_loss") - loss).alias("delta_log_loss"),
        (F.col("rps") - rps).alias("delta_rps"),
    )


def search(
    df: DataFrame, folds: Sequence[Fold], make: Callable[..., Family], settings: Sequence[dict]
) -> list[tuple[dict, float]]:
    """Settings by pooled walk-forward loss, best first.

    ``df`` is the slice before the evaluated folds and ``folds`` are its own;
    random folds would let the future into the fit.
    """
    families = []
    for i, one in enumerate(settings):
        families.append(replace(make(**one), name=f"s{i}"))
    forecasts = fold_forecasts(df, folds, families)
    terms = EV.scored_terms(EV.to_wide(forecasts), len(families)).filter("common")
    rows = {r["forecaster"]: r["log_loss"] for r in EV.rank_forecasters(terms).collect()}
    scored = [(one, rows[f"s{i}"]) for i, one in enumerate(settings)]
    return sorted(scored, key=lambda pair: pair[1])
