"""Model fitting and scoring on ``pyspark.ml``.

The feature matrix is one ``VectorAssembler`` over the fitted numeric
expressions (M04) and one-hot indicator expressions (M05, unknown level ->
all zeros); names are kept in matrix order for attribution. Estimators are
written as Spark jobs (``logistic``, ``forest``, ``boosting``, ``isotonic``); Platt calibration is Spark's logistic regression.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipway.operators import boosting as gb
from slipway.operators import forest as fr
from slipway.operators import isotonic as iso
from slipway.operators import logistic as lg
from slipway.operators import prep as pp

# Estimator settings of the pipeline configuration.
LR_C, LR_MAX_ITER = 1.0, 1000
RF_TREES, RF_DEPTH = 300, 10
GBT_ITER, GBT_DEPTH, GBT_STEP = 300, 6, 0.05
SEED = 42
FITS_AT_ONCE = 4


class Prepared:
    """Fitted preparation bundle: numeric + categorical fits and output names."""

    def __init__(self, num_fit: dict, cat_fit: dict):
        self.num_fit, self.cat_fit = num_fit, cat_fit
        self.names = list(num_fit) + pp.one_hot_vector_names(cat_fit)

    def only(self, cols) -> "Prepared":
        """The fit of some of the columns; columns are fitted one by one, so it is what a fit on them alone gives."""
        return Prepared({c: p for c, p in self.num_fit.items() if c in cols}, {c: p for c, p in self.cat_fit.items() if c in cols})

    def transform(self, df: DataFrame, keep=("order_id", "seller_id", "as_of_date", "block")) -> DataFrame:
        """Fitted transform; keeps ids, date, block and label columns."""
        num = [pp._scaled(c, p).alias(f"_f{i}") for i, (c, p) in enumerate(self.num_fit.items())]
        cat, j = [], len(num)
        for c, p in self.cat_fit.items():
            v = F.coalesce(F.col(c), F.lit(p["mode"]))
            for lv in p["levels"]:
                cat.append((v == F.lit(lv)).cast("double").alias(f"_f{j}"))
                j += 1
        kept = [c for c in df.columns if c in set(keep) or c.startswith("is_late") or c == "y"]
        x = df.select(*kept, *num, *cat)
        va = VectorAssembler(inputCols=[f"_f{i}" for i in range(j)], outputCol="features", handleInvalid="keep")
        return va.transform(x).select(*kept, "features")


    def save(self, path: str) -> str:
        """The fitted preparation as one row of JSON."""
        row = (json.dumps(self.num_fit), json.dumps(self.cat_fit))
        SparkSession.getActiveSession().createDataFrame([row], "num string, cat string").write.mode("overwrite").parquet(path)
        return path

    @classmethod
    def load(cls, path: str) -> "Prepared":
        r = SparkSession.getActiveSession().read.parquet(path).first()
        return cls(json.loads(r["num"]), json.loads(r["cat"]))


def fit_prep(train: DataFrame, target: str) -> Prepared:
    num, cat = pp.feature_columns(train, target, extra_exclude=["_rid"])
    return Prepared(pp.fit_numeric(train, num), pp.fit_categorical(train, cat))


def fit_logistic(train: DataFrame, target: str):
    """L2 logistic regression, C=1, balanced weights (``operators.logistic``): C times the sum of the weighted
    losses and half the squared coefficients."""
    w = pp.class_weights(train, target).first()
    return lg.fit(train, target, (w["w_neg"], w["w_pos"]), 1.0 / LR_C, LR_MAX_ITER)


def fit_forest(train: DataFrame, target: str, trees: int = RF_TREES, depth: int = RF_DEPTH):
    """Random forest with balanced weights (``operators.forest``)."""
    w = pp.class_weights(train, target).first()
    return fr.fit(train, target, (w["w_neg"], w["w_pos"]), trees, depth, SEED)


def fit_boosting(train: DataFrame, target: str, iters: int = GBT_ITER, depth: int = GBT_DEPTH,
                 step: float = GBT_STEP):
    """Gradient-boosted trees with class weights (``operators.boosting``)."""
    return gb.fit(train, target, {"maxIter": iters, "maxDepth": depth, "stepSize": step})


def score(model, df: DataFrame, name: str = "score") -> DataFrame:
    """P(y=1) as a double column (Spark's own models: Arrow-free, JVM-side vector access)."""
    if hasattr(model, "transform_scores"):
        return model.transform_scores(df, name)
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]) \
                .drop("rawPrediction", "probability", "prediction")


def fit_isotonic(calib: DataFrame, target: str, score_col: str = "score"):
    """Isotonic calibration (``operators.isotonic``); needs >= 200 rows and both classes."""
    return iso.fit_isotonic(calib, target, score_col)


def fit_platt(calib: DataFrame, target: str, score_col: str = "score"):
    """Sigmoid (Platt) calibration: logistic regression on the score."""
    va = VectorAssembler(inputCols=[score_col], outputCol="_s")
    lr = LogisticRegression(featuresCol="_s", labelCol=target, predictionCol="_pp", probabilityCol="_prob",
                            rawPredictionCol="_raw")
    return va, lr.fit(va.transform(calib))


def apply_platt(va_model, df: DataFrame) -> DataFrame:
    va, m = va_model
    return m.transform(va.transform(df)).withColumn("calibrated", vector_to_array("_prob")[1]) \
            .drop("_s", "_pp", "_prob", "_raw")


def fit_stacking(train: DataFrame, target: str, base_fitters: dict, n_splits: int = 3, order_col: str = "as_of_date",
                 id_col: str = "_rid"):
    """Temporal stacking. Forward-chaining folds over the train rows
    (M03): for fold i every base model is fitted on the rows before the
    fold and scores the fold (the earliest block is never scored); a
    balanced logistic regression is fitted on the out-of-fold scores; the
    base models are then refitted on all train rows. The loop runs over
    n_splits x len(base_fitters) fits (a bounded parameter loop), each a
    distributed fit."""
    from slipway.operators.split import fold_starts
    from slipway.session import cut_lineage
    before = fold_starts(train, n_splits, order_col, id_col)
    parts = {**{i: train.filter(b) for i, b in before.items()}, "all": train}
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:  # fits of different folds and bases do not wait for each other
        fits = {(i, n): pool.submit(fit, part, target) for i, part in parts.items() for n, fit in base_fitters.items()}
        fitted = {k: v.result() for k, v in fits.items()}
    oof = None
    for i in sorted(before):
        fold = train.filter(~before[i])
        scored = (fold.filter(before[i + 1]) if i + 1 in before else fold).select(id_col, target, "features")
        for name in base_fitters:
            scored = score(fitted[i, name], scored, f"s_{name}")
        oof = scored if oof is None else oof.unionByName(scored)
    names = [f"s_{n}" for n in base_fitters]
    meta_in = VectorAssembler(inputCols=names, outputCol="features").transform(oof.drop("features"))
    meta = fit_logistic(cut_lineage(meta_in), target)
    bases = {n: fitted["all", n] for n in base_fitters}
    return StackedModel(bases, meta, names)


class StackedModel:
    """Bases -> meta logistic regression, applied as one transform chain."""

    def __init__(self, bases: dict, meta, names: list[str]):
        self.bases, self.meta, self.names = bases, meta, names

    def transform_scores(self, df: DataFrame, out: str = "score") -> DataFrame:
        x = df
        for n, m in self.bases.items():
            x = score(m, x, f"s_{n}")
        x = VectorAssembler(inputCols=self.names, outputCol="_meta").transform(x)
        x = x.withColumnRenamed("features", "_features").withColumnRenamed("_meta", "features")
        x = score(self.meta, x, out)
        return x.drop("features", *self.names).withColumnRenamed("_features", "features")

    @property
    def numFeatures(self) -> int:
        return next(iter(self.bases.values())).numFeatures

    def save(self, path: str) -> None:
        for n, m in self.bases.items():
            save_model(m, f"{path}/base-{n}")
        save_model(self.meta, f"{path}/meta")
        kinds = {cls: k for k, cls in _KINDS.items()}
        rows = [(i, n, kinds[type(m).__name__]) for i, (n, m) in enumerate(self.bases.items())]
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(rows, "at int, name string, kind string").write.mode("overwrite").parquet(f"{path}/bases")

    @classmethod
    def load(cls, path: str) -> "StackedModel":
        rows = SparkSession.getActiveSession().read.parquet(f"{path}/bases").orderBy("at").collect()
        bases = {r["name"]: load_model(r["kind"], f"{path}/base-{r['name']}") for r in rows}
        return cls(bases, load_model("logistic_regression", f"{path}/meta"), [f"s_{n}" for n in bases])


# ------------------------------------------------------------------ artifacts (S20) and checks
_KINDS = {"logistic_regression": "LogisticFit", "random_forest": "Forest",
          "boosting": "BoostedTrees"}


def save_model(model, path: str) -> str:
    """Persist a fitted model."""
    model.save(path)
    return path


def load_model(kind: str, path: str):
    kinds = {"ensemble": StackedModel, "logistic_regression": lg.LogisticFit, "random_forest": fr.Forest, "boosting": gb.BoostedTrees}
    return kinds[kind].load(path)


def check_feature_space(prep: "Prepared", model, stored_names: list[str] | None = None) -> bool:
    """The model's input width must equal the prepared feature names;
    a stored name list that differs from the current one marks a stale
    model (returns False, the caller skips it)."""
    if model.numFeatures != len(prep.names):
        raise ValueError(f"model expects {model.numFeatures} features, preparation yields {len(prep.names)}")
    return stored_names is None or list(stored_names) == list(prep.names)
