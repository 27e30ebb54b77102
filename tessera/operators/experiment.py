"""CV-8: the whole model experiment as one function over Spark jobs:
split -> folds -> baseline arena -> random search per model -> soft vote of
the best forms -> select best -> refit on all training rows -> holdout ->
robustness -> runs and champion logged and registered, if a folder is given."""

from __future__ import annotations

import json
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import metrics as MT
from tessera.operators import model as MD
from tessera.operators import sample as SA
from tessera.operators.profile import with_class_weight
from tessera.sources import tracking as TR


def prepare(df: DataFrame, label: str, key: str, test_size: float = 0.2, k: int = 5, seed: int = 42,
            weight: str | dict | None = "balanced") -> tuple[DataFrame, DataFrame]:
    """Stratified holdout split, stratified folds on the training part and
    class weights (balanced or fixed).  Returns (train with ``fold`` and
    ``weight``, holdout)."""
    # split and folds are narrow comparisons of the key's hash: nothing is kept
    d = SA.stratified_split(df, label, key, test_size, seed)
    train = d.where(~F.col("is_test")).drop("is_test")
    test = d.where(F.col("is_test")).drop("is_test")
    train = SA.stratified_folds(train, label, key, k, seed)
    if weight is not None:
        train = with_class_weight(train, label, "weight", None if weight == "balanced" else weight)
    return train, test


def kept_parts(df: DataFrame, label: str, key: str, test_size: float = 0.2, k: int = 5, seed: int = 42,
               weight: str | dict | None = "balanced") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """:func:`prepare` for work that goes over the training rows many times: they are
    kept, in even partitions.  The search for the cuts reads ``df`` a dozen times, so it
    is kept too.  Returns (train, holdout, ``df`` if it was kept here); the caller releases them."""
    owned = None if df.is_cached else df.persist()
    train, test = prepare(df, label, key, test_size, k, seed, weight)
    train = SA.evenly(train, key, train.count()).persist()
    return train, test, owned


def _pipe(model: str, params: Mapping, features, label, wcol, config, seed):
    p = dict(params)
    method, k = p.pop("reducer_method", None), p.pop("reducer_n", 2)
    reducer = {"method": method, "n_components": k} if method and method != "none" else None
    return MD.build_pipeline(model, features, p, label, wcol, config.get("scaling", "standard"), reducer, seed,
                             scale_columns=config.get("scale_columns"))


def run_experiment(df: DataFrame, features: Sequence[str], label: str, key: str, config: Mapping) -> dict:
    """Returns ``{"ranking", "search", "vote", "holdout", "summary", "model",
    "best", "version"}``.

    ``config``: ``models`` {name: params}, ``search`` {name: (space,
    n_trials)}, ``vote_top`` (2), ``weights`` (1..5), ``test_size``, ``folds``,
    ``seed``, ``parallelism``, ``scaling``, ``scale_columns``, ``class_weight``;
    with ``registry`` (a folder) every trial, every CV result and the champion
    with its training and holdout metrics are logged there as runs, and the
    champion, a vote included, is registered as ``name``.

    ``ranking`` has one row per entrant, the vote among them: a model that its
    search improved enters with its best trial, the vote averages the entrants'
    best forms, and the best entrant of all is refitted on all training rows."""
    spark = df.sparkSession
    seed = config.get("seed", 42)
    par = config.get("parallelism", 1)
    train, test, df = kept_parts(df, label, key, config.get("test_size", 0.2), config.get("folds", 5), seed,
                                 config.get("class_weight", "balanced"))
    wcol = "weight" if config.get("class_weight", "balanced") is not None else None
    models = config["models"]
    base_dir = config.get("registry")

    def log(model, stage, params, metrics):
        return TR.append_run(spark, base_dir, model, stage, params, metrics) if base_dir else None
    pipes = {m: _pipe(m, p, features, label, wcol, config, seed) for m, p in models.items()}
    baseline, oofs = MD.arena(pipes, train, key, label, "fold", par)
    base = {r["model"]: r["cv_roc_auc_mean"] for r in baseline.collect()}
    for m, auc in base.items():
        log(m, "baseline", models[m], {"cv_roc_auc": auc})
    best_params = {m: dict(p) for m, p in models.items()}
    searches = []
    for m, (space, n_trials) in (config.get("search") or {}).items():
        res = MD.random_search(m, space, n_trials, train, features, key, label, "fold", wcol, seed, par,
                               baseline_auc=base.get(m), scaling=config.get("scaling", "standard"),
                               scale_columns=config.get("scale_columns"))
        searches.append(res)
        top = None
        for r in res.orderBy(F.desc_nulls_last("cv_roc_auc_mean"), "trial").collect():  # one row per trial
            top = top or r
            log(m, "trial", json.loads(r["params"]), {"cv_roc_auc": r["cv_roc_auc_mean"]})
        if top is not None and top["cv_roc_auc_mean"] is not None and top["cv_roc_auc_mean"] > base.get(m, -1):
            base[m] = top["cv_roc_auc_mean"]
            best_params[m] = {**models[m], **json.loads(top["params"])}
            oofs[m].unpersist()
            _, oofs[m] = MD.cross_validate(_pipe(m, best_params[m], features, label, wcol, config, seed), train, key,
                                           label, "fold", m)
    vote, weights = None, {}
    able = [m for m, _ in sorted(base.items(), key=lambda kv: (-kv[1], kv[0])) if m in MD.HAS_PROBABILITY]
    members = able[: config.get("vote_top", 2)]
    if len(members) >= 2:
        vote = MD.small(MD.soft_vote({m: oofs[m] for m in members}, key, config.get("weights", (1, 2, 3, 4, 5))))
        v = vote.first()
        base["soft_vote"] = v["cv_roc_auc_mean"]
        weights = {m: float(v[f"w_{m}"]) for m in members}
        log("soft_vote", "vote", weights, {"cv_roc_auc": base["soft_vote"]})
    for o in oofs.values():
        o.unpersist()
    ranking = spark.createDataFrame([(m, float(a), json.dumps(best_params.get(m) or weights, sort_keys=True))
                                     for m, a in base.items()], "model string, cv_roc_auc_mean double, params string")
    best = MD.select_best(ranking).first()["model"]

    def refit(m):
        return MD.fit_pipeline(_pipe(m, best_params[m], features, label, wcol, config, seed), train)
    final = MD.VoteModel([(weights[m], refit(m)) for m in members]) if best == "soft_vote" else refit(best)
    hold = MD.small(MD.holdout_evaluate(final, test, label))
    fitted = MD.holdout_evaluate(final, train, label).first()
    h = hold.first()
    run = log(best, "champion", best_params.get(best) or weights, {
        "cv_roc_auc": base[best], "train_roc_auc": fitted["roc_auc"], "roc_auc": h["roc_auc"], "recall": h["recall"]})
    version = None
    if base_dir:
        version = TR.save_model(spark, base_dir, config.get("name", "model"), final, run)
    summary = spark.createDataFrame(
        [(best, float(base[best]), float(h["roc_auc"]), float(h["recall"]))],
        "best_model string, cv_roc_auc double, holdout_roc_auc double, holdout_recall double")
    summary = summary.withColumn("diagnosis", MT.robustness("cv_roc_auc", "holdout_roc_auc"))
    train.unpersist()
    if df is not None:
        df.unpersist()
    return {"ranking": SA.rank_models(ranking, "cv_roc_auc_mean"), "search": searches, "vote": vote, "holdout": hold,
            "summary": summary, "model": final, "best": best, "version": version}
