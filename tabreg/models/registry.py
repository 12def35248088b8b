"""Named regressors and their search spaces."""

from __future__ import annotations

from tabreg.models import ensembles as E
from tabreg.models import iterative as I
from tabreg.models import kernels as K
from tabreg.models import linear as L
from tabreg.models import trees as T
from tabreg.models.base import Regressor
from tabreg.models.knn import KNeighbors
from tabreg.models.search import LogUniform, RandInt, Uniform

REGRESSORS: dict[str, type[Regressor]] = {
    "LinearRegression": L.LinearRegression, "Ridge": L.Ridge, "RidgeCV": L.RidgeCV, "Lasso": L.Lasso,
    "LassoCV": L.LassoCV, "ElasticNet": L.ElasticNet, "ElasticNetCV": L.ElasticNetCV, "Lars": L.Lars,
    "LarsCV": L.LarsCV, "LassoLars": L.LassoLars, "LassoLarsCV": L.LassoLarsCV, "LassoLarsIC": L.LassoLarsIC,
    "OrthogonalMatchingPursuit": L.OrthogonalMatchingPursuit,
    "OrthogonalMatchingPursuitCV": L.OrthogonalMatchingPursuitCV, "BayesianRidge": L.BayesianRidge,
    "TweedieRegressor": E.Tweedie, "GeneralizedLinearRegressor": E.Tweedie, "PoissonRegressor": E.Poisson,
    "GammaRegressor": E.Gamma, "HuberRegressor": E.Huber, "RANSACRegressor": I.Ransac, "SGDRegressor": I.SGD, "PassiveAggressiveRegressor": I.PassiveAggressive,
    "QuantileRegressor": I.Quantile, "LinearSVR": I.LinearSupportVector, "SVR": I.RadialSupportVector,
    "NuSVR": I.NuSupportVector, "KernelRidge": K.KernelRidge, "GaussianProcessRegressor": K.GaussianProcess,
    "TransformedTargetRegressor": I.TransformedTarget, "DummyRegressor": I.Dummy,
    "DecisionTreeRegressor": E.DecisionTree, "RandomForestRegressor": E.RandomForest, "BaggingRegressor": E.Bagging,
    "GradientBoostingRegressor": E.GradientBoosting, "HistGradientBoostingRegressor": E.HistGradientBoosting,
    "XGBRegressor": T.BoostedTreesDepthwise, "LGBMRegressor": T.BoostedTreesLeafwise, "ExtraTreeRegressor": T.ExtraTree,
    "ExtraTreesRegressor": T.ExtraTrees, "AdaBoostRegressor": E.AdaBoost,
    "KNeighborsRegressor": KNeighbors,
}

YES_NO = (True, False)

# The documented search ranges, for the parameters that exist here.
SPACES: dict[str, dict] = {
    "LinearRegression": {"fit_intercept": YES_NO},
    "Ridge": {"alpha": Uniform(0.1, 10), "fit_intercept": YES_NO},
    "RidgeCV": {"alphas": ((0.1, 1.0, 10.0),)},
    "Lasso": {"alpha": (0.1, 0.5, 1.0, 2.0, 5.0, 10.0), "fit_intercept": YES_NO, "max_iter": (1000, 2000, 3000),
              "tol": (1e-4, 1e-3, 1e-2), "positive": YES_NO},
    "LassoCV": {"eps": (1e-3, 1e-2, 1e-1), "n_alphas": tuple(range(100, 1001, 100)), "fit_intercept": YES_NO,
                "max_iter": (500, 1000, 2000, 3000), "tol": (1e-4, 1e-3, 1e-2), "positive": YES_NO},
    "ElasticNet": {"alpha": Uniform(1e-6, 1.0), "l1_ratio": Uniform(0.01, 1.0), "fit_intercept": YES_NO,
                   "max_iter": (1000, 2000, 3000), "tol": (1e-4, 1e-3, 1e-2), "positive": YES_NO},
    "ElasticNetCV": {"l1_ratio": Uniform(0, 0.99), "eps": (1e-3, 1e-2, 1e-1), "n_alphas": (100, 200, 300, 400, 500),
                     "fit_intercept": YES_NO, "max_iter": (500, 1000, 2000, 3000), "tol": (1e-4, 1e-3, 1e-2),
                     "positive": YES_NO},
    "Lars": {"fit_intercept": YES_NO, "n_nonzero_coefs": (100, 200, 300, 400, 500), "eps": Uniform(1e-16, 1e-8)},
    "LarsCV": {"fit_intercept": YES_NO, "max_iter": RandInt(100, 1000), "max_n_alphas": RandInt(100, 2000),
               "eps": Uniform(1e-8, 1e-3)},
    "LassoLars": {"alpha": Uniform(0.1, 10.0), "fit_intercept": YES_NO, "positive": YES_NO},
    "LassoLarsCV": {"fit_intercept": YES_NO, "max_iter": (500, 1000, 1500), "max_n_alphas": (500, 1000, 1500),
                    "eps": (1e-16, 1e-12, 1e-8), "positive": YES_NO},
    "LassoLarsIC": {"criterion": ("aic", "bic"), "fit_intercept": YES_NO, "max_iter": (500, 1000, 1500),
                    "eps": (1e-16, 1e-12, 1e-8)},
    "OrthogonalMatchingPursuit": {"n_nonzero_coefs": (None, 1, 2, 3, 5, 10), "fit_intercept": YES_NO},
    "OrthogonalMatchingPursuitCV": {"fit_intercept": YES_NO},
    "BayesianRidge": {"tol": Uniform(1e-5, 1e-2), "alpha_1": Uniform(1e-8, 1e-4), "alpha_2": Uniform(1e-8, 1e-4),
                      "lambda_1": Uniform(1e-8, 1e-4), "lambda_2": Uniform(1e-8, 1e-4), "alpha_init": Uniform(0.1, 1.0),
                      "lambda_init": Uniform(0.1, 1.0), "fit_intercept": YES_NO},
    "TweedieRegressor": {"power": (0, 1, 2), "alpha": Uniform(0, 1), "fit_intercept": YES_NO,
                         "link": ("auto", "identity", "log"), "max_iter": (100, 500, 1000), "tol": Uniform(1e-5, 1e-2)},
    "HuberRegressor": {"epsilon": Uniform(1.0, 2.0), "alpha": Uniform(1e-6, 1.0), "max_iter": (100, 500, 1000),
                       "fit_intercept": YES_NO, "tol": Uniform(1e-5, 1e-2)},
    "RANSACRegressor": {"min_samples": Uniform(0.1, 0.5), "residual_threshold": Uniform(1.0, 5.0),
                        "max_trials": (100, 200, 300), "loss": ("absolute_error", "squared_error")},
    "SGDRegressor": {"loss": ("squared_error", "huber", "epsilon_insensitive", "squared_epsilon_insensitive"),
                     "penalty": ("l2", "l1", "elasticnet"), "alpha": Uniform(1e-6, 1.0),
                     "l1_ratio": Uniform(0.01, 0.99), "fit_intercept": YES_NO, "epsilon": Uniform(0.1, 1.0),
                     "eta0": Uniform(0.01, 1.0), "power_t": Uniform(0.1, 1.0), "tol": Uniform(1e-5, 1e-2),
                     "n_iter_no_change": (5, 10, 15)},
    "PassiveAggressiveRegressor": {"C": Uniform(0.1, 10.0), "fit_intercept": YES_NO, "tol": Uniform(1e-5, 1e-2), "n_iter_no_change": (5, 10, 15),
                                   "loss": ("epsilon_insensitive", "squared_epsilon_insensitive"), "epsilon": Uniform(0.01, 0.2)},
    "LinearSVR": {"C": Uniform(0.1, 100), "tol": Uniform(1e-4, 1e-2)},
    "SVR": {"C": Uniform(0.1, 100), "kernel": ("linear", "rbf"), "gamma": ("scale", "auto"), "tol": Uniform(1e-4, 1e-2)},
    "NuSVR": {"nu": Uniform(0.1, 0.9), "C": Uniform(0.1, 10), "kernel": ("linear", "rbf"), "gamma": ("scale", "auto"), "tol": Uniform(1e-4, 1e-2)},
    "KernelRidge": {"alpha": Uniform(1e-6, 1.0), "kernel": ("linear", "poly", "rbf", "sigmoid"), "degree": RandInt(1, 10),
                    "gamma": ("scale", "auto"), "coef0": Uniform(-1, 1)},
    "GaussianProcessRegressor": {"alpha": Uniform(1e-10, 1.0), "normalize_y": (False,)},
    "TransformedTargetRegressor": {"regressor": (L.LinearRegression(), L.Ridge(), L.BayesianRidge()),
                                   "transformer": (None, "quantile", "yeo-johnson", "box-cox")},
    "DummyRegressor": {"strategy": ("mean", "median", "quantile", "constant"), "constant": (0.0, 1.0, -1.0),
                       "quantile": (0.0, 0.25, 0.5, 0.75, 1.0)},
    "DecisionTreeRegressor": {"max_depth": (None, *range(1, 21)), "min_samples_leaf": RandInt(1, 11),
                              "min_weight_fraction_leaf": Uniform(0, 0.5), "min_impurity_decrease": Uniform(0, 0.5)},
    "RandomForestRegressor": {"n_estimators": tuple(range(200, 2001, 200)), "max_depth": (10, 20, 30, 40, 50),
                              "min_samples_leaf": (1, 2, 4), "min_weight_fraction_leaf": Uniform(0.0, 0.5),
                              "max_features": ("sqrt", "log2"), "min_impurity_decrease": Uniform(0.0, 0.5),
                              "bootstrap": YES_NO},
    "BaggingRegressor": {"n_estimators": RandInt(10, 200), "max_samples": Uniform(0.1, 1.0),
                         "max_features": Uniform(0.1, 1.0), "bootstrap": YES_NO},
    "GradientBoostingRegressor": {
        "loss": ("squared", "absolute"), "n_estimators": tuple(range(100, 1001, 100)), "subsample": Uniform(0.1, 1.0),
        "learning_rate": (0.0001, 0.001, 0.01, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0),
        "min_samples_leaf": (1, 2, 4), "min_weight_fraction_leaf": Uniform(0.0, 0.5), "max_depth": (3, 4, 5, 6, 7),
        "min_impurity_decrease": Uniform(0.0, 0.5), "max_features": ("sqrt", "log2"), "tol": Uniform(1e-5, 1e-2)},
    "HistGradientBoostingRegressor": {
        "loss": ("squared", "absolute"), "learning_rate": Uniform(0.01, 0.5), "max_iter": RandInt(50, 500),
        "max_depth": (None, *range(2, 20)), "min_samples_leaf": RandInt(5, 50), "max_features": Uniform(0.1, 1.0),
        "max_bins": RandInt(32, 256), "tol": (1e-8, 1e-7, 1e-6, 1e-5)},
    "XGBRegressor": {"max_depth": (4, 5, 6, 7, 8), "learning_rate": (0.1, 0.01, 0.001),
                     "n_estimators": tuple(range(100, 1400, 150)), "subsample": tuple(i / 10 for i in range(1, 10)),
                     "colsample_bytree": tuple(i / 10 for i in range(1, 10)), "reg_alpha": tuple(i / 10 for i in range(1, 10)),
                     "reg_lambda": tuple(i / 10 for i in range(1, 10)), "min_child_weight": tuple(range(2, 8))},
    "LGBMRegressor": {"boosting_type": ("gbdt", "dart", "rf"), "num_leaves": RandInt(10, 200), "max_depth": RandInt(-1, 20),
                      "learning_rate": (0.01, 0.05, 0.1, 0.2, 0.3), "n_estimators": RandInt(100, 1000), "min_split_gain": Uniform(0, 1),
                      "min_child_weight": Uniform(1e-5, 1e-1), "min_child_samples": RandInt(5, 100), "subsample": Uniform(0.5, 1),
                      "subsample_freq": RandInt(0, 10), "colsample_bytree": Uniform(0.5, 1), "reg_alpha": Uniform(0, 1),
                      "reg_lambda": Uniform(0, 1)},
    "ExtraTreeRegressor": {"n_estimators": RandInt(10, 101), "max_depth": (None, *range(1, 21)), "min_samples_split": RandInt(2, 11),
                           "min_samples_leaf": RandInt(1, 11), "min_weight_fraction_leaf": Uniform(0, 0.5),
                           "max_features": ("sqrt", "log2", None), "min_impurity_decrease": Uniform(0, 0.5), "bootstrap": YES_NO},
    "ExtraTreesRegressor": {"n_estimators": tuple(range(100, 1001, 100)), "max_depth": (10, 20, 30, 40, 50), "min_samples_split": (2, 5, 10),
                            "min_samples_leaf": (1, 2, 4), "min_weight_fraction_leaf": Uniform(0.0, 0.5),
                            "max_features": ("auto", "sqrt", "log2"), "min_impurity_decrease": Uniform(0.0, 0.5), "bootstrap": YES_NO},
    "AdaBoostRegressor": {"n_estimators": (50, *range(100, 1001, 100)), "learning_rate": Uniform(0.1, 1.0),
                          "loss": ("linear", "square", "exponential")},
    "KNeighborsRegressor": {"n_neighbors": (3, 5, 7, 9, 11), "weights": ("uniform", "distance"), "p": (1, 2)},
}

# Draws and folds where they differ from 50 and 5.
SEARCH_SIZE: dict[str, tuple[int, int]] = {"LarsCV": (100, 5), "LGBMRegressor": (100, 5), "XGBRegressor": (10, 3)}

# Parameters a user may give own ranges for.
CUSTOM_RANGES = ("RandomForestRegressor", "XGBRegressor", "LGBMRegressor", "GradientBoostingRegressor")


def make(name: str, **params) -> Regressor:
    if name not in REGRESSORS:
        raise ValueError(f"unknown model {name!r}")
    return REGRESSORS[name](**params)


def tune(name: str, df, features, target, *, n_iter: int | None = None, folds: int | None = None, **options):
    """Random search for a named model with its documented space and search size."""
    from tabreg.models.search import random_search

    draws, parts = SEARCH_SIZE.get(name, (50, 5))
    if options.get("custom") and name not in CUSTOM_RANGES:
        raise ValueError(f"own ranges are available for {CUSTOM_RANGES}")
    return random_search(make(name), df, features, target, SPACES.get(name, {}), n_iter=n_iter or draws,
                         folds=folds or parts, **options)


__all__ = ["REGRESSORS", "SPACES", "SEARCH_SIZE", "make", "tune", "LogUniform"]
