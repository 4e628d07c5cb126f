"""Learners that fit all replicates of an experiment in one job.

A learner has ``fit(train, keys, dim, n_classes)`` and ``supports(test, model, keys)``.
``train`` holds (keys, x, y[, w]); every distinct key is one replicate. The model is a
small table with one row per key, so scoring is a join on the key and an expression
over arrays. ``predict`` adds ``y_pred``, the class of largest support, lowest code on ties.
"""

from trustframe.learners.base import Projected
from trustframe.learners.bayes import GaussianBayes
from trustframe.learners.centroid import NearestCentroid
from trustframe.learners.trees import Boosting, DecisionTree, RandomForest

REGISTRY = {
    "DT": DecisionTree,
    "RF": RandomForest,
    "XGB": Boosting,
    "centroid": NearestCentroid,
    "gnb": GaussianBayes,
}

__all__ = ["REGISTRY", "GaussianBayes", "NearestCentroid", "DecisionTree", "RandomForest", "Boosting", "Projected"]
