"""Guided analytics on one labelled table, as DataFrame operators.

    profile -> issues -> task -> recommendations -> cleaning / recipes
            -> split, tune, train, compare -> diagnose -> validate on new data -> export
"""

from mlscout.operators.clean import clean, impute, oversample, undersample
from mlscout.operators.issues import find_issues, prep_steps
from mlscout.operators.metrics import metric_set
from mlscout.operators.profile import profile
from mlscout.operators.recipe import Recipe, default_recipe, prep_recipe, recipe_from_options
from mlscout.operators.recommend import recommend
from mlscout.operators.split import assign_folds, split
from mlscout.operators.task import detect_task
from mlscout.plans.findings import explain, write_report
from mlscout.plans.train import compare, load_model, permutation_importance, save_model, train
from mlscout.plans.validate import validate
from mlscout.sources.readers import read_table

__all__ = [
    "Recipe",
    "assign_folds",
    "clean",
    "compare",
    "default_recipe",
    "detect_task",
    "explain",
    "find_issues",
    "impute",
    "load_model",
    "metric_set",
    "oversample",
    "permutation_importance",
    "prep_recipe",
    "prep_steps",
    "profile",
    "read_table",
    "recipe_from_options",
    "recommend",
    "save_model",
    "split",
    "train",
    "undersample",
    "validate",
    "write_report",
]
