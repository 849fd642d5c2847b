from spendguard.plans.fit import Models, fit, list_models, load_models, save_models
from spendguard.plans.run import Run, run
from spendguard.plans.single_category import single_category_forest
from spendguard.plans.score import predict, prepare_for_scoring, score_batch, score_records

__all__ = [
    "Models", "Run", "fit", "list_models", "load_models", "predict", "prepare_for_scoring", "run",
    "save_models", "score_batch", "score_records", "single_category_forest",
]
