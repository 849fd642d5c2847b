"""Run parameters. Names and default values are fixed values: a run must mean what its users expect."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

DETECTORS = ("iforest", "knn", "lof", "gmm", "ocsvm")


@dataclass(frozen=True)
class Params:
    random_seed: int = 42

    train_years: tuple[int, ...] = (2011, 2012, 2013, 2014, 2015, 2016, 2017, 2018, 2019, 2021, 2022)
    test_years: tuple[int, ...] = (2023, 2024, 2025)
    inference_years: tuple[int, ...] = (2026,)
    excluded_years: tuple[int, ...] = (2020,)
    default_year: int = 2025

    min_rows_train: int = 500
    hash_dim_favorecido: int = 64
    hash_mode: str = "native"
    mean_value_group: tuple[str, ...] = ("verba", "conta")

    contamination_iqr_multiplier: float = 1.5
    contamination_min: float = 0.01
    contamination_max: float = 0.15

    detectors: tuple[str, ...] = DETECTORS
    iforest_trees: int = 100
    iforest_sample: int = 256
    knn_k_candidates: tuple[int, ...] = (3, 5, 10, 15)
    lof_k_candidates: tuple[int, ...] = (3, 5, 10, 15)
    gmm_max_components: int = 8
    gmm_reg_covar: float = 1e-4
    gmm_max_iter: int = 100
    ocsvm_nu: float = 0.1
    include_sod: bool = False

    ensemble_strategy: str = "consensus"
    shap_max_records: int | None = None
    temporal_trend_start_year: int = 2011
    temporal_trend_end_year: int = 2025
    top_anomalies_per_category: int = 20

    @classmethod
    def from_dict(cls, values: dict) -> "Params":
        """Build from a plain mapping; unknown keys are ignored, lists become tuples."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)

    def active_detectors(self) -> tuple[str, ...]:
        return (*self.detectors, "sod") if self.include_sod and "sod" not in self.detectors else self.detectors

    def for_year_range(self, start: int, end: int) -> "Params":
        """Keep only the train and test years inside [start, end]."""
        return self.with_(
            train_years=tuple(y for y in self.train_years if start <= y <= end),
            test_years=tuple(y for y in self.test_years if start <= y <= end),
        )
