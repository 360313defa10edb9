"""Every knob of the categoriser in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

from ledgerleaf import fixed_values as fv


@dataclass(frozen=True)
class CategorizerConfig:
    # features
    word_ngrams: tuple[int, int] = (1, 2)
    char_ngrams: tuple[int, int] = (3, 5)
    word_min_df: int = 2
    char_min_df: int = 2
    word_max_features: int = 150_000
    char_max_features: int = 100_000
    stop_tokens: tuple[str, ...] = tuple(fv.NOISE_TOKENS + fv.CITY_STOP)
    # training
    coarse_trainer: str = "lr"          # 'lr' | 'ovr' | 'sgd' | 'nb'
    fine_trainer: str = "ensemble"      # 'ensemble' | 'nb'
    inverse_regularisation: float = 2.0
    ovr_reg_param: float = 1e-5
    sgd_epochs: int = 4
    sgd_batches: int = 12               # steps of an epoch, whatever the size of the table
    sgd_pieces: int = 2                 # a batch is made of so many pieces, dealt anew each epoch
    sgd_step: float = 16.0
    max_iter: int = 2_000               # a guard; the tolerances end the fits
    coarse_tol: float = 1e-3
    fine_tol: float = 1e-4
    nb_alpha: float = 0.5
    ensemble_weights: tuple[float, float] = (0.7, 0.3)
    # labels
    hierarchy: dict = field(default_factory=lambda: dict(fv.HIERARCHY))
    coarse_floors: dict = field(default_factory=lambda: dict(fv.COARSE_FLOORS))
    fine_floors: dict | None = None     # None: those of the threshold rule
    # calibration
    threshold_rule: str = "v7"          # 'v7' | 'v6'
    calibrate_on: str = "train"         # 'train' | 'holdout'
    holdout_fraction: float = 0.1
    coarse_cal_size: int = 12_000
    coarse_cal_divisor: int = 5
    fine_cal_size: int = 2_000
    fine_cal_min: int = 200
    fine_cal_frac: float = 0.2
    coarse_seed: int = 42
    fine_seed: int = 123
    # scoring
    boost_alignment: str = "key"        # 'key' | 'positional'
    lexicon: dict = field(default_factory=lambda: dict(fv.LEXICON))
    lexicon_coarse: dict = field(default_factory=lambda: dict(fv.LEXICON_COARSE))
    override_rules: tuple = tuple(fv.OVERRIDE_RULES)
    bump: float = fv.LEXICON_BUMP
    low_conf: float = 0.60
    top_features: int = 6
    # probabilities are rounded to this many digits before any comparison, so
    # that decisions do not depend on the order in which partitions are summed
    decision_digits: int = 6
    max_labels: int = 1_000             # a guard: more distinct labels raise an error

    @property
    def effective_fine_floors(self) -> dict:
        if self.fine_floors is not None:
            return self.fine_floors
        return fv.FINE_FLOORS_V6 if self.threshold_rule == "v6" else fv.FINE_FLOORS

    def __post_init__(self):
        if not 0.0 <= self.low_conf <= 1.0:
            raise ValueError(f"low_conf must lie in [0, 1], got {self.low_conf}")
        for name, allowed in (
            ("coarse_trainer", ("lr", "ovr", "sgd", "nb")),
            ("fine_trainer", ("ensemble", "nb")),
            ("threshold_rule", ("v7", "v6")),
            ("calibrate_on", ("train", "holdout")),
            ("boost_alignment", ("key", "positional")),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, got {getattr(self, name)!r}")
