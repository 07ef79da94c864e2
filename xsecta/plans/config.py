"""Settings of a walk-forward run, their presets, and reading and writing them as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    # The defaults that the runs to match use.
    label: str = ""
    rebalance_freq: str = "ME"
    train_window_days: int = 504
    beta_lookback: int = 252
    signal_type: str = "mom_12_1"
    sector_neutral_signal: bool = False
    sector_neutral: bool = False
    sector_neutral_tol: float | None = None
    sector_soft_row_norm: bool = True
    pca_neutralize: bool = True
    pca_k: int = 2
    pca_neutral_tol: float | None = 0.03
    pca_equalize_risk: bool = False
    risk_model: str = "lw"
    ewma_lambda: float = 0.97
    dollar_neutral: bool = True
    long_only: bool = False
    position_bound: float = 0.10
    gross_limit: float | None = 2.0
    beta_neutralize: bool = True
    beta_limit: float | None = 0.02
    risk_budget_annual: float | None = 0.20
    risk_aversion: float = 5.0
    transaction_cost_bps: float = 5.0
    min_name_change: float = 0.002
    min_port_change: float = 0.05
    benefit_cost_buffer: float = 1.0
    step_fraction: float = 1.0
    standardize_mu: bool = True
    winsor_mu_k: float = 3.0
    overlay_mr: bool = True
    overlay_mr_weight: float = 0.30
    mr_lookback: int = 3
    mr_lambda: float | None = 0.3
    mr_beta_lookback: int = 126
    market_filter: bool = False
    mkt_fast_win: int = 63
    mkt_slow_win: int = 252
    risk_off_shrink: float = 0.5
    crash_protect: bool = True
    crash_fast_win: int = 21
    crash_slow_win: int = 63
    crash_fast_th: float = 0.07
    crash_slow_th: float = 0.12
    crash_shrink_neg: float = 0.5
    vol_target_ex_ante: bool = True
    vol_scale_bounds: tuple[float, float] = (0.7, 1.3)
    combo_mr_weight: float = 0.20
    gp_backend: str = "sklearn"
    gp_train_lookback_days: int = 100
    gp_uncertainty_sizing: bool = True
    gp_sigma_floor: float = 0.25
    gp_n_restarts: int = 0
    gp_alpha: float = 3e-5
    gp_max_train_points: int | None = 200
    gp_refit_every: int = 1
    gp_float32: bool = True
    gp_per_date_name_frac: float | None = 0.4
    gp_label_mode: str = "zmad"
    ny_kernel: str = "rbf"
    ny_components: int = 200
    ny_alpha: float = 1e-2
    ny_gamma: float | None = None
    ny_random_state: int = 0
    ny_time_half_life_days: float | None = 180.0

    @property
    def ann_factor(self) -> int:
        return annual_factor(self.rebalance_freq)

    @property
    def overlay_weight(self) -> float:
        """mr_lambda, where given, takes the place of overlay_mr_weight."""
        return self.overlay_mr_weight if self.mr_lambda is None else self.mr_lambda


# The presets by mode.
PRESETS = {
    "MR_WEEKLY": {"signal_type": "mr_5", "rebalance_freq": "W-FRI", "transaction_cost_bps": 10.0},
    "MOM_MONTHLY": {"signal_type": "mom_12_1"},
    "COMBO_MONTHLY": {"signal_type": "combo_mom_mr"},
    "GP_MONTHLY": {"signal_type": "gp_xs"},
    "NYSTROM_MONTHLY": {"signal_type": "gp_xs", "gp_backend": "nystrom_krr", "overlay_mr": False},
}


def annual_factor(freq: str | None) -> int:
    """Periods a year of a calendar label: weeks, months, else trading days."""
    label = (freq or "").upper()
    return 52 if label.startswith("W") else 12 if label in {"M", "ME", "MS", "BM", "BME"} else 252


def settings(mode: str = "MOM_MONTHLY", overrides: dict | None = None) -> Settings:
    if mode not in PRESETS:
        raise ValueError(f"unknown mode {mode}; known are {', '.join(PRESETS)}")
    return variant(Settings(label=mode.lower()), {**PRESETS[mode], **(overrides or {})})


def variant(base: Settings, overrides: dict) -> Settings:
    """base with overrides; names that it doesn't have are an error."""
    strange = set(overrides) - {f.name for f in fields(Settings)}
    if strange:
        raise ValueError(f"unknown settings {', '.join(sorted(strange))}")
    return replace(base, **overrides)


def dumps(chosen: Settings, **context) -> str:
    """Settings and context (tickers, dates, market) as JSON; the periods a year go with them for those who read it."""
    return json.dumps({"config": asdict(chosen) | {"ann_factor": chosen.ann_factor}, **context}, indent=2, default=str)


def loads(text: str) -> tuple[Settings, dict]:
    held = json.loads(text)
    own = held.pop("config")
    own.pop("ann_factor", None)
    own["vol_scale_bounds"] = tuple(own["vol_scale_bounds"])
    return variant(Settings(), own), held
