"""Parameters of an evaluation: defaults, presets, bounds for overrides."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """Rates are shares, amounts are euros."""

    rate: float = 0.127
    exchange_fee: float = 0.025
    agent_fee: float = 0.05
    inspection: float = 3.0
    source_shipping: float = 5.0
    insurance: float = 0.015
    freight: float = 30.0
    customs: float = 15.0
    duty: float = 0.0
    home_shipping: float = 7.0
    vat: float = 0.23
    fee_olx: float = 0.0
    fee_vinted: float = 0.05
    fee_kuantokusta: float = 0.0
    fee_amazon: float = 0.08
    fee_default: float = 0.05
    min_margin: float = 0.15
    min_profit: float = 30.0
    hide_above: float = 60.0


#: The least and greatest that an override may be.
BOUNDS = {
    "rate": (0.01, 1), "exchange_fee": (0, 0.5), "agent_fee": (0, 0.5), "insurance": (0, 0.5), "inspection": (0, 100),
    "source_shipping": (0, 200), "freight": (0, 1000), "customs": (0, 500), "home_shipping": (0, 500), "duty": (0, 1),
    "vat": (0, 1), "min_margin": (0, 1), "min_profit": (0, 10000), "hide_above": (0, 100),
}
#: Whole cost modes, and what forwarders charge.
PRESETS = {
    "conversion": Config(exchange_fee=0, agent_fee=0, inspection=0, source_shipping=0, insurance=0, freight=0, customs=0, duty=0, home_shipping=0, vat=0, min_margin=0, min_profit=0, hide_above=100),
    "realistic": Config(),
    "conservative": Config(exchange_fee=0.03, agent_fee=0.07, inspection=5, source_shipping=8, insurance=0.025, freight=50, customs=25, duty=0.05, home_shipping=12, min_margin=0.25, min_profit=50, hide_above=40),
}
FORWARDERS = {
    "cssbuy": Config(),
    "superbuy": Config(inspection=4, source_shipping=4, insurance=0.01, freight=28),
    "wegobuy": Config(agent_fee=0.04, inspection=4, freight=32),
    "bhiner": Config(agent_fee=0.03, inspection=5, source_shipping=6, insurance=0.01, freight=35, customs=18),
}


def overridden(config: Config, **changes: float) -> Config:
    """config with changes brought within bounds; unknown names and values that are no finite numbers are refused."""
    known = {f.name for f in fields(Config)}
    for name, value in changes.items():
        if name not in known or name not in BOUNDS:
            raise ValueError(f"{name} cannot be overridden")
        if not isinstance(value, (int, float)) or value != value or abs(value) == float("inf"):
            raise ValueError(f"{name} must be a finite number")
    return replace(config, **{k: min(max(float(v), BOUNDS[k][0]), BOUNDS[k][1]) for k, v in changes.items()})
