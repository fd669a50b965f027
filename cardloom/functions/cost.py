"""Prices and model routing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tiers stand for models; callers map them to the names of their provider.
MID, LOW, TOP = "mid-tier", "low-tier", "top-tier"
# Dollars for a million tokens in and out.
PRICES = {MID: (3.00, 15.00), LOW: (0.80, 4.00), TOP: (15.00, 75.00)}
# What an unknown model costs, and the share of the price that a batch pays.
FALLBACK, BATCH_SHARE = (15.00, 75.00), 0.5
# From so many characters or cards on, the middle tier is chosen.
ROUTE_CHARS, ROUTE_CARDS = 10_000, 30


def _price(model: Column, which: int, prices: dict[str, tuple[float, float]]) -> Column:
    known = F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, float(p[which]))])
    return F.coalesce(F.element_at(known, model), F.lit(float(FALLBACK[which])))


def estimated_cost(model: Column, tokens_in: Column, tokens_out: Column, batch: Column | bool = False, prices: dict[str, tuple[float, float]] = PRICES) -> Column:
    """F8: dollars for a call; an unknown model costs the most, a batch half."""
    share = F.when(batch if isinstance(batch, Column) else F.lit(batch), F.lit(BATCH_SHARE)).otherwise(F.lit(1.0))
    cost_in = tokens_in / F.lit(1_000_000.0) * (_price(model, 0, prices) * share)
    return cost_in + tokens_out / F.lit(1_000_000.0) * (_price(model, 1, prices) * share)


def selected_model(chars: Column, cards: Column, force: Column | None = None) -> Column:
    """a forced model wins; long texts and many cards go to the middle tier."""
    routed = F.when((chars >= ROUTE_CHARS) | (cards >= ROUTE_CARDS), F.lit(MID)).otherwise(F.lit(LOW))
    return routed if force is None else F.coalesce(force, routed)


def call_cost(model: str, tokens_in: int, tokens_out: int) -> float:
    """F8 for one call, where it is made."""
    price_in, price_out = PRICES.get(model, FALLBACK)
    return tokens_in / 1_000_000.0 * price_in + tokens_out / 1_000_000.0 * price_out
