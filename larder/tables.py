"""Table layouts, planning parameters and the fixed values shared by the operators.

A *series* is one store-and-item demand history and the parallel axis of everything
in this package. After `daily_totals` a series holds at most one row per calendar
day, so a per-series group is bounded by the calendar however hot its raw rows are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from statistics import NormalDist

# ---------------------------------------------------------------------------
# Names and defaults that results depend on.
# ---------------------------------------------------------------------------
CALENDAR_FEATURES = (
    "dow", "month", "is_weekend", "is_xmas", "is_july4", "is_piday", "is_thanksgiving",
)
DEMAND_FEATURES = ("lag_1", "lag_7", "roll7", "roll28")
FEATURES = CALENDAR_FEATURES + DEMAND_FEATURES
REQUIRED_SALES_COLUMNS = ("date", "qty_sold")

DEFAULT_RECIPE = {"apples": 3, "dough": 1}
DEFAULT_LOTS = {"apples": 300, "dough": 120}
DEFAULT_SPECIAL_DAYS = (3, 4, 5, 6)
DEFAULT_REORDER_POINTS = {"apples": 50, "dough": 20}
DEFAULT_RESTOCK_AMOUNTS = {"apples": 300, "dough": 120}
DEFAULT_SHELF_LIFE_DAYS = 3
ALPHA_GRID = (0.1, 0.3, 1.0, 3.0, 10.0)
CV_FOLDS = 5

DEFAULT_MENU = {
    "apples": (
        "Apple Crumble Cups", "Apple Turnovers", "Apple Cider Donuts", "Caramel Apple Slices",
        "Mini Apple Hand Pies", "Apple Compote Pancakes", "Apple-Oat Parfait",
        "Cheddar Apple Grilled Cheese", "Apple Galette Slices",
    ),
    "dough": (
        "Garlic Knots", "Cinnamon Rolls", "Mini Calzones", "Savory Hand Pies",
        "Flatbread Special", "Herb Breadsticks", "Stuffed Bread Bites",
        "Chocolate Swirl Rolls", "Cheese Twists",
    ),
    "_default": (
        "Chef’s Choice Special 1", "Chef’s Choice Special 2", "Chef’s Choice Special 3",
        "Chef’s Choice Special 4", "Chef’s Choice Special 5", "Chef’s Choice Special 6",
    ),
}
DEFAULT_WEEKEND_IDEAS = ("Apple Turnovers", "Apple Cider Donuts", "Mini Apple Hand Pies")
REASONS = {
    "buy": "below_ROP", "special": "surplus_burn", "demand": "projected_demand", "weekend": "weekend_surplus",
}

WEEKDAY_NUMBERS = {"mon": 0, "tue": 1, "wed": 2, "thu": 3, "fri": 4, "sat": 5, "sun": 6}
# ---------------------------------------------------------------------------

ADVISORY_COLUMNS = {
    "date": "date",
    "type": "string",
    "ingredient": "string",
    "qty": "bigint",
    "special_qty": "bigint",
    "message": "string",
    "suggestions": "string",
    "reason": "string",
    "pred_mean": "double",
    "pred_lower": "double",
    "pred_upper": "double",
    "pred_summary": "string",
    "week": "int",
    "window_start": "date",
    "window_end": "date",
}


def weekday_numbers(days) -> list[int]:
    """Weekdays given as 0..6 or by name, as sorted distinct numbers; others are ignored."""
    found = set()
    for day in days or ():
        if isinstance(day, str):
            found.add(WEEKDAY_NUMBERS.get(day.strip()[:3].lower()))
        elif isinstance(day, int) and 0 <= day <= 6:
            found.add(day)
    return sorted(found - {None})


@dataclass(frozen=True)
class Policy:
    """Planning parameters. They are a handful of literals, folded into the query plans."""

    recipe: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_RECIPE))
    lots: Mapping[str, int] = field(default_factory=lambda: dict(DEFAULT_LOTS))
    shelf_life: Mapping[str, int] = field(default_factory=dict)
    start_stock: Mapping[str, int] = field(default_factory=dict)
    menu: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(DEFAULT_MENU))
    weekend_ideas: Sequence[str] = DEFAULT_WEEKEND_IDEAS
    vendor_weekday: int | str | None = 0
    special_days: Sequence[int | str] = DEFAULT_SPECIAL_DAYS
    special_boost_max_per_day: int = 5
    service_level: float = 0.95
    lead_time_days: int = 2
    horizon_days: int = 365
    forecast_year: int | None = None
    interval_alpha: float = 0.05
    suggestion_seed: int = 0
    suggestion_count: int = 5
    # weekly balance and daily signals
    reorder_points: Mapping[str, int] = field(default_factory=lambda: dict(DEFAULT_REORDER_POINTS))
    restock_amounts: Mapping[str, int] = field(default_factory=lambda: dict(DEFAULT_RESTOCK_AMOUNTS))
    restock_weekday: int = 0
    safety_days: int = 2
    surplus_factor: float = 1.5

    def __post_init__(self):
        if not self.recipe:
            raise ValueError("the recipe needs at least one ingredient")
        if self.vendor_weekday is not None:
            number = weekday_numbers([self.vendor_weekday])
            if not number:
                raise ValueError(f"not a weekday: {self.vendor_weekday!r}")
            object.__setattr__(self, "vendor_weekday", number[0])
        object.__setattr__(self, "special_days", tuple(weekday_numbers(self.special_days)))
        if not 0.0 < self.service_level < 1.0:
            raise ValueError("the service level lies strictly between 0 and 1")
        if self.lead_time_days < 0 or self.horizon_days < 0:
            raise ValueError("lead time and horizon cannot be negative")

    @property
    def ingredients(self) -> list[str]:
        return list(self.recipe)

    @property
    def z(self) -> float:
        """Normal deviate of the service level."""
        return NormalDist().inv_cdf(self.service_level)

    def expiry_days(self, ingredient: str) -> int:
        """Days of future need counted before stock on hand spoils."""
        shelf = self.shelf_life.get(ingredient, DEFAULT_SHELF_LIFE_DAYS)
        return self.lead_time_days + int(shelf / 2)

    def with_(self, **changes) -> Policy:
        return replace(self, **changes)

    @classmethod
    def from_config(cls, config: Mapping | None) -> Policy:
        """Policy from a nested store/production/forecast mapping; absent keys keep defaults."""
        config = config or {}
        store = config.get("store") or {}
        production = config.get("production") or {}
        forecast = config.get("forecast") or {}
        given = {
            "recipe": production.get("recipe"),
            "special_days": production.get("special_days"),
            "special_boost_max_per_day": production.get("special_boost_max_per_day"),
            "lots": store.get("restock_lot_size"),
            "vendor_weekday": store.get("vendor_weekday"),
            "service_level": store.get("service_level"),
            "lead_time_days": store.get("lead_time_days"),
            "horizon_days": forecast.get("forecast_horizon_days"),
            "forecast_year": forecast.get("forecast_year"),
        }
        return cls(**{name: value for name, value in given.items() if value is not None})
