"""Elo ratings as column expressions: expected scores, factors, outcomes and one update."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ratings never fall below this.
FLOOR = 100
START = 1000


def expected(own: Column, other: Column, scale: float = 400.0) -> Column:
    """Expected score of ``own``: its strength 10^(rating / scale) in the sum of both."""
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / scale))


def standard_factor(rating: Column, games: Column) -> Column:
    return F.when((rating < 1800) & (games < 30), 100).when(rating < 1800, 50).otherwise(10)


def season_factor(rating: Column, games: Column) -> Column:
    return F.lit(100) - games


def updated(rating: Column, factor: Column, score: Column, expectation: Column) -> Column:
    """The new rating: not below the floor, cut to an integer."""
    return F.greatest(rating + factor * (score - expectation), F.lit(float(FLOOR))).cast("int")


# outcomes from the first side's view; ``inverted`` tells the other side's score of the inverted outcome
def win_draw_loss(own: Column, other: Column) -> Column:
    return F.when(own > other, 1.0).when(own < other, 0.0).otherwise(0.5)


def win_loss_overtime(own: Column, other: Column, regulation: Column, two_point: bool = False, inverted: bool = False) -> Column:
    """Scores of a win or loss in regulation time or later; both sides' need not sum to one."""
    win, lose = (1.0, 0.5) if two_point else (0.666, 0.333)
    won = ~(own > other) if inverted else own > other
    return F.when(won, F.when(regulation, 1.0).otherwise(win)).otherwise(F.when(regulation, 0.0).otherwise(lose))


def score_share(own: Column, other: Column) -> Column:
    return F.when(own + other == 0, 0.5).otherwise(own / (own + other))


def inverted(score: Column) -> Column:
    """The other side's score of an outcome whose scores sum to one: win, draw and loss, or a share."""
    return 1 - score


def by_rating(rating: Column, descending: bool = True) -> Column:
    """Order of ratings: by value, and a missing rating is below all others."""
    return rating.desc_nulls_last() if descending else rating.asc_nulls_first()


@dataclass(frozen=True)
class Strategy:
    """How ratings move: the scale of expectations, and the factor by rating and games played."""

    scale: float
    factor: Callable[[float, int], float]
    factor_column: Callable[[Column, Column], Column]


STANDARD = Strategy(400.0, lambda rating, games: 100 if rating < 1800 and games < 30 else 50 if rating < 1800 else 10, standard_factor)
SEASON = Strategy(200.0, lambda rating, games: 100 - games, season_factor)
