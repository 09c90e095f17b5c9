"""Matching of all kinds of entities, level by level, in rounds that see the matches of the rounds before."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ABSOLUTE, RELATIVE, mismatch_bound
from ..storage import keep
from .ranking import Registry, accept, score_pairs, without_conflicts

#: Matches (a, b) by kind.
State = dict[str, DataFrame]


@dataclass(frozen=True)
class Kind:
    """Entities that are matched alike: candidates(state, level) gives pairs (a, b, columns of the scorers), of which
    those with a matched end are left out. Where by_scorers is set, it gives the same at levels with the same scorers."""

    name: str
    candidates: Callable[[State, str], DataFrame]
    scorers: Registry
    by_scorers: bool = False


def match_pass(kind: Kind, level: str, state: State, absolute: float = ABSOLUTE, relative: float = RELATIVE) -> bool:
    """One pass over the unmatched entities of a kind under the matches as they are now: score, accept, drop contested
    targets, apply. Whether something was matched."""
    old, maximum = state[kind.name], kind.scorers.maximum(level)
    open_ = kind.candidates(state, level).join(old.select("a"), "a", "left_anti").join(old.select("b"), "b", "left_anti")
    scored = score_pairs(open_, kind.scorers.at(level), mismatch_bound(maximum, absolute, relative) + 1e-6, results=False)
    chosen = without_conflicts(accept(scored.withColumn("raw", F.round("raw", 9)), maximum, absolute, relative))
    fresh = keep(chosen.select("a", "b"))
    if fresh.isEmpty():
        return False
    state[kind.name] = keep(old.unionByName(fresh))
    return True


def auto_match(classes: Kind, members: list[Kind], variables: list[Kind], start: State, most: int = 1000, **thresholds: float) -> State:
    """Matches of all kinds from those of start.

    Classes at the first level, and once more if that matched any. Then for each further level: all kinds
    of members, and classes, until a round matches nothing (a round whose members match nothing ends the
    level if the class pass before it did not match either, but classes get one pass a level in any case).
    At last variables, at the level full, until nothing is matched. Raises after most rounds at one place.

    Where candidates go by scorers, a pass that matched nothing is not run again until something else is matched.
    """
    state, idle = dict(start), set()

    def run(kind: Kind, level: str) -> bool:
        this = (kind.name, *[s.name for s in kind.scorers.at(level)])
        if kind.by_scorers and this in idle:
            return False
        found = match_pass(kind, level, state, **thresholds)
        if found:
            idle.clear()
        else:
            idle.add(this)
        return found

    if run(classes, "initial"):
        run(classes, "initial")
    for level in ("intermediate", "full", "extra"):
        by_class = True
        for _ in range(most):
            by_member = any([run(kind, level) for kind in members])
            if not by_member and not by_class:
                break
            by_class = run(classes, level)
            if not by_member and not by_class:
                break
        else:
            raise RuntimeError(f"matches are still accepted after {most} rounds")
    for _ in range(most):
        if not any([run(kind, "full") for kind in variables]):
            return state
    raise RuntimeError(f"matches are still accepted after {most} rounds")
