"""Ordered first-match classification by substrings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Holds if any phrase occurs, or all phrases of any group do."""

    label: str
    any_of: tuple[str, ...] = ()
    all_of: tuple[tuple[str, ...], ...] = ()

    def test(self, folded: Column) -> Column:
        found = F.lit(False)
        for phrase in self.any_of:
            found = found | F.contains(folded, F.lit(phrase.lower()))
        for group in self.all_of:
            every = F.lit(True)
            for phrase in group:
                every = every & F.contains(folded, F.lit(phrase.lower()))
            found = found | every
        return found


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    default: str


def classify(text: Column, rules: RuleSet) -> Column:
    """The label of the first rule that holds, letter case aside; null counts as empty."""
    folded = F.lower(F.coalesce(text, F.lit("")))
    found = None
    for rule in rules.rules:
        found = F.when(rule.test(folded), rule.label) if found is None else found.when(rule.test(folded), rule.label)
    return F.lit(rules.default) if found is None else found.otherwise(rules.default)


def dispatch(df: DataFrame, label: str, branches: dict[str, dict[str, Column]], otherwise: dict[str, Column] | None = None) -> DataFrame:
    """df with the columns that each label's branch gives, in one pass over the rows. What a branch doesn't give is null, and so is all
    for a label without a branch, unless `otherwise` gives it."""
    names = list(dict.fromkeys(n for branch in [*branches.values(), otherwise or {}] for n in branch))

    def one(name: str) -> Column:
        rest = (otherwise or {}).get(name, F.lit(None))
        for told, branch in reversed(branches.items()):
            rest = F.when(F.col(label) == told, branch.get(name, F.lit(None))).otherwise(rest)
        return rest

    return df.withColumns({name: one(name) for name in names})
