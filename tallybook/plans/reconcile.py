"""The whole reconciliation: period clip, one-to-one, many-to-one, timeline, figures."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallybook.operators.clean import clip_to_period
from tallybook.operators.combo import combo_assign, number_combos
from tallybook.operators.match import match_one_to_one, split
from tallybook.operators.view import build_view
from tallybook.session import stored


@dataclass
class Reconciled:
    ledger: DataFrame        # tagged ledger rows
    bank: DataFrame          # tagged bank rows inside the ledger's period
    combos: DataFrame        # one row per combo member
    view: DataFrame          # timeline


def reconcile(ledger: DataFrame, bank: DataFrame, keys: list[str], cap: int | None, tol: int = 3) -> Reconciled:
    """J9. ``cap`` bounds the ledger rows that a combo is looked for in; None is no bound. The tagged sides are written once to the shared checkpoint folder: four later steps read them."""
    bank = clip_to_period(bank, ledger, keys)
    tagged_l, tagged_b = (stored(df) for df in match_one_to_one(ledger, bank, keys, tol))
    free_l, free_b = split(tagged_l)[1], split(tagged_b)[1]
    combos = number_combos(combo_assign(free_b, free_l, keys, cap, tol), free_b, keys)
    return Reconciled(tagged_l, tagged_b, combos, build_view(tagged_l, tagged_b, combos, keys))
