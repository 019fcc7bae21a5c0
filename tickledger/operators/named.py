"""The views under their names, for use from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickledger.operators import views as V


def register_views(tx: DataFrame, accepted: DataFrame | None = None, prefix: str = "") -> list[str]:
    """Make every view a temporary view `<prefix><name>` and return the names.

    Views are unevaluated queries: only what a statement asks for is computed. `accepted`
    is the right side of the self join where that is read from a published view.
    """
    balance, balance2 = V.balance(tx), V.balance_with_time(tx)
    views = {
        "transactions": tx,
        "accepted_transactions": V.accepted_ids(tx),
        "outer_join": V.outer_join(tx, tx if accepted is None else accepted),
        "outer_join_with_time": V.outer_join_with_time(tx, tx),
        "credits": V.credits(tx),
        "debits": V.debits(tx),
        "balance": balance,
        "total": V.total(balance),
        "credits2": V.credits_with_time(tx),
        "debits2": V.debits_with_time(tx),
        "balance2": balance2,
        "total2": V.total(balance2),
        "sums": V.sums(tx),
    }
    for name, view in views.items():
        view.createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{name}" for name in views]
