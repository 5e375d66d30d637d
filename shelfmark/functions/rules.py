"""Expressions on rule columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.numeric import divide, infinity

ARROW = "→"


def min_occurrence(transactions: Column) -> Column:
    """Invoices an item must occur in, by the number of invoices."""
    return F.when(transactions < 100, 2).when(transactions < 1000, 3).otherwise(5)


def min_count(support: Column, transactions: Column) -> Column:
    """Smallest count that reaches a support share."""
    return F.ceil(support * transactions)


def leverage(support: Column, antecedent: Column, consequent: Column) -> Column:
    return support - antecedent * consequent


def conviction(consequent: Column, confidence: Column) -> Column:
    return F.when(
        confidence < 1, F.try_divide(F.lit(1.0) - consequent, F.lit(1.0) - confidence)
    ).otherwise(infinity())


def representativity() -> Column:
    """Share of transactions without missing items; boolean baskets have none missing."""
    return F.lit(1.0)


def zhangs_metric(support: Column, antecedent: Column, consequent: Column) -> Column:
    bottom = F.greatest(
        support * (F.lit(1.0) - antecedent), antecedent * (consequent - support)
    )
    return divide(leverage(support, antecedent, consequent), bottom, 0.0)


def jaccard(support: Column, antecedent: Column, consequent: Column) -> Column:
    return divide(support, antecedent + consequent - support, 0.0)


def certainty(confidence: Column, consequent: Column) -> Column:
    return divide(confidence - consequent, F.lit(1.0) - consequent, 0.0)


def kulczynski(support: Column, antecedent: Column, consequent: Column) -> Column:
    return (divide(support, antecedent, 0.0) + divide(support, consequent, 0.0)) / 2


def quoted_items(items: Column) -> Column:
    """Each item in single quotes; one with an apostrophe is put in double quotes."""
    return F.transform(
        items,
        lambda x: F.when(
            x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"'))
        ).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))),
    )


def item_list(items: Column) -> Column:
    """``['a', 'b']``"""
    quoted = quoted_items(items)
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def rule_string(antecedents: Column, consequents: Column, arrow: str = "->") -> Column:
    return F.concat(item_list(antecedents), F.lit(f" {arrow} "), item_list(consequents))


def rule_id(antecedents: Column, consequents: Column) -> Column:
    return F.concat(
        item_list(F.array_sort(antecedents)), F.lit("->"), item_list(F.array_sort(consequents))
    )
