"""Condition trees compiled to three-valued Columns: null is unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compile_tree(tree, judged) -> Column:
    """``judged(name)`` gives a condition's Column; a tree is a name or a dict with all, any, not, if/then or optional.

    An ``if`` whose premise is unknown is unknown even if the rest holds; ``optional`` always holds."""
    if isinstance(tree, str):
        return judged(tree)
    if "all" in tree:
        out = F.lit(True)
        for x in tree["all"]:
            out = out & compile_tree(x, judged)
        return out
    if "any" in tree:
        out = F.lit(False)
        for x in tree["any"]:
            out = out | compile_tree(x, judged)
        return out
    if "not" in tree:
        return ~compile_tree(tree["not"], judged)
    if "optional" in tree:
        return F.lit(True)
    premise = compile_tree(tree["if"], judged)
    return F.when(premise.isNull(), F.lit(None).cast("boolean")).when(~premise, True).otherwise(compile_tree(tree["then"], judged))


def applicability(c: Column) -> Column:
    return F.when(c, "applicable").when(~c, "not_applicable").otherwise("insufficient_information")
