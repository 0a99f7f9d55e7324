"""Judgments of several raters: blinding, resolution, partial orders, review queues, gates before metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELATIONS = ("left_preferred", "right_preferred", "tie", "incomparable", "insufficient_information")
FLIPS = {"left_preferred": "right_preferred", "right_preferred": "left_preferred"}


def opinions(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, a, b, agreed): both raters' values; unknown never agrees."""
    x, y = a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("b"))
    return x.join(y, keys).withColumn("agreed", F.col("a").isNotNull() & F.coalesce(F.col("a") == F.col("b"), F.lit(False)))


def resolved(a: DataFrame, b: DataFrame, c: DataFrame, keys: list[str], value: str, at: str, disputed: str | None = None) -> DataFrame:
    """(keys, value, status): agreement, else the third rater's value if it came after both; else unresolved. A disputed
    choice is unresolved, a third judgment that is older than one of the others is ``stale``."""
    side = lambda d, n: d.select(*keys, F.col(value).alias(f"{n}v"), F.col(at).alias(f"{n}t"), (F.col(disputed) if disputed else F.lit(False)).alias(f"{n}d"))
    rows = side(a, "a").join(side(b, "b"), keys, "full_outer").join(side(c, "c"), keys, "left")
    both = F.col("av").isNotNull() & F.col("bv").isNotNull()
    agreed = both & (F.col("av") == F.col("bv"))
    late = F.col("ct") >= F.greatest("at", "bt")
    status = F.when(agreed & ~F.coalesce("ad", F.lit(False)), "agreed").when(~both | agreed | F.col("cv").isNull() | F.coalesce("cd", F.lit(False)), "unresolved").when(~late, "stale").otherwise("adjudicated")
    rows = rows.withColumn("status", status)
    return rows.select(*keys, F.when(F.col("status") == "agreed", F.col("av")).when(F.col("status") == "adjudicated", F.col("cv")).alias(value), "status")


def disagreements(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], errors: str | None = None) -> DataFrame:
    """Keys that both raters judged and whose values differ, null-safe, or that carry errors."""
    x = a.select(*keys, F.struct(*values).alias("a"), (F.size(errors) if errors else F.lit(0)).alias("ea"))
    y = b.select(*keys, F.struct(*values).alias("b"), (F.size(errors) if errors else F.lit(0)).alias("eb"))
    return x.join(y, keys).where(~F.col("a").eqNullSafe(F.col("b")) | (F.col("ea") > 0) | (F.col("eb") > 0)).select(*keys, F.to_json("a").alias("a"), F.to_json("b").alias("b"))


#: What may be wrong with a card, in alphabetical order; and numbers of cells that a task's matrices have at once.
FAULTS = ("against a chain of judgments", "cycle", "missing pair", "pair outside the applicable items", "preference inside a tie", "repeated pair", "unknown relation")
CELLS = 4_000_000


def _orders(sizes: np.ndarray, card: np.ndarray, left: np.ndarray, right: np.ndarray, relation: np.ndarray):
    """(faults, priority, top outcome, wins) of cards of ``sizes`` items; a judgment names its card, two items by their places
    (-1: none of the card's) and the index of a relation (-1: unknown). Faults are rows of flags, wins a flag per item.

    Matrices of ties and preferences are closed: ties are an equivalence, and a preference passes over ties and chains.
    Cards of one size are looked at side by side."""
    faults, starts = np.zeros((len(sizes), len(FAULTS)), bool), np.concatenate([[0], np.cumsum(sizes)])
    flag = lambda name: faults[:, FAULTS.index(name)]
    wins = np.zeros(starts[-1], bool)
    said_any, open_any, unsure = (np.zeros(len(sizes), bool) for _ in range(3))
    known = relation >= 0
    outside = known & ((left == right) | (left < 0) | (right < 0))
    flag("unknown relation")[card[~known]] = True
    flag("pair outside the applicable items")[card[outside]] = True
    good = known & ~outside
    card, left, right, relation = card[good], left[good], right[good], relation[good]
    order = np.argsort(sizes[card], kind="stable")
    card, left, right, relation = card[order], left[order], right[order], relation[order]
    ends = sizes[card]
    for n in np.unique(sizes):
        lo, hi = np.searchsorted(ends, [n, n + 1])
        same = np.flatnonzero(sizes == n)
        place = np.full(len(sizes), -1)
        for first in range(0, len(same), step := max(1, CELLS // max(1, int(n * n)))):
            own = same[first : first + step]
            place[:] = -1
            place[own] = np.arange(len(own))
            c = place[card[lo:hi]]
            i, j, q = left[lo:hi][c >= 0], right[lo:hi][c >= 0], relation[lo:hi][c >= 0]
            c = c[c >= 0]
            times = np.zeros((len(own), n, n), np.int32)
            np.add.at(times, (c, np.minimum(i, j), np.maximum(i, j)), 1)
            judged = (times > 0) | (times > 0).transpose(0, 2, 1)
            tie, better = np.broadcast_to(np.eye(n, dtype=bool), judged.shape).copy(), np.zeros_like(judged)
            is_ = lambda name: q == RELATIONS.index(name)
            for x, y in ((i, j), (j, i)):
                tie[c[is_("tie")], x[is_("tie")], y[is_("tie")]] = True
            better[c[is_("left_preferred")], i[is_("left_preferred")], j[is_("left_preferred")]] = True
            better[c[is_("right_preferred")], j[is_("right_preferred")], i[is_("right_preferred")]] = True
            insufficient = is_("insufficient_information")
            open_any[own[c[insufficient | is_("incomparable")]]] = True
            unsure[own[c[insufficient]]] = True
            flag("repeated pair")[own] = (times > 1).any((1, 2))
            flag("missing pair")[own] = judged.sum((1, 2)) != n * (n - 1)
            ties, said = tie.copy(), better
            for k in range(n):
                ties |= ties[:, :, k, None] & ties[:, None, k]
            weight = ties.astype(np.float32)
            over = (weight @ better.astype(np.float32) @ weight) > 0  # between the classes
            direct = over.copy()
            for k in range(n):
                over |= over[:, :, k, None] & over[:, None, k]
            round_ = (over & over.transpose(0, 2, 1)).any((1, 2))
            inside = (ties & said).any((1, 2))
            flag("cycle")[own], flag("preference inside a tie")[own] = round_ & ~inside, round_ & inside
            flag("against a chain of judgments")[own] = ~round_ & (judged & (ties & ~tie | over & ~said)).any((1, 2))
            said_any[own] = said.any((1, 2))
            best = (ties | direct & said).all(2) & ~faults[own].any(1)[:, None]
            wins[(starts[own][:, None] + np.arange(n)).ravel()] = best.ravel() & (n > 1)
    number = np.add.reduceat(np.append(wins, False).astype(int), starts[:-1]) * (sizes > 0) if len(sizes) else sizes
    lack = lambda other: np.where(unsure, "insufficient_information", other)
    priority = np.where(sizes < 2, "not_comparable", np.where(said_any, np.where(open_any, "partial", "clear"), lack("none")))
    top = np.where(sizes < 2, "not_comparable", np.where(number == 1, "unique_best", np.where(number > 1, "tied_best", lack("undetermined"))))
    return faults, priority, top, wins


def preference(items: list[str], pairs: list[tuple[str, str, str]]) -> tuple[list[str], str, str, list[str]]:
    """(violations, priority, top outcome, best set) of one card: what its pairwise judgments imply."""
    own = sorted(set(items))
    at, names = {x: k for k, x in enumerate(own)}, {x: k for k, x in enumerate(RELATIONS)}
    told = np.array([(at.get(a, -1), at.get(b, -1), names.get(q, -1)) for a, b, q in pairs], dtype=int).reshape(-1, 3)
    faults, priority, top, wins = _orders(np.array([len(own)]), np.zeros(len(told), int), told[:, 0], told[:, 1], told[:, 2])
    return [f for f, x in zip(FAULTS, faults[0], strict=True) if x], str(priority[0]), str(top[0]), [x for x, w in zip(own, wins, strict=True) if w]


def preferences(items: DataFrame, pairs: DataFrame, case: str, item: str = "item", applicability: str = "applicability") -> DataFrame:
    """Per case: number of applicable items, violations, priority, top outcome and best set of its partial order.

    items (case, item, applicability), pairs (case, left, right, relation). A card has some ten items, so a case's arrays are
    small; an item whose applicability is unknown leaves the best set open."""
    own = items.groupBy(case).agg(F.collect_list(F.when(F.col(applicability) == "applicable", F.col(item).cast("string"))).alias("items"), F.max(F.col(applicability) == "insufficient_information").alias("unsure"))
    said = pairs.groupBy(F.col(case).alias("_c")).agg(F.collect_list(F.struct(F.col("left").cast("string").alias("l"), F.col("right").cast("string").alias("r"), F.col("relation").alias("q"))).alias("pairs"))
    return ordered(own.join(said, F.col(case) == F.col("_c"), "left").select(case, "items", "unsure", "pairs"), [case])


def ordered(cards: DataFrame, keys: list[str]) -> DataFrame:
    """The same of cards (keys, items, unsure, pairs) that are already collected; pairs are structs of l, r and q, all texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kinds = ", ".join(f"{k} {cards.schema[k].dataType.simpleString()}" for k in keys)
    rows = cards.select(*keys, "items", F.coalesce("unsure", F.lit(False)).alias("unsure"), *[F.coalesce(F.col(f"pairs.{c}"), F.array().cast("array<string>")).alias(c) for c in "lrq"])

    def owner(column):
        return np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False))

    def lists(counts, values):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)

    def run(batches):
        relations, faults_ = pa.array(RELATIONS, pa.string()), pa.array(FAULTS, pa.string())
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                items, left, right, relation = (batch.column(batch.schema.get_field_index(c)) for c in ("items", "l", "r", "q"))
                names = items.flatten().unique()
                names = names.take(pc.sort_indices(names))  # in the order of code points
                # a card's different items, sorted
                own = np.unique(owner(items) * len(names) + pc.index_in(items.flatten(), value_set=names).to_numpy(zero_copy_only=False))
                sizes = np.bincount(own // max(1, len(names)), minlength=len(batch))
                starts, card = np.concatenate([[0], np.cumsum(sizes)])[:-1], owner(left)

                def places(side, names=names, own=own, card=card, starts=starts):
                    x = pc.index_in(side.flatten(), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
                    key = card * len(names) + x
                    at = np.minimum(np.searchsorted(own, key), max(0, len(own) - 1))
                    return np.where((x >= 0) & (own[at] == key), at - starts[card], -1) if len(own) else np.full(len(x), -1)

                q = pc.index_in(relation.flatten(), value_set=relations).fill_null(-1).to_numpy(zero_copy_only=False)
                faults, priority, top, wins = _orders(sizes, card, places(left), places(right), q)
                told = pc.list_value_length(items).to_numpy(zero_copy_only=False)
                open_ = batch.column(batch.schema.get_field_index("unsure")).to_numpy(zero_copy_only=False).astype(bool) & (told > 1)
                top = np.where(open_, "insufficient_information", top)
                who = own // max(1, len(names))
                wins &= ~open_[who]
                best = lists(np.bincount(who[wins], minlength=len(batch)), names.take(pa.array(own[wins] % max(1, len(names)))))
                bad = lists(faults.sum(1), faults_.take(pa.array(np.nonzero(faults)[1])))
                out = [batch.column(batch.schema.get_field_index(k)) for k in keys]
                yield pa.RecordBatch.from_arrays([*out, pa.array(told, pa.int64()), bad, pa.array(priority.tolist(), pa.string()), pa.array(top.tolist(), pa.string()), best], [*keys, "applicable", "violations", "priority", "top_outcome", "best_set"])

    return rows.mapInArrow(run, f"{kinds}, applicable long, violations array<string>, priority string, top_outcome string, best_set array<string>")


def citation_errors(known: Column, observations: Column, conditions: Column, label: Column, missing: Column) -> Column:
    """Codes of what is wrong with a judgment's citations: ``known`` conditions, cited arrays, label, missing-information codes."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    tests = {
        "UNKNOWN_CONDITION": F.coalesce(F.size(F.array_except(conditions, known)), F.lit(0)) > 0, "NO_CONDITION": empty(conditions),
        "NO_OBSERVATION": empty(observations) & (label != "insufficient_information"), "NO_MISSING_INFORMATION": empty(missing) & (label == "insufficient_information"),
        "UNKNOWN_LABEL": ~F.coalesce(label.isin("applicable", "not_applicable", "insufficient_information"), F.lit(False)),
        "REPEATED_CITATION": F.size(F.array_distinct(observations)) < F.size(observations),
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))


def audited(checks: DataFrame, texts: DataFrame, key: str, excerpt: str, text: str, status: str) -> DataFrame:
    """Checks whose excerpt isn't in the text they cite become ``uncertain``, with a note; an unknown text is a note, too."""
    from tideline.functions.text import verified_excerpt

    rows = checks.join(texts.select(key, F.col(text).alias("_t")), key, "left")
    good = F.coalesce(verified_excerpt(F.col(excerpt), F.col("_t")), F.lit(False))
    note = F.when(F.col("_t").isNull(), "unknown reference").when(~good, "excerpt not found")
    return rows.withColumn("note", note).withColumn(status, F.when(good, F.col(status)).otherwise("uncertain")).drop("_t")


def outcomes(predictions: DataFrame, gold: DataFrame, keys: list[str], predicted: str, label: str, parsed: str) -> DataFrame:
    """Predictions with outcome parse_failure, unjudged, success or error."""
    rows = predictions.join(gold.select(*keys, label), keys, "left")
    return rows.withColumn("outcome", F.when(~F.coalesce(F.col(parsed), F.lit(False)), "parse_failure").when(F.col(label).isNull(), "unjudged").when(F.col(predicted) == F.col(label), "success").otherwise("error"))


def gated(metrics: DataFrame, gold: DataFrame, values: list[str]) -> DataFrame:
    """Metrics with status READY; without any gold row status PENDING and null metrics."""
    any_gold = gold.limit(1).agg((F.count("*") > 0).alias("_g"))  # one row
    return metrics.crossJoin(F.broadcast(any_gold)).select(*[F.when(F.col("_g"), F.col(c)).alias(c) if c in values else F.col(c) for c in metrics.columns], F.when(F.col("_g"), "READY").otherwise("PENDING").alias("status"))


def one_revision(column: str, expected: str) -> Column:
    """As an aggregate: all rows carry the expected revision."""
    return (F.count_distinct(column) == 1) & (F.min(column) == F.lit(expected)) & (F.count(column) == F.count("*"))


def finished(df: DataFrame, batch: str, status: str, terminal: list[str]) -> DataFrame:
    return df.groupBy(batch).agg(F.bool_and(F.coalesce(F.col(status).isin(terminal), F.lit(False))).alias("finished"))
