"""Mixing sources to target shares of all tokens, with a cap on how often a document is used.

The largest mix with exact shares is bounded by the source that is scarcest for its
share: total = min over sources of max_repeats * tokens / share.  A source's budget is
its share of that.  It is filled with whole uses of all its documents, and the rest
with one more use of some of them, chosen by exact token length: documents are counted
by length, the same part of each length's count is taken, and bounded-knapsack dynamic
programming over the lengths fits the remaining budget to the token.  Where one more use
can't meet the budget, whole uses are given back and fitted too, at last all of them.
Which documents of a length are taken is decided by a seeded hash.

Every length is counted exactly, whatever it is.  Counts by length reach the driver: a
source of T tokens has at most sqrt(2 T) distinct lengths, as so many different ones add
up to T.  A fit ends when it meets the budget (or the largest multiple of the lengths'
common divisor in it) or when the table over all sums from 0 has shown that no better
sum exists.  ``CELLS``, ``WORK`` and ``SUMS`` bound that table; a fit that neither meets
the budget nor fits into them says so (``exact`` false in the report) with its shortfall.

Defined results
* documents without a source, of sources without a target or with a target share or
  cap that is null or not positive are not used;
* a source with a target but without tokens gets none; the others keep their shares
  relative to each other, and the report shows what was reached;
* empty and null texts have no tokens and are not used; a document repeated in the
  table is a document for each row;
* equal hashes are ordered by ``doc_id``; rows equal in that too are one another's copies;
* a target named twice counts with the sum of its shares and its largest cap;
* empty tables give an empty mix; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import gcd

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunloom.llm import bpe
from sunloom.session import cut_lineage

#: Buckets of the seeded hash within a length, so that no length is sorted as a whole.
BUCKETS = 1024
#: Longest lengths that the first table reaches over; each table after it reaches so many times further.
REACH, FURTHER = 8, 8
#: Sums of the largest table, sums times steps of work on one, and sums that are kept one by one beyond it.
CELLS, WORK, SUMS = 1 << 26, 1 << 35, 1 << 16
#: Picked lengths up to so many are broadcast; more are left to the planner.
FEW_LENGTHS = 200_000


@dataclass
class Plan:
    """What to take of a source: uses of every document, and so many more uses of each length."""

    source: str
    share: float
    max_repeats: int
    tokens: int
    documents: int
    budget: int = 0
    whole: int = 0
    more: dict[int, int] = field(default_factory=dict)
    exact: bool = True

    @property
    def reached(self) -> int:
        return self.whole * self.tokens + sum(k * n for k, n in self.more.items())


def _powers(n: int) -> Iterator[int]:
    """1, 2, 4, ... and a rest, which add up to ``n`` and of which some add up to anything below."""
    power = 1
    while n > 0:
        k = min(power, n)
        yield k
        n -= k
        power *= 2


def _by_table(lengths: np.ndarray, have: np.ndarray, rest: int, order: np.ndarray) -> tuple[np.ndarray, bool]:
    """How many of each length make the largest sum up to ``rest`` that is found, and whether it is the largest there is."""
    steps = [(int(i), k) for i in order if lengths[i] <= rest for k in _powers(int(min(have[i], rest // lengths[i])))]
    if rest + 1 > CELLS:
        return _by_sums(lengths, rest, steps)
    # first[s]: the step that reached the sum s, which then needs only steps before it.
    first = np.full(rest + 1, -1, np.int32)
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    done = True
    for j, (i, k) in enumerate(steps):
        if j * (rest + 1) > WORK:
            done = False
            break
        size = k * int(lengths[i])
        new = reached[: rest + 1 - size] & ~reached[size:]
        first[size:][new] = j
        reached[size:] |= new
        if reached[rest]:
            break
    take = np.zeros(len(lengths), np.int64)
    at = int(np.flatnonzero(reached)[-1])
    done |= at == rest
    while at:
        i, k = steps[first[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take, done


def _by_sums(lengths: np.ndarray, rest: int, steps: list[tuple[int, int]]) -> tuple[np.ndarray, bool]:
    """``_by_table`` for a large ``rest``: the sums themselves; of more than ``SUMS`` of them only the largest in each of so many parts of the range."""
    sums, kept, held, done = np.zeros(1, np.int64), [], 0, True
    for i, k in steps:
        if sums[-1] == rest:
            break
        held += len(sums)
        if held > CELLS:
            done = False
            break
        kept.append((i, k, sums))
        sums = np.union1d(sums, sums + k * int(lengths[i]))
        sums = sums[sums <= rest]
        if len(sums) > SUMS:
            cell, done = sums // (rest // SUMS + 1), False
            sums = sums[np.r_[cell[1:] != cell[:-1], True]]
    take, at = np.zeros(len(lengths), np.int64), int(sums[-1])
    done |= at == rest
    for i, k, before in reversed(kept):
        j = int(np.searchsorted(before, at))
        if j == len(before) or before[j] != at:
            at -= k * int(lengths[i])
            take[i] += k
    return take, done


def _by_remainder(lengths: np.ndarray, have: np.ndarray, take: np.ndarray, rest: int, order: np.ndarray) -> np.ndarray | None:
    """``take`` changed so that the rest is met: other lengths bring the sum to the rest's remainder by one length, of which more or fewer make up the quotient.

    The least sum for each remainder is kept, so the table has as many cells as the
    dividing length, however large the budget.  None if the rest isn't met so.
    """
    slack = np.minimum(take, have - take)
    pivot = int(np.argmax(slack.astype(float) * lengths))
    w, down, up = int(lengths[pivot]), int(take[pivot]), int(have[pivot] - take[pivot])
    if w > CELLS or slack[pivot] == 0:
        return None
    goal = rest % w
    least = np.full(w, np.iinfo(np.int64).max // 4)
    least[0] = 0
    came: list[tuple[int, int, np.ndarray]] = []
    kept = work = 0

    def met() -> bool:
        return least[goal] < np.iinfo(np.int64).max // 4 and -down <= (rest - int(least[goal])) // w <= up

    for i in order:
        if i == pivot:
            continue
        for k in _powers(int(min(have[i] - take[i], 2 * w))):
            size = k * int(lengths[i])
            other = np.roll(least, size % w) + size
            better = other < least
            if better.any():
                least = np.where(better, other, least)
                came.append((int(i), k, np.packbits(better)))
                kept += w // 8
            work += w
            if met() or kept > CELLS or work > WORK >> 5:
                break
        if met() or kept > CELLS or work > WORK >> 5:
            break
    if not met():
        return None
    take = take.copy()
    at, total = goal, int(least[goal])
    take[pivot] += (rest - total) // w
    for i, k, better in reversed(came):
        if better[at // 8] >> (7 - at % 8) & 1:
            take[i] += k
            at = (at - k * int(lengths[i])) % w
    return take


def fit_sum(counts: dict[int, int], budget: int, seed: int = 0) -> tuple[dict[int, int], bool]:
    """How many of each length to take so that their sum is the largest up to ``budget``, and whether that is certain.

    Starts from the proportional part of all counts, so that the choice is spread over all
    lengths, and fits what remains by tables that reach further and further back, at last to
    the start.
    """
    lengths = np.array(sorted(k for k in counts if k > 0 and counts[k] > 0), np.int64)
    if budget <= 0 or not len(lengths):
        return {}, True
    have = np.array([counts[int(k)] for k in lengths], np.int64)
    total = sum(int(k) * int(n) for k, n in zip(lengths, have))
    if budget >= total:
        return {int(k): int(n) for k, n in zip(lengths, have)}, True
    unit = gcd(*map(int, lengths))
    lengths, budget, total = lengths // unit, budget // unit, total // unit
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(lengths))
    weigh = lambda t: sum(int(k) * int(n) for k, n in zip(lengths, t))
    best, most, certain = np.zeros(len(lengths), np.int64), -1, False
    reach, before = REACH, -1
    while True:
        base, rest = _spread(lengths, have, budget, total, reach * int(lengths[-1]), order)
        if rest != before:
            before = rest
            more, whole_table = _by_table(lengths, have - base, rest, order)
            options = [base + more]
            if weigh(options[0]) < budget and (other := _by_remainder(lengths, have, options[0], budget - weigh(options[0]), order)) is not None:
                options.append(other)
            for take in options:
                if (reached := weigh(take)) > most:
                    best, most = take, reached
            certain = most == budget or (whole_table and rest == budget)
            if certain or not whole_table or rest == budget:
                break
        reach *= FURTHER
    return {int(k) * unit: int(n) for k, n in zip(lengths, best) if n}, certain


def _spread(lengths: np.ndarray, have: np.ndarray, budget: int, total: int, leave: int, order: np.ndarray) -> tuple[np.ndarray, int]:
    """A proportional part of the counts, and single ones in the given order, that leave about ``leave`` of the budget; and what is left."""
    part = max(budget - leave, 0)
    take = np.array([int(n) * part // total for n in have], np.int64)
    rest = budget - sum(int(k) * int(n) for k, n in zip(lengths, take))
    for i in order:
        if rest - lengths[i] >= leave and take[i] < have[i]:
            take[i] += 1
            rest -= int(lengths[i])
    return take, rest


def plan_mix(histogram: dict[str, dict[int, int]], targets: list[tuple[str, float, int]], seed: int = 0) -> list[Plan]:
    """A plan for each target source, from its counts by length."""
    plans = []
    for source, share, repeats in targets:
        counts = histogram.get(source, {})
        plans.append(Plan(source, share, repeats, sum(k * n for k, n in counts.items()), sum(counts.values())))
    able = [p for p in plans if p.tokens > 0]
    if not able:
        return plans
    total = min(p.max_repeats * p.tokens / p.share for p in able)
    for j, p in enumerate(plans):
        if p.tokens == 0:
            continue
        counts = histogram[p.source]
        p.budget = min(int(round(p.share * total)), p.max_repeats * p.tokens)
        most = min(p.budget // p.tokens, p.max_repeats)
        # Even use first; whole uses are only given back where the budget can't be met with them, and at last any use up to the cap is tried.
        ways = [(most, 1), (most - 1, 2), (0, most + 1), (0, p.max_repeats)]
        for whole, again in dict.fromkeys((w, min(n, p.max_repeats - w)) for w, n in ways if w >= 0):
            more, exact = fit_sum({k: n * again for k, n in counts.items()}, p.budget - whole * p.tokens, seed + j)
            if (whole, again) == (most, min(1, p.max_repeats - most)) or whole * p.tokens + sum(k * n for k, n in more.items()) > p.reached:
                p.whole, p.more = whole, more
            p.exact = exact
            if p.reached == p.budget:
                p.exact = True
                break
    return plans


def _used_sources(targets: DataFrame) -> list[tuple[str, float, int]]:
    """The targets as rows: a table with one row a source of the mix."""
    t = (
        targets.filter("source IS NOT NULL AND target_share > 0 AND NOT isnan(target_share) AND max_repeats > 0")
        .groupBy("source")
        .agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    )
    return sorted((r["source"], float(r["share"]), int(r["repeats"])) for r in t.collect())


def mix_with_plans(documents: DataFrame, targets: DataFrame, seed: int = 42, vocabulary: str = bpe.VOCABULARY, folder: str = bpe.TOKENIZERS) -> tuple[DataFrame, list[Plan]]:
    """(doc_id, source, n_tokens, uses) of each document of the mix, and the plans that it follows."""
    spark = documents.sparkSession
    wanted = _used_sources(targets)
    names = [s for s, _, _ in wanted]
    listed = documents.filter(F.col("source").isin(names)) if names else documents.filter("false")
    sized = bpe.count_tokens(listed, ["doc_id", "source"], vocabulary=vocabulary, folder=folder).filter("n_tokens > 0")
    # Sizes are used several times; the encoding is done once.
    sized = cut_lineage(sized.withColumn("h", F.xxhash64("doc_id", "source", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")))
    histogram: dict[str, dict[int, int]] = {}
    for r in sized.groupBy("source", "n_tokens").count().collect():
        histogram.setdefault(r[0], {})[int(r[1])] = int(r[2])
    plans = plan_mix(histogram, wanted, seed)
    shown = spark.createDataFrame([(p.source, p.whole) for p in plans], "source string, whole int")
    # Of each length every document gets a whole number of the further uses, and some of them one more.
    picks = [(p.source, k, n // histogram[p.source][k], n % histogram[p.source][k]) for p in plans for k, n in p.more.items()]
    picked = spark.createDataFrame(picks, "source string, n_tokens long, each long, want long")
    picked = F.broadcast(picked) if len(picks) <= FEW_LENGTHS else picked
    more = sized.withColumn("n_tokens", F.col("n_tokens").cast("long")).join(picked, ["source", "n_tokens"], "left")
    by_bucket = more.filter("want > 0").groupBy("source", "n_tokens", "want", "bucket").count()
    before = Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rest = by_bucket.select("source", "n_tokens", "bucket", F.greatest(F.lit(0), F.least("count", F.col("want") - F.coalesce(F.sum("count").over(before), F.lit(0)))).alias("from_bucket"))
    in_bucket = Window.partitionBy("source", "n_tokens", "bucket").orderBy("h", "doc_id")
    ranked = more.join(rest, ["source", "n_tokens", "bucket"], "left").withColumn("r", F.row_number().over(in_bucket))
    further = F.coalesce("each", F.lit(0)) + (F.col("r") <= F.coalesce("from_bucket", F.lit(0))).cast("int")
    # One row for each target source.
    mixed = (
        ranked.join(F.broadcast(shown), "source")
        .select("doc_id", "source", F.col("n_tokens").cast("int").alias("n_tokens"), (F.col("whole") + further).cast("int").alias("uses"))
        .filter("uses > 0")
    )
    return mixed, plans


def mix(documents: DataFrame, targets: DataFrame, seed: int = 42, vocabulary: str = bpe.VOCABULARY, folder: str = bpe.TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens, uses) of each document of the mix."""
    return mix_with_plans(documents, targets, seed, vocabulary, folder)[0]


def report(mixed: DataFrame, targets: DataFrame, plans: list[Plan]) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_uses, budget, shortfall, exact) of each target source.

    ``budget`` is the number of tokens that the share allows, ``shortfall`` what the mix is
    below it, ``exact`` whether no choice of documents comes nearer to it from below.
    """
    by_source = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens").cast("long") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses")
    )
    total = by_source.agg(F.sum("tokens").alias("total"))
    goals = targets.filter("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    budgets = mixed.sparkSession.createDataFrame([(p.source, p.budget, p.exact) for p in plans], "source string, budget long, exact boolean")
    tokens, budget = F.coalesce("tokens", F.lit(0)), F.coalesce("budget", F.lit(0))
    # One row of one number, and one row for each target source.
    return (
        goals.join(by_source, "source", "left")
        .join(F.broadcast(budgets), "source", "left")
        .join(F.broadcast(total), F.lit(True), "left")
        .select(
            "source",
            "target_share",
            F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"),
            tokens.alias("tokens"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            budget.alias("budget"),
            (budget - tokens).alias("shortfall"),
            F.coalesce("exact", F.lit(True)).alias("exact"),
        )
    )
