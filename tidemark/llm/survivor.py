"""The surviving value of each duplicate group, field by field: by token-level consensus, or by a ranking where a rule wants one.

The different values of a group are aligned progressively into columns of tokens;
each votes with its weight in every column, for its token or for a gap; the
existing value closest to the winning tokens survives.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored

#: What is typed for "no value", in lower case.
STAND_INS = frozenset(
    "n/a|na|n.a.|n.a|none|null|nil|nan|unknown|not available|not stated|not known|not specified|not applicable|not provided|not given|not disclosed|no value|no data|no name|unspecified|undisclosed|undefined|missing|blank|(blank)|empty|(empty)|(none)|(null)|(unknown)|(n/a)|[blank]|<blank>|<null>|__missing__|tbd|tba|tbc|to be determined|to be confirmed|to be advised|pending|xxx|test|see note|see above|various|same as parent".split("|")
)
BLOCK = 48  # values aligned in one task; how many has no influence on the result
_STEP = 5  # bits of the tree, and so up to 32 branches, that are merged at a time


def usable(value: Column | str) -> Column:
    """Whether a value says anything: not null, not blank, not signs only, not a stand-in."""
    value = F.col(value) if isinstance(value, str) else value
    plain = F.lower(F.regexp_replace(value, r"[\s\p{Cf}]+", " "))
    plain = F.trim(plain)
    return F.coalesce(F.regexp_like(value, F.lit(r"[\p{L}\p{N}]")) & ~plain.isin(sorted(STAND_INS)), F.lit(False))


def tokens_of(value: str) -> list[str]:
    return re.findall(r"\w+|[^\w\s]", value.casefold())


class Profile:
    """Aligned columns: for each, the weight of every token and of the gap ('')."""

    def __init__(self, columns: list[dict[str, float]], weight: float):
        self.columns, self.weight = columns, weight

    @classmethod
    def of(cls, tokens: Sequence[str], weight: float) -> Profile:
        return cls([{t: weight} for t in tokens], weight)

    def align(self, other: Profile) -> Profile:
        """Needleman-Wunsch on columns: columns that share a token match, others cost as much as a gap each."""
        a, b = self.columns, other.columns
        n, m = len(a), len(b)
        said_a, said_b = [c.keys() - {""} for c in a], [c.keys() - {""} for c in b]
        cost = [[j * 2 for j in range(m + 1)]] + [[i * 2] + [0] * m for i in range(1, n + 1)]
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                same = 3 if said_a[i - 1].isdisjoint(said_b[j - 1]) else 0
                cost[i][j] = min(cost[i - 1][j - 1] + same, cost[i - 1][j] + 2, cost[i][j - 1] + 2)
        i, j, out = n, m, []
        while i or j:
            if i and j and cost[i][j] == cost[i - 1][j - 1] + (3 if said_a[i - 1].isdisjoint(said_b[j - 1]) else 0):
                i, j = i - 1, j - 1
                out.append(_votes(a[i], b[j]))
            elif i and cost[i][j] == cost[i - 1][j] + 2:
                i -= 1
                out.append(_votes(a[i], {"": other.weight}))
            else:
                j -= 1
                out.append(_votes({"": self.weight}, b[j]))
        return Profile(out[::-1], self.weight + other.weight)

    def consensus(self) -> list[str]:
        won = [max(c.items(), key=lambda tw: (tw[1], tw[0]))[0] for c in self.columns]
        return [t for t in won if t]

    def pack(self) -> str:
        return json.dumps([self.columns, self.weight])

    @classmethod
    def unpack(cls, packed: str) -> Profile:
        return cls(*json.loads(packed))


def _votes(a: dict[str, float], b: dict[str, float]) -> dict[str, float]:
    out = dict(a)
    for t, w in b.items():
        out[t] = out.get(t, 0.0) + w
    return out


def tokens_of(value: str) -> list[str]:
    return re.findall(r"\w+|[^\w\s]", value.casefold())


def merged(parts: Sequence[tuple[int, str, Profile]], bit: int) -> Profile:
    """Profiles aligned two by two along the binary tree of their keys, from ``bit`` down.

    Which profiles meet, and in which order, follows from the keys alone, so a tree
    may be cut anywhere and its branches be merged elsewhere.  Equal keys are
    aligned in the order of their text.
    """
    if len(parts) == 1:
        return parts[0][2]
    if bit < 0:
        parts = sorted(parts, key=lambda p: p[1])
        whole = parts[0][2]
        for p in parts[1:]:
            whole = whole.align(p[2])
        return whole
    zero = [p for p in parts if not p[0] >> bit & 1]
    one = [p for p in parts if p[0] >> bit & 1]
    if zero and one:
        return merged(zero, bit - 1).align(merged(one, bit - 1))
    return merged(zero or one, bit - 1)


def distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Edit distance of token lists."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def _ranked(rows: DataFrame, group: str, row_id: str, value: str, ranking: Sequence[Column], keep: Column | None) -> DataFrame:
    """``g, id, v, worse`` of usable rows; ``worse`` is least for the best ranked, whatever is null comes last."""
    ok = usable(F.col(value)) if keep is None else keep
    worse = F.array(*[x for r in ranking for x in (r.isNull().cast("double"), -F.coalesce(r.cast("double"), F.lit(0.0)))])
    return rows.where(ok & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(row_id).alias("id"), F.col(value).alias("v"), worse.alias("worse"))


def best_values(rows: DataFrame, group: str, row_id: str, value: str, ranking: Sequence[Column], keep: Column | None = None) -> DataFrame:
    """``group, row_id, value``: for each group the usable value that ``ranking`` puts first.

    Each term of the ranking counts from the greatest down, nulls last; equal rows
    go to the smallest ``row_id``.  ``keep`` says which values are usable; by default
    :func:`usable`.  Groups without one, and null groups, give no row.  Rows are
    compared before anything is shuffled, so a group of any size is no burden.
    """
    best = _ranked(rows, group, row_id, value, ranking, keep).groupBy("g").agg(F.min(F.struct("worse", "id", "v")).alias("b"))
    return best.select(F.col("g").alias(group), F.col("b.id").alias(row_id), F.col("b.v").alias(value))


def consensus_values(
    rows: DataFrame, group: str, row_id: str, value: str, ranking: Sequence[Column], weight: Column, keep: Column | None = None, block: int = BLOCK
) -> DataFrame:
    """``group, row_id, value``: for each group the existing value closest to the consensus of its usable values.

    Votes are sums of ``weight`` (null and negative ones as zero) over the rows that
    bear a value; copies of a row count once.  Of equally close values the one with
    the best row by ``ranking`` is taken, as in :func:`best_values`.

    Equal values are summed before anything is aligned.  Values are aligned two by
    two along the binary tree of their hashes.  A group of more than ``block``
    different values is cut into branches of that tree, which are merged level by
    level: the same alignments in the same order, so the result is the same for
    every ``block``, and no task holds all values of a large group.  A profile
    holds each token once a column.
    """
    w = F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    plain = _ranked(rows.withColumn("_w", w), group, row_id, value, ranking, keep)
    weights = rows.where((usable(F.col(value)) if keep is None else keep) & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(row_id).alias("id"), F.col(value).alias("v"), w.alias("w")).distinct()
    best = plain.groupBy("g", "v").agg(F.min(F.struct("worse", "id")).alias("b"))
    said = weights.groupBy("g", "v").agg(F.sum("w").alias("w")).join(best, ["g", "v"]).withColumn("h", F.xxhash64("v"))
    said = stored(said, "values")
    sizes = said.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # as many leading bits of the hash as leave half a block to a branch
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(max(1, block / 2))))).cast("int")
    placed = said.join(sizes.select("g", F.when(F.col("n") > block, bits).otherwise(0).alias("bits")), "g")
    placed = placed.withColumn("branch", F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(h, 64 - bits)")).otherwise(F.lit(0).cast("long")))

    @F.pandas_udf("array<string>")
    def aligned(groups: pd.Series, bits: pd.Series) -> pd.Series:
        out = []
        for items, b in zip(groups, bits, strict=True):
            parts = [(x["h"] & (1 << 64) - 1, x["v"], Profile.of(tokens_of(x["v"]), float(x["w"]))) for x in items]
            whole = merged(parts, 63 - b)
            out.append(whole.consensus() if b == 0 else [whole.pack()])
        return pd.Series(out)

    @F.pandas_udf("array<string>")
    def joined(groups: pd.Series, bits: pd.Series) -> pd.Series:
        out = []
        for items, b in zip(groups, bits, strict=True):
            whole = merged([(x["branch"], "", Profile.unpack(x["p"])) for x in items], min(_STEP, b) - 1)
            out.append(whole.consensus() if b <= _STEP else [whole.pack()])
        return pd.Series(out)

    level = placed.groupBy("g", "bits", "branch").agg(F.collect_list(F.struct("h", "v", "w")).alias("items"))
    level = stored(level.select("g", "bits", "branch", aligned("items", "bits").alias("p")), "profiles")
    target = level.where("bits = 0").select("g", F.col("p").alias("target"))
    while not (open_ := level.where("bits > 0")).isEmpty():
        up = open_.withColumn("up", F.expr(f"shiftright(branch, least(bits, {_STEP}))"))
        held = F.struct(F.expr(f"branch & (shiftleft(1L, least(bits, {_STEP})) - 1)").alias("branch"), F.get("p", F.lit(0)).alias("p"))
        up = up.groupBy("g", "bits", "up").agg(F.collect_list(held).alias("items"))
        level = stored(up.select("g", F.greatest(F.lit(0), F.col("bits") - _STEP).alias("bits"), F.col("up").alias("branch"), joined("items", "bits").alias("p")), "profiles")
        target = target.unionByName(level.where("bits = 0").select("g", F.col("p").alias("target")))

    @F.pandas_udf("int")
    def away(value: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([distance(tokens_of(v), list(t)) for v, t in zip(value, target, strict=True)])

    near = said.join(target, "g").select("g", "v", "b", away("v", "target").alias("d"))
    won = near.groupBy("g").agg(F.min(F.struct("d", "b.worse", "b.id", "v")).alias("c"))
    return won.select(F.col("g").alias(group), F.col("c.id").alias(row_id), F.col("c.v").alias(value))
