"""Problem 8: items of varying length into containers of fixed capacity.

Sizes are token counts of byte_bpe_50k. A plan is made on the histogram of sizes, which has no more bins than the capacity
has tokens, whatever the number of items: shallow combinations of lengths that fill a window below the capacity are
enumerated, non-negative least squares finds how often to repeat each against the histogram, the counts are rounded down,
and what is left is packed best fit, longest first, by counts. The plan gives each length a run of slots; an item takes
the slot of its rank among the items of its length. Ranks are counted in salted parts, so one length may hold any share.

Defined results: an item above the capacity is split into full pieces and a rest, no other is split; null and empty texts
have size 0 and container 0, which holds nothing else; repeated rows of an id are one item; ties go by id.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, durable, read, spread
from .encoding import encode

SALTS = 64
WINDOW = 64  #: a combination leaves at most capacity / WINDOW tokens unused
FILLERS, PARTNERS, ITERATIONS = 3, 48, 250


def combinations(lengths: list[int], capacity: int) -> list[dict[int, int]]:
    """Combinations of few different lengths that fill the capacity up to the window."""
    window = max(1, capacity // WINDOW)
    out: dict[tuple, dict[int, int]] = {}

    def add(base: dict[int, int]):
        space = capacity - sum(a * n for a, n in base.items())
        if 0 <= space <= window:
            out[tuple(sorted(base.items()))] = base
        hi = bisect.bisect_right(lengths, space)
        for f in lengths[max(0, hi - FILLERS) : hi]:
            if space - f <= window:
                got = dict(base)
                got[f] = got.get(f, 0) + 1
                out[tuple(sorted(got.items()))] = got

    step = max(1, len(lengths) // PARTNERS)
    partners = lengths[::step]
    for a in lengths:
        most = capacity // a
        for k in sorted({1, 2, most // 2, most - 1, most}):
            if 0 < k <= most:
                add({a: k})
        for b in partners:
            if a + b < capacity and a != b:
                add({a: 1, b: 1})
                if (m := (capacity - a) // b) > 1:
                    add({a: 1, b: m})
    return list(out.values())


def nnls(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """x >= 0 of least squares |Ax - h|, A given by its entries: accelerated projected gradient."""
    ax = lambda x: np.bincount(rows, vals * x[cols], len(h))
    at = lambda y: np.bincount(cols, vals * y[rows], n)
    v = np.ones(n)
    for _ in range(20):
        u = at(ax(v))
        v = u / max(np.linalg.norm(u), 1e-12)
    step = 1 / max(np.linalg.norm(at(ax(v))), 1e-12)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(ITERATIONS):
        x2 = np.maximum(0, y - step * at(ax(y) - h))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = x2 + (t - 1) / t2 * (x2 - x)
        x, t = x2, t2
    return x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: times}) of the containers that hold all items of the histogram, lengths 1 to capacity.

    Where long items abound, perfect combinations may use up the short ones that should top them up; so the plan is
    held against best fit alone, and the one of fewer containers is taken."""
    left = {a: n for a, n in histogram.items() if n and a}
    alone = best_fit(dict(left), capacity)
    out: list[tuple[int, dict[int, int]]] = []
    lengths = sorted(left)
    combos = combinations(lengths, capacity) if lengths else []
    if combos:
        at = {a: i for i, a in enumerate(lengths)}
        weight = 0.05 + np.array(lengths) / capacity  # an uncovered long length costs more than a short one
        h = np.array([left[a] for a in lengths], float) * weight
        rows = np.array([at[a] for c in combos for a in c])
        cols = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
        vals = np.array([n for c in combos for n in c.values()], float) * weight[rows]
        x = nnls(rows, cols, vals, h, len(combos))
        fill = np.array([sum(a * n for a, n in c.items()) for c in combos])
        for k in sorted(range(len(combos)), key=lambda k: (-fill[k], -x[k], k)):
            r = min([int(x[k] + 0.5), *(left[a] // n for a, n in combos[k].items())])
            if r > 0:
                out.append((r, combos[k]))
                for a, n in combos[k].items():
                    left[a] -= n * r
    out += best_fit(left, capacity)
    return min(out, alone, key=lambda p: sum(r for r, _ in p))


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit, longest first, by counts: groups of equal containers, sorted by the space left."""
    groups: list[tuple[int, int, int, dict[int, int]]] = []  # (space, order, repeats, content)
    order = 0
    for a in sorted((a for a, n in left.items() if n), reverse=True):
        n = left[a]
        while n:
            i = bisect.bisect_left(groups, (a,))
            if i == len(groups):
                fit = capacity // a
                full, rest = divmod(n, fit)
                for r, k in ((full, fit), (1 if rest else 0, rest)):
                    if r:
                        order += 2
                        bisect.insort(groups, (capacity - a * k, order, r, {a: k}))
                n = 0
                continue
            space, _, r, content = groups.pop(i)
            k = min(space // a, -(-n // r))  # of this length into each
            use = min(r, n // k)
            order += 2
            bisect.insort(groups, (space - a * k, order, use, content | {a: k}))
            if use < r:
                bisect.insort(groups, (space, order + 1, r - use, content))
            n -= use * k
    return [(r, content) for _, _, r, content in groups]


class Slots:
    """The runs of slots of each length: rank -> container."""

    def __init__(self, containers: list[tuple[int, dict[int, int]]]):
        runs: dict[int, list[tuple[int, int, int]]] = {}
        base, used = 1, {}
        for r, content in containers:
            for a, n in content.items():
                runs.setdefault(a, []).append((used.get(a, 0), base, n))
                used[a] = used.get(a, 0) + r * n
            base += r
        self.count = base - 1
        self.runs = {a: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for a, v in runs.items()}

    def of(self, length: int, ranks: np.ndarray) -> np.ndarray:
        start, base, times = self.runs[length]
        k = np.searchsorted(start, ranks, "right") - 1
        return base[k] + (ranks - start[k]) // times[k]


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens) of each text."""

    def run(b: pa.RecordBatch) -> dict:
        d = pc.dictionary_encode(b.column(1), null_encoding="encode")
        offsets, _ = encode(d.dictionary.to_pylist())
        return {"doc_id": b.column(0), "tokens": pa.array(np.diff(offsets).astype(np.int64)).take(d.indices)}

    got = arrow_map(spread(read(spark, sf_dir, "documents", "doc_id", "text")), run, "doc_id bigint, tokens bigint")
    return durable(got.groupBy("doc_id").agg(F.max("tokens").alias("tokens")))


def pieces(sized: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """(capacity_id, doc_id, piece, tokens): each item once per capacity, those above it in pieces."""
    each = F.array(*[F.struct(F.lit(i).alias("capacity_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c in capacities])
    per = sized.select("doc_id", "tokens", F.explode(each).alias("c")).select("doc_id", "tokens", "c.*")
    n = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("tokens") / F.col("capacity")))
    cut = per.select("capacity_id", "doc_id", "tokens", "capacity", F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("piece"))
    return cut.select("capacity_id", "doc_id", "piece", F.least("capacity", F.col("tokens") - (F.col("piece") - 1) * F.col("capacity")).alias("tokens"))


def ranked(items: DataFrame) -> DataFrame:
    """items with their rank among those of equal capacity and size, from 0, counted in salted parts."""
    keys = ["capacity_id", "tokens"]
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    counts = salted.groupBy(*keys, "salt").agg(F.count(F.lit(1)).alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.row_number().over(Window.partitionBy(*keys, "salt").orderBy("doc_id", "piece")) - 1
    return salted.withColumn("part", part).join(counts.withColumn("offset", offset).drop("n"), [*keys, "salt"]).withColumn("rank", F.col("offset") + F.col("part")).drop("salt", "part", "offset")


def p8_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capacity_id, container_id, doc_id, piece, tokens): where each item of documents goes, for each capacity."""
    capacities = [(int(r.capacity_id), int(r.capacity_tokens)) for r in read(spark, sf_dir, "pack_capacity").collect()]  # a fixed table of three rows
    items = pieces(sizes(spark, sf_dir), capacities)
    bins: dict[int, dict[int, int]] = {i: {} for i, _ in capacities}
    # at most one row per capacity and token count up to it
    for r in items.groupBy("capacity_id", "tokens").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        bins[r.capacity_id][r.tokens] = r.n
    slots = {i: Slots(plan(bins[i], c)) for i, c in capacities}

    def run(b: pa.RecordBatch) -> dict:
        cap, tok, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 3, 4))
        out = np.zeros(len(cap), np.int64)
        order = np.lexsort((tok, cap))
        edges = np.flatnonzero(np.diff(cap[order]) | np.diff(tok[order])) + 1
        for part in np.split(order, edges):
            if len(part) and tok[part[0]] > 0:
                out[part] = slots[int(cap[part[0]])].of(int(tok[part[0]]), rank[part])
        return {"capacity_id": b.column(0), "container_id": out, "doc_id": b.column(1), "piece": b.column(2), "tokens": b.column(3)}

    rows = ranked(items).select("capacity_id", "doc_id", "piece", "tokens", F.col("rank").cast("bigint").alias("rank"))
    return arrow_map(rows, run, "capacity_id int, container_id bigint, doc_id bigint, piece bigint, tokens bigint")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capacity_id, containers, tokens, least, fill): containers used against the least there can be, and how full they are."""
    got = p8_packs(spark, sf_dir).where(F.col("container_id") > 0).groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("tokens"))
    by = got.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    cap = read(spark, sf_dir, "pack_capacity", "capacity_id", "capacity_tokens")
    joined = by.join(cap, "capacity_id")
    return joined.select("capacity_id", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
