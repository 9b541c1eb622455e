"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints at most r bits apart, cut into partitions with thresholds t_p where the t_p + 1 add
up to r + 1, are at most t_p bits apart in at least one partition p (a threshold of -1 leaves a
partition out). So it is enough to probe, for each partition, the values within t_p of a
fingerprint's own value there, and to verify what is found.

* The partitions and thresholds come from a bounded sample of distinct fingerprints: correlated bits
  are grouped into one partition, and dynamic programming spreads the thresholds so that estimated
  probes and candidate pairs are fewest. The plan steers cost only; any plan finds every link.
* Rows with one partition and value meet in a sorted run. A run gives a spanning forest of its links
  instead of all its pairs: at most one edge fewer than it has fingerprints. A long run (families of texts
  that share whole partitions) is split by the same principle over its other bits, again and again, so
  that no task holds more than ``LONG_RUN`` rows of a run unless few bits are left to tell them apart.
* Components of distinct fingerprints grow from those forests by hooking to the smallest neighbour and
  contraction. Copies and equal fingerprints are one vertex throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.exact_dedup import UPPER
from pagemill.llm.simhash import as_hex, fingerprints, words
from pagemill.session import written

WORD_BREAKS = r"[\x20\x09-\x0D]+"
#: A probe row costs about as much as this many verified candidates (shuffle and sort against a popcount).
PROBE_COST = 20.0
#: Runs up to this length are compared by shifted slices, longer ones by pivots.
SHORT_RUN = 48
#: Longer runs are split, as long as more than ``FEW_BITS`` of the 64 bits are open in them: few bits make few values.
LONG_RUN, FEW_BITS = 20_000, 12


# ---------------------------------------------------------------- plan


def correlated_groups(sample: np.ndarray, parts: int) -> list[list[int]]:
    """64 bit numbers in ``parts`` groups of nearly equal size; each group gathers, from its first bit,
    the free bits most correlated with the group."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(axis=0) if len(bits) else 0
    norm = np.sqrt((bits**2).sum(axis=0))
    corr = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    free, groups = list(range(64)), []
    for p in range(parts):
        size = 64 * (p + 1) // parts - 64 * p // parts
        pairs = corr[np.ix_(free, free)] - 2 * np.eye(len(free))
        group = [free[int(np.argmax(pairs.max(axis=1)))]]
        while len(group) < size:
            rest = [b for b in free if b not in group]
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].mean(axis=1)))])
        groups.append(sorted(group))
        free = [b for b in free if b not in group]
    return groups


def part_value(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def share_within(sample: np.ndarray, bits: list[int], limit: int, pairs: int = 200_000) -> list[float]:
    """Estimated share of fingerprint pairs at most 0, 1, ... ``limit`` apart in ``bits``."""
    values, floor = part_value(sample, bits), [sum(comb(len(bits), k) for k in range(t + 1)) / 2.0 ** len(bits) for t in range(limit + 1)]
    if len(sample) < 2:
        return floor
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, len(values), pairs), rng.integers(0, len(values), pairs)
    apart = np.bitwise_count(values[a] ^ values[b])[a != b]
    return [max(float((apart <= t).mean()), floor[t]) for t in range(limit + 1)]


def allocate(cost: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds t_p >= -1 with sum(t_p + 1) = radius + 1 that make the sum of cost[p][t_p + 1] least."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        grown: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for u in range(min(len(row) - 1, radius + 1 - used) + 1):
                got = (c + row[u], [*ts, u - 1])
                if used + u not in grown or got < grown[used + u]:
                    grown[used + u] = got
        best = grown
    return best[radius + 1]


def plan(sample: np.ndarray, total: int, radius: int = 3, choices: tuple[int, ...] = (2, 3, 4, 5)) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the cheapest partitioning for ``total`` distinct fingerprints."""
    found = []
    for parts in choices:
        groups = correlated_groups(sample, parts)
        cost = []
        for g in groups:
            share = share_within(sample, g, radius)
            row = [0.0]
            for t in range(radius + 1):
                probes = sum(comb(len(g), k) for k in range(t + 1))
                rows = 1 if t == 0 else 1 + probes  # with t = 0 one row both waits and probes
                row.append(PROBE_COST * total * rows + share[t] * total * total / 2)
            cost.append(row)
        least, thresholds = allocate(cost, radius)
        found.append((least, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


# ---------------------------------------------------------------- probes


def neighbours(width: int, limit: int) -> np.ndarray:
    """Masks with 1 to ``limit`` of ``width`` bits."""
    return np.array([sum(1 << b for b in c) for k in range(1, limit + 1) for c in combinations(range(width), k)], dtype=np.uint64)


def probe_rows(parts: list[tuple[list[int], int]]):
    """mapInArrow: fp -> (part, value, fp, probe) for every value to wait at (probe false) or to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = [neighbours(len(bits), t) for bits, t in parts]
        for batch in batches:
            whole = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(whole), 2000):
                fps = whole[lo : lo + 2000]
                for p, (bits, _) in enumerate(parts):
                    own = part_value(fps, bits)
                    values = np.concatenate([own, (own[:, None] ^ around[p]).ravel()])
                    found = np.concatenate([fps, np.repeat(fps, len(around[p]))])
                    probe = np.arange(len(values)) >= len(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), p, dtype=np.int32)), pa.array(values.view(np.int64)), pa.array(found.view(np.int64)), pa.array(probe)],
                        names=["part", "value", "fp", "probe"],
                    )

    return run


def finer_rows(radius: int):
    """mapInArrow: (part, value, used, fp) of a run -> the same columns, once for each of ``radius`` + 1 groups of the
    bits not in ``used``. Two fingerprints at most ``radius`` bits apart agree on one of the groups, so they meet
    again. The new value is a hash of the old key and the group's bits; runs that it throws together only cost time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy().astype(np.uint64)
            value, used, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("value", "used", "fp"))
            for mask in np.unique(used):
                at = used == mask
                fps, key = fp[at], mixed(value[at] + mixed(part[at]))
                free = [b for b in range(64) if not int(mask) >> b & 1]
                for k in range(radius + 1):
                    bits = free[k :: radius + 1]
                    after = mask | np.uint64(sum(1 << b for b in bits))
                    made = mixed(key + mixed(part_value(fps, bits) + np.uint64(k << 60)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(fps), k, dtype=np.int32)), pa.array(made.view(np.int64)), pa.array(np.full(len(fps), after).view(np.int64)), pa.array(fps.view(np.int64))],
                        names=["part", "value", "used", "fp"],
                    )

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bounded_runs(runs: DataFrame, radius: int, longest: int = LONG_RUN) -> DataFrame:
    """(part, value, fp) from the runs (part, value, used, fp), where ``used`` marks the bits that a run agrees on:
    runs of over ``longest`` rows are split until they are shorter or ``FEW_BITS`` bits are left open. Every link
    inside a run is inside one of its parts."""
    done = []
    while True:
        runs = written(runs, "runs")
        open_bits = F.bit_count("used") < 64 - FEW_BITS
        long = runs.filter(open_bits).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > longest)
        long = written(long.select("part", "value"), "long-runs")
        if long.isEmpty():
            done.append(runs)
            break
        # a run has one ``used``, but for runs that a hash threw together
        split = runs.withColumn("open", open_bits).join(long.withColumn("open", F.lit(True)), ["part", "value", "open"], "left_semi")
        done.append(runs.withColumn("open", open_bits).join(long.withColumn("open", F.lit(True)), ["part", "value", "open"], "left_anti").drop("open"))
        runs = split.select("part", "value", "used", "fp").mapInArrow(finer_rows(radius), "part int, value long, used long, fp long")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("part", "value", "fp")


# ---------------------------------------------------------------- links inside a run


def short_links(key: np.ndarray, fps: np.ndarray, radius: int, longest: int) -> np.ndarray:
    """Links between rows of one key, which stand together in at most ``longest`` rows."""
    found = []
    for step in range(1, longest):
        near = (key[step:] == key[:-step]) & (np.bitwise_count(fps[step:] ^ fps[:-step]) <= radius)
        at = np.flatnonzero(near)
        found.append(np.stack([fps[at], fps[at + step]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.uint64)


def forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """Edges of a spanning forest of the links within ``fps`` (distinct values), at most len(fps) - 1.

    Pivots: everything within the radius of a pivot hangs on it. Two pivots' groups can only touch
    when the pivots are within 3 radii; those pairs of groups not yet joined are compared until one
    link between them is found."""
    left, pivots, groups, edges = fps, [], [], []
    while len(left):
        near = np.bitwise_count(left ^ left[0]) <= radius
        group = left[near]
        pivots.append(left[0])
        groups.append(group)
        edges.append(np.stack([np.full(len(group) - 1, left[0]), group[1:]], axis=1))
        left = left[~near]
    root = list(range(len(pivots)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    centres = np.array(pivots, dtype=np.uint64)
    for a in range(len(pivots)):
        for b in a + 1 + np.flatnonzero(np.bitwise_count(centres[a + 1 :] ^ centres[a]) <= 3 * radius):
            if top(a) == top(b):
                continue
            small, large = sorted((groups[a], groups[b]), key=len)
            for x in small:
                hit = np.flatnonzero(np.bitwise_count(large ^ x) <= radius)
                if len(hit):
                    edges.append(np.array([[x, large[hit[0]]]], dtype=np.uint64))
                    root[top(a)] = top(b)
                    break
    return np.concatenate(edges) if edges else np.zeros((0, 2), dtype=np.uint64)


def run_links(radius: int):
    """mapInArrow over rows sorted by (part, value): the links found in each run, as a forest."""

    def links(key: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(starts, len(key)))
        short = sizes <= SHORT_RUN
        at = np.repeat(short, sizes)
        number = np.repeat(np.arange(len(sizes)), sizes)
        found = [short_links(number[at], fps[at], radius, int(sizes[short].max(initial=1)))]
        for s, n in zip(starts[~short], sizes[~short]):
            found.append(forest(np.unique(fps[s : s + n]), radius))
        both = np.concatenate(found)
        both = np.unique(np.sort(both, axis=1), axis=0)
        both = both[both[:, 0] != both[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(both[:, k].astype(np.uint64).view(np.int64)) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column("part").to_numpy().astype(np.int64), batch.column("value").to_numpy()], axis=1)
            fp = batch.column("fp").to_numpy().view(np.uint64)
            # the run that the batch ends with may go on
            last = np.flatnonzero((key != key[-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from links(np.concatenate([*keys, key[:cut]]), np.concatenate([*fps, fp[:cut]]))
                keys, fps = [], []
            keys.append(key[cut:])
            fps.append(fp[cut:])
        if keys:
            yield from links(np.concatenate(keys), np.concatenate(fps))

    return run


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (a, b): the smallest vertex reachable.

    Each round hooks every vertex to its smallest neighbour, follows the hooks to their roots and
    contracts the graph to these. Two rounds at least halve the vertices that have a link left, and
    pointer jumping halves the way to a root, so a long chain takes rounds by its logarithm. Tables are
    written between rounds, so a lost executor costs one round."""
    links, labels = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"), None
    while labels is None or links.limit(1).count():
        both = links.union(links.select("b", "a"))
        roots = to_roots(written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("root")), "hooks"))
        if labels is None:
            labels = roots.withColumnRenamed("root", "label")
        else:
            higher = labels.join(roots, labels.label == roots.v, "left")
            labels = written(higher.select(labels.v, F.coalesce("root", "label").alias("label")), "labels")
        for end in ("a", "b"):
            links = links.join(roots.withColumnRenamed("v", end), end).drop(end).withColumnRenamed("root", end)
        links = links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = written(links.distinct(), "edges")
    return labels


def to_roots(hooks: DataFrame) -> DataFrame:
    """``hooks`` (v, root) followed until every root is its own."""
    while True:
        above = hooks.select(F.col("v").alias("root"), F.col("root").alias("higher"))
        step = hooks.join(above, "root").select("v", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved"))
        step = written(step, "hooks")
        if not step.filter("moved").limit(1).count():
            return hooks
        hooks = step.drop("moved")


# ---------------------------------------------------------------- operator


def shingle_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``carry`` and fp (long) of each row: A-Z lower-cased, words between ASCII blanks, shingles of
    ``length`` words with repeats; no word: 0."""
    rows = docs.select(
        F.col(id_col).alias(id_col),
        *carry,
        F.monotonically_increasing_id().alias("__row"),
        words(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, UPPER.lower()), WORD_BREAKS).alias("__words"),
    )
    return fingerprints(rows, [id_col, *carry, "__row"], F.col("__words"), length, "fp").drop("__row")


def linked(fps: DataFrame, radius: int = 3, sample_rows: int = 20_000, longest: int = LONG_RUN) -> DataFrame:
    """Forest edges (a, b) of the links between the distinct fingerprints ``fps.fp``: two fingerprints are
    joined by edges exactly when a chain of links at most ``radius`` bits long each joins them.

    The plan is made from about ``sample_rows`` fingerprints, at most a quarter of them and never more
    than twice ``sample_rows``."""
    total = fps.count()
    share = min(0.25, sample_rows / max(total, 1))
    drawn = fps.filter(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000))
    seen = drawn.limit(2 * sample_rows).collect()
    parts = plan(np.array([r.fp for r in seen], dtype=np.int64).view(np.uint64), total, radius)
    probes = fps.mapInArrow(probe_rows(parts), "part int, value long, fp long, probe boolean")
    masks = [sum(1 << b for b in bits) for bits, _ in parts]
    used = F.element_at(F.array(*[F.lit(m - ((m >> 63) << 64)).cast("long") for m in masks]), F.col("part") + 1)
    runs = bounded_runs(probes.select("part", "value", used.alias("used"), "fp"), radius, longest)
    runs = runs.repartition("part", "value").sortWithinPartitions("part", "value")
    return runs.mapInArrow(run_links(radius), "a long, b long")


def labelled(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, label) for each of the distinct ``fps.fp``: the smallest fingerprint reachable."""
    labels = components(linked(fps, radius)).withColumnRenamed("v", "fp")
    return fps.select("fp").join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 3, radius: int = 3) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hex digits), component_id (the smallest id
    reachable over links of at most ``radius`` bits, its own included).

    Defined results: null, empty and blank texts have fingerprint 0 and are linked like any other; a
    null id gets its component's smallest id, or null if there is none; repeated rows each keep their
    row; an empty table gives an empty result; other columns are ignored, whatever their names."""
    rows = written(shingle_fingerprints(docs, id_col, text_col, length), "shingle-fps")
    classes = written(rows.groupBy("fp").agg(F.min(id_col).alias("first")), "fp-classes")
    found = classes.join(labelled(classes, radius), "fp")
    # only vertices with a link can belong together; the others are their own component
    least = found.groupBy("label").agg(F.min("first").alias("component_id"))
    named = written(found.join(least, "label").select("fp", "component_id"), "fp-components")
    return rows.join(named, "fp").select(id_col, as_hex("fp").alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 3, radius: int = 3) -> DataFrame:
    """One row of ``docs`` for each component of links: the one with the smallest id.

    Defined results: a null id comes after every other; of equal ids the text with the smaller hash stays, of
    rows alike in id and text any one; null, empty and blank texts are one component (fingerprint 0); an
    empty table gives an empty result; other columns are passed on, whatever their names."""
    text = F.col(f"`{text_col}`")
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), text.alias("text"),
        F.xxhash64(F.lit(0), text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"),
    )
    rows = written(shingle_fingerprints(named, "id", "text", length, ("a", "b")), "shingle-fps")
    labels = labelled(written(rows.select("fp").distinct(), "fp-classes"), radius)
    alike = rows.groupBy("fp", "id", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "a", "b", "n"))
    kept = written(alike.join(labels, "fp").groupBy("label").agg(first.alias("k")).select("k.id", "k.a", "k.b", "k.n"), "kept-rows")

    def same(key: DataFrame):
        return named["id"].eqNullSafe(key["id"]) & (named["a"] == key["a"]) & (named["b"] == key["b"])

    once, often = kept.filter("n = 1"), kept.filter("n > 1")
    out = named.join(once, same(once), "left_semi").select("row")
    if not often.isEmpty():
        again = named.join(often, same(often), "left_semi").groupBy("id", "a", "b").agg(F.first("row").alias("row"))
        out = out.unionByName(again.select("row"))
    return out.select("row.*")
