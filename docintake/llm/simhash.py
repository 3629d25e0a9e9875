"""SimHash near-duplicates found with the generalised pigeonhole principle.

Fingerprint: 64 bits over word shingles, a bit set if it is set in over half of the shingle hashes (XXH64, seed 42).
Search: correlated bits are grouped into m parts; part i gets a threshold t_i (-1: not probed) with
sum(t_i + 1) = radius + 1, so that two fingerprints within the radius agree on some part within its threshold. Dynamic
programming picks the thresholds that make probes and estimated candidates cheapest for a stated design size, so the
rows per fingerprint (66 to probe and 34 to find, for 64 bits and radius 4) are the same for any table. The flips of a
part are shared between both sides: the index holds all values within t_i / 2 of a fingerprint's own, probes go to all within the rest of t_i;
what meets is verified by the whole distance.

Equal fingerprints are one node, so thousands of copies cost one. A part value that over `hot` fingerprints share is
not joined with itself: its members, and all that probe it, meet at midpoints (two fingerprints within a radius r share
a value within r / 2 of both, rounded up for one of them), which is linear in the number of members and loses no link
of a component.

Edge cases: null and empty texts and texts without a word have fingerprint zero and link like any other; texts with
fewer words than a shingle are one shingle; repeated rows stay, each with its component; a null doc_id never becomes
a component's id unless all its members have none; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb, inf

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, join_hot, map_batches, stored, text_key
from .components import connected
from .sieve import without

BITS = 64
SEED = 42

#: Fingerprints that the estimates of correlations and candidates are made from; all fingerprints are searched.
SAMPLED = 4_000

#: Distinct fingerprints that the plan is made for; with more of them there are more candidates for each, not more rows.
DESIGN = 10**9

#: Fingerprints that one task takes when it makes keys of them.
ROWS_EACH = 1_000_000

#: Fingerprints with one part value beyond which they meet at midpoints.
HOT = 2_000

#: Keys around crowded values that may be broadcast; more of them meet by a shuffle.
MOST_SPOTS = 100_000


def fingerprint(text: str | None, shingle: int = 4) -> int:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: -shingle].tolist()]
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    set_bits = np.zeros(BITS, dtype=np.int64)
    packed = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(packed), 1 << 16):
        set_bits += np.unpackbits(packed[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, text_key, fp: the fingerprint as a signed long."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        return {"doc_id": rows["doc_id"], "text_key": rows["text_key"], "fp": [signed(fingerprint(t, shingle)) for t in rows["text"]]}

    return map_batches(docs.select("doc_id", "text", text_key().alias("text_key")), run, "doc_id long, text_key long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits 0..63 in `parts` groups of nearly equal size; each takes the bits most correlated with those it has."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    centred = bits - bits.mean(axis=0) if len(bits) else np.zeros((1, BITS))
    norm = np.sqrt((centred**2).sum(axis=0))
    tied = np.abs(centred.T @ centred) / np.maximum(np.outer(norm, norm), 1e-9)
    free, groups = set(range(BITS)), []
    for i in range(parts):
        width = (BITS - sum(map(len, groups))) // (parts - i)
        group = [min(free)]
        free -= {group[0]}
        while len(group) < width:
            best = max(sorted(free), key=lambda b: tied[b, group].sum())
            group.append(best)
            free -= {best}
        groups.append(sorted(group))
    return groups


def ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Least sum of costs[i][u_i] with sum(u_i) = units; u_i = t_i + 1, so 0 units means that part i is not probed."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for u, c in enumerate(row[: units - used + 1]):
                if used + u not in new or cost + c < new[used + u][0]:
                    new[used + u] = (cost + c, [*chosen, u])
        best = new
    return best[units]


@dataclass(frozen=True)
class Part:
    """A probed part: its bits and threshold; index and probe side share the flips, near + far = threshold."""

    mask: int
    threshold: int

    @property
    def near(self) -> int:
        return self.threshold // 2

    @property
    def far(self) -> int:
        return self.threshold - self.near

    def flips(self, radius: int) -> list[int]:
        bits = [1 << b for b in range(BITS) if self.mask >> b & 1]
        return [sum(f) for r in range(radius + 1) for f in combinations(bits, r)]

    def value(self, fp: Column) -> Column:
        return fp.bitwiseAND(F.lit(signed(self.mask)))


def _rows(width: int, threshold: int) -> int:
    """Rows of both sides that a part makes for each fingerprint."""
    return ball(width, threshold // 2) + ball(width, threshold - threshold // 2)


def _price(width: int, threshold: int, share: float, design: int) -> float:
    """Rows plus estimated candidates for `design` fingerprints, `share` of whose pairs agree on the part.

    No value keeps more than HOT fingerprints, which bounds the candidates of each.
    """
    return design * (_rows(width, threshold) + min(share * design, float(HOT * ball(width, threshold))) / 2)


def shape(radius: int, design: int = DESIGN) -> tuple[int, int]:
    """(parts, rows for each fingerprint) of the cheapest plan for `design` fingerprints of evenly spread bits."""
    found = []
    for parts in range(2, radius + 2):
        widths = [(BITS + i) // parts for i in range(parts)]
        costs = [[0.0, *(_price(w, t, ball(w, t) / 2.0**w, design) for t in range(radius + 1))] for w in widths]
        cost, units = allocate(costs, radius + 1)
        found.append((cost, parts, sum(_rows(w, u - 1) for w, u in zip(widths, units, strict=True) if u)))
    return min(found)[1:]


def plan(sample: np.ndarray, radius: int, design: int = DESIGN) -> list[Part]:
    """The probed parts for `design` fingerprints like those of the sample; how many rows there are plays no part.

    No part may make more rows than the whole plan for evenly spread bits, however uneven the sample is. Pairs within the radius are links, which every plan has to meet; candidates are what else agrees on a part.
    """
    differ = sample[:2000, None] ^ sample[None, :2000]
    false, costs = differ[np.bitwise_count(differ) > radius], []
    parts, rows = shape(radius, design)
    groups = group_bits(sample, parts)
    masks = [sum(1 << b for b in group) for group in groups]
    for mask, group in zip(masks, groups, strict=True):
        near = np.bincount(np.bitwise_count(false & np.uint64(mask)), minlength=BITS + 1).cumsum()
        shares = [max(near[t] / max(1, differ.size), ball(len(group), t) / 2.0 ** len(group)) for t in range(radius + 1)]
        prices = [_price(len(group), t, share, design) if _rows(len(group), t) <= rows else inf for t, share in enumerate(shares)]
        costs.append([0.0, *prices])
    _, units = allocate(costs, radius + 1)
    return [Part(mask, u - 1) for mask, u in zip(masks, units, strict=True) if u]


def _sample(nodes: DataFrame) -> np.ndarray:
    rows = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLED).collect()
    return np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)


def _keys(fps: DataFrame, part: Part, radius: int) -> DataFrame:
    """(fp, key) for all values of the part within `radius` of the fingerprint's own."""
    flips = F.array(*[F.lit(signed(f)) for f in part.flips(radius)])
    return fps.select("fp", F.explode(F.transform(flips, lambda f: part.value(F.col("fp")).bitwiseXOR(f))).alias("key"))


def links(nodes: DataFrame, radius: int = 4, hot: int = HOT, design: int = DESIGN) -> DataFrame:
    """nodes(fp, distinct) -> edges (a, b) between fingerprints, whose components are those of "at most `radius` bits apart".

    Outside of crowded values there is one edge or more for every pair within the radius. Spark takes the keys of all
    fingerprints for no more rows than the fingerprints are, so their joins are told to sort instead of broadcasting.
    """
    nodes = nodes.select("fp")
    parts = plan(_sample(nodes), radius, design)
    own = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), p.value(F.col("fp")).alias("value")) for i, p in enumerate(parts)])).alias("at"))
    crowded = stored(own.groupBy("at.part", "at.value").count().where(F.col("count") > hot).select("part", "value"))
    some = crowded.count()
    found, members = [], []
    for i, part in enumerate(parts):
        calm = nodes
        if some:
            here = crowded.where(F.col("part") == i).select(F.col("value").alias("fp"))
            spots = _keys(here, part, part.near).select("key").distinct()
            if some * len(part.flips(part.near)) > MOST_SPOTS:
                spots = spots.hint("merge")
            members.append(_keys(nodes, part, part.far).join(spots, "key", "left_semi").select("fp"))
            calm = nodes.join(here.select(F.col("fp").alias("value")), part.value(F.col("fp")) == F.col("value"), "left_anti")
        probe, index = _keys(calm, part, part.far), _keys(calm, part, part.near).withColumnRenamed("fp", "other")
        apart = F.col("fp").bitwiseXOR(F.col("other"))
        differ = F.bit_count(part.value(apart))
        # a pair that the probe side alone can bring together meets at the other one's own value only
        once = (F.col("key") == part.value(F.col("other"))) | (differ > part.far)
        found.append(probe.join(index.hint("merge"), "key").where((F.col("fp") < F.col("other")) & (F.bit_count(apart) <= radius) & once).select(F.col("fp").alias("a"), F.col("other").alias("b")))
    if some:
        found.append(_midpoints(reduce(DataFrame.union, members).distinct(), radius))
    return reduce(DataFrame.union, found)


def _midpoints(members: DataFrame, radius: int) -> DataFrame:
    """Edges from each member to the least one that shares a value within radius / 2 of both.

    As many fingerprints as such a value can have neighbours meet there at most, whatever the number of members. For an
    odd radius one of the two may be a bit further away: the least member is sought among the nearer ones, so that no
    edge is longer than the radius.
    """
    whole = Part((1 << BITS) - 1, radius)
    keys, least = _keys(members, whole, (radius + 1) // 2), F.col("fp")
    if radius % 2:
        least = F.when(F.bit_count(F.col("fp").bitwiseXOR(F.col("key"))) <= radius // 2, F.col("fp"))
    around = keys.withColumn("a", F.min(least).over(Window.partitionBy("key")))
    return around.where("a != fp").select("a", F.col("fp").alias("b")).distinct()


def _node(least: Column) -> Column:
    """What components are ordered by: the least row of a fingerprint (rows without an id last), then the fingerprint."""
    return F.struct(least["none"].alias("none"), least["id"].alias("id"), least["key"].alias("key"), F.col("fp").alias("fp"))


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, hot: int = HOT) -> DataFrame:
    """doc_id, text_key, fp (signed long), component_id, first_key.

    component_id is the smallest doc_id reachable over links of at most `radius` bits; (component_id, first_key) names
    the first row of the component: the smallest id, then the smallest text_key.
    """
    marked = stored(fingerprints(docs, shingle))
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    least = marked.groupBy("fp").agg(F.min(row).alias("least"), F.count("*").alias("n"))
    total = marked.count()
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, total // ROWS_EACH + 1)
    nodes = stored(least.select("fp", "n", _node(F.col("least")).alias("node")).repartition(tasks, "fp"))
    ends = {side: nodes.select(F.col("fp").alias(side), F.col("node").alias(f"node_{side}")) for side in ("a", "b")}
    # the least row of a component names it, so components need no further grouping by their members
    edges = links(nodes, radius, hot).join(ends["a"], "a").join(ends["b"], "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    labels = connected(edges).select(F.col("node.fp").alias("fp"), "label")
    named = nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "node"))
    facts = stored(named.select("fp", "n", F.col("label.id").alias("component_id"), F.col("label.key").alias("first_key")))
    return join_hot(marked, facts, "fp", total, "n").select("doc_id", "text_key", "fp", "component_id", "first_key")


def representatives(docs: DataFrame, radius: int = 4, shingle: int = 4, hot: int = HOT) -> DataFrame:
    """One row of docs for each group of near-duplicates, with its columns: the smallest id, then the smallest text_key."""
    found = near_duplicates(docs, radius, shingle, hot)
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key"))
    keys = stored(found.select("doc_id", "text_key", first.alias("stays")))
    return without(docs, keys)
