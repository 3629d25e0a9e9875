"""Quality rules with an isolation forest on rule statistics.

Statistics of a text (words, characters, symbols, repeated lines and word windows) feed two verdicts: fixed base rules,
and isolation forests whose short mean path over random splits marks anomalous documents. There is one forest for each
family of statistics (shape of words and symbols, repetition), so that a rare but harmless value of one family does not
hide an anomaly of another. A tree is grown on PER_TREE rows, as isolation forests are, drawn from all labelled documents
that pass the base rules; the score from which a forest rejects is calibrated on every one of them.

Edge cases: null and empty texts have zero statistics and fail the base rules; repeated rows give repeated results;
without labelled rows no document is an anomaly; labels repeated for an id count once; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, labelled, map_batches, removed, stored, text_key

TREES = 200
PER_TREE = 128
#: Hashes of ids are put into so many places to draw the rows that trees are grown on.
PLACES = 1 << 40
#: Share of good labelled documents that the threshold may reject.
GOOD_LOST = 0.001

SYMBOLS = "#*$%&|<>"
#: Columns of features() that a forest looks at.
FAMILIES = {"shape": (0, 1), "repetition": (2, 3, 4)}

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")
_SPACES = " \t\n\x0b\x0c\r"


def statistics(text: str | None) -> tuple[int, ...]:
    """STATS of a text; words are runs of anything but space and \\x09-\\x0D, lines are split at \\n."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(grams)) < len(grams):
        counts, reach = Counter(grams), 0
        for i, g in enumerate(grams):
            if counts[g] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(set(words)),
    )


def base_failed(stats: tuple[int, ...]) -> bool:
    return stats[0] < 50 or 100 * stats[4] > 50 * stats[0]


def features(stats: np.ndarray) -> np.ndarray:
    """Scale-free rates: mean word length, symbols per character, repeated lines, repeated words, distinct words."""
    n, chars, symbols, dup, repeat, lines, distinct = stats.astype(np.float64).reshape(-1, len(STATS)).T
    words = np.maximum(n, 1)
    # a text of n words from one source has about n^0.9 distinct ones here; short and long texts become comparable
    return np.column_stack([chars / words, symbols / np.maximum(chars, 1), dup / np.maximum(lines, 1), repeat / words, np.log1p(distinct) - 0.9 * np.log1p(n)])


def usual_path(n: np.ndarray | float) -> np.ndarray | float:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays [tree, node]; feature -1 marks a leaf, whose `depth` holds the path length."""

    feature: np.ndarray
    limit: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    height: int
    norm: float
    threshold: float = 2.0

    @staticmethod
    def grow(rows: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        per_tree = min(per_tree, len(rows))
        height = max(1, int(np.ceil(np.log2(max(per_tree, 2)))))
        nodes = 2 ** (height + 1)
        feature = np.full((trees, nodes), -1, dtype=np.int64)
        limit, depth = np.zeros((trees, nodes)), np.zeros((trees, nodes))
        child = np.zeros((trees, nodes), dtype=np.int64)
        for t in range(trees):
            todo, free = [(0, rows[rng.choice(len(rows), per_tree, replace=False)], 0)], 1
            while todo:
                at, part, level = todo.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                varied = np.flatnonzero(high > low)
                if level >= height or len(part) <= 1 or not len(varied):
                    depth[t, at] = level + usual_path(len(part))
                    continue
                f = int(rng.choice(varied))
                cut = rng.uniform(low[f], high[f])
                feature[t, at], limit[t, at], child[t, at] = f, cut, free
                side = part[:, f] <= cut
                todo += [(free, part[side], level + 1), (free + 1, part[~side], level + 1)]
                free += 2
        return Forest(feature, limit, child, depth, height, float(usual_path(per_tree)) or 1.0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2^(-mean path / usual path): towards 1 for anomalies."""
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(rows), len(self.feature)), dtype=np.int64)
        for _ in range(self.height):
            f = self.feature[trees, at]
            right = np.take_along_axis(rows, np.maximum(f, 0), axis=1) > self.limit[trees, at]
            at = np.where(f >= 0, self.child[trees, at] + right, at)
        return 2.0 ** (-self.depth[trees, at].mean(axis=1) / self.norm)


def _kept_rank(good: int, good_lost: float = GOOD_LOST) -> int:
    """The place, from 1 in ascending order, of the last of so many good scores that must not be rejected."""
    return min(good, int(np.ceil(good * (1 - good_lost))))


def _threshold(floor: float, most: float, bad: float | None) -> float:
    """Half-way into the gap between what is kept and the least bad score above it; without one, above all good scores."""
    return float(np.nextafter(most, 2)) if bad is None else float((floor + bad) / 2)


def calibrated(scores: np.ndarray, good: np.ndarray, good_lost: float = GOOD_LOST) -> float:
    """The score from which on documents are rejected: most bad rows above it, at most `good_lost` of the good ones.

    Without good rows nothing is rejected; without bad rows the threshold lies above all good scores.
    """
    if not good.any():
        return 2.0
    ordered = np.sort(scores[good])
    floor = ordered[_kept_rank(len(ordered), good_lost) - 1]
    bad = scores[~good]
    bad = bad[bad > floor]
    return _threshold(floor, ordered[-1], bad.min() if len(bad) else None)


def calibrated_on(scored: DataFrame, score: str, good_lost: float = GOOD_LOST) -> float:
    """calibrated() of a table of scores with y: one task holds the `good_lost` of the good scores that may be rejected."""
    good = scored.where("y = 1").select(score)
    n, most = good.agg(F.count("*"), F.max(score)).first()
    if not n:
        return 2.0
    above = n - _kept_rank(n, good_lost) + 1
    floor = good.orderBy(F.desc(score)).limit(above).agg(F.min(score)).first()[0]
    return _threshold(floor, most, scored.where((F.col("y") != 1) & (F.col(score) > floor)).agg(F.min(score)).first()[0])


SCHEMA = "doc_id long, text_key long, " + ", ".join(f"{s} long" for s in STATS)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_key() and STATS of each row."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        found = [statistics(t) for t in rows["text"]]
        return {n: rows[n] for n in ("doc_id", "text_key")} | {s: [x[i] for x in found] for i, s in enumerate(STATS)}

    return map_batches(docs.select("doc_id", "text", text_key().alias("text_key")), run, SCHEMA)


def _scores(forests: dict[str, Forest]):
    def run(rows: dict[str, list]) -> dict[str, list]:
        seen = features(np.array([rows[s] for s in STATS], dtype=np.int64).T)
        return {"y": rows["y"]} | {name: forest.score(seen[:, FAMILIES[name]]) for name, forest in forests.items()}

    return run


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, Forest]:
    """Forests with their thresholds from all labelled documents that pass the base rules; none without such rows.

    No text is moved: rows of numbers meet the labels. Only the rows that trees are grown on, TREES times PER_TREE at
    most, come to the driver: those with the least hash of their id.
    """
    one = with_statistics(docs).join(labelled(labels, "quality", None), "doc_id").groupBy("doc_id", "y")
    each = one.agg(F.min_by(F.struct(*STATS), "text_key").alias("s")).select("doc_id", "y", "s.*")
    judged = stored(each.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words"))
    most, place = TREES * PER_TREE, F.pmod(F.xxhash64("doc_id"), F.lit(PLACES))
    # half as many again as are asked for are let through, lest every task send as many to the driver
    near = place < int(min(1.0, 1.5 * most / max(judged.count(), 1)) * PLACES)
    drawn = judged.where(near).orderBy(place, "doc_id").limit(most).collect()
    forests = {}
    if drawn:
        rows = features(np.array([[r[s] for s in STATS] for r in sorted(drawn, key=lambda r: r["doc_id"])], dtype=np.int64))
        forests = {name: Forest.grow(rows[:, columns]) for name, columns in FAMILIES.items()}
        scored = stored(map_batches(judged.select("y", *STATS), _scores(forests), "y int, " + ", ".join(f"{n} double" for n in forests)))
        for name, forest in forests.items():
            forest.threshold = calibrated_on(scored, name)
        removed(scored)
    removed(judged)
    return forests


def judge(stats: np.ndarray, forests: dict[str, Forest]) -> tuple[np.ndarray, np.ndarray]:
    """(largest anomaly score over the forests, whether any forest rejects) of each row of statistics."""
    worst, rejected = np.zeros(len(stats)), np.zeros(len(stats), dtype=bool)
    rows = features(stats)
    for name, forest in forests.items():
        score = forest.score(rows[:, FAMILIES[name]])
        worst, rejected = np.maximum(worst, score), rejected | (score >= forest.threshold)
    return worst, rejected


def _judged(forests):
    def run(rows: dict[str, list]) -> dict[str, list]:
        found = [statistics(t) for t in rows["text"]]
        failed = [base_failed(s) for s in found]
        worst, rejected = judge(np.array(found, dtype=np.int64).reshape(-1, len(STATS)), forests.value)
        out = {s: [x[i] for x in found] for i, s in enumerate(STATS)}
        return out | {"base_failed": failed, "anomaly": worst, "kept": [not (b or r) for b, r in zip(failed, rejected.tolist(), strict=True)]}

    return run


VERDICT = ", ".join(f"{s} long" for s in STATS) + ", base_failed boolean, anomaly double, kept boolean"


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, STATS, base_failed, anomaly (0 to 1), kept; kept is false for base failures and anomalies."""
    forests = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return add_columns(docs.select("doc_id", "text"), _judged(forests), ["text"], VERDICT).drop("text")


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with their columns."""
    forests = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    run = _judged(forests)
    return add_columns(docs, lambda rows: {"__kept": run(rows)["kept"]}, ["text"], "__kept boolean").where("__kept").drop("__kept")
