"""Tweedie gradient boosting with a log link, over binned columns, for many models at once.

Every input becomes a small bin number once: numbers by quantile edges, categories by level, bin 0 for what is missing or
unknown. Rows lie in blocks in the shared folder. A pass reads each block, walks the rows down the trees grown so far and
adds up gradient, curvature and rows per (model, node, input, bin); the sums of all tasks meet per node, where the best split is
chosen, and only splits reach the driver. All models of a fit (folds, targets) share the passes, so their number depends on
the depth of a round's trees, not on the number of models. The first pass of a round also moves the scores.

Gradients are added as whole numbers of a fixed unit: sums, and so trees, are the same however rows are partitioned. A split sends missing
rows to the side that gains more. Categories are split into two sets: levels in order of gradient over curvature, cut once. Trees grow best first
up to ``leaves``: each pass opens all nodes that could be next, and the driver keeps those that a one-by-one growth would have
opened. A row's or input's place in a round's sample is a hash of its key and the round.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.blocks import load_block, save_block
from shelfcast.session import cut_lineage, shared_folder

FOLDS = 5
MODEL = "model__"
BLOCK_ROWS = 1 << 17
BIN_ROWS = 50_000
LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class BoosterParams:
    """``leaves``: best-first growth ends there (None: all nodes down to ``max_depth``). ``subsample`` and ``colsample``: shares of rows and inputs per round.

    Quantile edges come from about BIN_ROWS rows a model, chosen by a hash; everything else sees all rows.
    """

    variance_power: float = 1.2
    rounds: int = 30
    learning_rate: float = 0.2
    max_depth: int = 5
    leaves: int | None = None
    max_bins: int = 64
    min_rows: int = 20
    subsample: float = 0.8
    colsample: float = 0.8
    smoothing: float = 20.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes as parallel lists; node 0 is the root, feature -1 a leaf. ``goes_left[i][bin]`` says where rows of a bin go."""

    feature: list[int] = field(default_factory=lambda: [-1])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    goes_left: list[np.ndarray | None] = field(default_factory=lambda: [None])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each column of ``bins`` (inputs x rows)."""
        node = np.zeros(bins.shape[1], np.int32)
        todo = [(0, np.arange(bins.shape[1]))] if self.feature[0] >= 0 else []
        while todo:
            i, rows = todo.pop()
            side = self.goes_left[i][bins[self.feature[i], rows]]
            for child, part in ((self.left[i], rows[side]), (self.right[i], rows[~side])):
                node[part] = child
                if self.feature[child] >= 0 and len(part):
                    todo.append((child, part))
        return node


@dataclass
class Split:
    """A node's best split and the sums (gradient, curvature, rows) on both sides."""

    gain: float
    feature: int
    goes_left: np.ndarray
    left: tuple[float, float, int]
    right: tuple[float, float, int]


class Growing:
    """A tree under growth. Nodes are known by their path, so the order in which they were opened decides nothing."""

    def __init__(self, p: BoosterParams) -> None:
        self.p, self.tree = p, Tree()
        self.path, self.best = [""], [None]
        self.leaves = p.leaves or 1 << p.max_depth

    def replay(self) -> tuple[list[int], list[int]]:
        """The nodes that a one-by-one growth splits as far as is known, and those among them without children yet."""
        t, chosen, waiting = self.tree, [], []
        heap = [(-self.best[0].gain, "", 0)] if self.best[0] else []
        while heap and len(chosen) < self.leaves - 1:
            _, _, i = heapq.heappop(heap)
            chosen.append(i)
            if t.left[i] < 0:
                waiting.append(i)
                continue
            for child in (t.left[i], t.right[i]):
                if self.best[child]:
                    heapq.heappush(heap, (-self.best[child].gain, self.path[child], child))
        return chosen, waiting

    def opened(self) -> list[int]:
        """Open what waits; the new nodes whose histograms are wanted. Empty: the tree is done."""
        while True:
            _, waiting = self.replay()
            wanted = []
            for i in waiting:
                s, t = self.best[i], self.tree
                t.feature[i], t.goes_left[i], t.gain[i] = s.feature, s.goes_left, s.gain
                for side, sums, to in (("L", s.left, t.left), ("R", s.right, t.right)):
                    to[i] = len(t.feature)
                    for column, x in ((t.feature, -1), (t.left, -1), (t.right, -1), (t.goes_left, None), (t.value, -sums[0] / sums[1]), (t.gain, 0.0)):
                        column.append(x)
                    self.path.append(self.path[i] + side)
                    self.best.append(None)
                    if len(self.path[-1]) < self.p.max_depth and sums[2] >= 2 * self.p.min_rows:
                        wanted.append(to[i])
            if wanted or not waiting:
                return wanted

    def done(self) -> Tree:
        """The tree of the chosen splits alone."""
        chosen, t, out = set(self.replay()[0]), self.tree, Tree()
        out.value[0] = t.value[0]
        todo = [(0, 0)]
        while todo:
            i, to = todo.pop()
            if i not in chosen:
                continue
            out.feature[to], out.goes_left[to], out.gain[to] = t.feature[i], t.goes_left[i], t.gain[i]
            for child, column in ((t.left[i], out.left), (t.right[i], out.right)):
                column[to] = len(out.feature)
                for c, x in ((out.feature, -1), (out.left, -1), (out.right, -1), (out.goes_left, None), (out.value, t.value[child]), (out.gain, 0.0)):
                    c.append(x)
                todo.append((child, column[to]))
        return out


@dataclass
class Forest:
    """What a fitted model needs to score: edges of numbers, levels of categories, trees."""

    features: list[str]
    edges: dict[str, np.ndarray]
    levels: dict[str, list[str]]
    start: float
    learning_rate: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, columns: list) -> np.ndarray:
        return np.stack([bins_of(x, self.edges.get(f), self.levels.get(f)) for f, x in zip(self.features, columns)])

    def predict(self, columns: list) -> np.ndarray:
        bins = self.binned(columns)
        total = np.zeros(bins.shape[1])
        for t in self.trees:
            total += np.array(t.value)[t.walk(bins)]
        return np.exp(self.start + self.learning_rate * total)

    def as_json(self) -> str:
        trees = [asdict(t) | {"goes_left": [None if g is None else "".join("01"[int(x)] for x in g) for g in t.goes_left]} for t in self.trees]
        return json.dumps({"features": self.features, "edges": {k: v.tolist() for k, v in self.edges.items()}, "levels": self.levels,
                           "start": self.start, "learning_rate": self.learning_rate, "trees": trees})

    @staticmethod
    def from_json(text: str) -> Forest:
        d = json.loads(text)
        trees = [Tree(**{**t, "goes_left": [None if g is None else np.array([c == "1" for c in g]) for g in t["goes_left"]]}) for t in d["trees"]]
        return Forest(d["features"], {k: np.array(v) for k, v in d["edges"].items()}, d["levels"], d["start"], d["learning_rate"], trees)


def bins_of(values, edges: np.ndarray | None, levels: list[str] | None) -> np.ndarray:
    """Bin numbers from 1; 0 for missing numbers and unknown levels."""
    if levels is not None:
        found = pc.index_in(pa.array(values, pa.string()), value_set=pa.array(levels, pa.string()))
        return (found.fill_null(-1).to_numpy(zero_copy_only=False) + 1).astype(np.uint16)
    v = np.asarray(values, np.float64)
    return np.where(np.isnan(v), 0, np.searchsorted(edges, v, "left") + 1).astype(np.uint16)


@dataclass
class BoosterModel:
    forest: Forest
    encodings: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return self.forest.features

    @property
    def trees(self) -> list[Tree]:
        return self.forest.trees

    @property
    def indexed(self) -> list[str]:
        return list(self.forest.levels)

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """The input columns plus a prediction, which the log link keeps above 0."""
        return BoosterSet([self.forest], self.encodings).transform(df, None, prediction)

    def importance(self) -> DataFrame:
        """Share of the trees' gain per input, in percent; a tree counts by the gain of all its splits."""
        total = [0.0] * len(self.features)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    total[f] += g
        norm = sum(total) or 1.0
        rows = [(f, g / norm * 100.0) for f, g in zip(self.features, total)]
        return SparkSession.getActiveSession().createDataFrame(rows, "feature string, gain_pct double").orderBy(F.desc("gain_pct"), "feature")

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.forest.as_json(),)], "model string").write.mode("overwrite").parquet(f"{path}/model")
        for c, table in self.encodings.items():
            table.write.mode("overwrite").parquet(f"{path}/encodings/{c}")


def load_booster(spark: SparkSession, path: str, features: list[str], encoded: list[str] | None = None) -> BoosterModel:
    """A saved model, ready to score; ``encoded`` names the inputs that were target-encoded."""
    forest = Forest.from_json(spark.read.parquet(f"{path}/model").first()["model"])
    if forest.features != list(features):
        raise ValueError("the saved model has other inputs")
    return BoosterModel(forest, {c: spark.read.parquet(f"{path}/encodings/{c}") for c in encoded or []})


@dataclass
class BoosterSet:
    """Models of one fit. ``encodings`` have a row per (model, level) where there is more than one model."""

    forests: list[Forest]
    encodings: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, k: int) -> BoosterModel:
        own = {c: t.where(F.col(MODEL) == k).drop(MODEL) if MODEL in t.columns else t for c, t in self.encodings.items()}
        return BoosterModel(self.forests[k], own)

    def transform(self, df: DataFrame, by: str | None, prediction: str = "prediction") -> DataFrame:
        """Each row scored by the model whose number is in ``by`` (None: the only one), in one pass."""
        keep, forests = df.columns, self.forests
        which = F.lit(0) if by is None else F.col(by).cast("int")
        wide = df.select(F.struct(*[df[c] for c in keep]).alias("row__"), which.alias(MODEL), *[df[f] for f in forests[0].features])
        for c, table in self.encodings.items():
            wide = wide.join(table, [c, *([MODEL] if MODEL in table.columns else [])], "left")
        # names must not hide inputs: a struct of places, not of columns
        inputs = _inputs(wide, forests[0].features, list(forests[0].levels), list(self.encodings))
        places = F.struct(F.col(MODEL).alias("m"), *[c.alias(f"i{k}") for k, c in enumerate(inputs)])

        def score(x: pd.DataFrame) -> pd.Series:
            out, model = np.full(len(x), np.nan), x["m"].to_numpy()
            for k in np.unique(model):
                at = np.flatnonzero(model == k)
                out[at] = forests[k].predict([x[f"i{j}"].to_numpy()[at] for j in range(len(forests[k].features))])
            return pd.Series(out)

        udf = F.pandas_udf(score, "double")
        return wide.withColumn(prediction, udf(places)).select(*[F.col(f"row__.`{c}`").alias(c) for c in keep], prediction)


def tweedie_deviance(y: Column, mean: Column, power: float) -> Column:
    """Mean deviance up to a term in y alone."""
    return F.avg(-y * F.pow(mean, F.lit(1 - power)) / (1 - power) + F.pow(mean, F.lit(2 - power)) / (2 - power))


def tweedie_step(y: np.ndarray, score: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the Tweedie deviance by a log-scale score."""
    a, b = np.exp((1 - power) * score), np.exp((2 - power) * score)
    return b - y * a, (power - 1) * y * a + (2 - power) * b


def sampled(keys: np.ndarray, r: int, share: float) -> np.ndarray:
    """Whether rows with these keys are in round r."""
    z = keys ^ np.uint64((r + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z >> np.uint64(11)).astype(np.float64) < share * (1 << 53)


def inputs_of_round(n: int, r: int, p: BoosterParams) -> list[int]:
    """The inputs that round r may split on."""
    order = sorted(range(n), key=lambda i: hashlib.md5(f"{p.seed}:{r}:{i}".encode()).hexdigest())
    return sorted(order[:max(1, round(p.colsample * n))])


def edges_of(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Upper edges of all bins but the last: between neighbours if there are few different values, else at quantiles."""
    seen = np.unique(values[~np.isnan(values)])
    if len(seen) <= max_bins - 1:
        return (seen[1:] + seen[:-1]) / 2
    ordered = np.sort(values[~np.isnan(values)])
    return np.unique(ordered[np.arange(1, max_bins - 1) * len(ordered) // (max_bins - 1)])


def best_split(sums: np.ndarray, offsets: list[int], features: list[int], is_level: list[bool], min_rows: int) -> Split | None:
    """``sums``: bins x (gradient, curvature, rows) of the listed inputs one after another."""
    found: Split | None = None
    for k, f in enumerate(features):
        h = sums[offsets[k]:offsets[k + 1]].astype(np.float64)
        whole = h.sum(0)
        if is_level[f]:
            seen = np.flatnonzero(h[:, 2] > 0)
            order = seen[np.argsort(h[seen, 0] / np.maximum(h[seen, 1], 1e-300), kind="stable")]
            options = [(order, np.cumsum(h[order], 0)[:-1])]
        else:
            below = np.cumsum(h[1:], 0)[:-1]
            options = [(None, below)] if h[0, 2] == 0 else [(False, below), (True, np.concatenate([h[:1], h[:1] + below]))]
        for kind, left in options:
            right = whole - left
            ok = (left[:, 2] >= min_rows) & (right[:, 2] >= min_rows) & (left[:, 1] > 0) & (right[:, 1] > 0)
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, left[:, 0] ** 2 / left[:, 1] + right[:, 0] ** 2 / right[:, 1] - whole[0] ** 2 / whole[1], -np.inf)
            at = int(np.argmax(gain))
            if gain[at] <= (found.gain if found else 0.0):
                continue
            goes_left = np.zeros(len(h), bool)
            if is_level[f]:
                goes_left[kind[:at + 1]] = True
            elif kind:  # missing rows on the left; the first option leaves them there alone
                goes_left[:at + 1] = True
            else:
                goes_left[1:at + 2] = True
                # no missing row was seen: later ones go with the larger side
                goes_left[0] = kind is None and left[at, 2] >= right[at, 2]
            found = Split(float(gain[at]), f, goes_left, tuple(left[at]), tuple(right[at]))
    return found


def _inputs(df: DataFrame, features: list[str], indexed: list[str], encoded: list[str]) -> list[Column]:
    """Categories as text, all others as numbers; missing numbers are null."""
    def column(f: str) -> Column:
        if f in indexed:
            return F.coalesce(df[f].cast("string"), F.lit(""))
        return df[f"{f}__mean" if f in encoded else f].cast("double")
    return [column(f) for f in features]


def _encode_levels(df: DataFrame, column: str, means: dict[int, float], p: BoosterParams) -> tuple[DataFrame, DataFrame]:
    """Smoothed target means of a column's levels per model.

    Training rows see only the other hash folds' targets; scoring uses all of them.
    """
    per_fold = df.groupBy(MODEL, column, "fold__").agg(F.sum("y__").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    totals = per_fold.groupBy(MODEL, column).agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"))
    overall = F.create_map(*[F.lit(x) for kv in means.items() for x in kv])[F.col(MODEL)]

    def mean(s: Column, n: Column) -> Column:
        return (s + p.smoothing * overall) / (n + p.smoothing)

    outside = per_fold.join(totals, [MODEL, column]).select(
        MODEL, column, "fold__", mean(F.col("s_all") - F.col("s"), F.col("n_all") - F.col("n")).alias(f"{column}__mean"))
    return outside, totals.select(MODEL, column, mean(F.col("s_all"), F.col("n_all")).alias(f"{column}__mean"))


def fit_booster(train: DataFrame, features: list[str], label: str, row_key: list[str], categorical: list[str] | None = None,
                params: BoosterParams = BoosterParams(), encoded: list[str] | None = None) -> BoosterModel:
    """Fit one model on every row of ``train``, see ``fit_boosters``."""
    one = fit_boosters(train.withColumn(MODEL, F.lit(0)), MODEL, 1, features, label, row_key, categorical, params, encoded)
    return one[0]


def fit_boosters(train: DataFrame, by: str, n_models: int, features: list[str], label: str, row_key: list[str], categorical: list[str] | None = None,
                 params: BoosterParams = BoosterParams(), encoded: list[str] | None = None) -> BoosterSet:
    """Fit models 0 to n_models - 1 on the rows whose ``by`` names them. Each equals a fit on its rows alone.

    Listed and string columns are categories, the rest numbers. Categories named in ``encoded`` (identifiers, say) become
    smoothed target means; all others are split by their levels, however many there are. A model without rows predicts 1e-6.
    """
    p, spark = params, train.sparkSession
    types = dict(train.dtypes)
    categories = [f for f in features if f in (categorical or []) or types[f] == "string"]
    indexed = [c for c in categories if c not in (encoded or [])]
    folder = f"{shared_folder(spark)}/booster-{uuid.uuid4().hex}"
    own = [c for c in dict.fromkeys(features) if c in categories]
    rows = train.where(F.col(label).isNotNull()).select(
        F.col(by).cast("int").alias(MODEL), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in own],
        *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(features) if c not in categories],
        F.col(label).cast("double").alias("y__"), F.xxhash64(*row_key, F.lit(p.seed)).alias("key__"))
    rows.withColumn("fold__", F.pmod(F.col("key__"), F.lit(FOLDS)).cast("int")).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    facts = {r[MODEL]: r for r in rows.groupBy(MODEL).agg(F.avg("y__").alias("mean"), F.count(F.lit(1)).alias("n"), *[F.collect_set(c).alias(c) for c in indexed]).collect()}
    means = {k: facts[k]["mean"] if k in facts else 0.0 for k in range(n_models)}
    levels = {c: sorted({x for r in facts.values() for x in r[c]}) for c in indexed}
    encodings, joined = {}, rows
    for c in categories:
        if c not in indexed:
            outside, full = _encode_levels(rows, c, means, p)
            joined, encodings[c] = joined.join(outside, [MODEL, c, "fold__"], "left"), cut_lineage(full)
    prepared = joined.select(MODEL, "y__", "key__", *[x.alias(f"i{k}") for k, x in enumerate(_inputs(joined, features, indexed, list(encodings)))])
    numbers = [k for k, f in enumerate(features) if f not in indexed]
    edges = _edges(prepared, {k: r["n"] for k, r in facts.items()}, numbers, p)
    forests = [Forest(features, {features[j]: edges[k, j] if (k, j) in edges else np.zeros(0) for j in numbers}, levels,
                      math.log(max(means[k] or 0.0, 1e-6)), p.learning_rate) for k in range(n_models)]
    blocks = _write_blocks(prepared, forests, folder)
    _boost(blocks, forests, folder, p)
    return BoosterSet(forests, encodings)


def _edges(prepared: DataFrame, n: dict[int, int], numbers: list[int], p: BoosterParams) -> dict[tuple[int, int], np.ndarray]:
    """Edges per (model, input), from rows that a hash of their key chooses."""
    if not numbers or not n:
        return {}
    share = F.create_map(*[F.lit(x) for k, c in n.items() for x in (k, int(min(1.0, BIN_ROWS / c) * 1_000_000))])[F.col(MODEL)]
    few = prepared.where(F.pmod(F.xxhash64("key__", F.lit(p.seed)), F.lit(1_000_000)) < share).select(MODEL, *[f"i{j}" for j in numbers])

    def work(key: tuple, t: pa.Table) -> pa.Table:
        made = [edges_of(t[f"i{j}"].cast(pa.float64()).fill_null(float("nan")).to_numpy(), p.max_bins).tolist() for j in numbers]
        return pa.table({"model": pa.array([key[0].as_py()] * len(numbers), pa.int32()), "input": pa.array(numbers, pa.int32()), "edges": pa.array(made, pa.list_(pa.float64()))})

    found = few.groupBy(MODEL).applyInArrow(work, "model int, input int, edges array<double>").collect()
    return {(r["model"], r["input"]): np.array(r["edges"]) for r in found}


def _write_blocks(prepared: DataFrame, forests: list[Forest], folder: str) -> DataFrame:
    """Bins (inputs x rows), model, label and key of the rows, as files; their names."""
    features = forests[0].features

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            bins = np.concatenate([h[0] for h in held], axis=1)
            narrow = np.uint8 if not bins.size or bins.max() < 256 else np.uint16
            save_block(folder, name, [bins.astype(narrow), *(np.concatenate([h[k] for h in held]) for k in (1, 2, 3))])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([name])], ["block"])

        for b in batches:
            if b.num_rows == 0:
                continue
            model = b.column(MODEL).to_numpy()
            columns = [b.column(f"i{k}") for k in range(len(features))]
            columns = [c if pa.types.is_string(c.type) else c.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in columns]
            bins = np.empty((len(features), b.num_rows), np.uint16)
            for k in np.unique(model).tolist():
                at = np.flatnonzero(model == k)
                bins[:, at] = forests[k].binned([c.take(pa.array(at)) if isinstance(c, pa.Array) else c[at] for c in columns])
            held.append((bins, model.astype(np.int32), b.column("y__").to_numpy(), b.column("key__").to_numpy().astype(np.int64).view(np.uint64)))
            if sum(len(h[1]) for h in held) >= BLOCK_ROWS:
                yield flush()
        if held:
            yield flush()

    # a name per file, so that a pass deals the blocks evenly to its tasks
    prepared.mapInArrow(work, "block string").write.option("maxRecordsPerFile", 1).parquet(f"{folder}/blocks")
    return prepared.sparkSession.read.parquet(f"{folder}/blocks")


def _boost(blocks: DataFrame, forests: list[Forest], folder: str, p: BoosterParams) -> None:
    """Add ``rounds`` trees to every forest."""
    features = forests[0].features
    sizes = [len(forests[0].levels[f]) + 1 if f in forests[0].levels else max(len(x.edges[f]) for x in forests) + 2 for f in features]
    is_level = [f in forests[0].levels for f in features]
    starts = np.array([x.start for x in forests])
    # a unit is about a millionth of a typical gradient
    units = np.array([2.0 ** round(math.log2(2.0 ** 20 / math.exp((2 - p.variance_power) * s))) for s in starts])
    for r in range(p.rounds):
        chosen = inputs_of_round(len(features), r, p)
        trees = [Growing(p) for _ in forests]
        wanted = [(k, 0) for k in range(len(forests))]
        while wanted:
            found = _pass(blocks, folder, p, r, [t.tree for t in trees], [x.trees[-1] if x.trees else None for x in forests],
                          wanted, chosen, sizes, is_level, starts, units)
            for slot, (k, node) in enumerate(wanted):
                if slot in found:
                    split, whole = found[slot]
                    trees[k].best[node] = split
                    if node == 0 and whole[1] > 0:
                        trees[k].tree.value[0] = -whole[0] / whole[1]
            wanted = [(k, i) for k, t in enumerate(trees) for i in t.opened()]
        for x, t in zip(forests, trees):
            x.trees.append(t.done())


def _pass(blocks: DataFrame, folder: str, p: BoosterParams, r: int, trees: list[Tree], before: list[Tree | None], wanted: list[tuple[int, int]],
          chosen: list[int], sizes: list[int], is_level: list[bool], starts: np.ndarray, units: np.ndarray) -> dict[int, tuple[Split | None, np.ndarray]]:
    """Best splits of the wanted (model, node) pairs. At a round's roots the scores first take the last round's trees in."""
    root = wanted[0][1] == 0
    offsets = [0, *np.cumsum([sizes[f] for f in chosen]).tolist()]
    width, n_models = offsets[-1], len(trees)
    slots = [np.full(len(t.feature), -1, np.int64) for t in trees]
    for s, (k, node) in enumerate(wanted):
        slots[k][node] = s

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for b in batches:
            for name in b.column(0).to_pylist():
                bins, model, y, key = load_block(folder, name)
                at = [np.flatnonzero(model == k) for k in range(n_models)] if n_models > 1 else [np.arange(len(model))]
                if not root:
                    score = load_block(folder, f"{name}.score-{r}")[0]
                elif r == 0:
                    score = starts[model]
                else:
                    score = load_block(folder, f"{name}.score-{r - 1}")[0].copy()
                    for k, t in enumerate(before):
                        score[at[k]] += p.learning_rate * np.array(t.value)[t.walk(bins[:, at[k]] if n_models > 1 else bins)]
                if root:
                    save_block(folder, f"{name}.score-{r}", [score])
                g, h = tweedie_step(y, score, p.variance_power)
                g, h = np.rint(g * units[model]), np.rint(h * units[model])
                slot = np.full(len(model), -1, np.int64)
                for k, t in enumerate(trees):
                    if (slots[k] >= 0).any():
                        slot[at[k]] = slots[k][t.walk(bins[:, at[k]] if n_models > 1 else bins)]
                take = slot >= 0
                if p.subsample < 1:
                    take &= sampled(key, r, p.subsample)
                rows = np.flatnonzero(take)
                slot, g, h = slot[rows], g[rows], h[rows]
                if total is None:
                    total = np.zeros((len(wanted), width, 3), np.int64)
                for k, f in enumerate(chosen):
                    n = sizes[f]
                    index = slot * n + bins[f, rows]
                    for j, weight in enumerate((g, h, None)):
                        total[:, offsets[k]:offsets[k + 1], j] += np.bincount(index, weight, len(wanted) * n).astype(np.int64).reshape(len(wanted), n)
        if total is not None:
            there = np.flatnonzero(total[:, :sizes[chosen[0]], 2].any(1))
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([total[s].tobytes() for s in there], pa.binary())], ["slot", "sums"])

    def choose(key: tuple, t: pa.Table) -> pa.Table:
        sums = np.zeros((width, 3), np.int64)
        for x in t["sums"]:
            sums += np.frombuffer(x.as_buffer(), np.int64).reshape(width, 3)
        slot = key[0].as_py()
        scale = np.array([1 / units[wanted[slot][0]]] * 2 + [1.0])
        whole = sums[:sizes[chosen[0]]].sum(0) * scale
        s = best_split(sums * scale, offsets, chosen, is_level, p.min_rows)
        if s is not None and s.gain <= LEAST_GAIN * max(whole[1], 1.0):
            s = None
        row = [slot, *whole.tolist(), *((s.gain, s.feature, np.packbits(s.goes_left).tobytes(), *s.left, *s.right) if s else [None] * 9)]
        return pa.table([pa.array([x], f.type) for x, f in zip(row, SPLIT_SCHEMA)], schema=SPLIT_SCHEMA)

    told = blocks.mapInArrow(scan, "slot int, sums binary").groupBy("slot").applyInArrow(choose, SPLIT_DDL).collect()
    out = {}
    for x in told:
        split = None
        if x["gain"] is not None:
            mask = np.unpackbits(np.frombuffer(x["goes_left"], np.uint8), count=sizes[x["feature"]]).astype(bool)
            split = Split(x["gain"], x["feature"], mask, (x["lg"], x["lh"], x["ln"]), (x["rg"], x["rh"], x["rn"]))
        out[x["slot"]] = (split, np.array([x["g"], x["h"], x["n"]]))
    return out


SPLIT_DDL = ("slot int, g double, h double, n double, gain double, feature int, goes_left binary, lg double, lh double, ln double, "
             "rg double, rh double, rn double")
SPLIT_SCHEMA = pa.schema([("slot", pa.int32())] + [(c, pa.float64()) for c in ("g", "h", "n", "gain")] + [("feature", pa.int32()), ("goes_left", pa.binary())]
                         + [(c, pa.float64()) for c in ("lg", "lh", "ln", "rg", "rh", "rn")])
