"""Training in passes (epochs) over shuffled batches, with a kept model state and a record per pass.

The model is a softmax over hashed, length-normalised term counts; it keeps the slots that occur in the training rows. A pass
shuffles the training rows into batches (``shuffle_batches``). Batches are steps that follow each other: ``WALK_ROWS`` rows of small batches are
walked through by one task, which hands the weights on to the next; a batch larger than that is one distributed step, whose tasks
turn their rows into sums per (slot, label), Spark adds these up, and the driver moves the weights. Both give the same weights.
Sums are whole numbers (``SCALE`` parts of one), so they don't depend on the order in which tasks are added.
After each pass the weights and the pass's record are written; a job that is started again with the same
folder goes on behind the last whole pass and ends with the same weights and records.

What the driver holds is the model: at most ``num_features`` x labels weights, whatever the number of rows.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline import constants as C
from pressline.functions import labels as lb
from pressline.operators.encode import tokenize
from pressline.operators.metrics import f_beta, report_names
from pressline.operators.sampling import shuffle_batches
from pressline.plans.stage import scratch_path, stage
from pressline.sources import runs
from pressline.sources.articles import path_exists

NUM_FEATURES = 1 << 18
#: Gradient sums are whole numbers of this part of one; 2^63 / SCALE rows fit in one batch.
SCALE = 1 << 36
#: Rows of small batches that one task steps through. Steps depend on the ones before, so a job for each batch gains nothing.
WALK_ROWS = 1 << 17
PHASES = ("train", "validation")
RECORD = "phase string, n long, batches int, loss double, acc1 double, seconds double, matrix array<struct<truth:int,guess:int,n:long>>"


@dataclass
class Softmax:
    """Label order, the sorted slots, their weights (slots x labels) and the constants."""
    labels: list[str]
    num_features: int
    slots: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def forward(self, slot: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probabilities of rows whose entries begin at ``starts``."""
        at = np.minimum(np.searchsorted(self.slots, slot), max(0, len(self.slots) - 1))
        known = (self.slots[at] == slot) if len(self.slots) else np.zeros(len(slot), bool)
        z = np.tile(self.bias, (len(starts) - 1, 1))
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        for k in range(len(self.bias)):
            part = np.where(known, self.weights[at, k] if len(self.slots) else 0.0, 0.0) * value
            z[:, k] += np.bincount(row, part, len(starts) - 1)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def bags(df: DataFrame, text_col: str, num_features: int = NUM_FEATURES) -> DataFrame:
    """``df`` with ``bag`` (sorted term slots, repeats kept) in place of its text."""
    slots = F.transform(tokenize(text_col), lambda t: F.pmod(F.xxhash64(t), F.lit(num_features)).cast("int"))
    return df.select(*[c for c in df.columns if c != text_col], F.array_sort(F.coalesce(slots, F.array().cast("array<int>"))).alias("bag"))


def entries(bag: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """slot and value (counts of a row, its length one) of each entry, and where rows begin."""
    flat = bag.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = bag.offsets.to_numpy().astype(np.int64) - bag.offsets[0].as_py()
    row = np.repeat(np.arange(len(bag)), np.diff(ends))
    first = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])]) if len(flat) else np.empty(0, np.int64)
    count = np.diff(np.r_[first, len(flat)]).astype(np.float64)
    norm = np.sqrt(np.bincount(row[first], count * count, len(bag)))
    starts = np.searchsorted(row[first], np.arange(len(bag) + 1))
    return flat[first], count / norm[row[first]], starts


def part_sums(m: Softmax, bag: pa.ListArray, truth: np.ndarray, gradient: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """slot, label and value of some rows' sums, see ``batch_sums``."""
    k = len(m.bias)
    slot, value, starts = entries(bag)
    p = m.forward(slot, value, starts)
    guess = p.argmax(axis=1)
    loss = -np.log(np.maximum(p[np.arange(len(p)), truth], 1e-300))
    whole = lambda x: np.rint(x * SCALE).astype(np.int64)
    cells, times = np.unique(truth.astype(np.int64) * k + guess, return_counts=True)
    out = [(np.full(3, -1), np.arange(3), np.array([len(p), int((guess == truth).sum()), int(whole(loss).sum())])),
           (-2 - cells // k, cells % k, times)]
    if gradient:
        p[np.arange(len(p)), truth] -= 1
        step = whole(p[np.repeat(np.arange(len(p)), np.diff(starts))] * value[:, None])
        order = np.argsort(slot, kind="stable")
        names, first = np.unique(slot[order], return_index=True)
        sums = np.add.reduceat(step[order], first, axis=0) if len(names) else np.zeros((0, k), np.int64)
        sums = np.r_[sums, whole(p).sum(axis=0)[None]]                  # the constants, as slot ``num_features``
        names = np.r_[names, m.num_features]
        out.append((np.repeat(names, k), np.tile(np.arange(k), len(names)), sums.ravel()))
    slot, label, value = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
    return slot, label, value


def batch_sums(rows: DataFrame, model: Softmax, gradient: bool) -> pa.Table:
    """(slot, label, value) sums over ``rows`` (bag, truth). Slots below zero hold the batch's record: -1 its
    rows, hits and loss, -2 - truth the guesses of that truth."""
    shared = rows.sparkSession.sparkContext.broadcast(model)            # the model, bounded by its width

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = part_sums(shared.value, batch["bag"], batch["truth"].to_numpy(), gradient)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums], ["slot", "label", "value"])

    part = rows.select("bag", "truth").mapInArrow(run, "slot long, label long, value long")
    return part.groupBy("slot", "label").agg(F.sum("value").alias("value")).toArrow()


class Meter:
    """What a phase of one pass leaves: rows, batches, mean loss, hits in percent, seconds and the confusion matrix."""

    def __init__(self):
        self.n = self.hits = self.loss = self.batches = 0
        self.cells: dict[tuple[int, int], int] = {}
        self.began = time.monotonic()

    def totals(self) -> list[list[int]]:
        return [[self.n, self.hits, self.loss, self.batches], *([t, g, v] for (t, g), v in self.cells.items())]

    def add_totals(self, totals: list[list[int]]) -> None:
        for t in totals:
            if len(t) == 4:
                self.n, self.hits, self.loss, self.batches = self.n + t[0], self.hits + t[1], self.loss + t[2], self.batches + t[3]
            else:
                self.cells[t[0], t[1]] = self.cells.get((t[0], t[1]), 0) + t[2]

    def add(self, slot: np.ndarray, label: np.ndarray, value: np.ndarray) -> int:
        total = {int(a): int(v) for a, v in zip(label[slot == -1], value[slot == -1], strict=True)}
        self.n, self.hits, self.loss, self.batches = self.n + total.get(0, 0), self.hits + total.get(1, 0), self.loss + total.get(2, 0), self.batches + 1
        for s, guess, v in zip(slot[slot < -1], label[slot < -1], value[slot < -1], strict=True):
            cell = (int(-2 - s), int(guess))
            self.cells[cell] = self.cells.get(cell, 0) + int(v)
        return total.get(0, 0)

    def record(self, phase: str) -> tuple:
        some = max(1, self.n)
        return (phase, self.n, self.batches, self.loss / SCALE / some if self.n else None, 100.0 * self.hits / some if self.n else None,
                time.monotonic() - self.began, [(t, g, v) for (t, g), v in sorted(self.cells.items())])


def move_weights(model: Softmax, sums: tuple, n: int, rate: float) -> None:
    """One step of the weights by the summed gradient of a batch of ``n`` rows."""
    slot, label, value = sums
    move = -rate / n * value / SCALE
    mine = (slot >= 0) & (slot < model.num_features)
    model.weights[np.searchsorted(model.slots, slot[mine]), label[mine]] += move[mine]
    model.bias[label[slot == model.num_features]] += move[slot == model.num_features]


def _by_batch(batches) -> Iterator[tuple[int, pa.Table]]:
    """(batch_id, its rows) of rows that come in the order of ``batch_id``."""
    held, at = [], None
    for batch in batches:
        ids = batch["batch_id"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else []
        for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
            if held and ids[a] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = int(ids[a])
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield at, pa.Table.from_batches(held)


def walk_batches(state: DataFrame, rows: DataFrame, labels: list[str], num_features: int, rate) -> DataFrame:
    """The steps of consecutive small batches in one task, which holds the model and one batch at a time. ``state``: slot, weights (the
    constants last); ``rows``: batch_id, bag, truth; ``rate``: the rate of a batch. Returns the new state; in its rows of slot -1, ``totals`` of the batches' record."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        model, meter = None, Meter()
        out = ["slot", "weights", "totals"]
        for batch_id, part in _by_batch(batches):
            if model is None:                                   # the state comes first
                w = part["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(labels)).copy()
                model = Softmax(labels, num_features, part["slot"].to_numpy()[:-1], w[:-1], w[-1])
                continue
            sums = part_sums(model, part["bag"].combine_chunks(), part["truth"].to_numpy(), True)
            move_weights(model, sums, max(1, meter.add(*sums)), rate(batch_id))
        if model is None:
            return
        found, all_weights = np.r_[model.slots, num_features].astype(np.int64), np.r_[model.weights, model.bias[None]]
        for a in range(0, len(found), 10_000):
            w = all_weights[a:a + 10_000]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(found[a:a + 10_000]), lists, pa.nulls(len(w), pa.list_(pa.list_(pa.int64())))], out)
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.nulls(1, pa.list_(pa.float64())), pa.array([meter.totals()], pa.list_(pa.list_(pa.int64())))], out)

    none = lambda kind: F.lit(None).cast(kind)
    first = state.select(F.lit(-1).cast("long").alias("batch_id"), "slot", "weights", none("array<int>").alias("bag"), none("int").alias("truth"))
    then = rows.select("batch_id", F.lit(0).cast("long").alias("slot"), none("array<double>").alias("weights"), "bag", "truth")
    both = first.unionByName(then).coalesce(1).sortWithinPartitions("batch_id", "slot")
    return both.mapInArrow(run, "slot long, weights array<double>, totals array<array<long>>")


def _write_state(spark: SparkSession, model: Softmax, path: str) -> None:
    table = pa.table({"slot": pa.array(np.r_[model.slots, model.num_features].astype(np.int64)),
                      "weights": pa.array([*model.weights.tolist(), model.bias.tolist()], pa.list_(pa.float64()))})
    spark.createDataFrame(table).write.mode("overwrite").parquet(path)


def _read_state(spark: SparkSession, labels: list[str], num_features: int, path: str) -> Softmax:
    return _held(spark.read.parquet(path), labels, num_features)


def _held(state: DataFrame, labels: list[str], num_features: int) -> Softmax:
    rows = state.orderBy("slot").toArrow()                              # at most num_features + 1 rows
    w = np.array(rows["weights"].to_pylist(), np.float64).reshape(-1, len(labels))
    return Softmax(labels, num_features, rows["slot"].to_numpy()[:-1], w[:-1], w[-1])


def load_softmax(spark: SparkSession, state_dir: str, epoch: int, labels: list[str], num_features: int = NUM_FEATURES) -> Softmax:
    """The model after pass ``epoch`` (from 0)."""
    return _read_state(spark, labels, num_features, f"{state_dir}/weights/epoch={epoch}")


def score(model: Softmax, df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep``, ``scores`` (probabilities in label order), ``guess`` and ``label_name``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = bags(df.select(*keep, text_col), text_col, model.num_features)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p = shared.value.forward(*entries(batch["bag"]))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], flat], [*keep, "scores"])

    kind = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields], "scores array<double>"])
    guess = lb.argmax("scores")
    names = F.array(*[F.lit(x) for x in model.labels])
    return rows.select(*keep, "bag").mapInArrow(run, kind).select(*keep, "scores", guess.alias("guess"), F.element_at(names, guess + 1).alias("label_name"))


def _walk_pass(spark: SparkSession, batched: DataFrame, model: Softmax, n_batches: int, per_walk: int, rate, meter: Meter) -> Softmax:
    """One pass as a chain of walks over ``per_walk`` batches each. The state goes from walk to walk through the shared folder, and is
    read back once; each walk reads its own folder of batches."""
    path, begun = scratch_path(spark, "epoch-batches"), scratch_path(spark, "epoch-state")
    n_walks = math.ceil(n_batches / per_walk)
    laid = batched.select("bag", "truth", "batch_id", F.floor(F.col("batch_id") / per_walk).alias("walk"))
    laid.repartition(max(1, n_walks), "walk").write.partitionBy("walk").parquet(path)
    _write_state(spark, model, begun)
    state = spark.read.parquet(begun)
    for walk in range(n_walks):
        rows = spark.read.schema("bag array<int>, truth int, batch_id long").parquet(f"{path}/walk={walk}")
        moved = stage(walk_batches(state, rows, model.labels, model.num_features, rate), "epoch-walk")
        meter.add_totals(moved.where("slot = -1").first()["totals"])
        state = moved.where("slot >= 0").select("slot", "weights")
    return _held(state, model.labels, model.num_features)


@dataclass
class EpochResult:
    model: Softmax
    history: DataFrame          # a row per epoch and phase, see ``RECORD``


def train_epochs(rows: DataFrame, state_dir: str, epochs: int, batch_size: int, lr: float = 2.0, warmup: int = 0, id_col: str = "doc_id",
                 text_col: str = "training_content", num_features: int = NUM_FEATURES, seed: str = C.DEFAULT_SEED,
                 stop_after: int | None = None) -> EpochResult:
    """Train on the ``train`` rows of ``rows`` (id, text, label, phase) for ``epochs`` passes, judging the ``validation`` rows after each.

    The rate grows over the first ``warmup`` batches. ``state_dir`` keeps weights and record of every pass; passes that it
    holds already are not run again. ``stop_after`` ends the job behind that many passes."""
    spark = rows.sparkSession
    labels = [r[0] for r in rows.select(F.col("label").cast("string")).distinct().orderBy("label").collect()]
    if None in labels:
        raise ValueError("rows without a label can't be trained on or judged")
    truth = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label").cast("string")) - 1
    data = bags(rows.select(id_col, text_col, "label", "phase"), text_col, num_features)
    # equal rows share the key: which of them comes first makes no difference
    data = stage(data.select("phase", "bag", truth.cast("int").alias("truth"), F.xxhash64(id_col, "label", "bag").alias("_key")), "epoch-rows")
    train, judged = (data.where(F.col("phase") == p).drop("phase") for p in PHASES)
    done = 0
    while path_exists(spark, f"{state_dir}/records/epoch={done}/_SUCCESS"):
        done += 1
    if done:
        model = load_softmax(spark, state_dir, done - 1, labels, num_features)
    else:
        slots = train.select(F.explode("bag").alias("slot")).distinct().toArrow()["slot"].to_numpy()       # at most num_features
        model = Softmax(labels, num_features, np.sort(slots).astype(np.int64), np.zeros((len(slots), len(labels))), np.zeros(len(labels)))
    for epoch in range(done, min(epochs, stop_after if stop_after is not None else epochs)):
        batched = shuffle_batches(train, batch_size, 1, "_key", f"{seed}-{epoch}")
        n_batches = math.ceil(train.count() / batch_size)
        rate = lambda b, before=epoch * n_batches: lr * min(1.0, (before + b + 1) / warmup) if warmup else lr
        meter = Meter()
        if batch_size <= WALK_ROWS:
            model = _walk_pass(spark, batched, model, n_batches, max(1, WALK_ROWS // batch_size), rate, meter)
        else:
            laid = stage(batched.select("bag", "truth", "batch_id").repartition("batch_id", F.pmod("_key", F.lit(64))).sortWithinPartitions("batch_id"), "epoch-batches")
            for b in range(n_batches):
                got = batch_sums(laid.where(F.col("batch_id") == b), model, gradient=True)
                sums = tuple(got[c].to_numpy() for c in ("slot", "label", "value"))
                move_weights(model, sums, max(1, meter.add(*sums)), rate(b))
        records = [meter.record("train")]
        meter = Meter()
        got = batch_sums(judged, model, gradient=False)
        meter.add(*(got[c].to_numpy() for c in ("slot", "label", "value")))
        records.append(meter.record("validation"))
        _write_state(spark, model, f"{state_dir}/weights/epoch={epoch}")
        spark.createDataFrame(records, RECORD).coalesce(1).write.mode("overwrite").json(f"{state_dir}/records/epoch={epoch}")
    return EpochResult(model, read_history(spark, state_dir))


def read_history(spark: SparkSession, state_dir: str) -> DataFrame:
    """A row per epoch (from 0) and phase."""
    return spark.read.schema(f"epoch int, {RECORD}").json(f"{state_dir}/records")


def epoch_reports(history: DataFrame, n_labels: int, beta: float = 1.0) -> DataFrame:
    """``history`` with the metric report of each row's confusion matrix as columns (x100 but for correct and total)."""
    keys = ["epoch", "phase"]
    cell = F.explode("matrix").alias("c")
    cells = history.select(*keys, cell).select(*keys, "c.*")
    none = F.lit(0).cast("long")
    side = lambda label, t, g, tp: F.struct(F.col(label).alias("label"), t.alias("t"), g.alias("g"), tp.alias("tp"))
    hits = F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(none)
    sides = cells.select(*keys, F.inline(F.array(side("truth", F.col("n"), none, hits), side("guess", none, F.col("n"), none))))
    per = sides.groupBy(*keys, "label").agg(F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("tp").alias("tp")).withColumns({
        "precision": F.col("tp") / (F.col("g") + F.lit(C.METRIC_EPSILON)), "recall": F.col("tp") / (F.col("t") + F.lit(C.METRIC_EPSILON))})
    # a label that no row has counts 0 in the means
    p, r = ([F.coalesce(F.max(F.when(F.col("label") == 1, F.col(c))), F.lit(0.0)) if n_labels == 2 else F.sum(c) / n_labels for c in ("precision", "recall")])
    one = per.groupBy(*keys).agg(F.sum("tp").alias("correct"), F.sum("t").alias("total"), p.alias("_p"), r.alias("_r"))
    names = report_names(n_labels)
    values = [100.0 * F.try_divide(F.col("correct").cast("double"), F.col("total")), F.col("correct").cast("double"), F.col("total").cast("double"),
              100.0 * F.col("_p"), 100.0 * F.col("_r"), 100.0 * f_beta(F.col("_p"), F.col("_r"), beta)]
    return history.join(one.select(*keys, *[v.alias(n) for n, v in zip(names, values, strict=True)]), keys, "left")


def history_lists(history: DataFrame, n_labels: int) -> DataFrame:
    """The job's record, a row per phase: lists with an entry per pass, in order."""
    report = epoch_reports(history, n_labels)
    names = report_names(n_labels)
    seconds = F.col("seconds") / F.greatest(F.lit(1), F.col("batches"))
    row = F.struct("epoch", "loss", F.col("acc1").alias("accuracy"), seconds.alias("batch_time"), F.col("matrix").alias("confusion_matrix"),
                   F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("classification_metrics"))
    rows = report.groupBy("phase").agg(F.collect_list(row).alias("r")).select("phase", F.array_sort("r", lambda a, b: a["epoch"] - b["epoch"]).alias("r"))
    return rows.select("phase", *[F.col("r").getField(c).alias(c) for c in ("loss", "accuracy", "batch_time", "confusion_matrix", "classification_metrics")])


def epoch_training_job(rows: DataFrame, out_dir: str, run_id: str, epochs: int, batch_size: int, lr: float = 2.0, warmup: int = 0,
                       note: str | None = None, **columns) -> EpochResult:
    """Train in passes (or go on with run ``run_id``), then leave the run record and the history record."""
    spark = rows.sparkSession
    result = train_epochs(rows, f"{out_dir}/passes/{run_id}", epochs, batch_size, lr, warmup, **columns)
    samples = rows.where(F.col("phase") == "train").count()
    runs.append_run(runs.run_record(spark, run_id, batch_size, epochs, lr, warmup, samples, result.model.labels, note), f"{out_dir}/runs")
    runs.write_history(history_lists(result.history, len(result.model.labels)), f"{out_dir}/history/{run_id}")
    return result
