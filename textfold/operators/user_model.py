"""G1 for any user model: a model file, sent once, opened once per Python worker, fed with batches of bounded tokens.

The file's bytes travel as one broadcast, whatever store the file is in. A worker opens it at its first batch and keeps it between
tasks. Within windows of ``WINDOW_ROWS`` rows, sequences are taken by length and cut into batches whose padded size (rows x longest) stays within
the token budget; a sequence longer than the budget is a batch of its own, never cut. Every row's predictions go back to its key, in the
order of the input, and a model that answers with another number of rows raises.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from ..plans.partitioning import text_batches

# open_model(bytes) gives predict(ids, lengths): padded ids [rows x longest] to scores [rows x outputs].
Predict = Callable[[np.ndarray, np.ndarray], np.ndarray]

WINDOW_ROWS = 4096
OPEN_MODELS = 2  # models a worker keeps open

_opened: OrderedDict[str, Predict] = OrderedDict()


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """A file of any content in the store of ``path``, written by the driver."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


class Shipped:
    """A model file on its way to the workers."""

    def __init__(self, spark: SparkSession, path: str):
        row = spark.read.format("binaryFile").load(path).select("content").first()
        if row is None:
            raise FileNotFoundError(path)
        self.key = uuid.uuid4().hex
        self.content: Broadcast = spark.sparkContext.broadcast(bytes(row["content"]))

    def __getstate__(self):
        return {"key": self.key, "content": self.content}

    def opened(self, open_model: Callable[[bytes], Predict]) -> Predict:
        if self.key not in _opened:
            while len(_opened) >= OPEN_MODELS:
                _opened.popitem(last=False)
            _opened[self.key] = open_model(self.content.value)
        _opened.move_to_end(self.key)
        return _opened[self.key]


def budget_batches(lengths: np.ndarray, budget: int) -> list[np.ndarray]:
    """Rows of each batch, shortest first; rows x longest of a batch is at most ``budget``, or it has one row."""
    order = np.argsort(lengths, kind="stable")
    out, begin = [], 0
    for end in range(1, len(order) + 1):
        if end == len(order) or (end - begin + 1) * max(1, lengths[order[end]]) > budget:
            out.append(order[begin:end])
            begin = end
    return out


def score_with(df: DataFrame, model: Shipped, open_model: Callable[[bytes], Predict], outputs: Sequence[tuple[str, int]], ids_col: str = "input_ids",
               key: str = "row_id", budget: int = 1 << 16, pad: int = 0) -> DataFrame:
    """Long predictions ``key, model, fold, logit`` of a user's model; ``outputs`` names the (model, fold) of each column of its scores.

    ``ids_col`` holds whole token sequences; a null or empty one is a row without ids.
    """
    names, folds = [m for m, _ in outputs], [f for _, f in outputs]

    def run(batches):
        predict = None
        for batch in batches:
            for a in range(0, batch.num_rows, WINDOW_ROWS):
                part = batch.slice(a, WINDOW_ROWS)
                predict = predict or model.opened(open_model)
                ids = part[ids_col]
                n = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                begin = np.cumsum(n) - n
                scores = np.zeros((part.num_rows, len(outputs)))
                for rows in budget_batches(n, budget):
                    width = int(n[rows].max())
                    at = np.arange(width)
                    there = at < n[rows][:, None]
                    padded = np.full((len(rows), width), pad, np.int64)
                    padded[there] = flat[(begin[rows][:, None] + at)[there]]
                    got = np.asarray(predict(padded, n[rows]), float)
                    if got.shape != (len(rows), len(outputs)):
                        raise ValueError(f"the model gave {got.shape} scores for {len(rows)} rows and {len(outputs)} outputs")
                    scores[rows] = got
                times = len(outputs)
                yield pa.RecordBatch.from_arrays([part[key].take(pa.array(np.repeat(np.arange(part.num_rows), times))),
                                                  pa.array(names * part.num_rows, pa.string()), pa.array(folds * part.num_rows, pa.int32()),
                                                  pa.array(scores.reshape(-1))], [key, "model", "fold", "logit"])

    kind = df.schema[key].dataType.simpleString()
    return text_batches(df.select(key, ids_col)).mapInArrow(run, f"{key} {kind}, model string, fold int, logit double")
