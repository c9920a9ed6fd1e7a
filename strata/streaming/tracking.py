"""Stateful operators: Kalman tracks over slices, versions with undo, a stack of images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.registry import operator


class Kalman:
    """A constant-state filter of n measurements: identity motion and measurement, diagonal noise.

    As coded in the reference the last residual is added to the predicted state; ``control`` = 1 keeps that, 0 leaves
    the plain filter.
    """

    def __init__(self, n: int, process: float = 0.1, measured: float = 0.1, start: float = 10.0, control: float = 1.0) -> None:
        self.x, self.v = np.zeros(n), np.zeros(n)
        self.p, self.q, self.r, self.control, self.steps = np.eye(n) * start, np.eye(n) * process, np.eye(n) * measured, control, 0

    def predict(self) -> np.ndarray:
        return self.x + self.control * self.v

    def update(self, z: np.ndarray) -> np.ndarray:
        if self.steps == 0:
            self.x = z.astype(float)
        predicted = self.predict()
        self.v = z - predicted
        self.p = self.p + self.q
        s = self.p + self.r
        w = self.p @ np.linalg.inv(s)
        self.x = predicted + w @ self.v
        self.p = self.p - w @ s @ w.T
        self.steps += 1
        return self.x

    def difference(self, z: np.ndarray) -> float:
        """Sum of absolute differences from what is predicted."""
        return float(np.abs(self.predict() - z).sum())


@operator("STREAM-01")
def track(rows: DataFrame, key: str, order: str, values: list[str], **options: float) -> DataFrame:
    """``rows`` with p_<value> (predicted), e_<value> (estimated) and ``difference``, each key's rows in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, filt, out = pdf.sort_values(order, kind="stable"), Kalman(len(values), **options), []
        for z in pdf[values].to_numpy(dtype=float):
            before = filt.predict() if filt.steps else z
            d = filt.difference(z) if filt.steps else 0.0
            out.append([*before, *filt.update(z), d])
        names = [f"p_{v}" for v in values] + [f"e_{v}" for v in values] + ["difference"]
        return pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes] + [f"`p_{v}` double" for v in values] + [f"`e_{v}` double" for v in values] + ["difference double"])
    return rows.groupBy(key).applyInPandas(run, schema)


@operator("STREAM-01")
def track_stream(rows: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """The same over a stream: each key's filter is kept as state between batches."""
    n = len(values)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        filt = Kalman(n)
        if state.exists:
            x, v, p, filt.steps = state.get
            filt.x, filt.v, filt.p = np.array(x), np.array(v), np.array(p).reshape(n, n)
        out = []
        for pdf in batches:
            for _, r in pdf.sort_values(order).iterrows():
                e = filt.update(r[values].to_numpy(dtype=float))
                out.append((k[0], int(r[order]), *map(float, e)))
        state.update((filt.x.tolist(), filt.v.tolist(), filt.p.ravel().tolist(), filt.steps))
        yield pd.DataFrame(out, columns=[key, order, *[f"e_{v}" for v in values]])

    kinds = dict(rows.dtypes)
    schema = f"`{key}` {kinds[key]}, `{order}` long, " + ", ".join(f"`e_{v}` double" for v in values)
    return rows.groupBy(key).applyInPandasWithState(run, schema, "x array<double>, v array<double>, p array<double>, steps int", "append", "NoTimeout")


class Versions:
    """Undo and redo over written versions of a table: an edit drops what could be redone, and old versions go when
    there are more than ``most``."""

    def __init__(self, spark: SparkSession, folder: str, most: int = 50) -> None:
        self.spark, self.folder, self.most = spark, folder, most
        self.paths: list[str] = []
        self.at, self.count = -1, 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/v{self.count}"
        df.write.parquet(path)
        self.count += 1
        self.paths = [*self.paths[: self.at + 1], path][-self.most :]
        self.at = len(self.paths) - 1
        return self.current()

    def current(self) -> DataFrame:
        return self.spark.read.parquet(self.paths[self.at])

    def undo(self) -> DataFrame:
        self.at = max(0, self.at - 1)
        return self.current()

    def redo(self) -> DataFrame:
        self.at = min(len(self.paths) - 1, self.at + 1)
        return self.current()


@operator("STREAM-02")
def versions(spark: SparkSession, folder: str, most: int = 50) -> Versions:
    return Versions(spark, folder, most)


class Stack:
    """Images by a running number, as views."""

    def __init__(self, spark: SparkSession, name: str = "stack") -> None:
        self.spark, self.name, self.next = spark, name, 0

    def push(self, vox: DataFrame, col: str) -> int:
        vox.select("z", "y", "x", F.col(col).cast("double").alias("value")).createOrReplaceTempView(f"{self.name}_{self.next}")
        self.next += 1
        return self.next - 1

    def get(self, number: int) -> DataFrame:
        return self.spark.table(f"{self.name}_{number}")

    def pop(self) -> DataFrame:
        self.next -= 1
        out = self.get(self.next)
        self.spark.catalog.dropTempView(f"{self.name}_{self.next}")
        return out

    def clear(self) -> None:
        for i in range(self.next):
            self.spark.catalog.dropTempView(f"{self.name}_{i}")
        self.next = 0


@operator("STREAM-03")
def stack(spark: SparkSession, name: str = "stack") -> Stack:
    return Stack(spark, name)
