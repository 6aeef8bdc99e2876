"""Batch scoring with given networks: linear, MLP, sine, residual and feed-forward layers over vector columns.

Weights are input; they are broadcast once, and numpy applies them to Arrow batches. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravec.functions.arrays import NORM_FLOOR
from terravec.operators.points import split_train_val_test
from terravec.sources.io import write_splits


def activation(x: Column, name: str, w0: float = 30.0) -> Column:
    """sigmoid, relu, leakyrelu (0.2), tanh, gelu or sine of a scalar column."""
    if name == "gelu":  # the error function by Abramowitz and Stegun 7.1.26
        z = F.abs(x) / F.sqrt(F.lit(2.0))
        t = 1 / (1 + 0.3275911 * z)
        erf = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z)
        return x * (1 + F.signum(x) * erf) / 2
    return {"sigmoid": 1 / (1 + F.exp(-x)), "relu": F.greatest(x, F.lit(0.0)), "leakyrelu": F.when(x > 0, x).otherwise(0.2 * x), "tanh": F.tanh(x), "sine": F.sin(w0 * x)}[name]


def _activate(x: np.ndarray, name: str | None, w0: float = 1.0) -> np.ndarray:
    if name is None:
        return x
    if name == "gelu":
        from math import erf

        return x * (1 + np.vectorize(erf)(x / np.sqrt(2.0))) / 2
    return {"sigmoid": lambda: 1 / (1 + np.exp(-x)), "relu": lambda: np.maximum(x, 0), "leakyrelu": lambda: np.where(x > 0, x, 0.2 * x), "tanh": lambda: np.tanh(x), "sine": lambda: np.sin(w0 * x)}[name]()


def layer_norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """Biased variance, eps under the root."""
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + eps) * gain + bias


@dataclass
class Layer:
    """activation(weight @ x + bias); with skip the input is added, with norm the sum is layer-normalised."""

    weight: np.ndarray  # (out, in)
    bias: np.ndarray
    act: str | None = None
    w0: float = 1.0
    skip: bool = False
    norm: tuple[np.ndarray, np.ndarray] | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = _activate(x @ self.weight.T + self.bias, self.act, self.w0)
        y = y + x if self.skip else y
        return layer_norm(y, *self.norm) if self.norm else y


@dataclass
class Net:
    layers: list[Layer] = field(default_factory=list)
    unit: bool = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for layer in self.layers:
            x = layer(x)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), NORM_FLOOR) if self.unit else x


def linear(weight: np.ndarray, bias: np.ndarray, unit: bool = True) -> Net:
    return Net([Layer(weight, bias)], unit)


def mlp(weights: list[tuple[np.ndarray, np.ndarray]], act: str = "relu", unit: bool = True) -> Net:
    return Net([Layer(w, b, act if k < len(weights) - 1 else None) for k, (w, b) in enumerate(weights)], unit)


def siren(weights: list[tuple[np.ndarray, np.ndarray]], first_w0: float = 30.0, unit: bool = True) -> Net:
    return Net([Layer(w, b, "sine" if k < len(weights) - 1 else None, first_w0 if k == 0 else 1.0) for k, (w, b) in enumerate(weights)], unit)


@dataclass
class Residual:
    """x + relu(second(relu(first(x))))."""

    first: Layer
    second: Layer

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x + np.maximum(self.second(np.maximum(self.first(x), 0)), 0)


def residual_fc(head: tuple[np.ndarray, np.ndarray], blocks: list[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]], unit: bool = False) -> Net:
    return Net([Layer(*head, "relu"), *(Residual(Layer(*a), Layer(*b)) for a, b in blocks)], unit)


def apply_net(df: DataFrame, net: Net, vector: str, out: str = "embedding") -> DataFrame:
    """df with ``out`` array<double> in place of a column of that name; null vectors stay null."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    own = df.drop(out) if out != vector else df.withColumnRenamed(vector, "_in")
    source = "_in" if out == vector else vector

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            have = pdf[source].notna().to_numpy()
            result = np.empty(len(pdf), dtype=object)
            if have.any():
                y = shared.value(np.stack([np.asarray(v, dtype=np.float64) for v in pdf[source][have]]))
                for at, row in zip(np.flatnonzero(have), y, strict=True):
                    result[at] = row
            pdf[out] = result
            yield pdf

    got = own.mapInPandas(run, T.StructType([*own.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))
    return got.drop("_in")


def encode_points(points: DataFrame, encoding: Column, net: Net, out: str = "location_embedding") -> DataFrame:
    """A positional encoding, then a network, then unit length."""
    return apply_net(points.withColumn("_encoded", encoding), net, "_encoded", out).drop("_encoded")


def precompute_embeddings(rows: DataFrame, encoding: Column, net: Net, path: str, key: str, val_fraction: float = 0.1, test_fraction: float = 0.1, keep: list[str] | None = None, order: Column | None = None, out: str = "location_embedding") -> DataFrame:
    """Encodes all rows, splits them exactly into train, val and test, writes one folder for each split below path, and returns what
    has been written. keep: columns that go along, all by default. A split column of rows' own is kept instead of a new one."""
    own = [c for c in (keep or rows.columns) if c != out]
    encoded = encode_points(rows, encoding, net, out)
    if "split" not in rows.columns:
        encoded = split_train_val_test(encoded, val_fraction, test_fraction, key, order=order)
    write_splits(encoded.select(*dict.fromkeys([*own, "split", out])), path)
    return rows.sparkSession.read.parquet(path)


def project_embeddings(df: DataFrame, net: Net, vector: str, out: str = "projected") -> DataFrame:
    return apply_net(df, net, vector, out)


def class_scores(df: DataFrame, weights: np.ndarray, vector: str, key: str, only: int | None = None) -> DataFrame:
    """(key, class, score): the sigmoid of every class's product, or of one class the raw product."""
    n = len(weights)
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(weights, dtype=np.float64))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            raw = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vector]]) @ shared.value.T if len(pdf) else np.zeros((0, n))
            if only is not None:
                yield pd.DataFrame({key: pdf[key], "class": only, "score": raw[:, only]})
            else:
                yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), n), "class": np.tile(np.arange(n), len(pdf)), "score": (1 / (1 + np.exp(-raw))).reshape(-1)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, vector).filter(F.col(vector).isNotNull()).mapInPandas(run, f"{key} {kind}, class int, score double")
