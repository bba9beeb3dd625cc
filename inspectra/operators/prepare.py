"""Preprocessing of all cross-validation folds in one go: leave-one-out views by subtraction.

A view is what a model may learn from: view f leaves fold f out, the last view
is all training rows.  Per-fold counts, sums and category counts come from one
scan each; a view's figures are the totals less its fold's.  Medians are exact
order statistics over the view's folds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import radix

INFREQUENT = "__infrequent__"
#: Values of a category that can have a slot; more is an error (such a column is no category).
MAX_VALUES = 10_000


@dataclass
class View:
    """Fitted on one view: numbers' medians, means and deviations; categories' modes and value -> slot; class weights."""

    medians: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    modes: list[int]
    slots: list[np.ndarray]  # per category: code -> slot among its names, -1: none
    weights: tuple[float, float]
    rows: int


@dataclass
class Preparation:
    """Names and values that all views share, and the views."""

    numeric: list[str]
    categorical: list[str]
    values: list[list[str]]
    rare_min: int | None
    views: list[View] = field(default_factory=list)

    def names(self, view: int) -> list[tuple[str, int]]:
        """(slot name, place in the matrix) of a view: numbers, then the values that have a slot, alphabetically."""
        out = [(f"num__{c}", i) for i, c in enumerate(self.numeric)]
        base = len(self.numeric)
        for c, values, slots in zip(self.categorical, self.values, self.views[view].slots):
            named = {(values + [INFREQUENT])[s]: s for s in slots.tolist() if s >= 0}
            out += [(f"cat__{c}_{v}", base + named[v]) for v in sorted(named)]
            base += len(values) + 1
        return out

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(len(v) + 1 for v in self.values)

    def inputs(self) -> list[Column]:
        """(nums, cats) columns of any rows: numbers as doubles, categories as codes (-1 null, 0 never seen in training)."""
        codes = [F.when(F.col(f"`{c}`").isNull(), -1).otherwise(F.array_position(F.array(*map(F.lit, v)).cast("array<string>"), F.col(f"`{c}`").cast("string")))
                 .cast("int") for c, v in zip(self.categorical, self.values)]
        return [F.array(*(F.col(f"`{c}`").cast("double") for c in self.numeric)).alias("nums"), F.array(*codes).cast("array<int>").alias("cats")]

    def matrix(self, nums: np.ndarray, cats: np.ndarray, view: int, scale: bool) -> np.ndarray:
        """Rows as seen by a view: imputed (and z-scored) numbers, then one-hot slots."""
        v = self.views[view]
        x = np.zeros((len(nums), self.width))
        filled = np.where(np.isnan(nums), v.medians, nums)
        x[:, :len(self.numeric)] = (filled - v.means) / v.deviations if scale else filled
        base = len(self.numeric)
        for k, values in enumerate(self.values):
            code = np.where(cats[:, k] < 0, v.modes[k], cats[:, k])
            slot = v.slots[k][code]
            at = np.flatnonzero(slot >= 0)
            x[at, base + slot[at]] = 1.0
            base += len(values) + 1
        return x


def prepare(train: DataFrame, numeric: list[str], categorical: list[str], rare_min: int | None) -> Preparation:
    """The values of the categories; ``fit_views`` does the rest."""
    values = []
    for c in categorical:
        got = sorted(r[0] for r in train.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().limit(MAX_VALUES + 1).collect())
        if len(got) > MAX_VALUES:
            raise ValueError(f"{c} has more than {MAX_VALUES} values: not a category")
        values.append(got)
    return Preparation(list(numeric), list(categorical), values, rare_min)


def fit_views(p: Preparation, rows: DataFrame, folds: int) -> Preparation:
    """Fits all folds + 1 views of ``rows`` (fold, label, nums, cats)."""
    n = len(p.numeric)
    flat = rows.select("fold", "label", *(F.col("nums")[i].alias(f"x{i}") for i in range(n)))
    columns = [f"x{i}" for i in range(n)]
    everything = set(range(folds))
    sets = {v: everything - {v} for v in range(folds + 1)}
    middle = radix.quantiles(flat, columns, "fold", sets, [0.5])
    pivot = [middle[folds, c, 0.5] or 0.0 for c in columns]
    ok = [F.nanvl(F.col(c), F.lit(None)) - F.lit(a) for c, a in zip(columns, pivot)]  # about the median: nothing cancels
    got = flat.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("positive"), *(
        e for i, x in enumerate(ok) for e in (F.count(x).alias(f"n{i}"), F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}")))).collect()
    per = {r["fold"]: r for r in got}
    cats = [{} for _ in p.categorical]
    if p.categorical:
        seen = rows.select("fold", F.posexplode("cats").alias("cat", "code")).groupBy("fold", "cat", "code").agg(F.count("*").alias("n")).collect()
        for r in seen:
            cats[r["cat"]].setdefault(r["code"], {})[r["fold"]] = r["n"]
    for v, own in sets.items():
        total = lambda name: sum((per[f][name] or 0) for f in own if f in per)  # noqa: B023, E731
        rows_n, positive = total("n"), total("positive")
        medians, means, deviations = (np.zeros(n) for _ in range(3))
        for i, c in enumerate(columns):
            m = middle[v, c, 0.5]
            medians[i] = 0.0 if m is None else m
            missing, d = rows_n - total(f"n{i}"), medians[i] - pivot[i]
            if rows_n:
                mean = (total(f"s{i}") + missing * d) / rows_n
                var = (total(f"q{i}") + missing * d * d) / rows_n - mean * mean
                means[i], deviations[i] = pivot[i] + mean, np.sqrt(var) if var > 1e-24 else 1.0
        deviations[deviations == 0] = 1.0
        modes, slots = [], []
        for k, values in enumerate(p.values):
            count = np.zeros(len(values) + 1, np.int64)
            nulls = 0
            for code, by in cats[k].items():
                m = sum(x for f, x in by.items() if f in own)
                if code < 0:
                    nulls = m
                else:
                    count[code] += m
            mode = int(np.argmax(count[1:])) + 1 if count[1:].any() else 0  # ties: the smallest value
            modes.append(mode)
            if mode:
                count[mode] += nulls
            slot = np.arange(-1, len(values))
            slot[count == 0] = -1
            if p.rare_min:
                slot[(count > 0) & (count < p.rare_min)] = len(values)
            slot[0] = -1
            slots.append(slot)
        negative = rows_n - positive
        weights = tuple(rows_n / (2 * x) if x else 0.0 for x in (negative, positive))
        p.views.append(View(medians, means, deviations, modes, slots, weights, rows_n))
    return p
