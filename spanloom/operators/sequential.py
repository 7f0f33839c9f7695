"""Operators that are sequential by nature: each group is one pandas call; a group is one recording or client.

Ties and orders are total: times first, then ids.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .online import Ewma


def per_group(df: DataFrame, group: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy(group).applyInPandas(fn, schema)


def ewma_spikes(df: DataFrame, group: str, time: str, row_id: str, delta: str) -> DataFrame:
    """group, id, spike: the size of each jump above the running level (0 where there is none). A null delta counts as 0."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*dict.fromkeys((time, row_id))], kind="stable")
        state = Ewma()
        return pd.DataFrame({group: pdf[group], "id": pdf[row_id], "spike": [state.push(d) for d in pdf[delta].fillna(0.0)]})

    return per_group(df.select(group, time, row_id, delta), group, run, f"{group} {kinds[group]}, id {kinds[row_id]}, spike double")


def scheduled(times: np.ndarray, strengths: np.ndarray, least_gap: float) -> list[int]:
    """Positions of the strongest set of sorted times at least ``least_gap`` apart; of equal sets the one that leaves later times out."""
    reach = np.searchsorted(times, times - least_gap, side="right")
    for i, t in enumerate(times):  # the difference itself decides where t - least_gap is rounded
        while reach[i] < i and t - times[reach[i]] >= least_gap:
            reach[i] += 1
        while reach[i] and t - times[reach[i] - 1] < least_gap:
            reach[i] -= 1
    value = np.zeros(len(times) + 1)
    for i, s in enumerate(strengths):
        value[i + 1] = max(value[i], s + value[reach[i]])
    out, i = [], len(times)
    while i:
        if value[i] > value[i - 1]:
            out.append(i - 1)
            i = reach[i - 1]
        else:
            i -= 1
    return out[::-1]


def select_cuts(df: DataFrame, group: str, time: str, row_id: str, strength: str, least_gap: float) -> DataFrame:
    """group, id, t of the cuts kept by weighted interval scheduling."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[time, strength]).sort_values([*dict.fromkeys((time, row_id))], kind="stable")
        keep = scheduled(pdf[time].to_numpy(float), pdf[strength].to_numpy(float), least_gap)
        pdf = pdf.iloc[keep]
        return pd.DataFrame({group: pdf[group], "id": pdf[row_id], "t": pdf[time].astype(float)})

    return per_group(df.select(group, time, row_id, strength), group, run, f"{group} {kinds[group]}, id {kinds[row_id]}, t double")


def segmentation(points: list[float], quality: list[float], target: float, longest: float, weight: float = 0.85) -> list[float]:
    """Inner points that cut [first, last] best: squared relative deviation of lengths from target, and the poor quality of cuts.

    A segment is between max(1.5, 0.28 target) and ``longest`` long; a point without such a predecessor may follow the one before it.
    """
    n = len(points)
    shortest = max(1.5, 0.28 * target)
    cost, via = [0.0] + [np.inf] * (n - 1), [-1] * n
    for j in range(1, n):
        a, b = bisect_left(points, points[j] - longest), min(j, bisect_right(points, points[j] - shortest))
        options = range(a, b) if a < b else range(j - 1, j)
        own = 0.0 if j == n - 1 else weight * (1 - quality[j])
        total = [(cost[i] + ((points[j] - points[i]) / target - 1) ** 2 + own, i) for i in options if points[i] < points[j]]
        if total:
            cost[j], via[j] = min(total)
    if not np.isfinite(cost[-1]):
        pieces = max(1, int(np.ceil((points[-1] - points[0]) / target)))
        return [points[0] + (points[-1] - points[0]) * k / pieces for k in range(1, pieces)]
    out, j = [], via[n - 1]
    while j > 0:
        out.append(points[j])
        j = via[j]
    return out[::-1]


def optimal_cuts(df: DataFrame, group: str, time: str, quality: str, target: float, longest: float) -> DataFrame:
    """group, t of the cuts between a group's first and last point that the boundary cost prefers."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        best = pdf.dropna(subset=[time]).groupby(time)[quality].max().sort_index()
        if len(best) < 3:
            return pd.DataFrame({group: [], "t": []})
        cuts = segmentation(best.index.astype(float).tolist(), best.fillna(0.3).astype(float).tolist(), target, longest)
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(cuts), "t": cuts})

    return per_group(df.select(group, time, quality), group, run, f"{group} {kinds[group]}, t double")


def grid_thinning(df: DataFrame, group: str, time: str, row_id: str, stride: float) -> DataFrame:
    """group, id, t of the rows kept so that each is ``stride`` or more after the last kept one."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[time]).sort_values([*dict.fromkeys((time, row_id))], kind="stable")
        t, keep, at = pdf[time].to_numpy(float), [], 0
        while at < len(t):
            keep.append(at)
            at = max(at + 1, int(np.searchsorted(t, t[at] + stride - 1e-9)))
        pdf = pdf.iloc[keep]
        return pd.DataFrame({group: pdf[group], "id": pdf[row_id], "t": pdf[time].astype(float)})

    return per_group(df.select(group, time, row_id), group, run, f"{group} {kinds[group]}, id {kinds[row_id]}, t double")


def greedy_distinct(df: DataFrame, group: str, time: str, row_id: str, bits: str, radius: int, quality: str | None = None) -> DataFrame:
    """group, id of the rows kept in time order: one within ``radius`` bits of a kept one goes, unless it is the group's first of best ``quality``."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[bits]).sort_values([*dict.fromkeys((time, row_id))], kind="stable")
        words = pdf[bits].to_numpy(np.int64).view(np.uint64)
        best = int(np.argmax(pdf[quality].to_numpy(float))) if quality and len(pdf) else -1
        kept: list[int] = []
        for i, w in enumerate(words):
            if i == best or not kept or np.bitwise_count(words[kept] ^ w).min() > radius:
                kept.append(i)
        pdf = pdf.iloc[kept]
        return pd.DataFrame({group: pdf[group], "id": pdf[row_id]})

    cols = dict.fromkeys([group, time, row_id, bits] + ([quality] if quality else []))
    return per_group(df.select(*cols), group, run, f"{group} {kinds[group]}, id {kinds[row_id]}")


def diversified(ids: list, relevance: np.ndarray, vectors: np.ndarray, k: int, balance: float = 0.72) -> list:
    """k ids by maximal marginal relevance: first the most relevant, then what adds most to those chosen; ties by position."""
    if not len(ids):
        return []
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    low, high = relevance.min(), relevance.max()
    gain = (relevance - low) / (high - low) if high > low else np.ones(len(ids))
    near = np.full(len(ids), -np.inf)
    left = np.ones(len(ids), bool)
    chosen: list[int] = []
    while len(chosen) < min(k, len(ids)):
        worth = gain if not chosen else balance * gain - (1 - balance) * near
        at = int(np.argmax(np.where(left, worth, -np.inf)))
        chosen.append(at)
        left[at] = False
        near = np.maximum(near, unit @ unit[at])
    return [ids[i] for i in chosen]


def mmr_select(df: DataFrame, group: str, item: str, relevance: str, vector: str, k: int, balance: float = 0.72) -> DataFrame:
    """group, item, place: the diversified top k of each group's shortlist. Items without a vector come last, by relevance."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([relevance, item], ascending=[False, True], kind="stable")
        has = pdf[vector].notna()
        pool = pdf[has]
        picked = diversified(pool[item].tolist(), pool[relevance].to_numpy(float), np.stack(pool[vector].to_numpy()).astype(float), k, balance) if len(pool) else []
        picked = (picked + pdf[~has][item].tolist())[:k]
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(picked), item: picked, "place": range(1, len(picked) + 1)})

    return per_group(df.select(group, item, relevance, vector), group, run, f"{group} {kinds[group]}, {item} {kinds[item]}, place int")
