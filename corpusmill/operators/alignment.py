"""Fitted topics matched with known groups of words, one to one.

A model numbers its topics as they come, so a known grouping (planted words, or the
topics of an earlier model) is compared through the match with the largest shared weight.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def shared_weight(phi: DataFrame, groups: DataFrame) -> DataFrame:
    """(topic_id, group_id, weight): weight of a group's words in a topic; `groups` has (term, group_id).

    At most topics x groups rows; the words are combined on the map side.
    """
    return phi.join(groups, "term").groupBy("topic_id", "group_id").agg(F.sum("weight").alias("weight"))


def best_match(weight: np.ndarray) -> list[int]:
    """Column of each row in the one-to-one match with the largest sum; needs as many columns as rows or more.

    Rows are added one by one along the cheapest alternating path.
    """
    cost = weight.max(initial=0.0) - weight
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for row in range(n):
        distance, back, done = cost[row] - row_price[row] - column_price, np.full(m, -1), np.zeros(m, dtype=bool)
        while True:
            column = int(np.argmin(np.where(done, np.inf, distance)))
            done[column], low = True, distance[column]
            if row_of[column] < 0:
                break
            via = row_of[column]
            through = low + cost[via] - row_price[via] - column_price
            shorter = ~done & (through < distance)
            distance[shorter], back[shorter] = through[shorter], column
        settled = np.flatnonzero(done)
        for c in settled:
            if row_of[c] >= 0:
                row_price[row_of[c]] += low - distance[c]
            column_price[c] -= low - distance[c]
        row_price[row] += low
        while back[column] >= 0:
            row_of[column] = row_of[back[column]]
            column = int(back[column])
        row_of[column] = row
    out = [-1] * n
    for column, row in enumerate(row_of):
        if row >= 0:
            out[row] = column
    return out


def align(phi: DataFrame, groups: DataFrame) -> dict[int, int]:
    """Group of each topic; topics beyond the number of groups have none."""
    rows = shared_weight(phi, groups).collect()
    topics, names = sorted({r["topic_id"] for r in rows}), sorted({r["group_id"] for r in rows})
    weight = np.zeros((len(topics), max(len(names), len(topics))))
    for r in rows:
        weight[topics.index(r["topic_id"]), names.index(r["group_id"])] = r["weight"]
    match = best_match(weight)
    return {t: names[c] for t, c in zip(topics, match) if c < len(names)}


def renamed(topic: Column, groups: dict[int, int]) -> Column:
    """The group of a topic number, as an expression."""
    of = [groups.get(t) for t in range(max(groups, default=-1) + 1)]
    return F.get(F.array(*[F.lit(g).cast("int") for g in of]), topic.cast("int"))
