"""Graphs of hits and sequences, and their clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .records import first_rows


def proximity_edges(points: DataFrame, group: str, id_col: str, x: str, y: str, radius: str) -> DataFrame:
    """Pairs of a group within its ``radius`` (Euclidean, inclusive).

    Both coordinates are cut into cells of the group's radius; a point meets
    only those of the 3 x 3 cells around it, by an equi-join. Groups of
    unknown or no radius give nothing.
    """
    p = points.where(F.col(radius) > 0).select(group, F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(radius).cast("double").alias("r"))
    p = p.withColumns({"cx": F.floor(F.col("x") / F.col("r")), "cy": F.floor(F.col("y") / F.col("r"))})
    around = p.select("*", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("ax")).select("*", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)).alias("ay"))
    a, b = around.alias("a"), p.alias("b")
    met = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.ax") == F.col("b.cx")) & (F.col("a.ay") == F.col("b.cy")))
    near = F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2) <= F.pow(F.col("a.r"), 2)
    return met.where((F.col("a.id") < F.col("b.id")) & near).select(F.col(f"a.{group}").alias(group), F.col("a.id").alias("i"), F.col("b.id").alias("j"))


def sequence_edges(dist: DataFrame, limit: float = 0.3) -> DataFrame:
    """Edges of close sequences. Equal sequences (distance 0) count as far, as
    in the reference behaviour."""
    return dist.where((F.col("p_distance") > 0) & (F.col("p_distance") <= limit))


def markov_clusters(n: int, edges: list[tuple[int, int]], expansion: int = 2, inflation: float = 2.0, prune: float = 0.001, rounds: int = 100) -> list[int]:
    """Markov clustering of an undirected graph: cluster number of each node.

    Self loops, column-normalised; expand, inflate, prune, until nothing moves.
    Nodes are numbered by their cluster's first attractor; a node with several
    takes the first.
    """
    m = np.eye(n)
    for i, j in edges:
        m[i, j] = m[j, i] = 1.0
    m /= m.sum(axis=0)
    for _ in range(rounds):
        last = m
        m = np.linalg.matrix_power(m, expansion) ** inflation
        m /= m.sum(axis=0)
        keep = m >= prune
        keep[m.argmax(axis=0), np.arange(n)] = True
        m = np.where(keep, m, 0)
        m /= m.sum(axis=0)
        if np.allclose(m, last, rtol=1e-5, atol=1e-8):
            break
    label: dict[int, int] = {}
    out = []
    attractors = np.flatnonzero(m.diagonal() > 0)
    home = {int(a): int(np.flatnonzero(m[a] > 0)[0]) for a in attractors}
    for j in range(n):
        rows = [int(a) for a in attractors if m[a, j] > 0]
        key = home[rows[0]] if rows else j
        out.append(label.setdefault(key, len(label)))
    return out


def graph_clusters(nodes: DataFrame, edges: DataFrame, group: str, id_col: str, most: int = 1000) -> DataFrame:
    """(group, id, cluster): Markov clusters of each group's graph.

    Groups are those of the sampling step before, of at most ``most`` nodes; a
    larger one is refused rather than cut.
    """

    def one(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(nodes["id"].unique())
        if len(ids) > most:
            raise ValueError(f"a group has {len(ids)} nodes; sample it to {most} first")
        at = {v: k for k, v in enumerate(ids)}
        links = [(at[a], at[b]) for a, b in zip(edges["i"], edges["j"]) if a in at and b in at]
        return pd.DataFrame({"g": nodes["g"].iloc[0] if len(nodes) else None, "id": ids, "cluster": markov_clusters(len(ids), links)})

    n = nodes.select(F.col(group).alias("g"), F.col(id_col).alias("id"))
    e = edges.select(F.col(group).alias("g"), "i", "j")
    kinds = {f.name: f.dataType.simpleString() for f in n.schema}
    out = n.groupBy("g").cogroup(e.groupBy("g")).applyInPandas(one, f"g {kinds['g']}, id {kinds['id']}, cluster int")
    return out.withColumnsRenamed({"g": group, "id": id_col})


def average_linkage(dist: np.ndarray, k: int) -> list[int]:
    """Agglomerative clusters by mean distance."""
    n = len(dist)
    members = [[i] for i in range(n)]
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive = list(range(n))
    while len(alive) > k:
        sub = d[np.ix_(alive, alive)]
        i, j = divmod(int(sub.argmin()), len(alive))
        a, b = sorted((alive[i], alive[j]))
        na, nb = len(members[a]), len(members[b])
        d[a] = (d[a] * na + d[b] * nb) / (na + nb)
        d[:, a] = d[a]
        d[a, a] = np.inf
        members[a] += members[b]
        alive.remove(b)
    out = [0] * n
    for c, a in enumerate(sorted(alive, key=lambda a: min(members[a]))):
        for i in members[a]:
            out[i] = c
    return out


def silhouette(dist: np.ndarray, labels: list[int]) -> float:
    lab = np.array(labels)
    if len(set(labels)) < 2:
        return -1.0
    total = 0.0
    for i in range(len(lab)):
        own = (lab == lab[i]) & (np.arange(len(lab)) != i)
        if not own.any():
            continue
        a = dist[i, own].mean()
        b = min(dist[i, lab == c].mean() for c in set(labels) if c != lab[i])
        total += (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return total / len(lab)


def distance_clusters(dist: np.ndarray, most: int | None = None, patience: int = 3) -> list[int]:
    """Average linkage with the best silhouette over k = 2, 3, ...; stops after
    ``patience`` steps without gain, or once the last row (the consensus) is alone."""
    n = len(dist)
    if n < 3:
        return [0] * n
    best, score, idle = [0] * n, -1.0, 0
    for k in range(2, min(most or n - 1, n - 1) + 1):
        labels = average_linkage(dist, k)
        if labels.count(labels[-1]) == 1:
            break
        s = silhouette(dist, labels)
        if s > score:
            best, score, idle = labels, s, 0
        else:
            idle += 1
            if idle >= patience:
                break
    return best


def best_of_clusters(hits: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Best hit of each cluster: longest alignment, then lowest score, then id."""
    x = hits.join(clusters, keys)
    return first_rows(x, [keys[0], "cluster"], [-F.col("sum_hits_alignlen"), F.col("sum_hits_score"), F.col(keys[-1])])
