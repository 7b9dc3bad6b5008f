"""Communities by the Leiden method (Traag et al., 2019) or greedy moves, component by component.

Modularity couples components only through the total weight, so each component is a group of its own. Groups come to
Python one after the other in the batches of a sorted partition, many to a batch, and are solved one at a time; a single component has to fit a task, which is the limit of this operator. Results do
not depend on partitioning: nodes are visited in sorted order, and a community is named by its smallest node.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.storage import Workspace

from .components import connected_components


def _move(adjacency: list[dict[int, float]], degree: list[float], label: list[int], total: float, within: list[int] | None = None) -> bool:
    """Move nodes to the neighbouring community with the best gain until none gains; within: moves stay inside it."""
    weight = {}
    for v, c in enumerate(label):
        weight[c] = weight.get(c, 0.0) + degree[v]
    queue, moved = list(range(len(adjacency))), False
    while queue:
        again: set[int] = set()
        for v in queue:
            links: dict[int, float] = {}
            for u, w in adjacency[v].items():
                if u != v and (within is None or within[u] == within[v]):
                    links[label[u]] = links.get(label[u], 0.0) + w
            own = label[v]
            weight[own] -= degree[v]
            best, gain = own, links.get(own, 0.0) - degree[v] * weight[own] / total
            for c in sorted(links):
                g = links[c] - degree[v] * weight[c] / total
                if g > gain + 1e-12:
                    best, gain = c, g
            weight[best] = weight.get(best, 0.0) + degree[v]
            if best != own:
                label[v], moved = best, True
                again |= {u for u in adjacency[v] if label[u] != best}
        queue = sorted(again)
    return moved


def partition(edges: Iterable[tuple[str, str, float]], total: float, method: str = "leiden") -> dict[str, str]:
    """node -> smallest node of its community. total: twice the weight of the whole graph."""
    edges = list(edges)
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    at = {x: i for i, x in enumerate(names)}
    adjacency: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in edges:
        adjacency[at[a]][at[b]] = adjacency[at[a]].get(at[b], 0.0) + w
        adjacency[at[b]][at[a]] = adjacency[at[b]].get(at[a], 0.0) + w
    degree = [sum(x.values()) for x in adjacency]
    groups = [[i] for i in range(len(names))]
    label = list(range(len(names)))
    while _move(adjacency, degree, label, total):
        refined = list(range(len(label)))
        if method == "leiden":
            _move(adjacency, degree, refined, total, within=label)
        else:
            refined = label
        order = {c: i for i, c in enumerate(sorted(set(refined)))}
        merged: list[dict[int, float]] = [{} for _ in order]
        members: list[list[int]] = [[] for _ in order]
        outer = [0] * len(order)
        for v, c in enumerate(refined):
            n = order[c]
            members[n] += groups[v]
            outer[n] = label[v]
            for u, w in adjacency[v].items():
                merged[n][order[refined[u]]] = merged[n].get(order[refined[u]], 0.0) + w
        if len(order) == len(label):
            break
        degree = [sum(degree[v] for v, c in enumerate(refined) if order[c] == n) for n in range(len(order))] if len(order) < 64 else _sum_by(degree, refined, order)
        first: dict[int, int] = {}
        label = [first.setdefault(c, n) for n, c in enumerate(outer)]
        adjacency, groups = merged, members
    final: dict[int, list[int]] = {}
    for n, c in enumerate(label):
        final.setdefault(c, []).extend(groups[n])
    return {names[v]: names[min(g)] for g in final.values() for v in g}


def _sum_by(values: list[float], keys: list[int], order: dict[int, int]) -> list[float]:
    out = [0.0] * len(order)
    for v, c in zip(values, keys, strict=True):
        out[order[c]] += v
    return out


def communities(edges: DataFrame, work: Workspace, method: str = "leiden") -> DataFrame:
    """(node, community): community is the smallest node of it. edges: (src, dst, weight). Nodes without edges are not
    returned; an empty table gives no rows."""
    total = 2 * (edges.agg(F.sum("weight").alias("m")).first()["m"] or 0.0)
    component = connected_components(edges, work, "src", "dst")
    grouped = edges.join(component.withColumnRenamed("node", "src"), "src").select("component", "src", "dst", "weight")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            found: dict[str, str] = {}
            for name, *edge in zip(*(batch.column(c).to_pylist() for c in ("component", "src", "dst", "weight")), strict=True):
                if name != now:
                    found |= partition(held, total, method)
                    now, held = name, []
                held.append(edge)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.string())], ["node", "community"])
        found = partition(held, total, method)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.string())], ["node", "community"])

    return grouped.repartition("component").sortWithinPartitions("component").mapInArrow(solve, "node string, community string")
