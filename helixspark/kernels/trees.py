"""Phylogenetic trees of small distance matrices, and their Newick texts."""

from __future__ import annotations

import re

import numpy as np


def _square(matrix) -> np.ndarray:
    """Symmetric with a zero diagonal; unknown distances count as the largest known."""
    d = np.array(matrix, dtype=float)
    top = np.nanmax(d) if d.size and not np.isnan(d).all() else 0.0
    d = np.where(np.isnan(d), top, d)
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0.0)
    return d


def upgma(matrix, names: list[str]) -> list[tuple[str, str, float, float, str]]:
    """PHY-01: Merges ``(left, right, height, size, node)`` by average linkage; the least distance first, ties by position."""
    d, labels, sizes = _square(matrix), list(names), [1.0] * len(names)
    out = []
    while len(labels) > 1:
        upper = np.where(np.triu(np.ones_like(d, dtype=bool), 1), d, np.inf)
        i, j = divmod(int(np.argmin(upper)), len(labels))
        height, node, size = d[i, j] / 2, f"U{len(out) + 1}", sizes[i] + sizes[j]
        out.append((labels[i], labels[j], float(height), size, node))
        row = (d[i] * sizes[i] + d[j] * sizes[j]) / size
        d[i], d[:, i] = row, row
        d[i, i] = 0.0
        labels[i], sizes[i] = node, size
        keep = [k for k in range(len(labels)) if k != j]
        d, labels, sizes = d[np.ix_(keep, keep)], [labels[k] for k in keep], [sizes[k] for k in keep]
    return out


def neighbour_joining(matrix, names: list[str]) -> list[tuple[str, str, float]]:
    """PHY-02: Edges ``(parent, child, branch)``, branches to 4 places; the last node is the root."""
    d, labels = _square(matrix), list(names)
    edges: list[tuple[str, str, float]] = []
    while len(labels) > 2:
        n = len(labels)
        total = d.sum(axis=1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        q = np.where(np.triu(np.ones_like(q, dtype=bool), 1), q, np.inf)
        i, j = divmod(int(np.argmin(q)), n)
        a = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        node = f"N{len(edges) // 2 + 1}"
        edges += [(node, labels[i], round(float(a), 4)), (node, labels[j], round(float(d[i, j] - a), 4))]
        row = (d[i] + d[j] - d[i, j]) / 2
        d[i], d[:, i] = row, row
        d[i, i] = 0.0
        labels[i] = node
        keep = [k for k in range(n) if k != j]
        d, labels = d[np.ix_(keep, keep)], [labels[k] for k in keep]
    if len(labels) == 2:
        edges.append((labels[0], labels[1], round(float(d[0, 1]), 4)) if labels[0].startswith("N") or not labels[1].startswith("N") else (labels[1], labels[0], round(float(d[0, 1]), 4)))
    return edges


def _clean(name: str) -> str:
    return re.sub(r"[\s():;,]", "_", name)


def upgma_edges(merges: list[tuple[str, str, float, float, str]]) -> list[tuple[str, str, float]]:
    """A branch is the height of the parent less that of the child."""
    height = {node: h for _, _, h, _, node in merges}
    return [(node, child, h - height.get(child, 0.0)) for left, right, h, _, node in merges for child in (left, right)]


def newick(edges: list[tuple[str, str, float]]) -> str:
    """PHY-03: Newick text of a tree given by its edges; the node that is no child is the root."""
    if not edges:
        return ";"
    below: dict[str, list[tuple[str, float]]] = {}
    for parent, child, branch in edges:
        below.setdefault(parent, []).append((child, branch))
    children = {c for _, c, _ in edges}
    root = next(p for p, _, _ in reversed(edges) if p not in children)
    text: dict[str, str] = {}
    stack = [(root, False)]
    while stack:
        node, seen = stack.pop()
        if node not in below:
            text[node] = _clean(node)
        elif seen:
            text[node] = "(" + ",".join(f"{text[c]}:{round(b, 6):g}" for c, b in below[node]) + ")" + _clean(node)
        else:
            stack.append((node, True))
            stack += [(c, False) for c, _ in below[node]]
    return text[root] + ";"


def parse_newick(text: str) -> list[tuple[str, str, float]]:
    """PHY-04: Edges of a Newick text; unnamed inner nodes are called ``Node_`` and a number."""
    tokens = re.findall(r"[(),;]|:[^(),;:]+|[^(),;:]+", text.strip())
    edges: list[tuple[str, str, float]] = []
    groups: list[list[tuple[str, float]]] = [[]]
    name, branch, closed, n = "", 0.0, None, 0

    def finish() -> None:
        nonlocal name, branch, closed, n
        if closed is not None and not name:
            name, n = f"Node_{n}", n + 1
        if name:
            groups[-1].append((name, branch))
            edges.extend((name, c, b) for c, b in closed or [])
        name, branch, closed = "", 0.0, None

    for t in tokens:
        if t == "(":
            groups.append([])
        elif t in ",;":
            finish()
        elif t == ")":
            finish()
            closed = groups.pop()
        elif t[0] == ":":
            branch = float(t[1:])
        else:
            name = t.strip()
    finish()
    return edges
