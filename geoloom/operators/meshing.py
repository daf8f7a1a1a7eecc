"""Triangles from rings and grids."""

from __future__ import annotations

import numpy as np


def ears(ring) -> np.ndarray:
    """Triangles (places of corners) of a simple ring, by cutting off ears; counter-clockwise."""
    p = np.asarray(ring, float)[:, :2]
    left = list(range(len(p)))
    if len(p) > 1 and (p[0] == p[-1]).all():
        left.pop()
    x, y = p[left, 0], p[left, 1]
    if float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) < 0:
        left.reverse()
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    out = []
    while len(left) > 3:
        for k in range(len(left)):
            i, j, n = left[k - 1], left[k], left[(k + 1) % len(left)]
            turn = side(p[i], p[j], p[n])
            if turn < 0:
                continue
            if turn > 0 and any(min(side(p[i], p[j], p[m]), side(p[j], p[n], p[m]), side(p[n], p[i], p[m])) >= 0 for m in left if m not in (i, j, n) and not any((p[m] == p[q]).all() for q in (i, j, n))):
                continue
            if turn > 0:
                out.append((i, j, n))
            left.pop(k)
            break
        else:
            break  # a ring that crosses itself has no further ear
    if len(left) == 3 and side(*p[left]) != 0:
        out.append(tuple(left))
    return np.array(out, np.int64).reshape(-1, 3)


def prism(profile, direction, depth: float) -> np.ndarray:
    """(3 n, 3) corners of the triangles of an extruded ring."""
    base = np.asarray(profile, float)[:, :2]
    if float((base[:, 0] * np.roll(base[:, 1], -1) - base[:, 1] * np.roll(base[:, 0], -1)).sum()) < 0:
        base = base[::-1]
    d = np.asarray(direction, float)
    d = d / max(float(np.linalg.norm(d)), 1e-12) * depth
    low = np.column_stack([base, np.zeros(len(base))])
    high, t = low + d, ears(base)
    out = [low[t[:, ::-1]].reshape(-1, 3), high[t].reshape(-1, 3)]
    for a, b in zip(range(len(base)), [*range(1, len(base)), 0]):
        out.append(np.array([low[a], low[b], high[b], low[a], high[b], high[a]]))
    return np.concatenate(out)


def grid_triangles(width: int, height: int) -> np.ndarray:
    """Two triangles a cell of a grid in rows."""
    r, c = np.meshgrid(np.arange(height - 1), np.arange(width - 1), indexing="ij")
    a = (r * width + c).ravel()
    return np.stack([a, a + width, a + 1, a + 1, a + width, a + width + 1], axis=1).reshape(-1, 3)
