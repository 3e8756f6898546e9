"""Betti numbers of small grids by brute force: floods cell by cell, and sets of all corners, edges, faces and cells."""

from __future__ import annotations

import itertools

STEPS = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]


def pieces(cells: set, steps: list) -> list[set]:
    """The connected pieces of a set of cells."""
    left, found = set(cells), []
    while left:
        piece, front = set(), [left.pop()]
        while front:
            cell = front.pop()
            piece.add(cell)
            near = {tuple(a + b for a, b in zip(cell, o, strict=True)) for o in steps} & left
            left -= near
            front.extend(near)
        found.append(piece)
    return found


def holes(cells: set) -> list[set]:
    """Pieces of background that don't reach the outside."""
    box = set(itertools.product(*[range(min(axis) - 1, max(axis) + 2) for axis in zip(*cells, strict=True)]))
    corner = min(box)
    return [p for p in pieces(box - cells, [o for o in STEPS if sum(map(abs, o)) == 1]) if corner not in p]


def betti(cells) -> tuple[int, int, int]:
    """b0, b1 and b2 of the union of closed unit cubes."""
    cells = {tuple(map(int, c)) for c in cells}
    if not cells:
        return 0, 0, 0
    b0, b2 = len(pieces(cells, STEPS)), len(holes(cells))
    parts = {tuple(2 * a + b for a, b in zip(c, o, strict=True)) for c in cells for o in [(0, 0, 0), *STEPS]}
    euler = sum((-1) ** sum(a % 2 == 0 for a in p) for p in parts)
    return b0, b0 + b2 - euler, b2
