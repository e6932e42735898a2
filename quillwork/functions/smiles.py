"""Molecular graphs from line notation, without a chemistry toolkit.

``parse`` reads atoms and bonds, ``ring_core`` prunes side chains, and ``skeleton_key``
names what is left independently of how the text was written. Bond orders, charges,
hydrogens, isotopes and stereo marks play no part.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the notation: a bracket atom, an organic-subset atom, a ring label, a branch, a bond or a separator.
_TOKEN = re.compile(r"\[(?P<iso>\d*)(?P<sym>[A-Za-z][a-z]?|\*)[^\]]*\]|(?P<org>Cl|Br|[BCNOPSFIbcnops*])|(?P<ring>%\(\d+\)|%\d\d|\d)|(?P<open>\()|(?P<close>\))|(?P<dot>\.)|(?P<bond>[-=#$:/\\~])")
#: Two-letter symbols that a bracket may hold in lower case for aromatic atoms.
_AROMATIC_PAIRS = ("se", "as", "te")


def parse(text: str) -> tuple[list[str], list[list[int]]] | None:
    """Element symbols and neighbour lists; None if the text cannot be read as one structure line."""
    atoms: list[str] = []
    near: list[list[int]] = []
    stack: list[int] = []
    rings: dict[str, int] = {}
    prev, at, end = -1, 0, len(text)
    while at < end:
        m = _TOKEN.match(text, at)
        if m is None:
            return None
        at = m.end()
        kind = m.lastgroup
        if kind in ("sym", "org"):
            s = m[kind]
            if len(s) == 2 and s[0].islower() and s not in _AROMATIC_PAIRS:
                s = s[0]  # aromatic atom with a hydrogen count, as in [nH]
            atoms.append(s.capitalize())
            near.append([])
            if prev >= 0:
                near[prev].append(len(atoms) - 1)
                near[-1].append(prev)
            prev = len(atoms) - 1
        elif kind == "ring":
            label = m["ring"].strip("%()")
            if prev < 0:
                return None
            if label in rings:
                other = rings.pop(label)
                if other != prev and other not in near[prev]:
                    near[prev].append(other)
                    near[other].append(prev)
            else:
                rings[label] = prev
        elif kind == "open":
            if prev < 0:
                return None
            stack.append(prev)
        elif kind == "close":
            if not stack:
                return None
            prev = stack.pop()
        elif kind == "dot":
            prev = -1
    if stack or rings or not atoms:
        return None
    return atoms, near


def ring_core(near: list[list[int]]) -> list[int]:
    """Atoms left when those with at most one neighbour are removed again and again: rings and what joins them."""
    degree = [len(n) for n in near]
    queue = [i for i, d in enumerate(degree) if d <= 1]
    gone = bytearray(len(near))
    while queue:
        i = queue.pop()
        if gone[i]:
            continue
        gone[i] = 1
        for j in near[i]:
            if not gone[j]:
                degree[j] -= 1
                if degree[j] <= 1:
                    queue.append(j)
    return [i for i in range(len(near)) if not gone[i]]


#: Keys of cores that a worker remembers, at most; many structures differ in side chains only.
REMEMBERED = 200_000
_remembered: dict[tuple, str] = {}


def skeleton_key(text: str | None) -> str | None:
    """A key equal for structures with the same rings and joining chains; None without rings or if unreadable."""
    if not text:
        return None
    graph = parse(text.strip())
    if graph is None:
        return None
    atoms, near = graph
    core = ring_core(near)
    if not core:
        return None
    index = {a: k for k, a in enumerate(core)}
    inside = (tuple([atoms[a] for a in core]), tuple([tuple([index[j] for j in near[a] if j in index]) for a in core]))
    key = _remembered.get(inside)
    if key is None:
        if len(_remembered) >= REMEMBERED:
            _remembered.clear()
        key = _remembered[inside] = core_key(*inside)
    return key


def core_key(elements: tuple[str, ...], adj: tuple[tuple[int, ...], ...]) -> str:
    """The key of a graph of atoms, equal however they are numbered.

    Atoms are told apart by element and degree, by how many atoms of each such kind lie at
    every distance, and by their neighbours' labels, refined until nothing splits. Atom sets
    are bit masks: the ball around an atom grows to the union of its neighbours' balls.
    """
    n = len(elements)
    kind = [(e, len(a)) for e, a in zip(elements, adj)]
    kinds = sorted(set(kind))
    masks = [sum(1 << i for i in range(n) if kind[i] == k) for k in kinds]
    ball = [1 << i for i in range(n)]
    profile: list[list] = [[kinds.index(k)] for k in kind]
    while True:
        wider = []
        for i, a in enumerate(adj):
            b = ball[i]
            for j in a:
                b |= ball[j]
            wider.append(b)
        if wider == ball:
            break
        for i, b in enumerate(wider):
            shell = b & ~ball[i]
            if shell:
                profile[i] += [(shell & m).bit_count() for m in masks]
        ball = wider
    seen = [tuple(p) for p in profile]
    counts: dict[tuple, int] = {}
    for p in seen:
        counts[p] = counts.get(p, 0) + 1
    order = {p: k for k, p in enumerate(sorted(counts))}
    label, trail = [order[p] for p in seen], [repr(kinds), repr(sorted(counts.items()))]
    while True:
        signature = [(label[i], *sorted([label[j] for j in a])) for i, a in enumerate(adj)]
        counts = {}
        for s in signature:
            counts[s] = counts.get(s, 0) + 1
        found = {s: k for k, s in enumerate(sorted(counts))}
        trail.append(repr(sorted(counts.items())))
        done = len(found) == len(order)
        label, order = [found[s] for s in signature], found
        if done:
            break
    return hashlib.sha256("\n".join(trail).encode()).hexdigest()[:32]


def scaffold_key(text: str | None) -> str | None:
    """As ``skeleton_key`` with ``acyclic`` for readable structures without rings."""
    key = skeleton_key(text)
    if key is None and text and parse(text.strip()) is not None:
        return "acyclic"
    return key


@F.pandas_udf(T.StringType())
def skeleton(s: pd.Series) -> pd.Series:
    """Column form of ``skeleton_key``."""
    return s.map(skeleton_key, na_action="ignore").astype(object)


@F.pandas_udf(T.StringType())
def scaffold(s: pd.Series) -> pd.Series:
    """Column form of ``scaffold_key``."""
    return s.map(scaffold_key, na_action="ignore").astype(object)


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("n_atoms", "n_bonds", "n_ring_core", "n_fragments")]))
def graph_counts(s: pd.Series) -> pd.DataFrame:
    """Atoms, bonds, atoms of the ring core and fragments of a structure; all NULL if unreadable."""
    out = []
    for text in s:
        g = parse(text.strip()) if isinstance(text, str) and text.strip() else None
        if g is None:
            out.append((None, None, None, None))
            continue
        atoms, near = g
        bonds = sum(map(len, near)) // 2
        seen, parts = [False] * len(atoms), 0
        for i in range(len(atoms)):
            if not seen[i]:
                parts += 1
                todo = [i]
                seen[i] = True
                while todo:
                    for j in near[todo.pop()]:
                        if not seen[j]:
                            seen[j] = True
                            todo.append(j)
        out.append((len(atoms), bonds, len(ring_core(near)), parts))
    return pd.DataFrame(out, columns=["n_atoms", "n_bonds", "n_ring_core", "n_fragments"]).astype("Int32")


def circular_bits(text: str | None, radius: int = 2, width: int = 2048) -> list[int] | None:
    """On-bits of a circular fingerprint: a hash of every atom's surroundings up to ``radius`` bonds, folded to ``width``.

    An atom starts as its element, degree and place in the ring core; each step hashes it with
    its sorted neighbours. Equal however the text is written; None if unreadable.
    """
    graph = parse(text.strip()) if text and text.strip() else None
    if graph is None:
        return None
    atoms, near = graph
    core = set(ring_core(near))
    label = [f"{a}{len(near[i])}{int(i in core)}" for i, a in enumerate(atoms)]
    seen = set(label)
    for _ in range(radius):
        label = [hashlib.md5("|".join([label[i], *sorted(label[j] for j in near[i])]).encode()).hexdigest() for i in range(len(atoms))]
        seen.update(label)
    return sorted({int.from_bytes(hashlib.md5(x.encode()).digest()[:4], "little") % width for x in seen})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def circular_fingerprint(s: pd.Series) -> pd.Series:
    """Column form of ``circular_bits`` with radius 2 and 2,048 bits."""
    return s.map(circular_bits, na_action="ignore").astype(object)


PROPERTIES = ("n_heavy", "n_rings", "n_hetero", "n_halogen", "n_chain_bonds", "n_branch_atoms", "ring_share")


def properties_of(text: str | None) -> tuple | None:
    """Heavy atoms, independent rings, hetero and halogen atoms, bonds outside the ring core, atoms with three neighbours or more, and the ring core's share of atoms; None if unreadable."""
    graph = parse(text.strip()) if text and text.strip() else None
    if graph is None:
        return None
    atoms, near = graph
    core = set(ring_core(near))
    bonds = sum(map(len, near)) // 2
    inside = sum(j in core for i in core for j in near[i]) // 2
    parts, seen = 0, set()
    for i in range(len(atoms)):
        if i not in seen:
            parts += 1
            todo = [i]
            seen.add(i)
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
    return (len(atoms), bonds - len(atoms) + parts, sum(a not in ("C", "H") for a in atoms), sum(a in ("F", "Cl", "Br", "I") for a in atoms), bonds - inside, sum(len(n) >= 3 for n in near), len(core) / len(atoms))


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType() if n == "ring_share" else T.IntegerType()) for n in PROPERTIES]))
def properties(s: pd.Series) -> pd.DataFrame:
    """Column form of ``properties_of``; all NULL if unreadable."""
    rows = [(properties_of(x) if isinstance(x, str) else None) or (None,) * len(PROPERTIES) for x in s]
    return pd.DataFrame(rows, columns=list(PROPERTIES)).astype({n: "float64" if n == "ring_share" else "Int32" for n in PROPERTIES})


def main_fragment(text: str | None) -> str | None:
    """The part between dots with most atoms, the first on ties; a part that cannot be read has none. None if no part can be read."""
    best, most = None, 0
    for part in (text or "").strip().split("."):
        graph = parse(part)
        if graph is not None and len(graph[0]) > most:
            best, most = part, len(graph[0])
    return best


@F.pandas_udf(T.StringType())
def largest_fragment(s: pd.Series) -> pd.Series:
    """Column form of ``main_fragment``."""
    return s.map(main_fragment, na_action="ignore").astype(object)
