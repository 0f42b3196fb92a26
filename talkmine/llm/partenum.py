"""PartEnum signatures: similar sets of about equal size share at least one.

Sets of 64-bit features with 100 * |A & B| >= t * |A | B| differ in at most
``(|A| + |B|) * (100 - t) / (100 + t)`` features. Sizes are cut into bands; within a band the
bound is ``k``. The feature domain is cut into ``groups`` first-level parts, each into ``parts``
second-level parts. With ``ceil((k + 1) / (damage + 1)) + spare`` groups at least ``spare + 1``
of them hold at most ``damage`` differences, so in each of these some ``parts - damage`` parts
agree, and their hash is a signature that both sets have.

Signatures of few features are shared by chance. As at least ``spare + 1`` signatures agree,
and both sets order them alike by what they hold, each may leave out its ``spare`` lightest ones
without losing a pair. A set with more than ``spare`` empty signatures adds those of another
cut of the domain, since a pair could then agree in empty ones alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np

from talkmine.llm.text import mix

_U64 = np.uint64


@dataclass(frozen=True)
class Scheme:
    """``parts`` per group of which ``damage`` may differ; ``spare`` is a share of the bound."""

    percent: int = 80
    parts: int = 3
    damage: int = 1
    spare: float = 0.125
    seed: int = 0

    @property
    def subsets(self) -> np.ndarray:
        return np.array(list(combinations(range(self.parts), self.parts - self.damage)))


def band_top(n: int, percent: int) -> int:
    """Largest size in the band of ``n``; bands grow by the largest ratio of two similar sets."""
    top = 1
    while top < n:
        top = max(top + 1, top * 100 // percent)
    return top


def band_tops(n: int, percent: int) -> list[int]:
    """Tops of the bands in which a set of ``n`` features can meet one at least as large."""
    tops, most = [band_top(n, percent)], n * 100 // percent
    while tops[-1] < most:
        tops.append(max(tops[-1] + 1, tops[-1] * 100 // percent))
    return tops


def signatures(features: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Signatures of one set of ascending distinct features. Equal sets are not its matter: bands
    in which only these are similar give none."""
    out, running = [], _running(features)
    for top in _tops(len(features), scheme.percent) if len(features) else []:
        k = 2 * top * (100 - scheme.percent) // (100 + scheme.percent)
        if k:
            out.extend(_of_band(features, running, top, k, scheme))
    return np.concatenate(out) if out else np.zeros(0, _U64)


_tops = lru_cache(1 << 12)(band_tops)


def _running(features: np.ndarray) -> np.ndarray:
    """Sums of the mixed features before each place."""
    out = np.zeros(len(features) + 1, dtype=_U64)
    np.cumsum(mix(features), out=out[1:])
    return out


@lru_cache(64)
def _names(top: int, cut: int, n: int, seed: int) -> np.ndarray:
    """What tells the ``n`` signatures of a band and a cut apart."""
    return mix(np.arange(n, dtype=_U64) + _U64((top << 24) + (cut << 58) + (seed << 52)))


def _of_band(features: np.ndarray, running: np.ndarray, top: int, k: int, scheme: Scheme) -> list[np.ndarray]:
    spare = 1 + int(k * scheme.spare)
    groups = -(-(k + 1) // (scheme.damage + 1)) + spare
    out, subsets = [], scheme.subsets
    for cut in range(64):
        x = features
        if cut or scheme.seed:
            x = np.sort(mix(x + _U64(1000 * scheme.seed + cut)))
            running = _running(x)
        cells = groups * scheme.parts
        place = ((x >> _U64(32)) * _U64(cells) >> _U64(32)).astype(np.int64)
        upto = np.searchsorted(place, np.arange(cells + 1))
        held = (upto[1:] - upto[:-1]).reshape(groups, scheme.parts)
        sums = mix(running[upto[1:]] - running[upto[:-1]] + np.arange(cells, dtype=_U64)).reshape(groups, -1)
        if subsets.shape[1] > 1:
            held, sums = held[:, subsets].sum(axis=2), sums[:, subsets].sum(axis=2, dtype=_U64)
        weight = held.ravel()
        value = mix(sums.ravel() + _names(top, cut, len(weight), scheme.seed))
        empty = int((weight == 0).sum())
        if empty < spare:
            order = np.argpartition((weight.astype(_U64) << _U64(40)) | (value >> _U64(24)), spare - 1)
            out.append(value[order[spare:]])
        else:
            out.append(value[weight > 0])
        if empty <= spare:
            break
    return out
