"""Sampled SentencePiece segmentations without replacement, and decoding.

The pieces of a vocabulary span a lattice over a text; a segmentation is a path.
Its probability is the product of its pieces' weights, which follow Zipf's law
in the vocabulary's order, and sums to one over all paths.  The segmentations
with the largest log-probability plus Gumbel noise are a sample without
replacement.  They are found by a best-first search: a node stands for all
segmentations with a given beginning and bears the largest perturbed score among
them; to expand it draws the segmentation that has this score, and splits the
others by where they first differ from it.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from tidemark.llm.hashing import mix, portions, powers, release
from tidemark.llm.shared import ship

SPACE = "▁"
#: Paths remembered per unit.
BEST = 4
#: Units up to this length are taken together, by length.
SHORT = 48


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.room, self.size = np.zeros(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        while self.size + len(more) > len(self.room):
            self.room = np.r_[self.room, np.zeros_like(self.room)]
        self.room[self.size : self.size + len(more)] = more
        self.size += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.size]


def _substring_keys(total: np.ndarray, down: np.ndarray, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    return mix((total[begin + length] - total[begin]) * down[begin] + np.asarray(length).astype(np.uint64))


def _hashed(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, running sums of their hashes, and what scales these by place."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    up, down = powers(len(points) + 1)
    return points, np.r_[np.uint64(0), np.cumsum(mix(points.astype(np.uint64) + np.uint64(77)) * up[: len(points)])], down


@dataclass(frozen=True)
class Sampling:
    """samples: segmentations per text; alpha: exponent of the pieces' weights, larger is closer to the best path;
    remembered: paths that a task keeps; held: whether its worker holds them for its next task, or frees their memory for other stages;
    portion: code points handled together.  These three change memory and time but no result."""

    samples: int = 2
    alpha: float = 1.0
    seed: int = 11
    remembered: int = 600_000
    held: bool = False
    portion: int = 1 << 19


class Lattice:
    """Paths of the units of texts: stretches such that no piece reaches over their ends."""

    def __init__(self, path: str, alpha: float) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        raw = {i: -alpha * math.log(2 - model.get_score(i)) for i in normal}
        total = math.log(sum(map(math.exp, raw.values())))
        self.pieces = {model.id_to_piece(i): (i, raw[i] - total) for i in normal}
        self.byte_weight = min(w for _, w in self.pieces.values()) - 2
        self.longest = max(map(len, self.pieces))
        self.surface = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else b"" if i not in raw else p.encode() for i, p in ((i, model.id_to_piece(i)) for i in ids)]
        chars = sorted({c for p in self.pieces for c in p})
        self.index = np.zeros(0x110000, np.uint16)
        self.index[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)  # neighbours that stand together in a piece
        for p in self.pieces:
            at = self.index[[ord(c) for c in p]]
            self.joined[at[:-1], at[1:]] = True
        _, total, down = _hashed("".join(self.pieces))
        size = np.array([len(p) for p in self.pieces])
        keys = _substring_keys(total, down, np.cumsum(size) - size, size)
        order = np.argsort(keys)
        self.piece_keys, self.piece_ids = keys[order], np.array([i for i, _ in self.pieces.values()])[order]
        self.piece_weights = np.array([w for _, w in self.pieces.values()])[order]
        self.maybe = np.zeros(1 << 20, bool)  # by a key's upper bits: most substrings are no pieces
        self.maybe[self.piece_keys >> np.uint64(44)] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.key_types = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ways: dict[str, list[list[tuple[float, int, tuple[int, ...]]]]] = {}  # of units in this portion of texts
        self.first, self.upto, self.log, self.rest = _Grown(np.int64), _Grown(float), _Grown(float), _Grown(bool)
        self.ids, self.ends = _Grown(np.int32), _Grown(np.int64)  # ids of all paths one after the other, and where each path's end

    def path_ids(self, path: int) -> tuple[int, ...]:
        start = int(self.ends.all[path - 1]) if path else 0
        return tuple(self.ids.all[start : int(self.ends.all[path])].tolist())

    def text(self, unit: int) -> str:
        """A unit, put together from its best path."""
        return b"".join(self.surface[i] for i in self.path_ids(int(self.first.all[unit]))).decode("utf-8", "surrogatepass")

    def paths(self, unit: str, most: int) -> tuple[list[tuple[float, tuple[int, ...]]], bool]:
        """The best paths as (log-probability, ids), best first, and whether there are others."""
        n = len(unit)
        best: list[list[tuple[float, int, int, tuple[int, ...]]]] = [[(0.0, 0, 0, ())]] + [[] for _ in range(n)]
        total = [0.0] + [-math.inf] * n
        more = [False] * (n + 1)
        for end in range(1, n + 1):
            found, into = [], []
            for start in range(max(0, end - self.longest), end):
                if total[start] == -math.inf:
                    continue
                piece = self.pieces.get(unit[start:end])
                if piece:
                    ids, w = (piece[0],), piece[1]
                elif end - start == 1:
                    raw = unit[start].encode("utf-8", "surrogatepass")
                    ids, w = tuple(self.bytes[b] for b in raw), self.byte_weight * len(raw)
                else:
                    continue
                into.append(total[start] + w)
                more[end] |= more[start]
                found += [(b[0] + w, start, k, ids) for k, b in enumerate(best[start])]
            if into:
                top = max(into)
                total[end] = top + math.log(sum(math.exp(x - top) for x in into))
                found.sort(key=lambda x: (-x[0], x[3], x[1], x[2]))
                more[end] |= len(found) > most
                best[end] = found[:most]
        self.total = total
        out = []
        for lp, start, k, ids in best[n]:
            parts = [ids]
            while start:
                _, start, k, ids = best[start][k]
                parts.append(ids)
            out.append((lp - total[n], tuple(i for part in reversed(parts) for i in part)))
        return out, more[n]

    def forward(self, unit: str) -> list[list[tuple[float, int, tuple[int, ...]]]]:
        """For each place the last pieces of ways to it: weight by that of all ways, start, ids; and at the end the log of all ways' weight."""
        total, out = [0.0], [[]]
        for end in range(1, len(unit) + 1):
            into = []
            for start in range(max(0, end - self.longest), end):
                piece = self.pieces.get(unit[start:end])
                if piece:
                    into.append((total[start] + piece[1], start, (piece[0],)))
                elif end - start == 1:
                    raw = unit[start].encode("utf-8", "surrogatepass")
                    into.append((total[start] + self.byte_weight * len(raw), start, tuple(self.bytes[b] for b in raw)))
            top = max(into)[0]
            weights = [math.exp(x[0] - top) for x in into]
            every = sum(weights)
            total.append(top + math.log(every))
            out.append([(w / every, x[1], x[2]) for w, x in zip(weights, into, strict=True)])
        return out

    def other(self, unit: str, known: dict[tuple[int, ...], float], rng: np.random.Generator) -> tuple[float, tuple[int, ...]] | None:
        """A path that isn't known, by its probability among these; None if there is none.  ``known`` has log-probabilities.

        The path is drawn from its end: what known paths with the same pieces so
        far weigh is taken off the weight of each way on.
        """
        if unit not in self.ways:
            self.ways[unit] = self.forward(unit)
        ways = self.ways[unit]
        like = [(ids, len(ids), math.exp(lp)) for ids, lp in known.items()]
        end, parts, lp = len(unit), [], 0.0
        while end:
            now, options, total = math.exp(lp), [], 0.0
            for w, start, ids in ways[end]:
                same = [(k, n - len(ids), p) for k, n, p in like if k[max(0, n - len(ids)) : n] == ids and (start > 0) == (n > len(ids))]
                left = max(0.0, now * w - math.fsum(p for _, _, p in same)) if same else now * w
                total += left
                options.append((left, w, start, ids, same))
            if total <= 0:
                return None
            u = rng.random() * total
            for left, w, start, ids, same in options:  # noqa: B007
                u -= left
                if u < 0:
                    break
            parts.append(ids)
            lp += math.log(w)
            end, like = start, same
        return lp, tuple(i for part in reversed(parts) for i in part)

    def learn(self, logs: np.ndarray, more: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember units: for each its paths' log-probabilities (-inf: none), whether there are others, and the ids of all paths."""
        there = np.isfinite(logs)
        count = there.sum(axis=1)
        place = np.cumsum(count + more) - (count + more) + self.log.size
        self.first.add(place)
        total = int((count + more).sum())
        log, upto, rest, size = np.full(total, -np.inf), np.full(total, np.inf), np.zeros(total, bool), np.zeros(total, np.int64)
        at = (place - self.log.size)[:, None] + np.arange(logs.shape[1])
        log[at[there]] = logs[there]
        upto[at[there]] = np.cumsum(np.where(there, np.exp(np.where(there, logs, 0)), 0), axis=1)[there]
        last = at[np.arange(len(count)), count - 1]
        upto[last[~more]] = np.inf
        rest[last[more] + 1] = True
        size[at[there]] = sizes[there]
        before = int(self.ends.all[-1]) if self.ends.size else 0
        for grown, part in ((self.upto, upto), (self.log, log), (self.rest, rest), (self.ids, ids), (self.ends, before + np.cumsum(size))):
            grown.add(part)

    def short_paths(self, points: np.ndarray, total: np.ndarray, down: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What learn() takes, for many units of one length at once."""
        count = len(begin)
        best = np.full((n + 1, count, BEST), -np.inf)
        best[0, :, 0] = 0.0
        back = np.zeros((n + 1, count, BEST), np.int32)  # start * BEST + rank
        edge = np.zeros((n + 1, n + 1, count), np.int32)  # piece from start to end; below 0: a code point as bytes
        sums = np.full((n + 1, count), -np.inf)
        sums[0] = 0.0
        more = np.zeros((n + 1, count), bool)
        for end in range(1, n + 1):
            starts = range(max(0, end - self.longest), end)
            weights = []
            for start in starts:
                key = _substring_keys(total, down, begin + start, end - start)
                some = np.flatnonzero(self.maybe[key >> np.uint64(44)])
                at = np.minimum(np.searchsorted(self.piece_keys, key[some]), len(self.piece_keys) - 1)
                hit = self.piece_keys[at] == key[some]
                some, at = some[hit], at[hit]
                weight, is_piece = np.full(count, -np.inf), np.zeros(count, bool)
                weight[some], is_piece[some] = self.piece_weights[at], True
                edge[start, end, some] = self.piece_ids[at]
                if end - start == 1 and not is_piece.all():
                    c = points[begin[~is_piece] + start].astype(np.int64)
                    weight[~is_piece] = self.byte_weight * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
                    edge[start, end, ~is_piece] = -1 - c
                weights.append(weight)
                more[end] |= more[start] & (weight > -np.inf)
            into = np.array([sums[s] + w for s, w in zip(starts, weights, strict=True)])
            sums[end] = np.logaddexp.reduce(into)
            made = np.concatenate([best[s] + w[:, None] for s, w in zip(starts, weights, strict=True)], axis=1)
            more[end] |= (made > -np.inf).sum(axis=1) > BEST
            order = np.argsort(-made, axis=1, kind="stable")[:, :BEST]
            got = np.take_along_axis(made, order, axis=1)
            best[end, :, : got.shape[1]] = got
            back[end, :, : got.shape[1]] = order + starts[0] * BEST
        logs = best[n] - sums[n][:, None]
        pieces = np.full((count, BEST, n + 1), -1, np.int64)  # from the end to the start; -1: nothing
        at, rank = np.full((count, BEST), n), np.broadcast_to(np.arange(BEST), (count, BEST)).copy()
        unit, slot = np.broadcast_to(np.arange(count)[:, None], (count, BEST)), np.broadcast_to(np.arange(BEST), (count, BEST))
        at = np.where(np.isfinite(logs), at, 0)
        for step in range(n):
            go = at > 0
            if not go.any():
                break
            u, e = unit[go], at[go]
            start, k = np.divmod(back[e, u, rank[go]], BEST)
            pieces[u, slot[go], step] = np.where(edge[start, e, u] < 0, edge[start, e, u] - 1, edge[start, e, u])
            at[go], rank[go] = start, k
        flat = pieces[:, :, ::-1].reshape(-1)
        owner = np.repeat(np.arange(count * BEST), n + 1)[flat != -1]
        flat = flat[flat != -1]
        if (raw := flat < -1).any():  # code points that become bytes
            spelled = [[self.bytes[b] for b in chr(-2 - c).encode("utf-8", "surrogatepass")] for c in flat[raw].tolist()]
            size = np.ones(len(flat), np.int64)
            size[raw] = [len(x) for x in spelled]
            owner, wide = np.repeat(owner, size), np.repeat(flat, size)
            wide[np.repeat(raw, size)] = list(chain.from_iterable(spelled))
            flat = wide
        return logs, more[n], flat.astype(np.int32), np.bincount(owner, minlength=count * BEST).reshape(count, BEST)

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Types of the units of all texts, and how many each text has; the texts have their space marks."""
        self.ways.clear()
        points, total, down = _hashed("".join(texts))
        size = np.array([len(t) for t in texts], np.int64)
        at = self.index[points]
        start = np.ones(len(points), bool)
        start[1:] = ~self.joined[at[:-1], at[1:]]
        heads = np.cumsum(size) - size
        start[heads[size > 0]] = True
        begin = np.flatnonzero(start)
        length = np.diff(np.r_[begin, len(points)]) if len(begin) else begin
        key = _substring_keys(total, down, begin, length)
        kinds, where, back = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, kinds)
        lacking = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != kinds) if len(self.keys) else np.arange(len(kinds))
        new_types = np.zeros(len(kinds), np.int64)
        lengths = length[where[lacking]]
        for n in np.unique(lengths).tolist():
            of = lacking[lengths == n]
            for some in np.array_split(of, len(of) * n * n // 300_000 + 1):
                known = self.first.size
                if n <= SHORT:
                    self.learn(*self.short_paths(points, total, down, begin[where[some]], n))
                else:
                    for b in begin[where[some]].tolist():
                        found, more = self.paths(points[b : b + n].tobytes().decode("utf-32-le", "surrogatepass"), BEST)
                        logs, sizes = np.full((1, BEST), -np.inf), np.zeros((1, BEST), np.int64)
                        logs[0, : len(found)], sizes[0, : len(found)] = [lp for lp, _ in found], [len(x) for _, x in found]
                        self.learn(logs, np.array([more]), np.array([*chain.from_iterable(x for _, x in found)], np.int32), sizes)
                new_types[some] = np.arange(known, known + len(some))
        self.keys, self.key_types = np.insert(self.keys, place[lacking], kinds[lacking]), np.insert(self.key_types, place[lacking], new_types[lacking])
        types = self.key_types[np.searchsorted(self.keys, kinds)][back] if len(kinds) else np.zeros(0, np.int64)
        return types, np.searchsorted(begin, heads + size) - np.searchsorted(begin, heads)


class Sampler:
    """Draws segmentations of many texts at once; their units are known.

    Random numbers are hashes of the text's key, the place of the unit and the
    number of the draw, so they depend on nothing else.
    """

    def __init__(self, lattice: Lattice, sampling: Sampling) -> None:
        self.lattice, self.sampling = lattice, sampling
        self.first, self.upto, self.log, self.rest = (x.all for x in (lattice.first, lattice.upto, lattice.log, lattice.rest))
        self.extra: list[tuple[float, tuple[int, ...]]] = []

    def path(self, choice: int) -> tuple[float, tuple[int, ...]]:
        known = len(self.log)
        return self.extra[choice - known] if choice >= known else (float(self.log[choice]), self.lattice.path_ids(choice))

    def pieces(self, choice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of paths one after the other, and how many each has."""
        ids, ends, known = self.lattice.ids.all, self.lattice.ends.all, len(self.log)
        rare = np.flatnonzero(choice >= known).tolist()
        listed = np.where(choice < known, choice, 0)
        begin = np.where(listed > 0, ends[listed - 1], 0)
        size = ends[listed] - begin
        size[rare] = [len(self.extra[int(choice[i]) - known][1]) for i in rare]
        upto = np.cumsum(size)
        places = np.repeat(begin - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)
        out = ids[np.minimum(places, max(len(ids) - 1, 0))]
        for i in rare:
            out[upto[i] - size[i] : upto[i]] = self.extra[int(choice[i]) - known][1]
        return out, size

    def _uniform(self, keys: np.ndarray, places: np.ndarray, draw: int) -> np.ndarray:
        """Numbers over 0 and below 1."""
        h = mix(mix(keys + np.uint64(self.sampling.seed << 32)) + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(draw))
        return ((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53

    def _other(self, unit: int, without: dict[tuple[int, ...], float], seed: list[int]) -> int:
        found = self.lattice.other(self.lattice.text(unit), without, np.random.default_rng(seed))
        if found is None:
            return -1
        self.extra.append(found)
        return len(self.log) + len(self.extra) - 1

    def _listed(self, unit: int) -> list[int]:
        end = self.first[unit + 1] if unit + 1 < len(self.first) else len(self.log)
        return [i for i in range(self.first[unit], end) if not self.rest[i]]

    def free(self, types: np.ndarray, u: np.ndarray, keys: np.ndarray, places: np.ndarray, draw: int) -> np.ndarray:
        """A path for each unit by its probability."""
        at = self.first[types]
        todo = np.flatnonzero(u > self.upto[at])
        while len(todo):
            at[todo] += 1
            todo = todo[u[todo] > self.upto[at[todo]]]
        for i in np.flatnonzero(self.rest[at]).tolist():
            listed = self._listed(int(types[i]))
            other = self._other(int(types[i]), {self.lattice.path_ids(j): float(self.log[j]) for j in listed}, [self.sampling.seed, draw, int(keys[i]), int(places[i])])
            at[i] = other if other >= 0 else listed[-1]
        return at

    def but(self, unit: int, without: list[int], seed: list[int]) -> int:
        """A path for one unit by its probability, other than those given; -1 if there is none."""
        rng = np.random.default_rng(seed)
        gone = {ids: lp for lp, ids in map(self.path, without)}
        every = self._listed(unit)
        listed = [i for i in every if i not in without]
        u = rng.random() * (1 - math.fsum(map(math.exp, gone.values())))
        for i in listed:
            u -= math.exp(self.log[i])
            if u < 0:
                return i
        others = every[-1] + 1 < len(self.rest) and bool(self.rest[every[-1] + 1])
        found = self._other(unit, gone | {self.lattice.path_ids(i): float(self.log[i]) for i in every}, [*seed, 1]) if others else -1
        return found if found >= 0 or not listed else listed[-1]

    def sample(self, types: np.ndarray, count: np.ndarray, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each round: texts that have such a sample, the path of each of their units, log-probability, perturbed one, probability of being included.

        ``types`` are the units of all texts, ``count`` how many each has.
        """
        n, rounds = len(count), self.sampling.samples
        start = np.cumsum(count) - count
        doc = np.repeat(np.arange(n), count)
        place, key = np.arange(len(types)) - start[doc], keys[doc]
        draws = self._uniform(keys, np.full(n, 1 << 40), 0)
        heaps: list[list[tuple[float, int, int, list[int]]]] = [[(math.log(-math.log(u)), 0, -1, [])] for u in draws.tolist()]
        choices: list[np.ndarray] = []
        out = []
        for r in range(rounds):
            low, at, parent = np.full(n, np.inf), np.zeros(n, np.int64), np.full(n, -2)
            gone, turned = np.zeros(n), np.full(n, -1)
            lists: list[list[int]] = [[]] * n
            for d, heap in enumerate(heaps):
                while heap:
                    g, i, p, without = heapq.heappop(heap)
                    if p >= 0:
                        turned[d] = self.but(int(types[start[d] + i]), without, [self.sampling.seed, r, int(keys[d]), i])
                        if turned[d] < 0:
                            continue
                        gone[d] = math.fsum(math.exp(self.path(x)[0]) for x in without)
                    low[d], at[d], parent[d], lists[d] = g, i, p, without
                    break
            active = parent > -2
            choice = self.free(types, self._uniform(key, place, 1), key, place, 0) if r == 0 else choices[0].copy()
            if r:
                for p in range(r):
                    of = parent[doc] == p
                    choice[of] = choices[p][of]
                after = np.flatnonzero(active[doc] & (place > at[doc]))
                choice[after] = self.free(types[after], self._uniform(key[after], place[after], 2 * r + 1), key[after], place[after], r)
                moved = np.flatnonzero(turned >= 0)
                choice[start[moved] + at[moved]] = turned[moved]
            choices.append(choice)
            lp = self.log[np.minimum(choice, max(len(self.log) - 1, 0))] if len(choice) else np.zeros(0)
            for i in np.flatnonzero(choice >= len(self.log)).tolist():
                lp[i] = self.extra[int(choice[i]) - len(self.log)][0]
            total = np.bincount(doc, lp, n)
            upto = np.cumsum(lp)
            before = upto - lp - np.r_[0.0, upto][start][doc]
            p = np.exp(lp)
            own = np.flatnonzero(active & (count > 0))
            p[start[own] + at[own]] += gone[own]
            left = np.where(p < 1 - 1e-12, np.log1p(-np.minimum(p, 1 - 1e-12)), -np.inf) + before
            left[(place < at[doc]) | ~active[doc]] = -np.inf
            some = np.flatnonzero(np.isfinite(left))
            score = left[some] - np.log(np.exp(np.minimum(left[some] + low[doc[some]], 700)) - np.log(self._uniform(key[some], place[some], 2 * r + 2)))
            order = np.lexsort((-score, doc[some]))
            d = doc[some][order]
            heads = np.flatnonzero(np.r_[True, np.diff(d) != 0]) if len(d) else d
            rank = np.arange(len(d)) - np.repeat(heads, np.diff(np.r_[heads, len(d)]))
            best = order[rank < rounds - r]
            for i, g in zip(some[best].tolist(), score[best].tolist(), strict=True):
                t = int(doc[i])
                heapq.heappush(heaps[t], (-g, int(place[i]), r, [*(lists[t] if place[i] == at[t] else []), int(choice[i])]))
            out.append((active, choice, total, -low))
        bound = np.array([-h[0][0] if h else -np.inf for h in heaps])
        return [(a, c, lp, g, np.where(np.isfinite(bound), -np.expm1(-np.exp(np.minimum(lp - np.where(np.isfinite(bound), bound, 0), 700))), 1.0)) for a, c, lp, g in out]


_lattices: dict[tuple[str, float], Lattice] = {}


def _lattice(path: str, alpha: float) -> Lattice:
    """The worker's lattice of a file, kept from task to task."""
    if (path, alpha) not in _lattices:
        _lattices[path, alpha] = Lattice(path, alpha)
    return _lattices[path, alpha]


def marked(text: str | None) -> str:
    """The text with space marks, one in front; nothing stays nothing."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def segmentations(docs: DataFrame, model: str, sampling: Sampling = Sampling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and sample: doc_id, sample (from 0), ids, log_prob, perturbed, inclusion, decoded_sha256.

    The last column is the digest of what the ids decode to, see decoder().

    Samples of a text are different segmentations, best perturbed score first;
    texts with fewer segmentations than samples have fewer rows.  Null and empty
    texts have one, without ids.  The noise is seeded by the id, so reruns and
    repeated rows agree; null ids share a seed.  Characters outside the
    vocabulary become bytes.  An empty table gives an empty result; other
    columns are ignored.
    """
    ship(docs.sparkSession)

    def sampled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, decode = _lattice(model, sampling.alpha), _Decoder(model)
        for part in portions(frames, sampling.portion):
            if lattice.log.size > sampling.remembered:
                lattice.clear()
            types, count = lattice.units([marked(t) for t in part["text"]])
            sampler, ends = Sampler(lattice, sampling), np.cumsum(count)
            for i, (active, choice, lp, g, q) in enumerate(sampler.sample(types, count, part["key"].to_numpy().astype(np.uint64))):
                ids, size = sampler.pieces(choice)
                cuts = np.r_[0, np.cumsum(size)][ends]
                digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decode(ids, cuts)]
                rows = pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "sample": i, "ids": np.split(ids, cuts[:-1]), "log_prob": lp, "perturbed": g, "inclusion": q, "decoded_sha256": digests})
                yield rows[active]
        if not sampling.held:
            lattice.clear()
            release()

    key = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), key.alias("key"))
    return rows.mapInPandas(sampled, "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, decoded_sha256 string")


class _Decoder:
    """Texts of ids, many at once."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        kinds = [(i, model.id_to_piece(i)) for i in range(model.get_piece_size())]
        surface = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else p.encode() for i, p in kinds]
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        self.size = np.array([len(x) for x in surface])
        self.begin = np.cumsum(self.size) - self.size

    def __call__(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """``ids`` of all texts one after the other, and where each text's end."""
        size = self.size[ids]
        upto = np.cumsum(size)
        data = self.flat[np.repeat(self.begin[ids] - (upto - size), size) + np.arange(size.sum())].tobytes()
        cuts = np.r_[0, np.r_[0, upto][ends]].tolist()
        return [data[a:b].decode("utf-8", "replace").replace(SPACE, " ")[1:] for a, b in zip(cuts, cuts[1:], strict=False)]


_decoders: dict[str, _Decoder] = {}


def decoder(model: str):
    """A function of a column of ids that gives the text."""

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if model not in _decoders:
            _decoders[model] = _Decoder(model)
        for part in batches:
            there = [np.asarray(x, np.int64) if x is not None else np.zeros(0, np.int64) for x in part]
            texts = _decoders[model](np.concatenate(there), np.cumsum([len(x) for x in there])) if len(there) else []
            yield pd.Series([None if x is None else t for x, t in zip(part, texts, strict=True)], dtype=object)

    decode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(decode, StringType())
