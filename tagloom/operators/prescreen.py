"""The prescreen's scores: weights of the predicates that a source and a candidate satisfy by any tag.

A task holds candidates by kinds: those alike in signature and genres, in anchors, and in the other fields. A source meets the
kinds of each group once, so that a candidate's score is the sum of three looked-up numbers. Candidates are looked at in order of
their score by signature and genres, and no further than others could still be among the best.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# The prescreen's predicates: fields of the base (or its boosts), field of the candidate, weight.
PREDICATES = [
    (["signature_tag"], "signature_tag", 18), (["niche_anchors"], "niche_anchors", 12), (["identity_tags", "micro_tags"], "identity_tags", 7), (["identity_tags", "micro_tags"], "micro_tags", 3),
    (["boost:identity"], "identity_tags", 5), (["boost:identity"], "niche_anchors", 7), (["setting_tags"], "setting_tags", 8), (["boost:setting"], "setting_tags", 5),
    (["music_primary", "music_secondary", "boost:music"], "music_primary", 7), (["music_primary", "music_secondary", "boost:music"], "music_secondary", 5), (["genre.primary"], "genre.primary", 10), (["genre.sub"], "genre.sub", 7), (["genre.sub_sub"], "genre.sub_sub", 4),
]

#: Fields by code.
FIELDS = list(dict.fromkeys(f for fields, to, _ in PREDICATES for f in (*fields, to)))
#: Fields of candidates by group; candidates are looked at in order of the first group's scores.
LEADING = ("signature_tag", "genre.primary", "genre.sub", "genre.sub_sub")
_GROUPS = (LEADING, ("niche_anchors",), ("identity_tags", "micro_tags", "setting_tags", "music_primary", "music_secondary"))
#: The predicates of each group: whether they ask for a field, the candidate's field and the weight.
_RULES = [[(np.isin(FIELDS, fields), FIELDS.index(to), weight) for fields, to, weight in PREDICATES if to in group] for group in _GROUPS]
#: Whether a group's predicates ask for a field.
_ASKED = [np.any([asks for asks, *_ in rules], axis=0) for rules in _RULES]
#: Candidates that are looked at together, least and most.
_LEAST, _MOST = 256, 500_000
#: Bytes of remembered scores of kinds.
_REMEMBERED = 48 << 20


def _keys(field: np.ndarray | int, tag: np.ndarray) -> np.ndarray:
    """A number for each tag of a field."""
    x = tag.view(np.uint64) ^ (np.atleast_1d(field).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _lists(table: pa.Table, column: str) -> tuple[np.ndarray, pa.Array]:
    """Where each row's list starts and ends, and all values."""
    x = table.column(column).combine_chunks()
    off = np.asarray(x.offsets, np.int64)
    return off - off[0], x.flatten()


def pack_sources(table: pa.Table) -> bytes:
    """The tags that rows ask for, and the items of each."""
    ends, tags = _lists(table, "tags")
    each, members = _lists(table, "members")
    return pickle.dumps((ends, np.asarray(tags.field("f"), np.int64), np.asarray(tags.field("t"), np.int64), each, np.asarray(members, np.int64)))


def pack_candidates(table: pa.Table) -> bytes:
    """Items of the rows, and the rows' kinds by group: the kinds' numbers, each row's kind, and the kinds' tags."""
    ends, tags = _lists(table, "tags")
    each, members = _lists(table, "members")
    n = len(ends) - 1
    row, field = np.repeat(np.arange(n), np.diff(ends)), np.asarray(tags.field("f"), np.int64)
    key = _keys(field, np.asarray(tags.field("t"), np.int64))
    groups = []
    for names in _GROUPS:
        inside = np.isin(field, [FIELDS.index(f) for f in names])
        r, k = row[inside], key[inside]
        total, cut = np.concatenate([np.zeros(1, np.uint64), np.cumsum(k, dtype=np.uint64)]), np.searchsorted(r, np.arange(n + 1))
        kinds, first, code = np.unique(total[cut[1:]] - total[cut[:-1]], return_index=True, return_inverse=True)
        own = first[code[r]] == r
        groups.append((kinds, code.astype(np.int32), k[own], code[r[own]].astype(np.int32)))
    there = np.asarray(members.field("there").to_numpy(zero_copy_only=False), bool)
    return pickle.dumps((np.asarray(members.field("id"), np.int64), np.asarray(members.field("tie"), np.float64), there, np.repeat(np.arange(n), np.diff(each)).astype(np.int32), groups))


class Held:
    """The candidates of a cell, by kinds."""

    def __init__(self, blocks: list[bytes]) -> None:
        parts = [pickle.loads(b) for b in blocks]
        ids, ties, there = (np.concatenate([p[k] for p in parts]) for k in range(3))
        codes, self.groups = [], []
        for g in range(len(_GROUPS)):
            kinds, first, at = np.unique(np.concatenate([p[4][g][0] for p in parts]), return_index=True, return_inverse=True)
            start, code, keys, of = 0, [], [], []
            for p in parts:
                own, local, key, kind = p[4][g]
                to = at[start : start + len(own)]
                new = first[to] == start + np.arange(len(own))
                code.append(to[local[p[3]]])
                keys.append(key[new[kind]])
                of.append(to[kind[new[kind]]])
                start += len(own)
            key, kind = np.concatenate(keys), np.concatenate(of)
            order = np.argsort(key, kind="stable")
            codes.append(np.concatenate(code).astype(np.int32))
            self.groups.append((len(kinds), key[order], kind[order].astype(np.int32)))
        order = np.lexsort((ids, ties))
        self.ids, self.ties, self.there = ids[order], ties[order], there[order]
        codes = [c[order] for c in codes]
        self.rank = np.argsort(codes[0], kind="stable").astype(np.int32)  # by leading kind, then in order
        lead = codes[0][self.rank]
        self.start = np.searchsorted(lead, np.arange(self.groups[0][0] + 1))
        small = lambda c, n: c.astype(np.uint16) if n < 1 << 16 else c
        self.codes = [small(c[self.rank], n) for c, (n, *_) in zip(codes[1:], self.groups[1:], strict=True)]
        self.known: dict[tuple, np.ndarray] = {}
        self.size = 0

    def scores(self, g: int, field: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Points of each kind of a group for what a source asks for."""
        name = (g, field.tobytes(), tag.tobytes())
        if name not in self.known:
            out = np.zeros(self.groups[g][0], np.uint8)
            for no, (asks, *_) in enumerate(_RULES[g]):
                asked = tag[asks[field]]
                if len(asked):
                    out += self._points(g, no, asked)
            self._remember(name, out)
        return self.known[name]

    def _points(self, g: int, no: int, asked: np.ndarray) -> np.ndarray:
        """A predicate's weight for each kind that has one of the tags."""
        name = (g, no, asked.tobytes())
        if name not in self.known:
            n, keys, kind = self.groups[g]
            _, to, weight = _RULES[g][no]
            out, key = np.zeros(n, np.uint8), _keys(to, asked)
            for low, high in zip(np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right"), strict=True):
                out[kind[low:high]] = weight
            self._remember(name, out)
        return self.known[name]

    def _remember(self, name: tuple, points: np.ndarray) -> None:
        if self.size + points.nbytes > _REMEMBERED:
            self.known, self.size = {}, 0
        self.known[name], self.size = points, self.size + points.nbytes

    def chunks(self, lead: np.ndarray, least: int) -> Iterator[tuple]:
        """(highest points of the first group, points, kinds of the other groups, places) of some candidates, highest points first."""
        order = np.argsort(255 - lead, kind="stable")
        order = order[self.start[order + 1] > self.start[order]]
        points, size = lead[order], self.start[order + 1] - self.start[order]
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.append(np.flatnonzero(np.diff(points)) + 1, len(order)) if len(order) else []
        a = 0
        for end in ends:
            if total[end] - total[a] < least and end < len(order):
                continue
            while a < end:
                b = min(end, max(a + 1, int(np.searchsorted(total, total[a] + _MOST, "right")) - 1))
                at = np.repeat(self.start[order[a:b]] - (total[a:b] - total[a]), size[a:b]) + np.arange(total[b] - total[a])
                yield int(points[a]), np.repeat(points[a:b], size[a:b]), [c[at] for c in self.codes], self.rank[at]
                a = b

    def best(self, others: list[np.ndarray], chunks: Iterator[tuple], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in order, points) of the first `k` candidates."""
        held, need, full = np.zeros(0, np.int64), 1, sum(int(x.max(initial=0)) for x in others)
        for highest, points, kinds, rank in chunks:
            if highest + full < need:
                break
            score = points.copy()
            for x, kind in zip(others, kinds, strict=True):
                score += x[kind]
            some = np.flatnonzero(score >= need)
            if len(some) > 4 * k:
                above = np.cumsum(np.bincount(score[some], minlength=256)[::-1])
                some = some[score[some] >= 255 - np.searchsorted(above, k)]
            held = np.concatenate([held, (255 - score[some].astype(np.int64)) << 40 | rank[some]])
            if len(held) > k:
                held = np.partition(held, k - 1)[:k]
            if len(held) == k:
                need = 255 - (int(held.max()) >> 40)
        held.sort()
        return held & ((1 << 40) - 1), 255 - (held >> 40)


def _remembering(made: Iterator[tuple]):
    """Iterators over what `made` gives, each from the start."""
    seen: list[tuple] = []

    def every() -> Iterator[tuple]:
        at = 0
        while True:
            if at == len(seen):
                one = next(made, None)
                if one is None:
                    return
                seen.append(one)
            yield seen[at]
            at += 1

    return every


def best_of(k: int):
    """For `block_topk`: holds candidate blocks and gives batches of the best `k` of each item of a source block."""

    def begin(blocks: list[bytes]):
        held = Held(blocks)

        def run(data: bytes) -> Iterator[dict[str, np.ndarray]]:
            ends, field, tag, each, members = pickle.loads(data)
            asks = [[(field[a:b][mask[field[a:b]]], tag[a:b][mask[field[a:b]]]) for mask in _ASKED] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            out, n, last, chunks = [], 0, None, None
            for i in sorted(range(len(asks)), key=lambda i: (asks[i][0][0].tobytes(), asks[i][0][1].tobytes())):
                lead = (asks[i][0][0].tobytes(), asks[i][0][1].tobytes())
                if lead != last:
                    last, chunks = lead, _remembering(held.chunks(held.scores(0, *asks[i][0]), max(_LEAST, 4 * k)))
                place, points = held.best([held.scores(g, *asks[i][g]) for g in (1, 2)], chunks(), k + 1)
                ids = held.ids[place]
                for m in members[each[i] : each[i + 1]]:
                    kept = np.flatnonzero(ids != m)[:k]
                    out.append((np.full(len(kept), m), place[kept], points[kept], np.arange(1, len(kept) + 1, dtype=np.int32)))
                    n += len(kept)
                    if n > 100_000:
                        yield rows(out)
                        out, n = [], 0
            if out:
                yield rows(out)

        def rows(out: list[tuple]) -> dict[str, np.ndarray]:
            source, place, points, rnk = (np.concatenate(x) for x in zip(*out, strict=True))
            return {"source": source, "candidate": held.ids[place], "tie": held.ties[place], "score": points.astype(np.int64), "there": held.there[place], "rnk": rnk}

        return run

    return begin
