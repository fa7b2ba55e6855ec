"""Near duplicates by Jaccard similarity of word shingles, joined with signature trees.

Plan (every step is exact; nothing is sampled or capped):

1. Each text becomes its set of shingle hashes. Texts with equal sets are one
   class, so exact copies take part once.
2. Prefix filter with slack: sets are ordered by hash, and of a set of n
   shingles the first n - ceil(t n) + n/8 + 1 are kept. Two linked sets have at
   least `need` kept shingles in common. Kept shingles are counted over all
   classes, one entry for each distinct shingle of a pack of texts, so a
   shingle that a third of all texts hold costs one entry a pack.
3. A text with fewer than `need` kept shingles that occur elsewhere can have no
   link. The others list all but need - 1 of those shingles, rarest first: two
   linked texts list one in common. Texts with a common listed shingle form a
   family.
4. In a family, sets are the leaves of a signature tree. Its nodes hold the OR
   of their token bitmaps, the range of set sizes and the largest number of
   shingles lost to equal bits. Two trees are walked against each other level
   by level; a pair of nodes goes on only if the sizes allow a link and
   popcount(a AND b) + the lost shingles reaches the least overlap for it. All
   leaf pairs are verified on the sets. Families over `leaf_rows` texts are cut by
   set size into several trees; pairs of trees with compatible sizes are dealt
   to different tasks.
5. Every task counts the links of its sets, a class of copies with its size, and
   gives a spanning forest of them to connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tagloom.llm.tables import bounded_batches, keyed_or_broadcast
from tagloom.llm.textblocks import BLOCK_BYTES, blocks, mix, shingle_sets, utf8
from tagloom.operators.graph import connected_components
from tagloom.plans.staging import Staged

#: Words of the signature bitmaps: 64 x 64 bits.
BITMAP_WORDS = 64


def least_overlap(a: int, b: int, num: int, den: int) -> int:
    """Smallest intersection with den * inter >= num * union, for set sizes a and b."""
    return -(-num * (a + b) // (den + num))


def _least_common(n, num: int, den: int):
    """Every set linked with one of n shingles has at least so many in common."""
    return -(-(n * num) // den)


def _slack(n):
    return n // 8 + 1


def _prefix(n, num: int, den: int):
    return np.minimum(n, n - _least_common(n, num, den) + _slack(n))


def _need(n, num: int, den: int):
    """Kept shingles that a set of n has in common with any set linked to it."""
    return np.minimum(_slack(_least_common(n, num, den)), _least_common(n, num, den))


def _sets_of(batch: pa.RecordBatch, column: str, size: int) -> Iterator[tuple[int, np.ndarray]]:
    raw, offsets = utf8(batch.column(column))
    for i, j in blocks(offsets):
        for k, s in enumerate(shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)):
            yield i + k, s


def _shingled(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, kept = [], [], [], []
            for _, s in _sets_of(batch, "text", size):
                n.append(len(s))
                one.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                two.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                kept.append(s[: int(_prefix(len(s), num, den))].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(kept, pa.binary())],
                names=["id", "n", "h1", "h2", "kept"],
            )

    return run


def _packs(bytes_each: int):
    """Rows to packs of about `bytes_each` of kept shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        kept: list[bytes] = []
        held = 0

        def out() -> pa.RecordBatch:
            pack = int(mix(np.array([ids[0]], dtype=np.int64).view(np.uint64))[0].view(np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array([pack], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array([len(k) // 8 for k in kept], np.int64).tobytes()], pa.binary()), pa.array([np.array(sizes, np.int64).tobytes()], pa.binary()), pa.array([b"".join(kept)], pa.binary())],
                names=["pack", "ids", "lens", "sizes", "kept"],
            )

        sizes: list[int] = []
        for batch in batches:
            for i, n, k in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("kept").to_pylist(), strict=True):
                ids.append(i)
                sizes.append(n)
                kept.append(k)
                held += len(k)
                if held >= bytes_each:
                    yield out()
                    ids, sizes, kept, held = [], [], [], 0
        if ids:
            yield out()

    return run


def _to_buckets(bits: int):
    """Each pack's distinct shingles with the texts of the pack that hold them,
    dealt to 2**bits ranges of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, kept in zip(batch.column("pack").to_pylist(), batch.column("kept"), strict=True):
                keys, counts = np.unique(np.frombuffer(kept.as_buffer(), np.uint64), return_counts=True)
                at = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                which, first = np.unique(at, return_index=True)
                ends = np.append(first[1:], len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which, pa.int64()), pa.array([pack] * len(which), pa.int64()), pa.array([keys[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()), pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())],
                    names=["bucket", "pack", "keys", "counts"],
                )

    return run


def _count_bucket(group: pa.Table) -> pa.Table:
    """Back to each pack: its shingles of this range that several texts hold."""
    packs = group.column("pack").to_pylist()
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("keys")]
    counts = [np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("counts")]
    keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)
    out_p, out_k, out_c, at = [], [], [], 0
    for p, k in zip(packs, parts, strict=True):
        c = total[inverse[at : at + len(k)]]
        at += len(k)
        if (c > 1).any():
            out_p.append(p)
            out_k.append(k[c > 1].tobytes())
            out_c.append(np.minimum(c[c > 1], 2**32 - 1).astype(np.uint32).tobytes())
    return pa.table({"pack": pa.array(out_p, pa.int64()), "keys": pa.array(out_k, pa.binary()), "counts": pa.array(out_c, pa.binary())})


def _list_shared(num: int, den: int):
    """Of a pack and its shared shingles: the texts that can have links, with
    the shingles that each lists."""

    def run(group: pa.Table) -> pa.Table:
        own = group.filter(pa.compute.is_valid(group.column("kept")))
        shared = group.filter(pa.compute.is_null(group.column("kept")))
        ids_out, n_out, key_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if own.num_rows and shared.num_rows:
            keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in shared.column("keys")])
            counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in shared.column("counts")])
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            for row in range(own.num_rows):
                ids, lens, sizes, kept = (np.frombuffer(own.column(c)[row].as_buffer(), t) for c, t in (("ids", np.int64), ("lens", np.int64), ("sizes", np.int64), ("kept", np.uint64)))
                at = np.searchsorted(keys, kept)
                at[at == len(keys)] = 0
                found = keys[at] == kept
                rows = np.repeat(np.arange(len(ids)), lens)[found]
                kept, df = kept[found], counts[at[found]]
                per = np.bincount(rows, minlength=len(ids))
                need = _need(sizes, num, den)
                order = np.lexsort((kept, df, rows))
                rows, kept = rows[order], kept[order]
                rank = np.arange(len(rows)) - np.repeat(np.cumsum(per) - per, per)
                take = (rank <= (per - need)[rows]) & (per >= need)[rows]
                ids_out.append(ids[rows[take]])
                n_out.append(sizes[rows[take]])
                key_out.append(kept[take].view(np.int64))
        return pa.table({"id": np.concatenate(ids_out), "n": np.concatenate(n_out), "key": np.concatenate(key_out)})

    return run


def _with_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for _, s in _sets_of(batch, "text", size)]
            if sets:
                keep = [i for i, c in enumerate(batch.schema.names) if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sets, pa.binary())], names=[*(batch.schema.names[i] for i in keep), "shingles"])

    return run


class SignatureTree:
    """Sets in order of size under nodes of `fan` children."""

    def __init__(self, sets: list[np.ndarray], fan: int = 8) -> None:
        self.sets, self.fan = sets, fan
        bits = np.uint64(BITMAP_WORDS * 64 - 1)
        maps = np.zeros((len(sets), BITMAP_WORDS), np.uint64)
        for row, s in zip(maps, sets, strict=True):
            b = s & bits
            np.bitwise_or.at(row, (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        n = np.array([len(s) for s in sets], np.int64)
        lost = n - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        #: From leaves to root: bitmaps, smallest and largest size, most shingles lost to equal bits.
        self.levels = [(maps, n, n, lost)]
        while len(self.levels[-1][1]) > 1:
            m, lo, hi, ls = self.levels[-1]
            cut = np.arange(0, len(lo), fan)
            self.levels.append((np.bitwise_or.reduceat(m, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(ls, cut)))

    def pairs(self, other: SignatureTree, num: int, den: int, at_once: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaf pairs that the bounds allow (i < j if other is self), by walking
        both trees at once. Both must have equally many levels or be padded."""
        same = other is self
        top = max(len(self.levels), len(other.levels)) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > at_once:
                for k in range(0, len(i), at_once):
                    stack.append((level, i[k : k + at_once], j[k : k + at_once]))
                continue
            ma, la, ha, xa = self.levels[min(level, len(self.levels) - 1)]
            mb, lb, hb, xb = other.levels[min(level, len(other.levels) - 1)]
            ok = (ha[i] * den >= lb[j] * num) & (hb[j] * den >= la[i] * num)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            need = -(-num * (la[i] + lb[j]) // (den + num))
            most = np.minimum(np.bitwise_count(ma[i] & mb[j]).sum(axis=1).astype(np.int64) + np.minimum(xa[i], xb[j]), np.minimum(ha[i], hb[j]))
            i, j = i[most >= need], j[most >= need]
            if level == 0:
                if same:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield i, j
                continue
            i2, j2 = self._down(i, level), other._down(j, level)
            fa, fb = i2.shape[1], j2.shape[1]
            i3, j3 = np.repeat(i2, fb, axis=1).ravel(), np.tile(j2, (1, fa)).ravel()
            ok = (i3 >= 0) & (j3 >= 0)
            if same:
                ok &= i3 <= j3
            if ok.any():
                stack.append((level - 1, i3[ok], j3[ok]))

    def _down(self, nodes: np.ndarray, level: int) -> np.ndarray:
        if level > len(self.levels) - 1:
            return nodes[:, None]
        kids = nodes[:, None] * self.fan + np.arange(self.fan)
        kids[kids >= len(self.levels[level - 1][1])] = -1
        return kids


def _overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, held: int = 1_000_000, tokens: int = 8192, pairs: int = 8192) -> np.ndarray:
    """Shingles that sets i and j have in common, for arrays of pairs. Ranges of
    hashes of about `held` shingles are taken in turn; in each, the shingles that
    several sets hold become columns of bitmaps, `tokens` at a time."""
    common = np.zeros(len(i), np.int64)
    if not len(i):
        return common
    used = np.unique(np.concatenate([i, j]))
    sets, i, j = [sets[k] for k in used], np.searchsorted(used, i), np.searchsorted(used, j)
    total = sum(len(s) for s in sets)
    ranges = max(1, -(-total // held))
    cuts = [(k << 64) // ranges for k in range(1, ranges)]
    bounds = np.array([np.concatenate(([0], np.searchsorted(s, np.array(cuts, np.uint64)), [len(s)])) for s in sets], np.int64)
    for k in range(ranges):
        parts = [s[a:b] for s, a, b in zip(sets, bounds[:, k], bounds[:, k + 1], strict=True)]
        key = np.concatenate(parts)
        row = np.repeat(np.arange(len(sets)), [len(x) for x in parts])
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        token = np.cumsum(np.append(False, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        several = np.bincount(token, minlength=1) > 1
        row, token = row[several[token]], (np.cumsum(several) - 1)[token[several[token]]]
        for low in range(0, int(several.sum()), tokens):
            a, b = np.searchsorted(token, [low, low + tokens])
            dense = np.zeros((len(sets), min(tokens, -(-(int(token[b - 1]) - low + 1) // 64) * 64)), bool)
            dense[row[a:b], token[a:b] - low] = True
            bits = np.packbits(dense, axis=1).view(np.uint64)
            for at in range(0, len(i), pairs):
                x, y = i[at : at + pairs], j[at : at + pairs]
                common[at : at + pairs] += np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
    return common


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _join_trees(num: int, den: int):
    """All links of a task: for each linked set its id, the root of its tree of
    links within the task, and the number of texts that it is linked with here."""

    def run(group: pa.Table) -> pa.Table:
        ids, side, copies = (np.asarray(group.column(c)) for c in ("id", "side", "copies"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        order = np.lexsort((ids, [len(s) for s in sets], side))
        # Repeated rows of one id with one text are one leaf.
        order = [k for n, k in enumerate(order) if not (n and ids[k] == ids[order[n - 1]] and side[k] == side[order[n - 1]] and np.array_equal(sets[k], sets[order[n - 1]]))]
        ids, side, copies, sets = ids[order], side[order], copies[order], [sets[k] for k in order]
        left = int((side == 0).sum())
        one = SignatureTree(sets[:left])
        two, shift = (SignatureTree(sets[left:]), left) if left < len(sets) else (one, 0)
        found = list(one.pairs(two, num, den))
        i = np.concatenate([np.zeros(0, np.int64), *(a for a, _ in found)])
        j = np.concatenate([np.zeros(0, np.int64), *(b for _, b in found)]) + shift
        n = np.array([len(s) for s in sets], np.int64)
        linked = _overlaps(sets, i, j) >= least_overlap(n[i], n[j], num, den)
        i, j = i[linked], j[linked]
        label = _labels(len(sets), i, j)
        links = (np.bincount(i, weights=copies[j], minlength=len(sets)) + np.bincount(j, weights=copies[i], minlength=len(sets))).astype(np.int64)
        some = np.flatnonzero(links)
        return pa.table({"src": ids[some], "dst": ids[label[some]], "links": links[some]})

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = Fraction(3, 4), shingle_words: int = 5, leaf_rows: int = 1024, broadcast_rows: int = 500_000
) -> DataFrame:
    """One row per document: `id_col`, n_shingles, component_id, n_links.

    Words are the runs of non-white-space characters of the text with A-Z
    lower-cased. A text of fewer words than a shingle is one shingle; a null
    text or one without words has none and is linked with nothing. Repeated
    rows with one id count as one document each; a null id is left out of
    links and has a null component. n_links is the number of other documents
    that a document is linked with, its copies among them; where one id has
    several texts, each of them has the links of all those that stand for a
    class of copies. Columns other than these two are ignored.
    `threshold` is the least Jaccard similarity, compared exactly. An empty
    table gives an empty result.
    """
    num, den = Fraction(threshold).numerator, Fraction(threshold).denominator
    texts = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shingled = Staged(texts.mapInArrow(_shingled(shingle_words, num, den), "id long, n long, h1 long, h2 long, kept binary"), "shingled")
    rows = shingled.df.where("n > 0 and id is not null")
    classes = Staged(rows.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    shingles = (classes.df.agg(F.sum("n")).first()[0] or 0) // 2
    bits = max(0, ceil(np.log2(max(1, shingles / 1_000_000))))

    reps = rows.select("id", "n", "h1", "h2", "kept").join(classes.df.select(F.col("rep").alias("id"), "n", "h1", "h2"), ["id", "n", "h1", "h2"], "left_semi").select("id", "n", "kept")
    packs = Staged(reps.mapInArrow(_packs(2 * BLOCK_BYTES), "pack long, ids binary, lens binary, sizes binary, kept binary"), "packs")
    buckets = packs.df.select("pack", "kept").mapInArrow(_to_buckets(bits), "bucket long, pack long, keys binary, counts binary")
    shared = buckets.groupBy("bucket").applyInArrow(_count_bucket, "pack long, keys binary, counts binary")
    nothing = F.lit(None).cast("binary")
    both = packs.df.select("pack", "ids", "lens", "sizes", "kept", nothing.alias("keys"), nothing.alias("counts")).unionByName(
        shared.select("pack", *(nothing.alias(c) for c in ("ids", "lens", "sizes", "kept")), "keys", "counts")
    )
    listed = Staged(both.groupBy("pack").applyInArrow(_list_shared(num, den), "id long, n long, key long"), "listed")
    shingled_ids = shingled.df.select("id", "n", "h1", "h2")

    leaders = listed.df.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("c")).where("c > 1")
    star = listed.df.join(leaders, "key").where("id <> leader").select("id", "leader").distinct()
    family = connected_components(star, "id", "leader").select(F.col("node").alias("id"), F.col("component").alias("family"))
    member = family.join(classes.df.select(F.col("rep").alias("id"), "n", "copies"), "id")
    member = Staged(member, "members")
    dealt_rows = Staged(_deal(member.df, leaf_rows, num, den, broadcast_rows), "dealt")
    live = dealt_rows.df.groupBy("id").agg(F.max("copies").alias("copies"), F.collect_list(F.struct("task", "side")).alias("tasks"))
    count, times = member.df.count(), dealt_rows.df.count()
    # A row of `live` names all tasks of its set; about 64 bytes each.
    sets = texts.join(keyed_or_broadcast(live, count, broadcast_rows, 32 + 64 * -(-times // max(1, count))), "id").mapInArrow(
        _with_sets(shingle_words), T.StructType([T.StructField("id", T.LongType()), *[f for f in live.schema.fields if f.name in ("copies", "tasks")], T.StructField("shingles", T.BinaryType())])
    )
    dealt_sets = sets.select(F.explode("tasks").alias("t"), "id", "copies", "shingles").select("t.task", "t.side", "id", "copies", "shingles")
    links = Staged(dealt_sets.groupBy("task").applyInArrow(_join_trees(num, den), "src long, dst long, links long"), "links")
    tally = links.df.groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    labels = connected_components(links.df).join(tally, "node").select(F.col("node").alias("rep"), "component", "links")
    named = classes.df.join(labels, "rep", "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = shingled_ids.join(named, ["n", "h1", "h2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links"),
    )
    packs.drop()
    listed.drop()
    return out


def _deal(member: DataFrame, leaf_rows: int, num: int, den: int, broadcast_rows: int) -> DataFrame:
    """(id, copies, task, side): a family of at most `leaf_rows` sets is one task. A
    larger one is cut into runs of set sizes, and two runs meet in a task if
    their size ranges can hold a link."""
    big = Staged(member.groupBy("family").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > leaf_rows).select("family"), "families").df
    few = keyed_or_broadcast(big, big.count(), broadcast_rows)  # at most one family for `leaf_rows` sets
    small = member.join(few, "family", "left_anti").select("id", "copies", F.concat_ws(":", F.col("family")).alias("task"), F.lit(0).alias("side"))
    # A cell is a set size of a family, split by a hash where it is frequent, so that a family has about as many cells as sizes and runs.
    large = member.join(few, "family", "left_semi")
    sizes = large.groupBy("family", "n").agg(F.ceil(F.count(F.lit(1)) / leaf_rows).alias("salts"))
    large = large.join(sizes, ["family", "n"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))).drop("salts")
    order = W.partitionBy("family").orderBy("n", "salt")
    cells = large.groupBy("family", "n", "salt").agg(F.count(F.lit(1)).alias("c")).withColumn("run", F.floor((F.sum("c").over(order) - 1) / leaf_rows))
    large = large.join(cells.select("family", "n", "salt", "run"), ["family", "n", "salt"])
    runs = cells.groupBy("family", "run").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    a, b = runs.alias("a"), runs.alias("b")
    meet = a.join(b, (F.col("a.family") == F.col("b.family")) & (F.col("a.run") <= F.col("b.run")) & (F.col("a.hi") * den >= F.col("b.lo") * num)).select(
        F.col("a.family").alias("family"), F.col("a.run").alias("r1"), F.col("b.run").alias("r2")
    )
    sides = meet.select("family", F.concat_ws(":", "family", "r1", "r2").alias("task"), F.explode(F.when(F.col("r1") == F.col("r2"), F.array(F.struct(F.col("r1").alias("run"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("r1").alias("run"), F.lit(0).alias("side")), F.struct(F.col("r2").alias("run"), F.lit(1).alias("side"))))).alias("s")).select("family", "task", "s.run", "s.side")
    return small.unionByName(large.join(sides, ["family", "run"]).select("id", "copies", "task", "side"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000, **params) -> DataFrame:
    """`docs` with one document of each group of near duplicates, that of the
    smallest id. Rows of one id stay or go together; rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, broadcast_rows=broadcast_rows, **params)
    gone = Staged(found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct(), "gone").df
    return docs.join(keyed_or_broadcast(gone, gone.count(), broadcast_rows), id_col, "left_anti").select(docs.columns)
