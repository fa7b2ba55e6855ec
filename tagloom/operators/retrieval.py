"""Candidate retrieval: nearest neighbours, prescreening, search."""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window as W

from tagloom.functions.text import norm_search_text, trigrams
from tagloom.functions.weights import let
from tagloom.operators.blocks import Search, block_topk, rows_for
from tagloom.operators.lists import SharedLists
from tagloom.operators.prescreen import FIELDS, LEADING, PREDICATES, best_of, pack_candidates, pack_sources  # noqa: F401
from tagloom.plans.staging import Staged

def _vectors(table: pa.Table) -> bytes:
    """Unit vectors of a block; zero stays zero."""
    flat = table.column("v").combine_chunks()
    x = np.asarray(flat.flatten(), np.float64).reshape(len(table), -1)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return struct.pack("<q", x.shape[1]) + np.divide(x, size, out=np.zeros_like(x), where=size > 0).tobytes()


def _cosines(a: bytes, b: bytes, rows: slice) -> np.ndarray:
    x, y = (np.frombuffer(d, np.float64, offset=8).reshape(-1, struct.unpack_from("<q", d)[0]) for d in (a, b))
    return np.round(x[rows] @ y.T, 9)


def knn_join(emb: DataFrame, k: int, id_col: str = "item_id", vector: str = "embedding", queries: DataFrame | None = None, by: str | None = None, block_rows: int | None = None) -> DataFrame:
    """(source, candidate, score, rnk): the exact `k` nearest rows by cosine, self left out; with
    `by`, among the rows of equal `by`. Ties go to the smaller id. Rows without a vector are left out.

    Blocks of vectors meet as matrix products (`block_topk`): for n rows, n / block_rows
    times the table is shuffled, and k rows for a source and task after that."""
    held = emb.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull())
    wide = held.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    if not wide[0]:
        return emb.sparkSession.createDataFrame([], "source long, candidate long, score double, rnk int")
    block_rows = block_rows or rows_for(emb.sparkSession.sparkContext.defaultParallelism, wide[0], max(256, min(8192, (4 << 20) // (8 * max(1, wide[1])))))
    group = (F.col(by) if by else F.lit(0)).cast("string")
    cut = lambda d: _vector_rows(d, group, id_col, vector)
    rows = cut(emb)
    return block_topk(rows if queries is None else cut(queries), rows, k, _vectors, _cosines, block_rows).drop("g")


def _vector_rows(df: DataFrame, group: Column, id_col: str, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull() & group.isNotNull()).select(group.alias("g"), F.col(id_col).cast("long").alias("id"), F.lit(0.0).alias("tie"), F.col(vector).alias("v"))


def projection_codes(rows: DataFrame, vector: str, width: int, tables: int, bits: int, probes: int, seed: int = 17) -> DataFrame:
    """`rows` once for each hash table and probe, with the cell `g` of each: the signs of `bits` random projections. The first
    probe is a vector's own cell; the others turn the sign of one projection each, those nearest to zero first."""
    planes = np.random.default_rng(seed).normal(size=(tables * bits, width))
    kept = [c for c in rows.columns]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            column = batch.column(vector)
            x = np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, width))
            seen = (x @ planes.T).reshape(n, tables, bits)
            own = ((seen > 0) << np.arange(bits)).sum(axis=2)
            flips = np.argsort(np.abs(seen), axis=2, kind="stable")[:, :, : max(0, probes - 1)]
            cells = np.concatenate([own[:, :, None], own[:, :, None] ^ (1 << flips)], axis=2)
            per = cells.shape[2]
            take = pa.array(np.repeat(np.arange(n), tables * per))
            names = np.char.add(np.char.add(np.tile(np.repeat(np.arange(tables), per), n).astype(str), ":"), cells.reshape(-1).astype(str))
            for a in range(0, len(take), 50_000):
                part = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take[part]) for c in kept), pa.array(names[part])], names=[*kept, "g"])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("g", StringType())]))


def knn_join_hashed(emb: DataFrame, k: int, id_col: str = "item_id", vector: str = "embedding", queries: DataFrame | None = None, tables: int = 8, probes: int = 4, cell_rows: int = 2_000, bits: int | None = None) -> DataFrame:
    """(source, candidate, score, rnk): nearest rows by cosine as `knn_join` has them, most of them, for work that
    grows with the rows and not with their square.

    Every row stands in one cell of each of `tables` hash tables of random projections, with as many bits as leave
    about `cell_rows` rows a cell; a source looks into `probes` cells of each. Rows of one cell meet in blocks, so that a cell of very many
    rows is the work of many tasks. Scores and ranks are exact among the rows met; `knn_join` is the exact way, taken too
    where looking into so many cells would cost as much."""
    held = emb.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull())
    n, wide = held.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    if bits is None:
        bits = max(0, int(np.ceil(np.log2(max(1, (n or 0) / cell_rows)))))
        bits = bits if tables * min(probes, bits + 1) < 1 << bits else 0
    if not n or not bits:
        return knn_join(emb, k, id_col, vector, queries)
    probes = min(probes, bits + 1)
    block_rows = rows_for(emb.sparkSession.sparkContext.defaultParallelism, n, max(256, min(8192, (4 << 20) // (8 * max(1, wide)))))
    cells = lambda df, seen: projection_codes(_vector_rows(df, F.lit("").cast("string"), id_col, vector).drop("g"), "v", wide, tables, bits, seen)
    best = block_topk(cells(held if queries is None else queries, probes), cells(held, 1), k, _vectors, _cosines, block_rows)
    once = best.groupBy("source", "candidate").agg(F.max("score").alias("score"))
    order = W.partitionBy("source").orderBy(F.desc("score"), "candidate")
    return once.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)


def refresh_neighbors(lists: DataFrame, emb: DataFrame, changed: DataFrame, gone: DataFrame, k: int, id_col: str = "item_id", vector: str = "embedding") -> DataFrame:
    """The neighbour lists that differ after a change, whole: (source, candidate, score, rnk), rows of what
    `knn_join(emb, k)` gives, with the sources that have no list any more as rows of a null candidate.

    lists: (source, candidate, score, rnk) before; emb: all vectors now; changed(id): new items and those of another vector;
    gone(id): deleted items. Changed items meet all, and all meet the changed ones; only lists that lost a member
    are made anew. So the work is that of changed x all, not all x all. Write the result with `replace_by_key` on `source`."""
    new = emb.join(changed.select(F.col(id_col)).distinct(), id_col, "left_semi")
    out_of_date = changed.select(F.col(id_col).alias("candidate")).unionByName(gone.select(F.col(id_col).alias("candidate"))).distinct()
    lost = lists.join(out_of_date, "candidate", "left_semi").select(F.col("source").alias(id_col)).distinct()
    again = Staged(lost.unionByName(changed.select(id_col)).distinct().join(gone.select(id_col), id_col, "left_anti"), "neighbours-again").df
    made = knn_join(emb, k, id_col, vector, queries=emb.join(again, id_col, "left_semi"))
    rest = emb.join(again, id_col, "left_anti")
    met = _against(rest, new, k, id_col, vector)
    touched = met.select("source").distinct()
    merged = lists.join(touched, "source", "left_semi").select("source", "candidate", "score").unionByName(met.select("source", "candidate", "score"))
    order = W.partitionBy("source").orderBy(F.desc("score"), "candidate")
    merged = merged.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)
    # A list to which nothing new has come near stays as it is.
    entered = Staged(merged, "neighbours-merged").df
    moved = entered.join(new.select(F.col(id_col).alias("candidate")), "candidate", "left_semi").select("source").distinct()
    ended = lists.select("source").distinct().join(gone.select(F.col(id_col).alias("source")), "source", "left_semi")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("candidate", "long"), ("score", "double"), ("rnk", "int"))]
    return made.unionByName(entered.join(moved, "source", "left_semi").select("source", "candidate", "score", "rnk")).unionByName(ended.select("source", *none))


def _against(sources: DataFrame, candidates: DataFrame, k: int, id_col: str, vector: str) -> DataFrame:
    """The `k` nearest of `candidates` for each of `sources`, two tables."""
    n, wide = candidates.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    block_rows = rows_for(sources.sparkSession.sparkContext.defaultParallelism, n or 0, max(256, min(8192, (4 << 20) // (8 * max(1, wide or 1)))))
    group = F.lit("0")
    return block_topk(_vector_rows(sources, group, id_col, vector), _vector_rows(candidates, group, id_col, vector), k, _vectors, _cosines, block_rows).drop("g")


def prescreen_candidates(list_tags: DataFrame, popularity: DataFrame, k: int = 450, boosts: DataFrame | None = None, block_rows: int | None = None, sources: DataFrame | None = None, there: DataFrame | None = None, hold_bytes: int | None = None) -> DataFrame:
    """(source, candidate, hits, rnk): candidates with a tag in common, by the summed
    weight of the predicates that hold, each counted once; ties by popularity and id. `sources`(source): those that are asked for, else all;
    with `there`(candidate) a column of that name says whether it has the candidate.

    boosts(item_id, field, tag), with fields boost:identity, boost:setting and
    boost:music, add to the bases' tags. Tags may be held by a large share of
    all items, so pairs are not joined by tag: blocks of items meet (`block_topk`). Items that ask for the same tags are one kind of sources, and
    items that give the same one kind of candidates. A task holds candidates by kinds and looks at those that can be
    among a source's best (`prescreen.Held`), for work that grows with the sources and with how many these are."""
    code = F.coalesce(*(F.when(F.col("field") == f, F.lit(i)) for i, f in enumerate(FIELDS)))
    tag = lambda d: d.select("item_id", code.alias("f"), F.trim("tag").alias("tag")).where("item_id is not null and f is not null and tag <> ''").select(F.col("item_id").cast("long").alias("id"), F.struct("f", F.xxhash64("tag").alias("t")).alias("x"))
    own = tag(list_tags).groupBy("id").agg(F.array_sort(F.collect_set("x")).alias("tags"))
    asked = own if boosts is None else tag(list_tags).unionByName(tag(boosts)).groupBy("id").agg(F.array_sort(F.collect_set("x")).alias("tags"))
    rank = popularity.groupBy(F.col("candidate").cast("long").alias("id")).agg(F.max("popularity").cast("double").alias("popularity"))
    known = own.join(rank, "id", "left")
    known = known.withColumn("there", F.lit(True)) if there is None else known.join(there.select(F.col("candidate").cast("long").alias("id"), F.lit(True).alias("there")).distinct(), "id", "left")
    alike = W.partitionBy("tags").orderBy("tie", "id")
    first = known.select("id", "tags", F.coalesce(-F.col("popularity"), F.lit(float("inf"))).alias("tie"), F.coalesce("there", F.lit(False)).alias("there")).withColumn("pos", F.row_number().over(alike)).where(F.col("pos") <= k + 1)
    kinds = first.groupBy("tags").agg(F.min("id").alias("id"), F.collect_list(F.struct("tie", "id", "there")).alias("members"))
    if sources is not None:
        asked = asked.join(sources.select(F.col("source").cast("long").alias("id")).distinct(), "id", "left_semi")
    # A kind of very many sources, or sources of one signature and genres, are the work of many tasks.
    part = F.floor((F.row_number().over(W.partitionBy("tags").orderBy("id")) - 1) / _KIND_SOURCES)
    asks = asked.withColumn("part", part).groupBy("tags", "part").agg(F.min("id").alias("id"), F.collect_list("id").alias("members"))
    lead = F.xxhash64(F.filter("tags", lambda x: x["f"].isin([FIELDS.index(f) for f in LEADING])))
    asks = asks.withColumn("lead", lead).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("lead"))).withColumn("deal", F.xxhash64("lead", F.pmod("id", F.ceil(F.col("n") / 256))))
    block = lambda d, *more: d.select(F.lit("").alias("g"), "id", F.lit(0.0).alias("tie"), *more, "tags", "members")
    asks, kinds = Staged(block(asks, "deal"), "prescreen-sources").df, Staged(block(kinds), "prescreen-candidates").df
    rows = block_rows or max(1, min(2048, asks.count() // (8 * list_tags.sparkSession.sparkContext.defaultParallelism)))
    search = Search(best_of(k), "source long, candidate long, tie double, score long, there boolean, rnk int", pack_candidates, block_rows or 50_000, hold_bytes or Search.hold_bytes)
    best = block_topk(asks, kinds, k, pack_sources, None, rows, search)
    return best.select("source", "candidate", F.col("score").alias("hits"), *(() if there is None else ("there",)), "rnk")


#: Sources of one kind that a block's row stands for.
_KIND_SOURCES = 4096


def place_rank() -> Column:
    """A candidate's rank for a member of its list: the member's own `place` moves later ones up by one."""
    return F.col("at") - F.coalesce((F.col("place") < F.col("at")).cast("int"), F.lit(0))


def retrieve_candidates(precomputed: DataFrame | SharedLists, prescreened: DataFrame | Callable[[DataFrame | None], DataFrame], nearest: DataFrame | Callable[[DataFrame], DataFrame], limit: int = 300, changed: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """(source, candidate, rnk): the stored candidates of a source if it has any, else a live list: nearest ones for
    default weights; prescreened and nearest ones in turn for the sources of `changed`(source), whose weights or boosts are
    not the default (without it, for all).

    Only candidates that `items`(item_id) has count, at their place in the list; a source of whose first `limit` stored
    candidates none is left gets a live list too.

    Stored candidates may be shared lists with `place` and `at`: which sources have any is then read off the lists. Live lists may be
    functions, so that none is made that stored ones replace: prescreened(sources) makes those of sources(source), nearest(without)
    all but those of without(source). Ranks of live lists count from 1 and repeat no candidate, so that places beyond `limit` are never given. A
    column `there` of a live list says whether `items` has the candidate; without it the pairs are joined with `items`."""
    from tagloom.operators.tables import interleave

    # Both sides are sorted and shuffled: ids in parquet are so small that Spark would broadcast any number of them.
    held = None if items is None else items.select(F.col("item_id").alias("candidate")).distinct()
    there = (lambda d: d) if items is None else lambda d: d.join(held.hint("merge"), "candidate", "left_semi")
    if isinstance(precomputed, SharedLists):
        lists = SharedLists(precomputed.members, Staged(there(precomputed.listed), "stored").df)
        stored = lists.pairs().select("source", "candidate", place_rank().cast("int").alias("rnk")).where(F.col("rnk") <= limit)
        has = Staged(_with_any(lists, limit), "has-stored").df
    else:
        stored = there(precomputed.where(F.col("rnk") <= limit).select("source", "candidate", F.col("rnk").cast("int").alias("rnk")))
        has = stored.select("source").distinct()
    without = lambda d: d.join(has.hint("merge"), "source", "left_anti")
    apart = None if changed is None else Staged(without(changed.select("source").distinct()), "changed").df
    fine = prescreened(apart) if callable(prescreened) else prescreened if apart is None else prescreened.join(apart, "source", "left_semi")
    fine, near = without(fine) if apart is None else fine, nearest(has) if callable(nearest) else without(nearest)

    def part(d: DataFrame, no: int) -> DataFrame:
        if items is not None and "there" not in d.columns:
            d = d.join(held.withColumn("there", F.lit(True)).hint("merge"), "candidate", "left")
        return d.where(F.col("rnk") <= limit).select("source", F.lit(no).alias("list_no"), "rnk", "candidate", *([] if items is None else [F.coalesce("there", F.lit(False)).alias("there")]))

    # Two lists of at most `limit` places a changed source: about a million rows a task.
    tasks = None if apart is None else max(apart.sparkSession.sparkContext.defaultParallelism, -(-2 * limit * apart.count() // 1_000_000))
    given = interleave(part(fine, 1).unionByName(part(near, 2)), limit, tasks=tasks)
    return stored.select("source", "candidate", "rnk").unionByName((given if items is None else given.where("there")).select("source", "candidate", "rnk"))


def _with_any(lists: SharedLists, limit: int) -> DataFrame:
    """(source) of the members that have a candidate other than themselves within the first `limit` places: one of the first two of their list."""
    first = lists.listed.withColumn("k", F.row_number().over(W.partitionBy("list_id").orderBy("at", "candidate"))).where("k <= 2")
    return lists.members.join(first.select("list_id", "candidate", "at"), "list_id").where((F.col("source") != F.col("candidate")) & (place_rank() <= limit)).select("source").distinct()


def search_keys(q: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, key): the fewest keys by which a query meets every name that can match it.

    A name that has all words of the query, or is similar to it by 0.3, shares 0.3 of
    the query's trigrams at least, so that it shares one of any 0.7 of them (and one more): the
    rarest in the names are taken. A name that contains the query shares the
    trigrams inside its words, of which the rarest is taken, or a word of
    one or two letters where it has no longer one."""
    df = names.select(F.explode("tn").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    pieces = lambda n: F.array_distinct(F.flatten(F.transform(F.filter(F.split("nq", " "), lambda w: F.length(w) >= n), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n))))))
    longest = F.array_max(F.transform(F.split("nq", " "), F.length))
    # Of trigrams that no name has, none can be shared; they still count among the 0.7.
    grams = q.select("query_id", F.size("tq").alias("all"), pieces(3).alias("inner"), F.explode("tq").alias("key")).join(df, "key", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("df", "key"))
    inside = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.array_contains("inner", F.col("key"))), "df", "key")) == 1
    some = grams.withColumn("rank", rank).withColumn("inside", inside & F.array_contains("inner", F.col("key")))
    kept = some.where((F.col("rank") <= F.col("all") - F.ceil(F.col("all") * 0.3 - 1e-9) + 1) | F.col("inside")).select("query_id", "key")
    short = q.where(longest < 3).select("query_id", F.element_at(F.when(longest == 2, pieces(2)).otherwise(pieces(1)), 1).alias("key"))
    return kept.unionByName(short).distinct()


def search_items(queries: DataFrame, items: DataFrame, k: int = 8) -> DataFrame:
    """The best `k` items of every query(query_id, q) by name.

    items(item_id, name, recommendations_total). A query and a distinct name meet by the
    query's rarest keys (`search_keys`); the five match rules are then judged on the
    pair. Points for similarity: 100 of the normalised and 40 of the lower-case strings. Blank queries find nothing.
    """
    word = r"[^\p{L}\p{N}]+"
    q = queries.select("query_id", "q").distinct().withColumn("nq", norm_search_text("q")).where("nq <> ''").withColumns({"tq": trigrams("nq"), "rq": trigrams("q", word)})
    names = items.select("name").where("name is not null").distinct().withColumn("nn", norm_search_text("name")).withColumns({"tn": trigrams("nn"), "rn": trigrams("name", word)})
    # Words of one and two letters are looked up by short queries alone.
    short = F.array_distinct(F.flatten(F.transform(F.array(F.lit(1), F.lit(2)), lambda n: F.flatten(F.transform(F.split("nn", " "), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, n)))))))
    keyed = names.select("name", F.explode(F.array_union("tn", short)).alias("key"))
    pairs = search_keys(q, names).join(keyed, "key").select("query_id", "name").distinct()
    x = pairs.join(q, "query_id").join(names, "name")
    alike = lambda a, b: F.when(F.size(a) + F.size(b) > 0, F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b) - F.size(F.array_intersect(a, b)))).otherwise(0.0)
    exact, starts, holds = F.col("nn") == F.col("nq"), F.col("nn").startswith(F.col("nq")), F.contains("nn", "nq")
    terms = F.size(F.array_except(F.split("nq", " "), F.split("nn", " "))) == 0
    x = x.withColumn("sim", alike("tq", "tn")).where(exact | starts | holds | terms | (F.col("sim") >= 0.3))
    points = lambda c, v: F.when(c, v).otherwise(0.0)
    named = points(exact, 10000.0) + points(starts, 500.0) + points(holds, 250.0) + points(terms, 120.0) + F.col("sim") * 100.0 + alike("rq", "rn") * 40.0 - F.length("name") * 0.03
    x = x.select("query_id", "name", named.alias("named")).join(items.select("item_id", "name", "recommendations_total"), "name")
    rec = F.greatest(F.coalesce("recommendations_total", F.lit(0)), F.lit(0))
    x = x.withColumn("score", F.round(F.col("named") + F.log1p(rec.cast("double")) * 3.0, 6)).where("score > 0")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.length("name"), F.lower("name"), "item_id")
    return x.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k).select("query_id", "item_id", "name", "score", "rnk")


def resolve_titles(titles: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """(title, item_id, name, place): items that share a word with a title, exact
    names first, then names and titles that contain each other, then by name.

    Common words are not joined with each other. Of the names that only share a word, the first
    `most` of each word are enough, since their order is the same for all
    titles. Where one string contains another, all words of the inner one but its first and last stand in
    the outer one, so that the two meet by its rarest one; an inner string of two words or less is
    looked up by each."""
    first = items.where("name is not null").withColumn("k", F.row_number().over(W.partitionBy("name").orderBy("item_id"))).where(F.col("k") <= most).select("item_id", "name")
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    t = titles.select("title").distinct().withColumn("text", norm_search_text("title")).where("text <> ''").withColumn("words", split("text"))
    n = first.select("name").distinct().withColumn("text", norm_search_text("name")).where("text <> ''").withColumn("words", split("text"))
    word = F.explode(F.array_distinct("words")).alias("word")
    in_titles, in_names = t.select("title", word), n.select("name", word)
    df = in_names.groupBy("word").agg(F.count(F.lit(1)).alias("df"))

    def keys(d: DataFrame, name: str) -> DataFrame:
        inner = d.where(F.size("words") > 2).select(name, F.explode(F.slice("words", 2, F.size("words") - 2)).alias("word")).join(df, "word", "left")
        rare = inner.withColumn("k", F.row_number().over(W.partitionBy(name).orderBy(F.coalesce("df", F.lit(0)), "word"))).where("k = 1").select(name, "word")
        return rare.unionByName(d.where(F.size("words") <= 2).select(name, word))

    held = in_titles.join(keys(n, "name"), "word").select("title", "name").union(keys(t, "title").join(in_names, "word").select("title", "name")).distinct()
    both = held.join(t.select("title", F.col("text").alias("a"), F.col("words").alias("aw")), "title").join(n.select("name", F.col("text").alias("b"), F.col("words").alias("bw")), "name")
    inside = both.where((F.contains("a", "b") | F.contains("b", "a")) & F.arrays_overlap("aw", "bw")).select("title", "name")
    lead = in_names.withColumn("k", F.row_number().over(W.partitionBy("word").orderBy("name"))).where(F.col("k") <= most)
    share = in_titles.join(lead, "word").select("title", "name")
    pairs = inside.union(share).distinct().join(first, "name")
    a, b = norm_search_text("title"), norm_search_text("name")
    order = W.partitionBy("title").orderBy(F.desc(a == b), F.desc(F.contains(a, b) | F.contains(b, a)), "name", "item_id")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("title", "item_id", "name", "place")


def zero_shot_join(images: DataFrame, labels: DataFrame, item: str = "item_id") -> DataFrame:
    """images(item, image_id, embedding) x labels(label, label_embedding), a fixed small
    table: softmax of the dot products of each image, mean per item and label, x 100."""
    dot = F.aggregate(F.zip_with("embedding", "label_embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x = images.crossJoin(F.broadcast(labels)).select(item, "image_id", "label", F.exp(F.round(dot, 9)).alias("e"))
    p = x.withColumn("p", F.col("e") / F.sum(F.col("e").cast("decimal(30,15)")).over(W.partitionBy("image_id")).cast("double"))
    return p.groupBy(item, "label").agg(F.round(F.sum(F.col("p").cast("decimal(20,12)")).cast("double") / F.count(F.lit(1)) * 100, 2).alias("score"))


def hashed_tf_embedding(text: Column, size: int = 64) -> Column:
    """Unit vector of hashed word counts; the default encoder."""
    words = F.filter(F.split(norm_search_text(text), " "), lambda w: w != "")
    at = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    counts = let(at, lambda held: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(held, lambda a: a == i)).cast("double")))
    both = let(counts, lambda c: F.struct(c.alias("c"), F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)).alias("n")))
    return let(both, lambda x: F.transform(x["c"], lambda v: F.when(x["n"] > 0, v / x["n"]).otherwise(0.0).cast("float")))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
