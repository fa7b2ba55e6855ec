"""Secret scans: fixed patterns, and character Markov models of random strings
against ordinary identifiers compared by their log-likelihood ratio.

All of it is built-in column functions; only the counts of character pairs, of a
fixed alphabet, come to the driver.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Kinds in the order in which equal starts are listed.
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_SIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
#: A run that fails the least length has no later start within it that reaches it, so the length is part of these.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Strings that the Markov models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Strings that are taken for identifiers: words, and strings too short to be judged.
WORD = r"[A-Za-z]{2,}"
SHORT = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{5,19}(?![A-Za-z0-9+/_=-])"

_HITS = "array<struct<kind:int,gap:int,size:int,ok:boolean,token:string>>"

#: Pieces of up to 65 characters, each from the last character of the one before, so that pairs of characters are read in a time that grows with the string's length.
PIECE = r"(?s)(?=(.{2,65})).{1,64}"


def _matches(text: Column, pattern: str, kind: int, group: int | None = None, least: int = 0, keep: bool = False) -> Column:
    """Array of (kind, gap, size, ok, token) of the leftmost non-overlapping matches:
    how many code points lie between a match and the one before, and how many it
    has. Not ok: the group has fewer than `least` characters. token: the match, with `keep`."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def one(gap: Column, match: Column) -> Column:
        ok = F.length(F.regexp_extract(match, pattern, group)) >= least if group is not None else F.lit(True)
        return F.when(match.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.length(match).alias("size"), ok.alias("ok"), (match if keep else F.lit(None).cast("string")).alias("token")))

    return F.filter(F.zip_with(F.split(text, pattern, -1), found, one), lambda x: x.isNotNull())


def hits(text: Column) -> Column:
    """The matches of the three fixed kinds and of the candidates for the Markov models."""
    kinds = [(text.rlike(ASSIGN_SIGN), _matches(text, ASSIGN, 0, 2, 6)), (text.contains("AKIA"), _matches(text, ACCESS, 1)), (text.rlike(HEX), _matches(text, HEX, 2)), (text.rlike(CANDIDATE), _matches(text, CANDIDATE, 3, keep=True))]
    return F.concat(*(F.when(maybe, found).otherwise(F.array().cast(_HITS)) for maybe, found in kinds))


def pieces(token: Column) -> Column:
    return F.regexp_extract_all(token, F.lit(PIECE), F.lit(1))


@dataclass
class Markov:
    """ratio[128 a + b]: bits by which the pair of ASCII codes a, b favours random strings."""

    ratio: list[float]

    def mean_bits(self, token: Column) -> Column:
        """Mean log-likelihood ratio of a string's character pairs, in bits."""
        table = F.from_json(F.lit(json.dumps(self.ratio)), "array<double>")
        code = lambda piece, at: F.ascii(F.substring(piece, at, F.lit(1)))
        bits = lambda piece: F.aggregate(
            F.sequence(F.lit(1), F.length(piece) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(table, code(piece, i) * 128 + code(piece, i + F.lit(1)) + 1)
        )
        total = F.aggregate(pieces(token), F.lit(0.0), lambda acc, piece: acc + bits(piece))
        return F.when(F.length(token) > 1, total / (F.length(token) - 1)).otherwise(F.lit(0.0))


def fit(pairs: list[tuple[str, str, bool, int]], prior: float = 1.0, uniform: float = 0.1) -> Markov:
    """pairs: (character, next, random?, count). Both models are mixed with the
    uniform distribution over the alphabet. The random one gives it half of its weight,
    since a sample of few kinds of secrets must not speak for all; the plain one
    gives it the share `uniform`, so that one pair that no word of the sample has
    can't outweigh the rest of a string."""
    count = {True: {}, False: {}}
    for a, b, random, n in pairs:
        count[random][a, b] = count[random].get((a, b), 0) + n
    size = len(ALPHABET)
    ratio = [0.0] * (128 * 128)
    for a in ALPHABET:
        total = {r: sum(count[r].get((a, b), 0) for b in ALPHABET) for r in (True, False)}
        for b in ALPHABET:
            seen = {r: (count[r].get((a, b), 0) + prior) / (total[r] + prior * size) for r in (True, False)}
            random = 0.5 * seen[True] + 0.5 / size
            plain = (1 - uniform) * seen[False] + uniform / size
            ratio[128 * ord(a) + ord(b)] = round(math.log2(random / plain), 6)
    return Markov(ratio)


def learn(samples: DataFrame) -> Markov:
    """Models of labelled strings: (token, random, n), where n counts the string."""
    piece = samples.select("random", "n", F.explode(pieces(F.col("token"))).alias("piece"))
    pair = F.transform(F.sequence(F.lit(1), F.length("piece") - 1), lambda i: F.substring(F.col("piece"), i, F.lit(2)))
    letters = "[" + ALPHABET.replace("-", r"\-") + "]{2}"
    counted = piece.select("random", "n", F.explode(pair).alias("pair")).groupBy("random", "pair").agg(F.sum("n").alias("n")).where(F.col("pair").rlike(f"^{letters}$"))
    return fit([(r.pair[0], r.pair[1], r.random, r.n) for r in counted.collect()])  # at most 2 x 67 x 67 rows


def labelled(docs: DataFrame, text_col: str = "text", plain: Column | None = None) -> DataFrame:
    """(token, random, n): strings of the texts with their label and weight. Values
    that the fixed patterns mark are random. Words are not, nor are strings of fewer
    than 20 characters, what stands where identifiers join words (a sign, a capital
    or a number between a word's last letter and the next word's first), and lines
    drawn of one sign; these come from the rows that are `plain`, or from all."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), ACCESS, " "), HEX, " ")
    every = lambda column, pattern, group=0: F.regexp_extract_all(column, F.lit(pattern), F.lit(group))
    rest = rest if plain is None else F.when(plain, rest).otherwise("")
    rows = docs.select(text.alias("text"), rest.alias("rest")).select("text", "rest", every("rest", WORD).alias("w"))
    nothing = F.lit(None).cast("string")
    values = F.concat(F.filter(every("text", ASSIGN, 2), lambda v: F.length(v) >= 12), every("text", ACCESS), every("text", HEX))
    told = lambda tokens, kind: F.transform(tokens, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token"), nothing.alias("first")))
    edge = lambda word, at: F.lower(F.substring(word, at, 1))
    joints = F.zip_with("w", F.slice(F.col("w"), F.lit(2), F.size("w")), lambda w, v: F.struct(F.lit("joint").alias("kind"), edge(w, -1).alias("token"), edge(v, 1).alias("first")))
    found = F.concat(told(values, "secret"), told(every("rest", SHORT), "short"), told(F.col("w"), "word"), joints)
    counted = rows.select(F.explode(found).alias("x")).groupBy("x.kind", "x.token", "x.first").agg(F.count(F.lit(1)).alias("n"))
    token, last, first = F.col("token"), F.col("token"), F.coalesce("first", F.lit("a"))
    number = F.pmod(F.xxhash64("token", "first"), F.lit(10_000)).cast("string")
    signs = [F.concat(a, F.lit(sign), b) for sign in "_-/=" for a, b in ((last, first), (F.upper(last), F.upper(first)))]
    numbers = [F.concat(last, number, F.lit("-"), first), F.concat(last, F.lit("-"), number, F.lit("/"), first), F.concat(F.upper(last), F.lit("_"), number, first)]
    rules = [F.lit(4 * sign) for sign in "_-/=+"]  # lines drawn of signs
    weighed = lambda tokens, weight: [F.struct(t.alias("token"), (F.col("n") * weight).alias("n")) for t in tokens]
    told_plain = {"word": weighed([token, F.lower(token), F.upper(token), F.initcap(token)], 4), "short": weighed([token], 8), "joint": weighed([*signs, F.concat(last, F.upper(first)), *numbers, *rules], 1)}
    kinds = F.array(*weighed([token], 1))
    for kind, tokens in told_plain.items():
        kinds = F.when(F.col("kind") == kind, F.array(*tokens)).otherwise(kinds)
    return counted.select((F.col("kind") == "secret").alias("random"), F.explode(kinds).alias("x")).select("x.token", "random", "x.n")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000, plain_rows: int = 4_000) -> Markov:
    """Learns from the `labelled` strings of at most `sample_rows` documents, those of
    lowest id hash; their first `plain_rows` give the plain strings, of which every text has many."""
    order = [F.xxhash64("id"), F.col("id")]
    chosen = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().orderBy(*order).limit(sample_rows)
    chosen = chosen.withColumn("plain", F.row_number().over(W.orderBy(*order)) <= plain_rows)  # one task, of sample_rows ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return learn(labelled(rows, plain=F.col("plain")))


def scan(docs: DataFrame, model: Markov, id_col: str = "doc_id", text_col: str = "text", bits: float = 0.5) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans, n_markov) of each
    row's whole text; a null text is empty. `spans` lists kind:start:end by start
    and kind; a string of CANDIDATE's form whose mean ratio reaches `bits` is a
    `markov` span unless it overlaps a fixed one. Repeated rows are each scanned.

    Only the places of matches are shuffled, by row. Places are running sums of
    lengths, and overlaps are seen from the fixed spans next before and next after, so
    that the time grows with the length of a text and the number of its matches."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    found = rows.select("row", "id", hits(F.col("text")).alias("hits")).select("row", "id", F.posexplode_outer("hits").alias("at", "x"))
    told = F.when(F.col("x.kind") < 3, F.col("x.ok")).otherwise(model.mean_bits(F.col("x.token")) >= bits)
    each = found.select("row", "id", "at", F.col("x.kind").alias("k"), F.col("x.gap").alias("gap"), F.col("x.size").alias("size"), told.alias("ok")).repartition("row")
    stop = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("row", "k").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    spans = each.withColumn("e", stop).withColumn("s", F.col("e") - F.col("size"))
    fixed = lambda place: F.when(F.col("ok") & (F.col("k") < 3), F.col(place))
    before = F.max(fixed("e")).over(W.partitionBy("row").orderBy("s", "k").rowsBetween(W.unboundedPreceding, 0))
    after = F.min(fixed("s")).over(W.partitionBy("row").orderBy(F.desc("s"), F.desc("k")).rowsBetween(W.unboundedPreceding, 0))
    spans = spans.withColumn("before", before).withColumn("after", after)
    free = (F.coalesce("before", F.lit(0)) <= F.col("s")) & (F.coalesce(F.col("after") >= F.col("e"), F.lit(True)))
    kept = spans.select("row", "id", F.when(F.col("ok") & ((F.col("k") < 3) | free), F.struct("s", "k", "e")).alias("span"))
    listed = kept.groupBy("row").agg(F.first("id").alias("id"), F.array_sort(F.collect_list("span")).alias("spans"))
    names = F.array(*(F.lit(k) for k in KINDS))
    tell = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return listed.select(
        F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(tell(F.filter("spans", lambda x: x["k"] < 3)), 256).alias("base_sha256"),
        tell(F.col("spans")).alias("spans"), count(3).alias("n_markov"),
    )
