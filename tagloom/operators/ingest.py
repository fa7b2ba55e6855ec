"""Clean-up of raw texts and semantics into typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import collapse_ws, first_wins
from tagloom.operators.tables import dedupe_merge_flags

# Entities that are undone.
ENTITIES = [("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def unescape_html(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def parse_languages(df: DataFrame, parent: str, html: str) -> DataFrame:
    """(parent, key, name, audio, subtitles): names of a list of languages, the first
    spelling of each; a star or `full audio` means audio, `subtitles` subtitles."""
    text = strip_tags(F.regexp_replace(unescape_html(F.col(html)), r"(?i)<br\s*/?>", "\n"))
    x = df.select(parent, F.posexplode(F.split(text, r"[,\n;]")).alias("pos", "raw"))
    low = F.lower("raw")
    name = F.trim(F.replace(F.regexp_replace("raw", r"\([^)]*\)", ""), F.lit("*"), F.lit("")))
    x = x.select(parent, "pos", name.alias("name"), (F.contains("raw", F.lit("*")) | F.contains(low, F.lit("full audio"))).alias("audio"), F.contains(low, F.lit("subtitles")).alias("subtitles")).where("name <> ''")
    return dedupe_merge_flags(x, parent, "name", "pos", ["audio", "subtitles"])


def clean_suggestions(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, item_id, name) of the anchors that name an item."""
    x = df.select(key, F.explode(F.split(html, "(?i)<a ")).alias("a"))
    item = F.regexp_extract("a", r"/app/(\d+)", 1).try_cast("long")
    body = F.regexp_extract("a", r"(?is)^[^>]*>(.*?)</a>", 1)
    return x.select(key, item.alias("item_id"), collapse_ws(unescape_html(strip_tags(body))).alias("name")).where("item_id is not null and name <> ''")


def coerce_json_list(raw: Column) -> Column:
    """A JSON list or scalar as an array of texts that are not blank; bad JSON is empty."""
    s = F.trim(raw)
    empty = F.array().cast("array<string>")
    as_list = F.from_json(s, "array<string>")
    scalar = F.from_json(F.concat(F.lit('{"v":'), s, F.lit("}")), "v string")["v"]
    values = F.when(s.startswith("["), F.coalesce(as_list, empty)).when(scalar.isNotNull(), F.array(scalar)).otherwise(empty)
    return F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))


def coerce_json_map(raw: Column) -> Column:
    """A JSON object as a map of texts; anything else is empty."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    parsed = F.from_json(raw, "map<string,string>")
    return F.when(F.trim(raw).startswith("{"), F.coalesce(F.map_filter(parsed, lambda k, v: v.isNotNull()), empty)).otherwise(empty)


def clean_vectors(vectors: Column, contexts: list[str]) -> Column:
    """A map of maps with the known contexts and positive integer weights alone."""
    return F.transform_values(F.map_filter(vectors, lambda k, v: k.isin(contexts)), lambda k, m: F.map_filter(F.transform_values(m, lambda t, w: w.try_cast("int")), lambda t, w: w > 0))


def clean_list(values: Column) -> Column:
    """Trimmed, blank ones left out, the first of equal labels kept."""
    return first_wins(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != ""), F.lower)


def repair_music(primary: Column, secondary: Column, legacy: Column) -> tuple[Column, Column]:
    """Music tags; where there are none, the first two of a legacy list."""
    old = clean_list(legacy)
    none = (F.trim(F.coalesce(primary, F.lit(""))) == "") & (F.trim(F.coalesce(secondary, F.lit(""))) == "")
    at = lambda i: F.coalesce(F.try_element_at(old, F.lit(i)), F.lit(""))
    return F.when(none, at(1)).otherwise(F.coalesce(primary, F.lit(""))), F.when(none, at(2)).otherwise(F.coalesce(secondary, F.lit("")))


def retrieval_document(name, signature, genres, tags, music, vector_tags) -> Column:
    """The text to embed: one line for each part that is not blank. vector_tags: array of `context:tag`."""
    parts = F.concat(F.array(name, signature), genres, tags, music, vector_tags)
    return F.array_join(F.filter(F.transform(parts, lambda p: F.trim(F.coalesce(p, F.lit("")))), lambda p: p != ""), "\n")


def query_repeats(weight: Column, step: int, most: int) -> Column:
    """How often a part is repeated for its weight: rounded half-even, from 1 to `most`."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.bround(weight / step, 0).cast("int")))


def query_document(parts: Column) -> Column:
    """parts: array of (text, times)."""
    return F.array_join(F.flatten(F.transform(parts, lambda p: F.array_repeat(p["text"], p["times"]))), "\n")


def query_parts(base: Column, lists: dict[str, Column], weights: dict[str, float], boosts: dict[str, dict[str, float]] | None = None, soundtrack: dict[str, float] | None = None) -> Column:
    """The (text, times) of an item's query for `query_document`, without blank ones.

    base: array of the item's own parts. For every context of a weight over 0 a `focus:` line and its first four tags of
    `lists` (arrays of its heaviest tags; for music all), each as often as the weight says (by 18, at most 5). Then the six
    heaviest boosts of each context, alone and as `context:tag`, and four of the soundtrack (by 24, at most 4). Weights and boosts are a
    profile, known when the query is planned."""
    times = lambda w, step, most: max(1, min(round(float(w) / step), most))
    part = lambda text, n: F.struct(text.alias("text"), F.lit(n).alias("times"))
    each = lambda texts, n: F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: part(t, n))
    out = [each(base, 1)]
    for context, w in weights.items():
        if w > 0:
            n = times(w, 18.0, 5)
            out.append(F.array(part(F.lit(f"focus:{context}"), n)))
            if context in lists:
                first = lists[context] if context == "music" else F.slice(lists[context], 1, 4)
                out.append(each(first, n))
    heaviest = lambda table, most: sorted(table.items(), key=lambda x: -x[1])[:most]
    for context, table in (boosts or {}).items():
        for tag, w in heaviest(table, 6):
            n = times(w, 24.0, 4)
            out.append(F.array(part(F.lit(tag), n), part(F.lit(f"{context}:{tag}"), n)))
    for tag, w in heaviest(soundtrack or {}, 4):
        out.append(F.array(part(F.lit(tag), times(w, 24.0, 4))))
    return F.filter(F.concat(*out), lambda p: F.trim(F.coalesce(p["text"], F.lit(""))) != "")


def serving_row(items: DataFrame, signals: DataFrame) -> DataFrame:
    """Items with signals, a search name, and '' or 0 for what is missing."""
    from tagloom.functions.text import norm_search_text

    x = items.join(signals, "item_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in signals.columns if c != "item_id"}
    return x.withColumns(zero | {"name": F.coalesce("name", F.lit("")), "search_name": norm_search_text(F.coalesce("name", F.lit("")))})


def image_sources(df: DataFrame, key: str, kinds: list[str], screenshots: str, most: int = 4) -> DataFrame:
    """(key, kind, url, pos): images in fixed order, then screenshots, each URL once."""
    named = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("url")) for k in kinds))
    shots = F.transform(F.slice(F.coalesce(screenshots, F.array().cast("array<string>")), 1, most), lambda u: F.struct(F.lit("screenshot").alias("kind"), u.alias("url")))
    every = F.filter(F.concat(named, shots), lambda x: F.trim(F.coalesce(x["url"], F.lit(""))) != "")
    once = first_wins(every, lambda x: x["url"])
    return df.select(key, F.posexplode(once).alias("pos", "x")).select(key, "x.kind", "x.url", "pos")


def evidence_text(evidence: dict[str, Column]) -> Column:
    lines = [F.lit("EVIDENCE SIGNALS:")]
    for label, values in evidence.items():
        joined = F.array_join(F.coalesce(values, F.array().cast("array<string>")), "; ")
        lines.append(F.concat(F.lit(f"- {label.replace('_', ' ')}: "), F.when(joined == "", "none").otherwise(joined)))
    return F.concat_ws("\n", *lines)


