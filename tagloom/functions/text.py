"""Text and tag functions: Column in, Column out, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of tags.
ACRONYMS = {"2d": "2D", "3d": "3D", "4x": "4X", "4k": "4K", "ai": "AI", "jrpg": "JRPG", "mmo": "MMO", "npc": "NPC", "pve": "PvE", "pvp": "PvP", "rpg": "RPG", "rts": "RTS", "ui": "UI", "vr": "VR"}
IRREGULAR = {"actions": "action", "mechanics": "mechanic", "systems": "system", "themes": "theme", "stories": "story", "visuals": "visual", "vibes": "vibe"}
COMPOUNDS = [("co", "op"), ("fast", "paced"), ("post", "apocalyptic"), ("turn", "based")]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mapped(c: Column, table: dict[str, str]) -> Column:
    """The value of a short table, or the input itself."""
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(c) if out is not None else c


def collapse_ws(c) -> Column:
    """White-space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def norm_search_text(c) -> Column:
    """Lower case; runs of other than a-z and 0-9 become one space."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " "))


def norm_title(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"(?U)\s+", " "))


def label_norm(c) -> Column:
    return collapse_ws(F.translate(F.lower(F.trim(_col(c))), "_-", "  "))


def _stem(t: Column) -> Column:
    n = F.length(t)
    plural = F.when(t.endswith("ies") & (n > 4), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
    plural = plural.when(t.endswith("s") & (n > 4) & ~(t.endswith("ss") | t.endswith("us") | t.endswith("is")), F.substring(t, F.lit(1), n - 1))
    out = F.when(t == "", t)
    for k, v in IRREGULAR.items():
        out = out.when(t == k, v)
    return out.otherwise(plural.otherwise(t))


def tokenize_tag(c) -> Column:
    """Array of lower-case stemmed tokens."""
    found = F.regexp_extract_all(F.translate(F.lower(_col(c)), "_-", "  "), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), _stem)


def normalize_tag(c) -> Column:
    """Tokens joined by spaces, fixed compounds by a hyphen."""
    out = F.array_join(tokenize_tag(c), " ")
    for a, b in COMPOUNDS:
        out = F.regexp_replace(out, rf"(^| ){a} {b}(?= |$)", f"$1{a}-{b}")
    return out


def format_display(c) -> Column:
    parts = F.split(normalize_tag(c), " ")
    return F.array_join(F.transform(parts, lambda p: mapped(p, ACRONYMS)), " ")


def head_token(c) -> Column:
    """The last token of the normal form; '' if there is none."""
    return F.substring_index(normalize_tag(c), " ", -1)


def token_jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both)).otherwise(0.0)


def trigrams(c, apart: str = "[^a-z0-9]+") -> Column:
    """Distinct trigrams of the words of a text, each padded by two spaces before
    and one after. `apart` is what stands between words."""
    words = F.filter(F.split(F.regexp_replace(F.lower(_col(c)), apart, " "), " "), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a, b) -> Column:
    return token_jaccard(trigrams(a), trigrams(b))


def all_terms_match(query, text) -> Column:
    """Every word of the query is a word of the text; false without words."""
    words = lambda c: F.filter(F.split(norm_search_text(c), " "), lambda w: w != "")
    q = words(query)
    return (F.size(q) > 0) & (F.size(F.array_except(q, words(text))) == 0)


def first_non_empty(*columns) -> Column:
    """The first value that is not blank, as it is; '' if there is none."""
    return F.coalesce(*(F.when(F.trim(F.coalesce(_col(c).cast("string"), F.lit(""))) != "", _col(c)) for c in columns), F.lit(""))


def first_wins(values: Column, key) -> Column:
    """The array without later elements whose key was seen before."""
    keys = F.transform(values, key)
    return F.filter(values, lambda x, i: F.array_position(keys, F.element_at(keys, (i + 1).cast("int"))) == i + 1)


def split_people(c) -> Column:
    """Comma list to trimmed names, first spelling of each kept."""
    names = F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), ","), lambda n: F.trim(n)), lambda n: n != "")
    return first_wins(names, F.lower)


def coerce_weight(c) -> Column:
    """An integer: of a number its whole part, of a text the first integer in it; else null."""
    s = F.trim(_col(c).cast("string"))
    return F.coalesce(s.try_cast("int"), F.when(s.try_cast("double").isNotNull() & ~s.rlike("(?i)nan|inf"), F.expr("1") * s.try_cast("double").cast("int")), F.regexp_extract(s, r"-?\d+", 0).try_cast("int"))


def strip_query(url) -> Column:
    return F.regexp_replace(_col(url), r"\?.*$", "")


def directory_url(url) -> Column:
    """The URL up to its last slash, without query; '' if there is none after the host."""
    return F.regexp_extract(strip_query(url), r"^(https?://[^/]+/(?:.*/)?)[^/]*$", 1)


def app_root_url(url) -> Column:
    """The URL through /apps/<id>/; '' elsewhere."""
    return F.regexp_extract(strip_query(url), r"^(.*/apps/\d+/)", 1)


def concept_tokens(tag, synonyms: dict[str, str], phrases: dict[tuple[str, str], tuple[str, ...]]) -> Column:
    """Tokens of the normal form with word and two-word synonyms applied, left to right."""
    tokens = tokenize_tag(normalize_tag(tag))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), F.lit(None).cast("string").alias("held"))

    def push(out: Column, held: Column) -> Column:
        return F.when(held.isNull(), out).otherwise(F.concat(out, F.array(mapped(held, synonyms))))

    def step(acc: Column, t: Column) -> Column:
        joined = None
        for (a, b), to in phrases.items():
            hit = (acc["held"] == a) & (t == b)
            value = F.concat(acc["out"], F.array(*map(F.lit, to)))
            joined = F.when(hit, value) if joined is None else joined.when(hit, value)
        is_pair = F.coalesce(joined.isNotNull(), F.lit(False)) if joined is not None else F.lit(False)
        plain = push(acc["out"], acc["held"])
        return F.struct((F.when(is_pair, joined).otherwise(plain) if joined is not None else plain).alias("out"), F.when(is_pair, F.lit(None).cast("string")).otherwise(t).alias("held"))

    return F.aggregate(tokens, start, step, lambda acc: push(acc["out"], acc["held"]))
