"""Token profiles of the tag-grouping stages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.text import concept_tokens


@dataclass(frozen=True)
class Profile:
    synonyms: dict[str, str]
    phrases: dict[tuple[str, str], tuple[str, ...]]
    wrappers: list[str]
    generic: list[str] = field(default_factory=list)
    least_length: int = 1
    digits: bool = True


# Word lists of the stages.
_NUMBER = {"games": "game", "mechanics": "mechanic", "options": "option", "systems": "system", "titles": "title"}
_LINKS = ["a", "an", "and", "based", "driven", "focused", "for", "in", "of", "style", "styles", "the", "with"]
_GENERIC = [
    "action", "challenge", "content", "design", "dynamic", "experience", "feature", "fun", "game", "gameplay", "issue", "mechanic", "mode", "option", "problem", "request", "simulation", "skill", "strategy",
    "technical", "theme", "title", "tool", "usability",
]
V2 = Profile(
    {"contemporary": "modern", "current": "modern", "futuristic": "future"},
    {("present", "day"): ("modern",), ("near", "future"): ("future",)},
    [
        "a", "an", "area", "areas", "backdrop", "collection", "design", "environment", "environments", "experience", "experiences", "game", "games", "genre", "journey", "landscape", "location", "locations",
        "mode", "modes", "of", "place", "places", "realm", "realms", "series", "setting", "space", "spaces", "style", "styles", "theme", "themed", "type", "types", "universe", "variety", "visual", "visuals", "world", "worlds",
    ],
)
V3 = Profile(
    {"contemporary": "modern", "current": "modern", "futuristic": "future", "games": "game"},
    {("present", "day"): ("modern",), ("near", "future"): ("future",), ("mini", "games"): ("mini", "game")},
    [
        "a", "an", "and", "backdrop", "collection", "environment", "environments", "for", "genre", "in", "landscape", "location", "locations", "of", "on", "realm", "realms", "series", "setting", "style", "styles",
        "theme", "themes", "universe", "variety", "with", "world", "worlds",
    ],
)
_PAIRS = {("drag", "drop"): ("drag", "drop"), ("day", "night"): ("day", "night"), ("mini", "games"): ("mini", "game"), ("multi", "monitor"): ("multi", "monitor"), ("real", "time"): ("real", "time")}
V4 = Profile(_NUMBER, _PAIRS, _LINKS, [*_GENERIC, "mechanics", "options", "system"])
V5 = Profile(_NUMBER, _PAIRS, _LINKS, [*_GENERIC, "system"], least_length=2, digits=False)
V6 = Profile(
    _NUMBER | {"roguelite": "roguelike"},
    {("card", "roguelike"): ("deckbuilding", "roguelike"), ("deck", "building"): ("deckbuilding",), ("run", "based"): ("run-based",), ("meta", "progression"): ("meta-progression",), ("social", "sim"): ("social", "simulation")},
    [*_LINKS, "system", "systems"],
    _GENERIC,
)
PROFILES = {"v2": V2, "v3": V3, "v4": V4, "v5": V5, "v6": V6}


def semantic_tokens(tag, profile: Profile) -> Column:
    """Content tokens of a tag under a profile."""
    drop = [*profile.wrappers, *profile.generic]
    keep = lambda t: ~t.isin(drop) & (F.length(t) >= profile.least_length) & (F.lit(True) if profile.digits else ~t.rlike("^[0-9]+$"))
    return F.filter(concept_tokens(tag, profile.synonyms, profile.phrases), keep)


def concept_core(tag) -> Column:
    """Content of a tag without wrapper words; '' with fewer than two tokens."""
    tokens = semantic_tokens(tag, V2)
    return F.when(F.size(tokens) >= 2, F.array_join(tokens, " ")).otherwise("")
