"""Personal data: detection and surrogates.

Detected entities are replaced by keyed surrogates of the same type and format:
digits stay digits, letters keep their script and case, separators stay, card
numbers keep their check digit's validity, addresses stay valid, names keep
their gender. A titled name counts with all its parts, and the parts also where they
stand without a title in the same text. A long number is a card where its check digit
is right or a word for cards stands before it. The same entity has the same surrogate in the whole corpus, and
different entities have different ones; so have the domains of addresses: candidate surrogates of all distinct
entities are compared, and where two meet, or where one is itself an entity of
the corpus, all but one are drawn again until none do. Where the space of a format is too
crowded (one-letter addresses of a domain, short phone numbers), later draws of
addresses, names and phone numbers are longer by a character every eight draws.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.tables import bounded_batches
from tagloom.llm.textblocks import utf8
from tagloom.plans.staging import Staged

TITLES = {
    "male": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н", "Κύριος", "السيد", "श्री"],
    "female": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Doña", "г-жа", "Κυρία", "السيدة", "श्रीमती"],
    "any": ["Dr", "Prof"],
}
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_MARKS = "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.category(c) in ("Mn", "Mc"))
_LETTER = rf"[^\W\d_][{_MARKS}]*"
_HAN = "㐀-䶿一-鿿"
#: Letters of scripts that put no spaces between words.
_SPACELESS = rf"{_HAN}぀-ヿ฀-໿က-႟ក-៿"
_NAME = rf"{_LETTER}(?:{_LETTER}|['’](?=[^\W\d_]))+|[{_HAN}]"
_CARD_CUE = re.compile(r"(?i)(?:card|visa|amex|maestro|kredit|karte|carte|tarjeta|карт)[^\d\n]{0,24}$")
_TITLE = "|".join(sorted(map(re.escape, _GENDER), key=len, reverse=True))
PATTERNS = [
    ("email", r"(?<![\w.+-])[\w.+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("card", r"(?<![\w.+-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w-])"),
    ("ssn", r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("ip", r"(?<![\w.-])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)"),
    ("ipv6", r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-. ]\d{3}[-. ]\d{4})(?![\w-])"),
]
_DIGITAL = re.compile("|".join(f"(?P<{k}>{p.replace(chr(92) + '1', '(?P=sep)').replace('([ -]?)', '(?P<sep>[ -]?)')})" for k, p in PATTERNS))
_GAP = r"(?:[ \t\xa0]+|[ \t\xa0]{0,8}\r?\n[ \t\xa0]{0,8})"
_TITLED = re.compile(rf"(?<!\w)(?P<titles>(?:{_TITLE})(?:\.?{_GAP}(?:{_TITLE})(?!\w))*)\.?{_GAP}(?=[^\W\d_])")
_WORD = re.compile(_NAME)
_RUN = re.compile(rf"[{_SPACELESS}][{_SPACELESS}{_MARKS}]*")
_INITIAL = re.compile(r"[^\W\d_]\.")
_JOINT = re.compile(r"[ \xa0]+|-")
_ELIDED = re.compile(r"[^\W\d_]{1,4}['’](?=[^\W\d_])")
_PARTICLE = re.compile(r"(?:v[ao]n(?: (?:de[rnm]?|het|'t))?|de(?: l[ao]s?)?|del|dell[aoe]|degli|dei|dalla|di|da|dos?|du|bin|bint|ibn|ben|a[fv]|ter|y|al(?=-)|el(?=-)|фон|ван|де)(?=[ \xa0-])")
_PARTICLES = set("van von den der de del della dello delle degli dei dalla di da do dos du la las le los bin bint ibn ben af av ter al el фон ван де".split())
KINDS = [k for k, _ in PATTERNS] + ["name"]
#: Draws after which surrogates grow by a character.
WIDER_AFTER = 8


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, key) of the entities, in order, not overlapping. The
    key is what coreferent mentions share. A name is one entity for each part:
    of several parts the last is the surname, of one part it is the surname. The
    parts of titled names are entities wherever else they stand in the text with
    a capital; particles stay."""
    out = [(m.start(), m.end(), m.lastgroup if m.lastgroup != "sep" else "card", m.group()) for m in _DIGITAL.finditer(text)]
    out = [(a, b, k, _key(k, t)) for a, b, k, t in out if k != "card" or luhn(_key(k, t)) or _CARD_CUE.search(text, max(0, a - 40), a)]
    out += _names(text, [(a, b) for a, b, _, _ in out])
    out.sort()
    return out


def _bare(word: str) -> str:
    return word[:-2] if word[-2:].casefold() in ("'s", "’s") else word


def _uncased(c: str) -> bool:
    """Is the letter of a script without capitals (or one whose names have none)?"""
    return "ა" <= c <= "ჿ" or not (c.isupper() or c.islower())


def _han(text: str, start: int, end: int) -> list[tuple[int, str]]:
    """Given name and surname of a name without spaces: of up to four signs, or the
    first three of a longer run, the first is the surname. Places as in the text."""
    run = text[start:end] if end - start <= 4 else text[start : start + 3]
    return [(start + 1, run[1:]), (start, run[:1])] if len(run) > 1 else [(start, run)]


def _parts(text: str, at: int) -> tuple[list[tuple[int, str]], int]:
    """(place, part) of the name from `at`, across particles and initials, and its
    end; the surname comes last. In scripts without capitals a name has at most two parts, in
    those without spaces it is one run."""
    run = _RUN.match(text, at)
    if run:
        parts = _han(text, at, run.end()) if re.match(f"[{_HAN}]", text[at]) else [(at, run.group())]
        return parts, max(a + len(p) for a, p in parts)
    parts, end = [], at
    while len(parts) < 2 or not _uncased(parts[-1][1][0]):
        m = _PARTICLE.match(text, at) or _INITIAL.match(text, at)
        if m:
            if m.group().endswith(".") and not m.group()[0].isupper():
                break
        else:
            m = _WORD.match(text, at)
            if not m or m.group() in _GENDER:
                break
            start, word = m.start(), m.group()
            elided = _ELIDED.match(word)
            if elided and not word[0].isupper() and word[elided.end()].isupper():
                start, word = start + elided.end(), word[elided.end() :]
            if not (word[0].isupper() or _uncased(word[0])) or len(word) < 2:
                break
            part = _bare(word)
            parts.append((start, part))
            end = start + len(part)
            if part != word:
                break
        joint = _JOINT.match(text, m.end())
        if not joint:
            break
        at = joint.end()
    return parts, end


def _names(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    out, kinds, done, at, runs = [], {}, set(), 0, {}
    while m := _TITLED.search(text, at):
        parts, at = _parts(text, m.end())
        at = max(at, m.end())
        gender = next((g for t in re.findall(r"[^\s.]+", m.group("titles")) if (g := _GENDER[t]) != "any"), "any")
        own = []
        for n, (start, p) in enumerate(parts):
            done.add(start)
            kind = "surname" if n == len(parts) - 1 else f"given_{gender}"
            kinds.setdefault(p.casefold(), kind)
            own.append((start, start + len(p), kind, _key(kind, p)))
        out += own
        if own and _RUN.match(own[0][3]):
            first = min(a for a, _, _, _ in own)
            runs.setdefault(text[first:at], [(a - first, b - first, k, e) for a, b, k, e in own])
            for a, b, k, e in own:
                if b - a > 1:
                    runs.setdefault(text[a:b], [(0, b - a, k, e)])
        for a, b, k, e in own:  # endings are written to a name without a space
            if b - a > 1 and "가" <= e[0] <= "힣":
                runs.setdefault(text[a:b], [(0, b - a, k, e)])
    if runs:  # names without spaces, inside of longer runs too; a single sign only where it stands alone
        forms = sorted(runs, key=len, reverse=True)
        for m in re.finditer("|".join(re.escape(f) if len(f) > 1 else rf"(?<!\w){re.escape(f)}(?!\w)" for f in forms), text):
            here = [(m.start() + a, m.start() + b, k, e) for a, b, k, e in runs[m.group()]]
            out += [x for x in here if x[0] not in done]
            done.update(a for a, _, _, _ in here)
    if kinds:
        follows = None  # the place of the next word, if that is a part
        for m in reversed(list(_WORD.finditer(text))):
            start, word = m.start(), m.group()
            elided = _ELIDED.match(word)
            if elided and word.casefold() not in kinds and _bare(word).casefold() not in kinds:
                start, word = start + elided.end(), word[elided.end() :]
            p = word if word.casefold() in kinds else _bare(word)
            kind = kinds.get(p.casefold())
            if start in done:
                follows = start
                continue
            clear = re.match(r"\w", text[m.end() : m.end() + 1]) or (start and re.match(r"\w", text[start - 1]))
            alone = p.casefold() in _PARTICLES and (follows is None or not _JOINT.fullmatch(text, m.end(), follows))
            if kind is None or not (p[0].isupper() or _uncased(p[0])) or _RUN.match(p) or clear or alone:
                follows = None
                continue
            follows = start
            out.append((start, start + len(p), kind, _key(kind, p)))
    starts, ends = [a for a, _ in taken], [b for _, b in taken]  # in order and apart, so that one of them may overlap at most from the left
    return [x for x in out if (k := bisect_left(starts, x[1])) == 0 or ends[k - 1] <= x[0]]


def _key(kind: str, text: str) -> str:
    if kind in ("email", "ipv6") or kind.startswith(("given", "surname")):
        return text.casefold()
    if kind in ("card", "iban", "ssn"):
        return re.sub(r"[^0-9A-Za-z]", "", text)
    if kind == "phone":
        return re.sub(r"\D", "", text)
    return text


class _Stream:
    """Keyed pseudo-random numbers below a bound."""

    def __init__(self, secret: bytes, *parts: str) -> None:
        self.secret, self.seed, self.n, self.pool = secret, "\x1f".join(parts).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, bound: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.new(self.secret, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % bound


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


_ALPHABETS = {
    "latin": ("bcdfghklmnprstvz", "aeiou"),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу"),
    "greek": ("βγδκλμνπρστ", "αεηιοω"),
}
_ENDINGS = {"latin": {"male": ["o", "us", "in", "ert"], "female": ["a", "ine", "elle", "ia"]}, "cyrillic": {"male": ["ий", "ор", "ан"], "female": ["а", "ия", "ина"]}, "greek": {"male": ["ος", "ης", "ας"], "female": ["α", "η", "ω"]}}


@lru_cache(4096)
def _script(text: str) -> str:
    """Script of the first letter, by its Unicode name."""
    first = next((c for c in text if c.isalpha()), "a")
    return unicodedata.name(first, "LATIN").split()[0].lower()


@lru_cache(None)
def _pool(script: str) -> str:
    """Small letters of a script; of one that is not known, Latin ones."""
    if script in _ALPHABETS:
        return "".join(_ALPHABETS[script])
    ranges = {"cjk": [range(0x4E00, 0x9FA6)], "hangul": [range(0xAC00, 0xD7A4)]}.get(script, [range(0x250, 0x3100), range(0xA000, 0xABC0), range(0x10000, 0x1E950)])
    name = script.upper() + " "
    found = "".join(c for r in ranges for c in map(chr, r) if c.isalpha() and unicodedata.category(c) in ("Ll", "Lo") and unicodedata.name(c, "").startswith(name))
    return found or "".join(_ALPHABETS["latin"])


def _pool_of(c: str) -> str:
    return "0123456789" if c.isdigit() and c.isascii() else "abcdefghijklmnopqrstuvwxyz" if c.isascii() else _pool(_script(c))


@lru_cache(4096)
def _host(secret: bytes, host: str) -> str:
    """The surrogate of a host name: a keyed permutation of the names of its pattern
    (which characters are digits, letters of which script, signs), so that
    different names never meet, and no name stays (but where it is all that its pattern allows)."""
    pools = [_pool_of(c) if c.isalnum() else "" for c in host]
    shape = [(p, i) for i, p in enumerate(pools) if p and host[i] in p]
    size = 1
    for p, _ in shape:
        size *= len(p)
    value = 0
    for p, i in shape:
        value = value * len(p) + p.index(host[i])
    pattern = "".join("?" if any(i == k for _, k in shape) else c for i, c in enumerate(host))
    # A shift by one between a permutation and its inverse leaves nothing in place.
    value = _permute(secret, pattern, (_permute(secret, pattern, value, size, False) + 1) % size, size, True) if size > 1 else value
    out = list(host)
    for p, i in reversed(shape):
        value, digit = divmod(value, len(p))
        out[i] = p[digit]
    return "".join(out)


def _permute(secret: bytes, tweak: str, value: int, size: int, back: bool, rounds: int = 6) -> int:
    """A keyed permutation of the numbers below `size`: a balanced Feistel network
    over the next even number of bits, repeated until the number is below `size`."""
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    order = range(rounds - 1, -1, -1) if back else range(rounds)
    while True:
        left, right = value >> half, value & mask
        for k in order:
            seed = b"%d:%d:" % (k, half) + tweak.encode("utf-8", "surrogatepass")
            if back:
                left, right = right ^ _digest(secret, seed, left, half), left
            else:
                left, right = right, left ^ _digest(secret, seed, right, half)
        value = (left << half) | right
        if value < size:
            return value


def _digest(secret: bytes, seed: bytes, value: int, bits: int) -> int:
    data = seed + b":" + value.to_bytes((value.bit_length() + 7) // 8 or 1, "big")
    out = b"".join(hmac.new(secret, data + bytes([n]), hashlib.sha256).digest() for n in range(-(-bits // 256)))
    return int.from_bytes(out, "big") & ((1 << bits) - 1)


def surrogate_key(kind: str, key: str, attempt: int, secret: bytes) -> str:
    """The normal form of the surrogate of an entity; `dress` gives it a mention's looks."""
    s = _Stream(secret, kind, key, str(attempt))
    more = attempt // WIDER_AFTER
    if kind in ("ssn", "phone", "card", "iban"):
        lead = {"iban": 4, "card": 1}.get(kind, 0)
        if kind == "phone" and len(key) > 10:
            lead = len(key) - 10  # the country's code
        out = [*key[:lead], *(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in key[lead:])]
        if kind == "phone":
            out += [str(s.below(10)) for _ in range(more)]
        if kind == "card":
            good = luhn(key)
            at = s.below(10)
            for k in range(10):
                out[-1] = str((at + k) % 10)
                if luhn("".join(out)) == good:
                    break
        if kind == "iban":
            out[2:4] = [str(s.below(10)), str(s.below(10))]
        return "".join(out)
    if kind == "ip":
        return ".".join([str(1 + s.below(223)), *(str(s.below(256)) for _ in range(3))])
    if kind == "ipv6":
        return "".join("0123456789abcdef"[s.below(16)] if c != ":" else c for c in key)
    if kind == "email":
        local, _, domain = key.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{_letters(local, s)}{_letters('x' * more, s)}@{_host(secret, host)}.{top}"  # a domain's addresses stay together
    if _script(key) not in _ALPHABETS:  # as many letters as the name has
        pool = _pool(_script(key))
        return "".join(pool[s.below(len(pool))] for c in key + "x" * more if c.isalpha())
    con, vow = _ALPHABETS[_script(key)]
    stem = "".join(con[s.below(len(con))] + vow[s.below(len(vow))] for _ in range(2 + s.below(2) + more))
    if kind.startswith("given"):
        ends = _ENDINGS[_script(key)]
        gender = kind.removeprefix("given_")
        tail = ends.get(gender) or ends["male"] + ends["female"]
        return stem[:-1] + tail[s.below(len(tail))]
    return stem + con[s.below(len(con))]


def _letters(text: str, s: _Stream) -> str:
    out = []
    for c in text:
        if c.isdigit() and c.isascii():
            out.append(str(s.below(10)))
        elif c.isalpha():
            pool = _pool(_script(c))
            out.append(pool[s.below(len(pool))])
        else:
            out.append(c)
    return "".join(out)


def dress(kind: str, mention: str, surrogate: str) -> str:
    """The surrogate with the case and separators of the mention."""
    if kind in ("card", "iban", "ssn", "phone"):
        it = iter(surrogate)
        return "".join(next(it) if c.isalnum() else c for c in mention) + "".join(it)
    if mention.isupper() and any(c.isalpha() for c in mention):
        return surrogate.upper()
    if kind == "surname" or kind.startswith("given"):
        return surrogate[:1].upper() + surrogate[1:] if mention[:1].isupper() else surrogate
    if len(mention) == len(surrogate):
        return "".join(b.upper() if a.isupper() else b for a, b in zip(mention, surrogate, strict=True))
    return surrogate


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = {(k, e) for t in _texts(batch) for _, _, k, e in find(t)}
        rows = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["kind", "entity"])


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    """The texts in which a pattern may occur; '' stands for the others."""
    raw, off = utf8(batch.column("text"))
    maybe = ((raw >= 48) & (raw <= 57)) | (raw == 64)
    total = maybe.cumsum() if len(raw) else None
    for i, t in enumerate(batch.column("text").to_pylist()):
        if t is None:
            yield ""
            continue
        a, b = off[i], off[i + 1]
        some = b > a and (total[b - 1] - (total[a - 1] if a else 0)) > 0
        yield t if some or _TITLED.search(t) else ""


def _draw(secret: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, keys, tries = (batch.column(c).to_pylist() for c in ("kind", "entity", "attempt"))
            out = [surrogate_key(k, e, a, secret) for k, e, a in zip(kinds, keys, tries, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "entity", "attempt", "mixed")), pa.array(out, pa.string())], names=["kind", "entity", "attempt", "mixed", "surrogate"])

    return run


def _base(kind: str = "kind"):
    """Given names of all genders are looked up as one kind."""
    return F.when(F.col(kind).startswith("given"), F.lit("given")).otherwise(F.col(kind))


def _looked_up(kind: str) -> str:
    return "given" if kind.startswith("given") else kind


def _space(kind: str = "kind"):
    """Names of all kinds share one space, so that no two of a text look alike."""
    return F.when(F.col(kind).startswith("given") | (F.col(kind) == "surname"), F.lit("name")).otherwise(F.col(kind))


def registry(docs: DataFrame, secret: bytes, text_col: str = "text", max_rounds: int = 40) -> tuple[DataFrame, int]:
    """(kind, entity, attempt, mixed) of all distinct entities, with how many needed
    more than the first draw or are given names met with several genders (mixed), whose
    kind differs from a mention's. Rounds go on while surrogates meet each other or an entity."""
    found = bounded_batches(docs).select(F.col(text_col).alias("text")).where("text is not null").mapInArrow(_entities, "kind string, entity string").distinct()
    # A given name met with titles of several genders is one entity all the same.
    met = {g: F.max((F.col("kind") == f"given_{g}").cast("int")).alias(g) for g in ("male", "female", "any")}
    found = found.groupBy(_base().alias("base"), "entity").agg(*met.values())
    gender = F.when(F.col("male") == F.col("female"), "any").when(F.col("male") == 1, "male").otherwise("female")
    kind = F.when(F.col("base") == "given", F.concat(F.lit("given_"), gender)).otherwise(F.col("base"))
    now = Staged(found.select(kind.alias("kind"), "entity", F.lit(0).cast("long").alias("attempt"), (F.col("male") + F.col("female") + F.col("any") > 1).alias("mixed")), "entities")
    schema = "kind string, entity string, attempt long, mixed boolean, surrogate string"
    for _ in range(max_rounds):
        drawn = now.df.select("kind", "entity", "attempt", "mixed").mapInArrow(_draw(secret), schema).withColumn("space", _space())
        first = drawn.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "entity")).alias("winner"), F.count(F.lit(1)).alias("c"))
        real = now.df.select(_space().alias("space"), F.col("entity").alias("surrogate"), F.lit(True).alias("real")).distinct()
        judged = drawn.join(first, ["space", "surrogate"]).join(real, ["space", "surrogate"], "left")
        lost = F.col("real").isNotNull() | ((F.col("c") > 1) & (F.struct("kind", "entity") != F.col("winner")))
        after = Staged(judged.select("kind", "entity", (F.col("attempt") + F.when(lost, 1).otherwise(0)).alias("attempt"), "mixed", lost.alias("lost")), "entities")
        again = after.df.where("lost").count()
        now.drop()
        now = Staged(after.df.drop("lost"), "entities") if again else after
        if again:
            after.drop()
        else:
            return now.df.drop("lost"), now.df.where("attempt > 0 or mixed").count()
    raise RuntimeError("surrogates still collide; raise max_rounds")


def _replace(text: str, secret: bytes, attempts: dict, counts: dict[str, int]) -> str:
    out, at = [], 0
    for a, b, kind, key in find(text):
        if a < at:
            continue
        kind, attempt = attempts.get((_looked_up(kind), key), (kind, 0))
        out += [text[at:a], dress(kind, text[a:b], surrogate_key(kind, key, attempt, secret))]
        counts["name" if kind == "surname" or kind.startswith("given") else kind] += 1
        at = b
    out.append(text[at:])
    return "".join(out)


def _apply(secret: bytes, attempts: dict | None, carried: list[str], counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            redrawn = batch.column("redrawn").to_pylist() if attempts is None else None
            for i, (t, maybe) in enumerate(zip(batch.column("text").to_pylist(), _texts(batch), strict=True)):
                own = attempts if redrawn is None else {(_looked_up(x["kind"]), x["entity"]): (x["kind"], x["attempt"]) for x in redrawn[i] or []}
                c = dict.fromkeys(KINDS, 0)
                texts.append(_replace(t, secret, own, c) if maybe else t)
                counts.append([c[k] for k in KINDS])
            extra = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))] if counted else []
            yield pa.RecordBatch.from_arrays([*(batch.column(f"c{i}") for i in range(len(carried))), pa.array(texts, batch.column("text").type), *extra], names=[*(f"c{i}" for i in range(len(carried))), "text", *([f"n_{k}" for k in KINDS] if counted else [])])

    return run


def replace_pii(docs: DataFrame, secret: str, text_col: str = "text", broadcast_rows: int = 200_000, counted: bool = False) -> DataFrame:
    """`docs` with surrogates in `text_col`; other columns stay. With `counted`,
    columns n_<kind> with the number of replacements follow (they replace columns
    of those names).

    A null text stays null; texts without entities stay as they are. Equal texts
    become equal texts. Entities that needed more than one draw are sent to all
    tasks while at most `broadcast_rows`; beyond it they reach the texts that
    mention them by a join on the text's digest.
    """
    key = secret.encode()
    entities, redrawn = registry(docs, key, text_col)
    extra = [f"n_{k}" for k in KINDS] if counted else []
    carried = [c for c in docs.columns if c != text_col and c not in extra]
    renamed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)), F.col(text_col).alias("text"))
    again = entities.where("attempt > 0 or mixed")
    if redrawn <= broadcast_rows:
        attempts = {(_looked_up(r.kind), r.entity): (r.kind, r.attempt) for r in again.collect()} if redrawn else {}
    else:
        attempts = None
        renamed = with_redrawn(renamed, again)
    schema = renamed.select(*(f"c{i}" for i in range(len(carried))), "text").schema
    for c in extra:
        schema = schema.add(c, "long")
    out = renamed.mapInArrow(_apply(key, attempts, carried, counted), schema)
    named = {f"c{i}": c for i, c in enumerate(carried)} | {"text": text_col}
    order = [text_col if c == text_col else c for c in docs.columns if c == text_col or c in carried] + extra
    return out.select(*(F.col(a).alias(b) for a, b in named.items()), *extra).select(*(f"`{c}`" for c in order))


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d1, d2 = batch.column("d1").to_pylist(), batch.column("d2").to_pylist()
        rows = sorted({(d1[i], d2[i], _looked_up(k), e) for i, t in enumerate(_texts(batch)) for _, _, k, e in find(t)})
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["d1", "d2", "base", "entity"])


def with_redrawn(docs: DataFrame, again: DataFrame) -> DataFrame:
    """`docs` with an array `redrawn` of the (kind, entity, attempt) that its text mentions."""
    keyed = docs.withColumns({"d1": F.xxhash64("text"), "d2": F.xxhash64(F.reverse("text"), F.length("text"))})
    mentions = keyed.where("text is not null").select("d1", "d2", "text").mapInArrow(_mentions, "d1 long, d2 long, base string, entity string").distinct()
    lists = mentions.join(again.withColumn("base", _base()), ["base", "entity"]).groupBy("d1", "d2").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("redrawn"))
    return keyed.join(lists, ["d1", "d2"], "left").drop("d1", "d2")
