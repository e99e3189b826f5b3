"""Personal data replaced by surrogates.

An entity is a kind, a shape (what a surrogate must match: lengths, script, gender) and a canonical value, so that spellings
of one entity are one. Its surrogate is drawn with a secret key from kind, shape, value and the number of the
attempt; nothing of the text around goes in, so an entity has one surrogate in the whole corpus. Distinctness is checked
over all entities: a draw that another entity has drawn first, or that is itself an entity of the corpus, is drawn again.
Only entities that needed a second draw are looked up when texts are rewritten; the rest follow from the key.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.shared import strings, written

# What announces a name, and the gender it tells.
TITLES = {
    "mr": "m", "mister": "m", "sir": "m", "mrs": "f", "ms": "f", "miss": "f", "lady": "f", "dr": "n", "prof": "n",
    "herr": "m", "herrn": "m", "frau": "f", "monsieur": "m", "madame": "f", "mme": "f", "mademoiselle": "f",
    "señor": "m", "señora": "f", "sr": "m", "sra": "f", "don": "m", "doña": "f",
    "господин": "m", "госпожа": "f", "г-н": "m", "г-жа": "f", "κύριος": "m", "κυρία": "f",
}
# Titles that stand inside a run of titles or behind a name; "don" may be a given name there.
_NESTED = frozenset(TITLES) - {"don"}
# Small words inside a name, which stay; the name goes on after them.
PARTICLES = (
    "af", "al", "av", "bin", "d", "da", "dal", "das", "de", "degli", "dei", "del", "dell", "della", "den", "der", "des", "di", "do", "dos", "du", "e", "el",
    "ibn", "l", "la", "las", "le", "los", "ten", "ter", "van", "vom", "von", "y", "zu", "zum", "zur", "фон", "де", "ван",
)
# Words that begin sentences. As a name they are one only after a title, not where they stand alone.
COMMON = frozenset(
    "a after all an and as at but by for from he her here his how i if in is it its my no not of on one or our she so that the their then there these they "
    "this those to was we what when where which while who why with yes you your "
    "aber als am an auch auf aus bei da das dann der die ein eine er es hier ich ihr im in ist mit nach sein sie so um und uns von wenn wer wie wir zu "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les mais ne nous on ou où par pour que qui sa se si son sur tu un une vous "
    "al como con cuando de del el ella ellos en es la las lo los no o para pero por que se si su un una y yo "
    "а без был в все вот вы где для до его ее если и из или как к когда мы на не но о он она они от по с так то у что это я "
    "η και ο οι σε στη στο τα τη την της το τον του".split()
)
# Syllables of surrogate names by script, and how names of a gender end.
SYLLABLES = {
    "latin": ("ba", "be", "co", "da", "de", "fa", "ge", "jo", "ka", "la", "le", "li", "ma", "mi", "na", "no", "pe", "ra", "ro", "sa", "se", "ta", "ti", "vi"),
    "cyrillic": ("ба", "ве", "го", "да", "ди", "же", "за", "ка", "ле", "ли", "ма", "ми", "на", "но", "пе", "ра", "ро", "са", "се", "та", "ти", "фе"),
    "greek": ("βα", "γε", "δα", "δη", "θε", "κα", "λε", "λι", "μα", "μι", "να", "νο", "πε", "ρα", "ρο", "σα", "σε", "τα", "τι", "φε"),
}
ENDINGS = {
    "latin": {"m": ("n", "r", "s", "d"), "f": ("na", "ra", "lia", "sa"), "n": ("l", "m", "n", "ri")},
    "cyrillic": {"m": ("н", "р", "м"), "f": ("на", "ра", "ля"), "n": ("л", "н", "ри")},
    "greek": {"m": ("ς", "ρος", "νος"), "f": ("νη", "ρα", "λια"), "n": ("ν", "ς", "ρι")},
}
# After so many draws a surrogate may be one character longer, and again after as many.
PATIENCE = 16

_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "card": r"(?<![\d+])\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,5}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    # A title; the capitalised words and initials that follow it, over particles, are the name.
    "name": rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(TITLES, key=len, reverse=True)))})\.?(?=[ \u00a0])",
}
KINDS = tuple(PATTERNS)
_COMPILED = {kind: re.compile(p, re.IGNORECASE if kind == "name" else 0) for kind, p in PATTERNS.items()}

_INITIALS = r"[^\W\d_]\.(?:-?[^\W\d_]\.)*"
_SMALL = "|".join(sorted(PARTICLES, key=len, reverse=True))
_NEXT_PART, _AFTER_INITIALS = (
    re.compile(rf"(?:[ \u00a0]+(?:{_SMALL})(?=[ \u00a0]))*[ \u00a0]{many}(?:(?:{_SMALL})[-'’](?=[^\W\d_]))?(?:(?P<initials>{_INITIALS})|(?P<word>{_NAME}))")
    for many in "+*"
)
_POSSESSIVE = re.compile(r"['’][sS]\Z")
_ALONE, _PIECE = re.compile(rf"(?<!\w){_NAME}(?!\w)"), re.compile(r"[^\W\d_]+")

Entity = tuple[str, str, str]


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d)) % 10 + int(d) // 5 for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in f"{rest}{country}00")
    return f"{98 - int(number) % 97:02d}"


def script_of(word: str) -> str:
    for c in word:
        name = unicodedata.name(c, "")
        for script in ("CYRILLIC", "GREEK"):
            if name.startswith(script):
                return script.lower()
    return "latin"


def entities_in(text: str) -> list[tuple[int, int, Entity]]:
    """(start, end, entity) by place. Where kinds overlap the one listed first in PATTERNS stays; a name is an entity for each word.

    The words of a name found after a title are entities wherever else the text has them capitalised.
    """
    found: list[tuple[int, int, Entity]] = []
    taken: list[tuple[int, int]] = []
    digits = re.search(r"\d", text) is not None
    for kind, pattern in _COMPILED.items():
        if (kind == "email" and "@" not in text) or (kind not in ("email", "name") and not digits):
            continue
        others = tuple(taken)
        for match in pattern.finditer(text):
            own = list(_name(text, match, others) if kind == "name" else _entity(kind, match.group(), match.start()))
            if own and not any(own[0][0] < y and x < own[-1][1] for x, y in taken):
                found += own
                taken.append((own[0][0], own[-1][1]))
    named: dict[str, Entity] = {}
    for _a, _b, entity in found:
        value = entity[2]
        if entity[0] == "name" and len(value) > 1 and "." not in value and value not in COMMON:
            if value not in named or entity[1].endswith("family"):
                named[value] = entity
    if named:
        taken.sort()
        starts = [a for a, _b in taken]
        for a, b, entity in _mentions(text, named):
            before = bisect_right(starts, b - 1) - 1
            if before < 0 or taken[before][1] <= a:
                found.append((a, b, entity))
    return sorted(found)


def _value(word: str) -> str:
    return unicodedata.normalize("NFC", word).casefold()


def _mentions(text: str, named: dict[str, Entity]) -> Iterator[tuple[int, int, Entity]]:
    """Capitalised words of the text that are parts of its names, also inside words with hyphens."""
    for match in _ALONE.finditer(text):
        a = match.start()
        word = _POSSESSIVE.sub("", match.group())
        if word[0].isupper() and (entity := named.get(_value(word))):
            yield a, a + len(word), entity
        elif len(word) > 1 and not word.isalpha():
            for piece in _PIECE.finditer(word):
                if piece.group()[0].isupper() and (entity := named.get(_value(piece.group()))):
                    yield a + piece.start(), a + piece.end(), entity


def _name(text: str, title: re.Match, others: tuple[tuple[int, int], ...]) -> Iterator[tuple[int, int, Entity]]:
    """The parts of the name after a title; it ends before other kinds, titles and words in lower case that are no particles."""
    gender = TITLES[title.group().rstrip(".").lower()]
    parts: list[tuple[int, int]] = []
    at, pattern = title.end(), _NEXT_PART
    while match := pattern.match(text, at):
        kind = match.lastgroup
        a, b = match.span(kind)
        surface = _POSSESSIVE.sub("", match[kind])
        if not surface[0].isupper() or (kind == "word" and surface.casefold() in _NESTED) or any(a < y and x < b for x, y in others):
            break
        # An initial gives its stop up where a blank and another part follow; before that, the stop may end the sentence.
        if parts and text[parts[-1][1] : parts[-1][1] + 1] == "." and text[parts[-1][1] + 1] in " \u00a0":
            parts[-1] = (parts[-1][0], parts[-1][1] + 1)
        parts.append((a, a + len(surface) - (kind == "initials")))
        if len(surface) < b - a:
            break
        at, pattern = b, _AFTER_INITIALS if kind == "initials" else _NEXT_PART
    for number, (a, b) in enumerate(parts):
        # The last of several words is the family's; it has no gender of its own.
        part = "family" if number == len(parts) - 1 else f"given-{gender}"
        value = _value(text[a:b]).rstrip(".")
        yield a, b, ("name", f"{script_of(value)}-{part}", value)


def _entity(kind: str, surface: str, at: int) -> Iterator[tuple[int, int, Entity]]:
    if kind == "email":
        value = surface.casefold()
        yield at, at + len(surface), (kind, re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", value)), value)
    elif kind == "iban":
        value = surface.replace(" ", "")
        yield at, at + len(surface), (kind, f"{value[:2]}{len(value)}", value)
    elif kind == "ip":
        yield at, at + len(surface), (kind, ".".join(str(len(x)) for x in surface.split(".")), surface)
    else:
        value = re.sub(r"\D", "", surface)
        shape = f"{len(value)}" + ("-check" if kind == "card" and luhn(value) else "")
        yield at, at + len(surface), (kind, shape, value)


def _stream(key: bytes, *parts: str) -> Iterator[int]:
    turn = 0
    while True:
        yield from hmac.new(key, "\x1f".join((*parts, str(turn))).encode(), hashlib.sha256).digest()
        turn += 1


def surrogate(entity: Entity, key: bytes, attempt: int = 0) -> str:
    """The canonical value that stands for an entity, of the same kind and shape."""
    kind, shape, value = entity
    stream = _stream(key, kind, shape, value, str(attempt))
    below = lambda n: (next(stream) << 16 | next(stream) << 8 | next(stream)) % n
    digit = lambda: str(below(10))
    longer = attempt // PATIENCE
    if kind == "name":
        script, part = shape.split("-", 1)
        made = "".join(SYLLABLES[script][below(len(SYLLABLES[script]))] for _ in range(2 + below(2) + longer))
        gender = part.partition("-")[2] or "n"
        return made + ENDINGS[script][gender][below(len(ENDINGS[script][gender]))]
    if kind == "ip":
        # As many digits in each place as before; after long search, any.
        ranges = {1: (1, 10), 2: (10, 100), 3: (100, 255)}
        return ".".join(str(a + below(b - a)) for a, b in (ranges[len(x)] if not longer else (1, 255) for x in value.split(".")))
    if kind == "iban":
        rest = "".join(digit() if c.isdigit() else chr(65 + below(26)) for c in value[4:]) + "".join(digit() for _ in range(longer))
        return value[:2] + iban_check(value[:2], rest) + rest
    if kind == "email":
        local, _at, domain = value.rpartition("@")
        host, _dot, top = domain.rpartition(".")
        swap = lambda text: "".join(digit() if c.isdigit() else chr(97 + below(26)) if c.isalpha() else c for c in text)
        return f"{swap(local)}{''.join(digit() for _ in range(longer))}@{swap(host)}.{top}"
    if kind == "card":
        made = value[0] + "".join(digit() for _ in range(len(value) - 1 + longer))
        if shape.endswith("-check"):
            made = next(made[:-1] + str(d) for d in range(10) if luhn(made[:-1] + str(d)))
        return made
    return (str(1 + below(9)) if value[0] != "0" else "0") + "".join(digit() for _ in range(len(value) - 1 + longer))


def in_format(kind: str, surface: str, new: str) -> str:
    """A canonical surrogate in the spelling of a mention: its punctuation, spaces and case."""
    if kind == "name":
        return new.upper() if surface.isupper() and len(surface) > 1 and "." not in surface else new[:1].upper() + new[1:] if surface[:1].isupper() else new
    if kind == "ip":
        return new
    if kind == "email":
        if len(new) == len(surface):
            return "".join(b.upper() if a.isupper() else b for a, b in zip(surface, new))
        return new
    letters = iter(new)
    filled = "".join(next(letters) if c.isalnum() else c for c in surface)
    return filled + "".join(letters)


def _entity_rows(docs: DataFrame, text_col: str) -> DataFrame:
    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            found = {e for t in strings(batch.column(0)) for _a, _b, e in entities_in(t.decode("utf-8", "replace"))}
            columns = list(zip(*sorted(found))) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["kind", "shape", "value"])

    return docs.select(text_col).mapInArrow(batches, "kind string, shape string, value string")


def _drawn(entities: DataFrame, key: bytes, attempt: int) -> DataFrame:
    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(e, key, attempt) for e in rows], pa.string())], names=["kind", "shape", "value", "new"])

    return entities.mapInArrow(batches, "kind string, shape string, value string, new string")


def redrawn(entities: DataFrame, key: bytes) -> DataFrame | None:
    """(kind, shape, value, attempt) of the entities whose first draw clashed; None if there are none.

    A draw is good if it is no value of its kind in the corpus, no surrogate already given, and its entity is the
    first, by shape and value, of those that drew it now. The clashing entities shrink from turn to turn.
    """
    open_rows, attempt, given, found = entities, 0, None, None
    real = entities.select("kind", F.col("value").alias("new")).distinct()
    while True:
        draws = written(_drawn(open_rows, key, attempt), "draws")
        free = draws.join(real, ["kind", "new"], "left_anti")
        if given is not None:
            free = free.join(given, ["kind", "new"], "left_anti")
        first = free.groupBy("kind", "new").agg(F.min(F.struct("shape", "value")).alias("first"))
        good = written(first.select("kind", "new", "first.shape", "first.value"), "given")
        if attempt:
            settled = good.select("kind", "shape", "value", F.lit(attempt).alias("attempt"))
            found = settled if found is None else found.unionByName(settled)
        open_rows = written(draws.join(good, ["kind", "shape", "value"], "left_anti").select("kind", "shape", "value"), "clashes")
        if open_rows.isEmpty():
            return found
        taken = good.select("kind", "new")
        given = taken if given is None else given.unionByName(taken)
        attempt += 1


def with_surrogates(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced, and ``n_<kind>`` counts of the replacements.

    Null texts stay null and empty ones empty, with counts of 0. Equal texts get equal results, repeated rows too.
    Columns with the names of the counts are replaced.
    """
    counts = [f"n_{kind}" for kind in KINDS]
    docs = docs.drop(*counts, "_redrawn", "_text_key")
    entities = written(_entity_rows(docs, text_col).distinct(), "entities")
    exceptions = redrawn(entities, key)
    looked_up = docs.withColumn("_redrawn", F.lit(None).cast("array<struct<kind:string,shape:string,value:string,attempt:int>>"))
    if exceptions is not None:
        looked_up = _with_exceptions(docs, text_col, exceptions)
    columns = docs.columns

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: dict[Entity, str] = {}
        for batch in tables:
            again = batch.column(len(columns)).to_pylist()
            texts = batch.column(columns.index(text_col))
            out, numbers = [], {kind: [] for kind in KINDS}
            for raw, known, valid in zip(strings(texts), again, texts.is_valid().to_pylist()):
                text, parts, at = raw.decode("utf-8", "replace"), [], 0
                attempts = {(r["kind"], r["shape"], r["value"]): r["attempt"] for r in known or ()}
                tally = dict.fromkeys(KINDS, 0)
                for a, b, entity in entities_in(text):
                    if entity in attempts:
                        new = surrogate(entity, key, attempts[entity])
                    else:
                        if len(given) > 200_000:
                            given.clear()
                        new = given.setdefault(entity, None) or surrogate(entity, key)
                        given[entity] = new
                    parts += (text[at:a], in_format(entity[0], text[a:b], new))
                    at = b
                    tally[entity[0]] += 1
                out.append("".join([*parts, text[at:]]) if valid else None)
                for kind, n in tally.items():
                    numbers[kind].append(n)
            arrays = [pa.array(out, pa.string()) if c == text_col else batch.column(i) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(numbers[k], pa.int64()) for k in KINDS)], names=[*columns, *counts])

    schema = docs.select("*", *(F.lit(0).cast("long").alias(c) for c in counts)).schema
    return looked_up.mapInArrow(batches, schema)


def _with_exceptions(docs: DataFrame, text_col: str, exceptions: DataFrame) -> DataFrame:
    """``docs`` with the redrawn entities of each text, found by a hash of the text."""
    keyed = docs.withColumn("_text_key", F.md5(F.coalesce(F.col(text_col), F.lit(""))))

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            rows = [(k, *e) for k, t in zip(batch.column(0).to_pylist(), strings(batch.column(1))) for e in {x for _a, _b, x in entities_in(t.decode("utf-8", "replace"))}]
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["_text_key", "kind", "shape", "value"])

    mentions = keyed.select("_text_key", text_col).mapInArrow(batches, "_text_key string, kind string, shape string, value string")
    met = mentions.join(exceptions, ["kind", "shape", "value"]).distinct()
    lists = written(met.groupBy("_text_key").agg(F.collect_list(F.struct("kind", "shape", "value", "attempt")).alias("_redrawn")), "redrawn")
    return keyed.join(lists, "_text_key", "left").select(*docs.columns, "_redrawn")
