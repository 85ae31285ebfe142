"""Free-typed values mapped to a canonical list by a symmetric-delete dictionary.

All strings obtained by deleting up to ``k`` characters of a reference name are
the keys of a dictionary; a typed value meets every name within edit distance
``k`` when its own deletions are looked up.  What meets is ranked by a weighted
Damerau-Levenshtein distance, then by how often the reference entry is written
plainly in the data.  A reference whose size is within a checked bound travels
with the tasks; of a larger one every value only gets the entries that share a
deletion with it, by a join.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMATCHED = "UNMATCHED"
MAX_REFERENCE = 50_000  # rows of a reference that travels with the tasks

#: What typists put for words that qualify a place, and words that say nothing about it.
QUALIFIERS = {
    "north": ("n", "no", "nth", "north", "northern"),
    "south": ("s", "so", "sth", "south", "southern"),
    "east": ("e", "east", "eastern"),
    "west": ("w", "west", "western"),
    "new": ("new", "nw"),
    "islands": ("is", "isl", "isls", "isle", "isles", "island", "islands"),
    "republic": ("rep", "repub", "rpb", "rpblc", "republic"),
    "grand": ("gr", "grd", "grand"),
    "duchy": ("duchy", "dchy", "dy"),
}
NOISE = frozenset(
    "of the a an in law laws state jur jurisdiction incorporated inc organized organised under company hq limited partnership lp formed country territory province corporation llc".split()
)
DIRECTIONS = frozenset(("north", "south", "east", "west"))
#: Neighbours on a keyboard, and characters that readers and scanners confuse.
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
CONFUSED = frozenset(("il", "i1", "l1", "o0", "uv", "ij", "mn", "ec", "s5", "b8", "gq", "ft", "rn", "z2"))

_WORD_OF = {short: word for word, forms in QUALIFIERS.items() for short in forms}
_PARTS = re.compile(r"\s*[,;/()\[\]|]+\s*|\s+[-–—]\s+")
_DIGIT_LETTERS = str.maketrans("01358", "oiesb")


def _near_keys() -> frozenset[str]:
    near = set()
    for y, row in enumerate(KEY_ROWS):
        for x, c in enumerate(row):
            around = row[x + 1 : x + 2]
            if y + 1 < len(KEY_ROWS):
                around += KEY_ROWS[y + 1][max(0, x - 1) : x + 1]
            near |= {c + d for d in around} | {d + c for d in around}
    return frozenset(near)


_NEAR = _near_keys()


def change_cost(a: str, b: str) -> float:
    """Cost of reading ``a`` for ``b``: less where eyes or fingers often slip."""
    if a == b:
        return 0.0
    if a + b in CONFUSED or b + a in CONFUSED:
        return 0.4
    return 0.7 if a + b in _NEAR else 1.0


def weighted_distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein distance (adjacent transpositions); infinite above ``most``.

    A letter typed twice or left out of a pair costs half, a transposition 0.8, and
    ``rn`` for ``m`` 0.6.
    """
    if abs(len(a) - len(b)) * 0.5 > most:
        return float("inf")
    rows = [[j * 1.0 for j in range(len(b) + 1)]]
    for j in range(1, len(b) + 1):
        rows[0][j] = rows[0][j - 1] + (0.5 if j > 1 and b[j - 1] == b[j - 2] else 1.0)
    for i in range(1, len(a) + 1):
        ca, above = a[i - 1], rows[i - 1]
        row = [above[0] + (0.5 if i > 1 and ca == a[i - 2] else 1.0)]
        for j in range(1, len(b) + 1):
            cb = b[j - 1]
            best = above[j - 1] if ca == cb else above[j - 1] + change_cost(ca, cb)
            best = min(best, above[j] + (0.5 if i > 1 and ca == a[i - 2] else 1.0), row[j - 1] + (0.5 if j > 1 and cb == b[j - 2] else 1.0))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb and ca != cb:
                best = min(best, rows[i - 2][j - 2] + 0.8)
            if i > 1 and cb == "m" and a[i - 2 : i] == "rn":
                best = min(best, rows[i - 2][j - 1] + 0.6)
            if j > 1 and ca == "m" and b[j - 2 : j] == "rn":
                best = min(best, above[j - 2] + 0.6)
            row.append(best)
        if min(row) > most and min(above) > most:
            return float("inf")
        rows.append(row)
    return rows[-1][-1] if rows[-1][-1] <= most else float("inf")


def letters(text: str) -> str:
    """Lower case without accents and invisible characters; other signs as they are."""
    text = unicodedata.normalize("NFKD", text).casefold()
    if text.isascii():
        return text
    return "".join(c for c in text if unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Cf")


def _qualifier(token: str) -> str | None:
    """The qualifying word a token stands for, also with one slip where the word is long enough."""
    found = _WORD_OF.get(token)
    if found is None and len(token) >= 5:
        for word in QUALIFIERS:
            if len(word) >= 5 and abs(len(word) - len(token)) <= 1 and weighted_distance(token, word, 1.0) <= 1.0:
                return word
    return found


def reading(text: str) -> tuple[tuple[str, ...], str]:
    """Qualifying words in fixed order, and the rest of the name joined.

    Initials are only read as qualifiers beside a longer word; letters spelled out
    one by one are joined.
    """
    raw = [t for t in re.split(r"[\s.\-_*:'\"&]+", letters(text)) if t]
    if len(raw) > 2 and all(len(t) == 1 for t in raw):
        raw = ["".join(raw)]
    if len(raw) > 1 and raw[0] == "g" and raw[1] == "d":
        raw[:2] = ["grand", "duchy"]
    tokens = []
    for t in raw:
        if not t.isalpha():
            t = t.translate(_DIGIT_LETTERS) if any(c.isalpha() for c in t) else ""
        if t and t not in NOISE:
            tokens.append(t)
    words, rest = [], []
    for t in tokens:
        q = _qualifier(t) if len(tokens) > 1 else None
        if q:
            words.append(q)
        else:
            rest.append(t)
    if not rest and words:
        words, rest = [], tokens
    return tuple(w for w in QUALIFIERS if w in words), "".join(rest)


def allowance(n: int) -> float:
    """Most weighted edits for a name of ``n`` letters: none below four, a quarter of its length after."""
    return 0.0 if n < 4 else min(3.0, 0.1 + n / 4)


class Dictionary:
    """Reference entries by code, exact name, core of the name, and deletions."""

    def __init__(self, entries: Sequence[tuple[str, Sequence[str]]], frequency: dict[str, int] | None = None, edits: int = 2):
        self.edits, self.frequency = edits, frequency or {}
        self.codes = {letters(code): code for code, _ in entries}
        self.names: dict[str, set[str]] = {}
        self.said: dict[str, set[tuple[str, tuple[str, ...]]]] = {}
        for code, names in entries:
            for name in names:
                if name and name.strip():
                    words, core = reading(name)
                    self.said.setdefault(core, set()).add((code, words))
                    self.names.setdefault("".join(words) + core, set()).add(code)
        self.deletes: dict[str, set[str]] = {}
        for core in self.said:
            for d in self._deletions(core):
                self.deletes.setdefault(d, set()).add(core)
        self._memo: dict[str, tuple[str, float]] = {}
        self._parts: dict[str, tuple[float, int, str] | None] = {}
        self.longest = max(map(len, self.said), default=0) + 3  # nothing longer is within reach of an entry
        self.longest_whole = max(map(len, self.names), default=0) + 3

    def _deletions(self, word: str) -> set[str]:
        """The word without up to ``edits`` characters; more of them where a long name allows more."""
        k = min(self.edits + (len(word) >= 9), len(word) - 2) if len(word) > 3 else 0
        return {"".join(c for i, c in enumerate(word) if i not in gone) for n in range(k + 1) for gone in map(set, combinations(range(len(word)), n))}

    def _score(self, words: tuple[str, ...], core: str, entry: str) -> Iterator[tuple[float, int, str]]:
        """Distance of a reading to each entry that bears the core ``entry``."""
        distance = weighted_distance(core, entry, allowance(len(entry)))
        if distance == float("inf"):
            return
        for code, own in self.said[entry]:
            if {w for w in words if w in DIRECTIONS} != {w for w in own if w in DIRECTIONS}:
                continue
            lacking, extra = len(set(own) - set(words)), len(set(words) - set(own))
            if "new" in words and "new" not in own:
                continue
            yield distance + 0.1 * lacking + 0.3 * extra, -self.frequency.get(code, 0), code

    def part(self, text: str, abbreviated: bool = True) -> tuple[float, int, str] | None:
        """The best entry for one part of a value: distance, rarity, code."""
        if text not in self._parts:
            if len(self._parts) > 100_000:
                self._parts.clear()
            self._parts[text] = self._part(text, abbreviated)
        return self._parts[text]

    def _part(self, text: str, abbreviated: bool) -> tuple[float, int, str] | None:
        words, core = reading(text)
        if not core:
            return None
        whole = "".join(words) + core
        if (code := self.codes.get(whole)) or (code := self.codes.get(re.sub(r"[^a-z]", "", letters(text)))):
            return 0.0, 0, code
        found = [r for r in self._score(words, core, core)] if core in self.said else []
        if not found and len(self.names.get(whole, ())) == 1:
            found = [(0.0, 0, next(iter(self.names[whole])))]
        if not found and abbreviated and text.rstrip(" *").endswith(".") and len(core) >= 4:
            begun = {code for entry, owners in self.said.items() if entry.startswith(core) for code, own in owners if set(own) >= set(words)}
            if len(begun) == 1:
                return 0.5, 0, begun.pop()
        if not found and 4 <= len(core) <= self.longest:
            near = {entry for d in self._deletions(core) for entry in self.deletes.get(d, ())}
            found = [r for entry in near for r in self._score(words, core, entry)]
            if not found and whole != core and len(whole) <= self.longest_whole:
                near = {e for d in self._deletions(whole) for e in self.deletes.get(d, ())}
                found = [r for e in near for r in self._score((), whole, e)]
        return min(found, default=None)

    def find(self, value: str) -> tuple[str, float]:
        """Code and distance of the entry a value names, in whole or in one of its parts."""
        known = self._memo.get(value)
        if known is None:
            if len(self._memo) > 200_000:
                self._memo.clear()
            known = self._memo[value] = self._find(value)
        return known

    def _find(self, value: str) -> tuple[str, float]:
        best = self.part(value)
        if best is None or best[0] > 0:
            parts = [p for p in _PARTS.split(value) if p.strip()]
            tries = list(parts) if len(parts) > 1 else []
            tries += [f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False)]
            found = [(r[0] + 0.05 * (len(parts) > 1), r[1], r[2]) for t in tries if (r := self.part(t))]
            if best:
                found.append(best)
            best = min(found, default=None)
        return (best[2], best[0]) if best else (UNMATCHED, float("inf"))


def _plain_counts(reference: DataFrame, code: str, names: Sequence[str], values: DataFrame, value: str) -> DataFrame:
    """``code, frequency``: how often the entries' codes and names stand in the values as they are."""
    said = values.groupBy(F.lower(F.trim(value)).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    plain = reference.where(F.col(code).isNotNull()).select(F.col(code).alias("code"), F.explode(F.array(code, *names)).alias("name")).where("name is not null")
    plain = plain.select("code", F.lower(F.trim("name")).alias("v")).distinct()
    return plain.join(said, "v").groupBy("code").agg(F.sum("n").alias("frequency"))


def load_dictionary(
    reference: DataFrame, code: str, names: Sequence[str], values: DataFrame | None = None, value: str = "value", edits: int = 2
) -> Dictionary:
    """Bring a reference of at most MAX_REFERENCE rows to the driver, with the frequency of its plain names in ``values``.

    Runs two small jobs.  Frequencies are counted where the data lies; as many rows
    as the reference has come back.  A larger reference is refused: use
    :func:`map_to_reference`.
    """
    rows = reference.select(code, *names).where(F.col(code).isNotNull()).limit(MAX_REFERENCE + 1).collect()
    if len(rows) > MAX_REFERENCE:
        raise ValueError(f"a reference of more than {MAX_REFERENCE} rows is too large for a dictionary in each task")
    entries = [(r[0], [n for n in r[1:] if n]) for r in rows]
    frequency: dict[str, int] = {}
    if values is not None:
        frequency = {r.code: r.frequency for r in _plain_counts(reference, code, names, values, value).collect()}
    return Dictionary(entries, frequency, edits)


def map_values(values: DataFrame, dictionary: Dictionary, record_id: str, field: str, value: str) -> DataFrame:
    """``record_id, field_name, value, code, distance`` of every row; code UNMATCHED and no distance where nothing is near.

    Rows with a null value are left out.  Every different value is looked up once,
    and the answers joined back to the rows.
    """
    shared = values.sparkSession.sparkContext.broadcast(dictionary)
    narrow = values.select(
        F.col(record_id).cast("string").alias("record_id"), F.col(field).alias("field_name"), F.col(value).alias("value")
    ).where("value is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.find
        for batch in batches:
            found = [find(v.as_py()) for v in batch.column(0)]
            cols = [batch.column(0), pa.array([c for c, _ in found], pa.string())]
            cols.append(pa.array([None if d == float("inf") else d for _, d in found], pa.float64()))
            yield pa.RecordBatch.from_arrays(cols, names=["value", "code", "distance"])

    # the values are small and the work on them is not: as many tasks as the session shuffles into, whatever
    # their size (by another hash than the shuffle before, or it would be taken for that one and coalesced)
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = narrow.select("value").distinct().repartition(tasks, F.xxhash64("value")).mapInArrow(run, "value string, code string, distance double")
    return narrow.join(answers, "value").select("record_id", "field_name", "value", "code", "distance")


def _index_keys(name: str | None, code: str, edits: int) -> list[str]:
    """The keys under which an entry's code (without a name) or one of its names is found."""
    d = Dictionary([], edits=edits)
    if name is None:
        return ["c" + letters(code)]
    words, core = reading(name)
    whole = "".join(words) + core
    keys = {"d" + x for x in d._deletions(core)} | {"s" + core, "w" + whole}
    return sorted(keys | {"p" + core[:n] for n in range(4, len(core) + 1)})


def _lookup_keys(value: str, edits: int, longest: int) -> list[str]:
    """The keys by which a value, its parts and its neighbouring parts are looked up: whatever an entry could be found by."""
    d = Dictionary([], edits=edits)
    parts = [p for p in _PARTS.split(value) if p.strip()]
    tries = {value, *parts, *(f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False))}
    keys: set[str] = set()
    for text in tries:
        words, core = reading(text)
        if not core:
            continue
        whole = "".join(words) + core
        keys |= {"c" + whole, "c" + re.sub(r"[^a-z]", "", letters(text)), "s" + core, "w" + whole}
        if len(core) >= 4 and text.rstrip(" *").endswith("."):
            keys.add("p" + core)
        for word in {core, whole} if 4 <= len(core) else ():
            if len(word) <= longest:
                keys |= {"d" + x for x in d._deletions(word)}
    return sorted(keys)


def map_by_join(values: DataFrame, reference: DataFrame, code: str, names: Sequence[str], record_id: str, field: str, value: str, edits: int = 2) -> DataFrame:
    """The rows of :func:`map_values` for a reference of any size.

    Entries and values are exploded to their deletions and met by a join; every
    value is then looked up in a dictionary of the entries it met, which hold all
    that could answer it.  A key that very many entries share (a very short name) is
    as large as they are.
    """
    narrow = values.select(F.col(record_id).cast("string").alias("record_id"), F.col(field).alias("field_name"), F.col(value).alias("value")).where("value is not null")
    # of each entry its code, without a name, and every name
    entries = reference.where(F.col(code).isNotNull()).select(F.col(code).alias("code"), F.explode(F.array(F.lit(None).cast("string"), *names)).alias("name"))
    entries = entries.where("name is null or trim(name) <> ''").distinct()
    longest = (entries.agg(F.max(F.length("name"))).first()[0] or 0) + 3  # nothing longer is within reach of an entry
    counts = _plain_counts(reference, code, names, values, value)
    entries = entries.join(counts, "code", "left").select("code", "name", F.coalesce("frequency", F.lit(0)).alias("frequency")).distinct()

    @F.pandas_udf("array<string>")
    def keys_of_entry(name: pd.Series, code: pd.Series) -> pd.Series:
        return pd.Series([_index_keys(n, c, edits) for n, c in zip(name, code, strict=True)])

    @F.pandas_udf("array<string>")
    def keys_of_value(value: pd.Series) -> pd.Series:
        return value.map(lambda v: _lookup_keys(v, edits, longest))

    @F.pandas_udf("code string, distance double")
    def answer(value: pd.Series, met: pd.Series) -> pd.DataFrame:
        out = []
        for v, entries in zip(value, met, strict=True):
            own: dict[str, list[str]] = {}
            for e in entries:
                own.setdefault(e["code"], []).extend([e["name"]] if e["name"] is not None else [])
            found, d = Dictionary(list(own.items()), {e["code"]: e["frequency"] for e in entries}, edits).find(v)
            out.append((found, None if d == float("inf") else d))
        return pd.DataFrame(out, columns=["code", "distance"])

    index = entries.select("code", "name", "frequency", F.explode(keys_of_entry("name", "code")).alias("key"))
    asked = narrow.select("value").distinct()
    looked = asked.select("value", F.explode(keys_of_value("value")).alias("key"))
    met = looked.join(index, "key").groupBy("value").agg(F.collect_set(F.struct("code", "name", "frequency")).alias("met"))
    answers = met.select("value", answer("value", "met").alias("a")).select("value", "a.*")
    return narrow.join(answers, "value", "left").select("record_id", "field_name", "value", F.coalesce("code", F.lit(UNMATCHED)).alias("code"), "distance")


def map_to_reference(values: DataFrame, reference: DataFrame, code: str, names: Sequence[str], record_id: str, field: str, value: str, edits: int = 2, most: int = MAX_REFERENCE) -> DataFrame:
    """:func:`map_values` with a dictionary in each task for a reference of at most ``most`` rows, :func:`map_by_join` for a larger one; the rows are the same."""
    if reference.limit(most + 1).count() <= most:
        return map_values(values, load_dictionary(reference, code, names, values, value, edits), record_id, field, value)
    return map_by_join(values, reference, code, names, record_id, field, value, edits)
