"""Scalar functions on text: normalisation, URLs, names, hashes, shingles, similarity."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parameters of a URL that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized(text: Column | str) -> Column:
    """Lower case, ASCII letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.trim(col(text))), "[^a-z0-9]+", " "))


def words(text: Column | str) -> Column:
    """Words of letters and digits; an empty list for text without any, null for null."""
    plain = normalized(text)
    return F.when(col(text).isNull(), None).otherwise(F.filter(F.split(plain, " "), lambda x: x != ""))


def plain_url(url: Column | str) -> Column:
    """Without fragment, lower case."""
    return F.lower(F.regexp_replace(F.trim(col(url)), "#.*$", ""))


def canonical_url(url: Column | str) -> Column:
    """Scheme and host in lower case, tracking parameters and fragment gone, other parameters in their order."""
    bare = F.regexp_replace(F.trim(col(url)), "#.*$", "")
    head = F.regexp_extract(bare, r"^([^?]*)", 1)
    host = F.lower(F.regexp_extract(head, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)", 1))
    path = F.regexp_replace(head, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(host, path, tail)


def domain(url: Column | str) -> Column:
    """Host of an http address without ``www.``; empty for what is none."""
    u = F.lower(col(url))
    host = F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit(""))
    return F.when(u.isNotNull(), F.when(u.rlike("^https?://"), F.regexp_replace(host, r"^www\.", "")).otherwise(""))


def content_id(prefix: str, *parts: Column | str) -> Column:
    """Prefix and sha256 of the parts, nulls as empty, joined by a unit separator."""
    joined = F.concat_ws("\x1f", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.sha2(joined, 256))


def shingles(tokens: Column | str, k: int = 3) -> Column:
    """Distinct, sorted 16-digit hashes of runs of ``k`` words; one for a shorter text, none for an empty one."""
    t = col(tokens)
    starts = F.sequence(F.lit(0), F.greatest(F.size(t) - k, F.lit(0)))
    runs = F.transform(starts, lambda i: F.substring(F.sha2(F.array_join(F.slice(t, i + 1, k), " "), 256), 1, 16))
    return F.when(F.size(t) > 0, F.array_sort(F.array_distinct(runs))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all elements of two sets; null for two empty ones."""
    return F.try_divide(F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b))))


def simhash64(hashes: Column | str) -> Column:
    """64 bits, each set where more hashes have it than not, from 16-digit hex hashes; zero for none.

    Counted per 16 bits in one pass over the hashes, inside the JVM.
    """
    h = F.transform(col(hashes), lambda x: F.conv(F.substring(x, 1, 8), 16, 10).cast("long"))
    low = F.transform(col(hashes), lambda x: F.conv(F.substring(x, 9, 8), 16, 10).cast("long"))

    def bits(values: Column) -> Column:
        weigh = lambda i: F.aggregate(values, F.lit(0), lambda acc, v: acc + F.when(F.getbit(v, i) == 1, 1).otherwise(-1))
        return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda acc, i: acc + F.when(weigh(i) > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long"))

    return F.shiftleft(bits(h), 32).bitwiseOR(bits(low))


def count_cues(text: Column | str, cue: str) -> Column:
    """How often a cue occurs, without overlaps."""
    t = F.lower(col(text))
    return ((F.length(t) - F.length(F.replace(t, F.lit(cue), F.lit("")))) / len(cue)).cast("long")


def title_key(title: Column | str) -> Column:
    """A title without links, agency brackets and punctuation."""
    t = F.regexp_replace(F.lower(col(title)), r"https?://\S+", " ")
    t = F.regexp_replace(t, r"\((?:reuters|ap|afp|bloomberg)\)", " ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def name_key(name: Column | str) -> Column:
    """A name with plain quotes and spaces, outer punctuation gone, lower case."""
    n = F.translate(col(name), " ‘’“”", " ''\"\"")
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(n, r"\s+", " ")), r"^[\s.,;:]+|[\s.,;:]+$", ""))


def as_timestamp(text: Column | str) -> Column:
    """A timestamp from epoch seconds or milliseconds, ISO text or a few plain forms; null for what is none."""
    t = F.trim(col(text))
    epoch = F.when(t.rlike(r"^\d{13}$"), F.timestamp_millis(t.try_cast("long"))).when(t.rlike(r"^\d{9,10}$"), F.timestamp_seconds(t.try_cast("long")))
    return F.coalesce(
        epoch, *[F.try_to_timestamp(t, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd", "MM/dd/yyyy")]
    )


def zone_aware(text: Column | str) -> Column:
    """Whether a time text names its offset, or is an epoch."""
    return F.trim(col(text)).rlike(r"(Z|[+-]\d{2}:?\d{2})$") | F.trim(col(text)).rlike(r"^\d{9,13}$")


def hash_bucket(key: Column | str, n: int) -> Column:
    """Remainder of the first 16 hex digits of the key's sha256."""
    digits = F.conv(F.substring(F.sha2(col(key).cast("string"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return F.pmod(digits, F.lit(n).cast("decimal(20,0)")).cast("long")


#: Legal forms by family, longest spelling first within each.
LEGAL_FORMS = {
    "llc": ("limited liability company", "l.l.c.", "llc"), "inc": ("incorporated", "inc.", "inc"), "ltd": ("limited", "ltd.", "ltd"), "corp": ("corporation", "corp.", "corp"), "plc": ("public limited company", "p.l.c.", "plc"),
    "lp": ("limited partnership", "l.p.", "lp"), "gmbh": ("gesellschaft mit beschrankter haftung", "gmbh"), "sa": ("s.a.", "sa"), "bv": ("b.v.", "bv"), "pty": ("proprietary limited", "pty ltd", "pty. ltd."),
}


def legal_form(name: Column | str) -> Column:
    """``family, stem`` of a name by the longest legal form it ends in; the whole name and no family where it ends in none."""
    n = name_key(name)
    spelled = sorted(((s, family) for family, forms in LEGAL_FORMS.items() for s in forms), key=lambda x: -len(x[0]))
    out = F.struct(F.lit(None).cast("string").alias("family"), n.alias("stem"))
    for s, family in reversed(spelled):
        bare = s.rstrip(".")  # outer punctuation is gone from the key
        stem = F.regexp_replace(F.substring(n, F.lit(1), F.length(n) - len(bare)), r"[\s,.]+$", "")
        out = F.when(F.endswith(n, F.lit(" " + bare)) | F.endswith(n, F.lit("," + bare)), F.struct(F.lit(family).alias("family"), stem.alias("stem"))).otherwise(out)
    return out


def band_keys(simhash: Column | str, bands: int = 4) -> Column:
    """The bits of a 64-bit hash in bands, each with its number: two hashes that differ in fewer bits than bands share one."""
    width = 64 // bands
    part = lambda i: F.shiftrightunsigned(col(simhash), width * i).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*[F.concat(F.lit(f"{i}:"), F.lpad(F.lower(F.hex(part(i))), width // 4, "0")) for i in range(bands)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def unicode_tokens(text):  # noqa: ANN001, ANN201
    """Words of letters and digits of any script after NFKC and case folding, inner apostrophes and hyphens kept; null for null."""
    token = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
    return text.map(lambda t: None if t is None else token.findall(unicodedata.normalize("NFKC", t).casefold()))


def items_of(raw: Column | str) -> Column:
    """Item numbers from a JSON list, a JSON object with numbers as keys, or a text like ``Item 2.02; Item 9.01``: in order, each once."""
    r = F.trim(col(raw))
    given = F.when(F.startswith(r, F.lit("[")), F.coalesce(F.from_json(r, "array<string>"), F.array().cast("array<string>"))).when(
        F.startswith(r, F.lit("{")), F.coalesce(F.map_keys(F.from_json(r, "map<string,string>")), F.array().cast("array<string>"))
    ).otherwise(F.split(r, r"[,;|]"))
    plain = F.transform(given, lambda x: F.regexp_extract(F.lower(F.trim(x)), r"^(?:item\s+)?(\d+(?:\.\d+)?)", 1))
    return F.array_distinct(F.filter(plain, lambda x: x != ""))


def ownership_percent(raw: Column | str) -> Column:
    """The percentage of an ownership text (``51%``, ``49.5 percent``, ``wholly owned``); null for none and for what is no percentage."""
    t = F.lower(F.trim(col(raw)))
    number = F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(t.rlike("wholly|^all$"), 100.0).when((number >= 0) & (number <= 100), number)


def footnotes(name: Column | str) -> Column:
    """``stem, refs`` of a name with footnote marks at its end: ``(1)``, ``[a]``, ``*``."""
    marks = r"\s*((?:\(\w{1,2}\)|\[\w{1,2}\]|\*+)(?:\s*,?\s*(?:\(\w{1,2}\)|\[\w{1,2}\]|\*+))*)$"
    tail = F.regexp_extract(F.trim(col(name)), marks, 1)
    refs = F.regexp_extract_all(tail, F.lit(r"(\w{1,2}|\*+)"), 1)
    return F.struct(F.trim(F.regexp_replace(F.trim(col(name)), marks, "")).alias("stem"), F.when(tail != "", refs).otherwise(F.array().cast("array<string>")).alias("refs"))


def clean_number(value: Column | str) -> Column:
    """A double without NaN and infinities: these are nulls."""
    v = col(value).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def period_scope(text: Column | str) -> Column:
    """``quarter``, ``year``, ``unknown``, or ``provider:`` and a slug of any other period a provider names."""
    t = F.lower(F.trim(col(text)))
    slug = F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))
    return F.when(t.isNull() | (t == ""), "unknown").when(t.contains("quarter") | t.rlike(r"\bq[1-4]\b"), "quarter").when(t.contains("year") | t.contains("annual") | t.rlike(r"\bfy"), "year").otherwise(
        F.concat(F.lit("provider:"), F.replace(slug, F.lit(" "), F.lit("_"))))
