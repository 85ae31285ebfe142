"""Variant spellings of one organisation or person, linked.

Names are taken apart (:mod:`name_parts`); what identifies (the name's own words, a
surname) is compared by edit distance, what describes (line of business, numeral,
given name) must agree or be absent.  Cores within ``k`` edits are found by a
pigeonhole segment join: a core is cut into ``k + 1`` segments, of which at least
one survives ``k`` edits unchanged and not far from its place; an inverted index of
segments is looked up with the substrings at the places it can have shifted to, and
what meets is verified by a banded edit distance.  One more segment, the sorted
letters, finds cores whose letters changed places more than ``k`` times.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.name_parts import NameParser, skeleton
from tidemark.session import stored

LONGEST = 128  # letters; places for longer cores are only made for lengths that occur
_FIELDS = "src string, id string, person boolean, core string, turned string, first string, second string, lead string, short string, line string, form string, numeral int"


def edits_allowed(n: int) -> int:
    """Edits under which two cores of about ``n`` letters are one name."""
    return 0 if n < 6 else 1 if n < 9 else 2 if n < 20 else 3


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """Start and length of ``k + 1`` segments that cut ``n`` letters evenly, longer ones last."""
    short, more = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = short + (i > k - more)
        out.append((at, size))
        at += size
    return out


def index_places(longest: int = LONGEST, longer: Sequence[int] = ()) -> list[tuple[int, int, int, int]]:
    """``n, segment, start, size`` of the segments under which a core of ``n`` letters is indexed."""
    return [(n, i, at, size) for n in [*range(1, longest + 1), *longer] for i, (at, size) in enumerate(segments(n, edits_allowed(n))) if size]


def probe_places(longest: int = LONGEST, longer: Sequence[int] = ()) -> list[tuple[int, int, int, int, int]]:
    """``n, indexed_n, segment, start, size``: the substrings with which a core of ``n`` letters is looked up.

    With ``i`` segments before one, at most ``i`` edits can lie before it if no
    earlier segment survives, and at most ``k - i`` after it; that bounds the shift
    from both ends.  Only cores as long or shorter are looked up: of a pair, the
    longer one finds the other.
    """
    out = []
    for n in [*range(1, longest + 1), *longer]:
        for m in range(max(1, n - 3), n + 1):
            k = edits_allowed(m)
            if abs(n - m) > k:
                continue
            delta = n - m
            for i, (at, size) in enumerate(segments(m, k)):
                lo, hi = max(at - i, at + delta - (k - i)), min(at + i, at + delta + (k - i))
                out += [(n, m, i, start, size) for start in range(max(0, lo), min(n - size, hi) + 1) if size]
    return out


def parse_names(names: DataFrame, src: str = "src", ident: str = "id", raw: str = "raw") -> DataFrame:
    """One row of parts for each row of ``src, id, raw`` whose name names something."""
    narrow = names.select(F.col(src).alias("src"), F.col(ident).cast("string").alias("id"), F.col(raw).alias("raw")).where("raw is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = NameParser()
        kinds = [pa.string(), pa.string(), pa.bool_(), *[pa.string()] * 8, pa.int32()]
        titles = [f.split()[0] for f in _FIELDS.split(", ")]
        for batch in batches:
            rows = []
            for src_, id_, raw_ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                p = parser.parse(raw_)
                if p is None:
                    continue
                core, turned, first, second = parser.spelt(p.core)
                if p.lead and p.short:
                    first, second = skeleton(p.lead), ""
                elif p.lead and not second:
                    first, second = skeleton(p.lead), first
                rows.append((src_, id_, p.person, core, turned, first, second, p.lead, skeleton(p.short) if p.short else "", p.line, p.form, p.numeral))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(titles)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=titles)

    return narrow.mapInArrow(run, _FIELDS)


def _letters_mask(core: str) -> Column:
    """26 bits for letters that occur and 26 for those that occur twice; an edit takes one letter, adds one, or both, and so changes two of them at most."""
    letter = f"pmod(ascii(substring({core}, i, 1)) - 97, 26)"
    return F.expr(f"aggregate(sequence(1, length({core})), 0L, (seen, i) -> seen | shiftleft(1L, cast({letter} + 26 * getbit(seen, cast({letter} as int)) as int)))")


def _neighbours_swapped(a: str, b: str) -> Column:
    """Whether one swap of two neighbouring letters makes ``a`` equal ``b``."""
    return F.expr(f"exists(sequence(1, length({a}) - 1), i -> concat(substring({a}, 1, i - 1), substring({a}, i + 1, 1), substring({a}, i, 1), substring({a}, i + 2)) = {b})")


def core_matches(nodes: DataFrame) -> DataFrame:
    """``a, na, b, nb``: pairs of different nodes of ``node, person, core, turned, n`` with cores within the allowed edits.

    A core of two words is indexed in both orders and looked up in one, so turned
    and run-together names are found.  Nodes of persons and of organisations do not
    meet.  Short segments are bounded in number by the letters, so their buckets
    may be large; the letters that occur are compared inside the join, and only
    what passes is verified, before anything is emitted.  Cores of the same letters
    are met too: long ones are verified within four edits, those of 4 to 7 letters
    by one swap of neighbours.  A pair may come more than once and in either order.
    """
    spark = nodes.sparkSession
    forms = nodes.select("node", "person", "n", F.lit(False).alias("other"), F.col("core").alias("form")).unionByName(
        nodes.where("turned <> core").select("node", "person", "n", F.lit(True).alias("other"), F.col("turned").alias("form"))
    ).where("form <> ''")
    # written, so that the letters are looked at once a form and not once a substring
    forms = stored(forms.withColumn("mask", _letters_mask("form")), "forms")
    lengths = forms.select(F.length("form").alias("n")).where(F.col("n") > LONGEST).distinct()
    longer = sorted(r.n for r in lengths.collect())
    places = F.broadcast(spark.createDataFrame(index_places(longer=longer), "size_of int, segment int, start int, size int"))
    probes = F.broadcast(spark.createDataFrame(probe_places(longer=longer), "size_of int, indexed int, segment int, start int, size int"))
    part = F.substring("form", F.col("start") + 1, F.col("size"))
    indexed = forms.join(places, F.length("form") == F.col("size_of")).select("node", "n", "other", "form", "mask", F.xxhash64("person", "size_of", "segment", part).alias("key"))
    looked = forms.where("not other").join(probes, F.length("form") == F.col("size_of")).select("node", "n", "form", "mask", F.xxhash64("person", "indexed", "segment", part).alias("key"))
    k = "case when length(i.form) < 6 then 0 when length(i.form) < 9 then 1 when length(i.form) < 20 then 2 else 3 end"
    # cores of equal length look each other up, once is enough; the distance is only taken of pairs with nearly the same letters
    once = F.expr("i.other or length(p.form) > length(i.form) or p.node < i.node")
    near = F.expr(f"case when bit_count(i.mask ^ p.mask) <= 2 * {k} then levenshtein(p.form, i.form, {k}) >= 0 else false end")
    met = looked.alias("p").join(indexed.alias("i"), (F.col("p.key") == F.col("i.key")) & (F.col("p.node") != F.col("i.node")) & once & near)
    close = met.select(F.col("p.node").alias("a"), F.col("p.n").alias("na"), F.col("i.node").alias("b"), F.col("i.n").alias("nb"))
    sorted_letters = F.xxhash64("person", F.array_join(F.array_sort(F.split(F.col("core"), "")), ""))
    bags = nodes.where(F.length("core") >= 4).select("node", "n", "core", "turned", sorted_letters.alias("key"))
    swapped = bags.alias("x").join(bags.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")))
    few = (F.levenshtein("x.core", "y.core", 4) >= 0) | (F.levenshtein("x.core", "y.turned", 4) >= 0)
    swapped = swapped.where(F.when(F.length("x.core") >= 8, few).otherwise(_neighbours_swapped("x.core", "y.core") | _neighbours_swapped("x.core", "y.turned")))
    return close.unionByName(swapped.select(F.col("x.node").alias("a"), F.col("x.n").alias("na"), F.col("y.node").alias("b"), F.col("y.n").alias("nb")))


def close_cores(nodes: DataFrame) -> DataFrame:
    """``a, b``: the pairs of :func:`core_matches`, each once in both orders."""
    pairs = core_matches(nodes).select("a", "b")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def houses(nodes: DataFrame, matches: DataFrame, rounds: int = 32) -> DataFrame:
    """``node, house``: each node follows its most frequent neighbour, and that one its own, to the end.

    Of a pair only the rarer node can follow the other, so every match is one row
    and the choice a partial aggregate.  Frequencies grow along the way, so there
    are no circles.  Every round doubles the length of the steps; it ends when
    nothing moves.
    """
    left, right = F.struct(F.col("na").alias("n"), F.col("a").alias("node")), F.struct(F.col("nb").alias("n"), F.col("b").alias("node"))
    best = matches.select(F.least(left, right)["node"].alias("node"), F.greatest(left, right).alias("w")).groupBy("node").agg(F.max("w")["node"].alias("house"))
    now = stored(best, "houses")  # only nodes that follow one; the others are houses themselves
    for _ in range(rounds):
        step = now.alias("x").join(now.select(F.col("node").alias("at"), F.col("house").alias("next")).alias("y"), F.col("house") == F.col("at"), "left")
        then = stored(step.select("node", F.coalesce("next", "house").alias("house"), F.col("next").isNotNull().alias("moved")), "houses")
        now = then.select("node", "house")
        if then.where("moved").isEmpty():
            break
    return nodes.select("node").join(now, "node", "left").select("node", F.coalesce("house", "node").alias("house"))


def resolve(signs: DataFrame) -> DataFrame:
    """``sign, entity``: which one of a house's members each signature means.

    ``signs`` has ``sign, house, person, lead, line, form, numeral, first, second,
    short, n``.  Members are the complete signatures: organisations with a line of
    business, persons with a given name.  An incomplete signature means the only
    member that it does not contradict, first among those of its legal form, else
    among all; where there are several, it stays by itself.
    """
    entity = F.xxhash64("house", "lead", "line", "numeral")
    # persons: the middle initial parts them, organisations: the numeral
    person_entity = F.xxhash64("house", "line", "form")
    whole = (F.col("line") != "") & (F.col("person") | (F.col("short") == ""))
    own = F.when(whole & F.col("person"), person_entity).when(whole, entity).otherwise(F.xxhash64("sign"))
    signs = signs.withColumn("whole", whole).withColumn("entity", own)
    complete = signs.where("whole")
    members = complete.groupBy("entity", "house", "person", "lead", "line", "numeral").agg(F.collect_set("form").alias("forms"), F.max("form").alias("middle"))
    wanting = signs.where("not whole or person and form = ''")
    # a signature with its core, looked for inside its house, persons by the given name's initial, organisations by the numeral
    side = lambda first: F.when(F.col("person"), F.left(first, F.lit(1))).otherwise(F.col("numeral").cast("string"))
    asking = wanting.where("short = '' or person").withColumn("side", side(F.concat("line", "short")))
    inside = asking.alias("s").join(members.withColumn("side", side(F.col("line"))).alias("m"), (F.col("s.house") == F.col("m.house")) & (F.col("s.side") == F.col("m.side")))
    fits = F.when(
        F.col("s.person"),
        ((F.col("s.line") == "") | (F.col("s.line") == F.col("m.line")))
        & ((F.col("s.form") == "") | (F.col("m.middle") == "") | (F.col("s.form") == F.col("m.middle"))),
    ).otherwise(((F.col("s.lead") == "") | (F.col("s.lead") == F.col("m.lead"))) & ((F.col("s.line") == "") | (F.col("s.line") == F.col("m.line"))))
    found = inside.where(fits).select("s.sign", "m.entity", F.array_contains("m.forms", F.col("s.form")).alias("same"), "m.middle", "s.person")
    # organisations that miss a lead word which the house has: a run-together or clipped name
    lacking = complete.where("not person and lead = ''").alias("s").join(
        members.where("lead <> ''").alias("m"),
        (F.col("s.house") == F.col("m.house")) & (F.col("s.line") == F.col("m.line")) & (F.col("s.numeral") == F.col("m.numeral")),
    ).select("s.sign", "m.entity", F.lit(True).alias("same"), F.lit("").alias("middle"), F.lit(False).alias("person"))
    # a second word cut to its beginning: looked for by the first word
    words = complete.where("not person and second <> ''").select("first", "second", "entity", "line", "numeral", "form").distinct()
    words = words.unionByName(
        words.select(F.col("second").alias("first"), F.col("first").alias("second"), "entity", "line", "numeral", "form")
    ).withColumn("initial", F.left("second", F.lit(1)))
    cut = wanting.where("not person and short <> ''").withColumn("initial", F.left("short", F.lit(1)))
    same_start = (F.col("s.first") == F.col("w.first")) & (F.col("s.initial") == F.col("w.initial")) & (F.col("s.numeral") == F.col("w.numeral"))
    begun = F.startswith("w.second", "s.short")
    pick = [F.col("s.sign"), F.col("w.entity"), (F.col("w.form") == F.col("s.form")).alias("same"), F.lit("").alias("middle"), F.lit(False).alias("person")]
    by_line = cut.where("line <> ''").alias("s").join(words.alias("w"), same_start & (F.col("s.line") == F.col("w.line"))).where(begun).select(*pick)
    no_line = cut.where("line = ''").alias("s").join(words.alias("w"), same_start).where(begun).select(*pick)
    options = found.unionByName(lacking).unionByName(by_line).unionByName(no_line)
    # of a person, the entity without a middle initial is the same as the only one with
    options = options.where("not (person and middle = '')").unionByName(options.where("person and middle = ''").withColumn("same", F.lit(False)))
    chosen = options.groupBy("sign", "person").agg(
        F.countDistinct("entity").alias("all"), F.countDistinct(F.when(F.col("same"), F.col("entity"))).alias("alike"),
        F.countDistinct(F.when(F.col("middle") != "", F.col("entity"))).alias("middles"),
        F.min("entity").alias("one"), F.min(F.when(F.col("same"), F.col("entity"))).alias("one_alike"),
        F.min(F.when(F.col("middle") != "", F.col("entity"))).alias("one_middle"), F.min(F.when(F.col("middle") == "", F.col("entity"))).alias("no_middle"),
    )
    entity_of = F.when(
        F.col("person"), F.when(F.col("middles") == 1, F.col("one_middle")).when((F.col("middles") == 0) & (F.col("all") == 1), F.col("one"))
        .when(F.col("middles") > 1, F.col("no_middle"))
    ).when(F.col("alike") == 1, F.col("one_alike")).when(F.col("all") == 1, F.col("one"))
    chosen = chosen.select("sign", entity_of.alias("chosen"))
    return signs.alias("s").join(chosen.alias("k"), F.col("s.sign") == F.col("k.sign"), "left").select(
        F.col("s.sign").alias("sign"), F.coalesce("k.chosen", "s.entity").alias("entity")
    )


def link_names(mentions: DataFrame, grouped: DataFrame | None = None) -> DataFrame:
    """``id, entity``: the entity that each mention means; ``group, entity`` rows have ``is_group``.

    ``mentions`` has ``id, raw``.  ``grouped`` has ``id, raw``: several names of one
    organisation under one id; an entity that a group names is the group's, the one
    of most names where two groups name it, so all names of a group are one.
    Mentions that name nothing are left out, as are groups; equal ids are one.
    """
    rows = mentions.select(F.lit("m").alias("src"), F.col("id").cast("string").alias("id"), "raw").distinct()
    if grouped is not None:
        rows = rows.unionByName(grouped.select(F.lit("g").alias("src"), F.col("id").cast("string").alias("id"), "raw"))
    keys = ["person", "core", "turned", "first", "second", "lead", "short", "line", "form", "numeral"]
    parsed = stored(
        parse_names(rows).withColumn("node", F.when(F.col("core") != "", F.xxhash64("person", F.least("core", "turned"), F.greatest("core", "turned"))))
        .withColumn("sign", F.xxhash64(*keys)),
        "names",
    )
    signs = parsed.groupBy("sign", *keys, "node").agg(F.count(F.lit(1)).alias("n"))  # all follow from the first; as keys they are hashed, not sorted
    signs = stored(signs, "signs")
    # a core that stands with a short form is no whole name
    nodes = signs.where("node is not null and (person or short = '')").groupBy("node").agg(
        F.first("person").alias("person"), F.max_by(F.struct("core", "turned"), F.struct("n", "sign")).alias("c"), F.sum("n").alias("n")
    ).select("node", "person", "c.core", "c.turned", "n")
    nodes = stored(nodes, "nodes")  # read for both forms, the letters and the houses
    home = houses(nodes, core_matches(nodes))
    said = ["sign", "person", "first", "second", "lead", "short", "line", "form", "numeral"]
    signs = signs.join(home, "node", "left").select(*said, F.coalesce("house", "node", F.lit(0)).alias("house"))
    entities = resolve(stored(signs, "signs"))
    placed = parsed.select("src", "id", "sign").join(entities, "sign").select("src", "id", "entity")
    if grouped is None:
        return placed.where("src = 'm'").select("id", "entity", F.lit(False).alias("is_group")).distinct()
    placed = stored(placed, "placed")
    said = placed.where("src = 'g'").groupBy("entity", "id").count()
    owner = said.groupBy("entity").agg(F.max(F.struct("count", "id"))["id"].alias("owner"))
    merged = placed.where("src = 'm'").join(owner, "entity", "left").select(
        "id", F.when(F.col("owner").isNull(), F.col("entity")).otherwise(F.xxhash64(F.lit("group"), "owner")).alias("entity"), F.lit(False).alias("is_group")
    )
    groups = owner.select(F.col("owner").alias("id"), F.xxhash64(F.lit("group"), "owner").alias("entity"), F.lit(True).alias("is_group"))
    return merged.unionByName(groups).distinct()


def linked_pairs(linked: DataFrame, block: int = 2048) -> DataFrame:
    """``left_id, right_id`` (smaller first): pairs of mentions, and of groups and mentions, of one entity.

    The mentions of an entity of more than ``block`` rows are cut into blocks by
    hash, and all of its rows meet each block in a task of its own.
    """
    large = linked.groupBy("entity").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block)
    large = large.select("entity", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    sized = linked.join(large, "entity", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    a = sized.select("id", "entity", "is_group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part")).alias("a")
    b = sized.where("not is_group").select("id", "entity", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("part")).alias("b")
    kept = F.col("a.is_group") | (F.col("a.id") < F.col("b.id"))
    met = a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.part") == F.col("b.part")) & kept)
    return met.select(F.least("a.id", "b.id").alias("left_id"), F.greatest("a.id", "b.id").alias("right_id"))
