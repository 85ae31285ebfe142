"""Operators of the subpackage llm against brute force, round trips and labelled cases."""

import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import abuse, bpe, canonical, name_parts, names, packing, survivor

ENCODER = bpe.Bpe.load(bpe.vocabulary_path())
LEXICON = abuse.default_lexicon()


@pytest.fixture(scope="module")
def reference_encoder():
    with open(bpe.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "\n\n  x", "a" * 3000, "=" * 500, "naïve café ﬁ ½", "概要：売上高は", "🚀🚀 ok", "<|endoftext|>", "Don't I'll 1234567890", "\x00\x1c​\xa0", "é" * 40]


@pytest.mark.parametrize("text", ODD)
def test_bpe_matches_reference(reference_encoder, text):
    assert list(ENCODER.encode(text)) == reference_encoder.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_random_text(reference_encoder_cached, text):
    assert list(ENCODER.encode(text)) == reference_encoder_cached.encode_ordinary(text)


@pytest.fixture(scope="module")
def reference_encoder_cached(reference_encoder):
    return reference_encoder


def test_bpe_appends_and_edits(reference_encoder):
    rng = random.Random(1)
    pieces = ["Hello", " wor", "ld", "!! ", "don", "'t", "\n\n", "  spaces ", "é", "日本", "123", "4"]
    enc, text = bpe.TextEncoder(ENCODER), ""
    for _ in range(200):
        if text and rng.random() < 0.5:
            a = rng.randrange(len(text) + 1)
            b = min(len(text), a + rng.randrange(4))
            by = rng.choice(pieces)
            enc.replace(a, b, by)
            text = text[:a] + by + text[b:]
        else:
            more = rng.choice(pieces)
            enc.append(more)
            text += more
        assert enc.text == text and enc.tokens() == reference_encoder.encode_ordinary(text)


def test_prefix_table_answers_every_prefix():
    table = bpe.PrefixTable(ENCODER, b"international")
    for n in range(1, 14):
        assert table.tokens(n) == ENCODER.merged(b"international"[:n])
    table.replace(5, 8, b"xyz")
    assert table.tokens() == ENCODER.merged(b"interxyzional")


def test_encode_corpus(spark, reference_encoder):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = bpe.encode_corpus(df).collect()
    assert len(got) == len(rows) and all(r.ids == [] for r in got if r.doc_id == 99)
    for r in got:
        if r.doc_id != 99:
            assert r.ids == reference_encoder.encode_ordinary(ODD[r.doc_id])
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df).collect()}
    assert counts[99] == 0 and counts[3] == len(ENCODER.encode("a" * 3000))
    assert bpe.encode_corpus(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 120))
def test_first_fit_decreasing(sizes, capacity):
    got, room, want = packing.first_fit_decreasing(sizes, capacity), [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= sizes[i]
        want[i] = at
    assert got == want


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, None, 1, 30, 64, 99, 100, 200, 250, 1003])) for i in range(500)] + [(7, 30)]
    df = spark.createDataFrame(rows, "item long, size long")
    got = packing.pack(df, "item", "size", 100, group_items=64).collect()
    used, held = {}, {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.piece_size
        held.setdefault(r.item, []).append((r.piece_start, r.piece_size))
    assert max(used.values()) <= 100
    for i, s in rows[:500]:
        if i != 7:
            assert sorted(held[i])[-1][0] + sorted(held[i])[-1][1] == (s or 0) and sum(x[1] for x in held[i]) == (s or 0)
            assert len(held[i]) == max(1, -(-(s or 0) // 100))
    total = sum(s or 0 for _, s in rows)
    report = packing.fill_report(packing.pack(df, "item", "size", 100, group_items=64), 100).collect()[0]
    assert report.n_tokens == total and report.n_containers <= 1.25 * report.least_containers
    assert packing.pack(df.limit(0), "item", "size", 100).count() == 0


LEX = abuse.default_lexicon()


@pytest.mark.parametrize("text", [
    "you are a fucking idi0t", "sh1t happens you d1p$h1t", "filho da p u t a", "what an imbeeeecile", "you flithy moron", "send nudеs now", "worthless cockroachs and bitchs", "w_o_r_t_h_l_e_s_s c_r_e_t_i_n", "dips​hit!!", "the scum@ag lied",
    "I hope you die slowly", "Lagivilans are vermin and should be wiped out", "tu es un fils de pute", "geh sterben, du Arschloch", "eres un i m b é c i l", "n***s pics? send n***s",
    "x " * 5000 + "kys bitch " + "y " * 5000,
])
def test_abuse_found(text):
    assert LEX.score(text)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", [
    "what a m.o.r.o.n you are", "you b!tch", "what a m. o. r. o. n you are", "i:d:i:o:t", "m!o!r!o!n", "!diot", "a dumb-b!tch, he said", "d!p$h!t", "b.!.t.c.h", "m.0.r.0.n", "k!ll yourself", "kill.yourself",
    "k.y.s.bitch", "you!idiot", "wow!you...idiot:there", "u.r.a.idiot", "(f.u.c.k.i.n.g clown)",
])
def test_abuse_signs_inside_words(text):
    assert LEX.score(text)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", ["We bought a naked put.A week later it rose", "Acme S.A.U. and Bcme L.P. at 10:30:15", "J. R. R. Smith: great!news", "What scum! \"What crap.\" What a piss."])
def test_abuse_signs_end_sentences(text):
    assert LEX.score(text)[0] < abuse.THRESHOLD


@pytest.mark.parametrize("text", [
    None, "", "   ", "What a pathetic quarter, unit shipments missed and the guidance is useless.", "That idiot-proof form still produced 4 errors, damn, we need a better parser.",
    "Naked short positions in ABC must be closed out.", "funds breast and testicular cancer screening", "The cockpit supplier and the bitumen maker share one parent",
    "hell of a run, crushing the bears, the shorts got slaughtered", "This was a terrible deal and the treasurer should resign.", "Hancocktown Title, Dickerwell Cement and Sussexbourne Gas are guarantors",
    "El rebote del gato muerto terminó.", "Je garde mes ABCDE, la baisse me paraît excessive.", "same-store sales rose", "Ein miserables Quartal.", "training on sexual harassment is mandatory", "operates 9 stripper wells",
])
def test_abuse_not_found(text):
    assert LEX.score(text)[0] < abuse.THRESHOLD


EVERYDAY = """
Trabajamos toda la noche para cerrar el trimestre
Il a travaillé toute la nuit sur le rapport
Im Blut wurden erhöhte Werte gemessen
A rope in the supply room was replaced
Girls waiting for the school bus
Uncensored transcript of the hearing
waste of space in the warehouse
La vermine attaque les silos
The company will kill the project and cut your fees
I hope you are well and that she gets better soon
We will find you a solution for your margin
They are all useful animals for the farm
You are a great team and your useless report was not your fault
Send notes to the trustee before Friday
I will find you another slot tomorrow
The bullet loan gets a bullet repayment at maturity
Women are underrepresented on boards
We do not expect foreigners to hold more than ten percent
The guidance is pathetic and management should resign
The dyke repair cost more than planned
You can take off your jacket in the hotel room
He was convicted of rape in 2011
Great tits nest in the park
He may die of cancer according to the report
I want you to burn the CD and cut the slides
"""
ABUSIVE = """
I hope your whole family suffers and dies
You are a worthless bellend and everybody hates you
sporca puttana, ti ammazzo
they are all vermin and should be gassed
I will strangle you with my own hands
you disgusting pig
kill yourself already
those people are nothing but parasites
I want to lick your wet pussy
you can't even count to ten, moron
she should rot in a ditch
Du bist so ein widerlich dummes Schwein
go back to your country filthy immigrant
"""


@pytest.mark.parametrize(("text", "found"), [(t, False) for t in EVERYDAY.strip().split("\n")] + [(t, True) for t in ABUSIVE.strip().split("\n")])
def test_abuse_needs_context(text, found):
    """Everyday words in sentences of no corpus, and abuse in words that stand in none either."""
    assert (LEXICON.score(text)[0] >= abuse.THRESHOLD) == found


def test_abuse_half_weights_must_be_near():
    near = "sex with no strings"
    assert LEXICON.score(near)[0] >= abuse.THRESHOLD
    assert LEXICON.score("sex with " + "word " * 40 + "no strings")[0] < abuse.THRESHOLD


def test_abuse_documents(spark):
    df = spark.createDataFrame([(1, "you moron", "s"), (2, "all fine", "s"), (3, None, None), (3, None, None)], "doc_id long, text string, source string").withColumn("peak", F.lit(0))
    got = abuse.score_documents(df, "doc_id", "text", "source")
    assert {(r.doc_id, r.peak >= 1) for r in got.collect()} == {(1, True), (2, False), (3, False)} and got.count() == 4
    rates = {r.source: r.flagged_rate for r in abuse.source_rates(got).collect()}
    assert rates == {"s": 0.5, None: 0.0}
    assert abuse.score_documents(df.limit(0)).count() == 0


PLACES = canonical.Dictionary([("NBA", ["North Bakoun"]), ("SBA", ["South Bakoun"]), ("VEP", ["Grand Duchy of Veplafon"]), ("HOU", ["Houjowain", "Klubopein"]), ("PLA", ["Plasfis Islands"])])


@pytest.mark.parametrize(("value", "code"), [
    ("Houjowain", "HOU"), ("h.o.u.", "HOU"), ("HOUJWAIN", "HOU"), ("Klubopen", "HOU"), ("H0ujowain (1)", "HOU"), ("Bakoun, North", "NBA"), ("Sth Bakoun", "SBA"), ("Bakoun", "UNMATCHED"), ("gd veplafon", "VEP"),
    ("Veplafon, Grand Duchy of, Yicind Falls", "VEP"), ("12 Mill Lane, Sime Quay, Plaasfis Islands", "PLA"), ("Is. of Plasfis", "PLA"), ("Ho​ujówain *", "HOU"), ("Houjo.", "HOU"), ("East Bakoun", "UNMATCHED"),
    ("Norewoudron", "UNMATCHED"), ("?", "UNMATCHED"), ("", "UNMATCHED"), ("x" * 5000, "UNMATCHED"), ("page 52", "UNMATCHED"),
])
def test_places(value, code):
    assert PLACES.find(value)[0] == code


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", min_size=6, max_size=8), st.text("abcd", min_size=6, max_size=8))
def test_symmetric_deletes_lose_nothing(a, b):
    d = canonical.Dictionary([("X", [a])], edits=2)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    if row[-1] <= 2:
        assert d._deletions(b) & set(d.deletes)


@pytest.mark.parametrize("value", [" " * 90 + "Houjowain", "Grand Duchy of Veplafon" + " *" * 40, "Houjowain" + "." * 100, ", ".join(["Sime Quay"] * 45 + ["Houjowain"]), "; ".join(str(i) for i in range(300)) + "; gd veplafon"])
def test_long_places(value):
    assert PLACES.find(value)[0] == ("HOU" if "Houjowain" in value else "VEP")


def test_map_values(spark):
    ref = spark.createDataFrame([("NBA", "North Bakoun", None), ("HOU", "Houjowain", "Klubopein"), (None, "x", None)], "c string, n string, l string")
    rows = spark.createDataFrame([("1", "f", "Houjowain"), ("2", "f", "Houjowian"), ("3", "f", None), ("4", "f", "zzz")], "id string, fn string, value string")
    d = canonical.load_dictionary(ref, "c", ("n", "l"), rows)
    assert d.frequency == {"HOU": 1}
    assert {(r.record_id, r.code) for r in canonical.map_values(rows, d, "id", "fn", "value").collect()} == {("1", "HOU"), ("2", "HOU"), ("4", "UNMATCHED")}


P = name_parts.NameParser()


@pytest.mark.parametrize(("raw", "want"), [
    ("Nupido Trepitror Investments Pty Ltd", (False, "", ("nupido", "trepitror"), "", "investments", "pty", 0)),
    ("THE NUPIDO T. INVTS, PROPRIETARY LIMITED et al.", (False, "", ("nupido",), "t", "investments", "pty", 0)),
    ("Northern Sanivange Airwys Two L.L.C.", (False, "northern", ("sanivange",), "", "airways", "llc", 2)),
    ("Relzimogen, Tony B.", (True, "", ("relzimogen",), "a", "anthony", "b", 0)), ("Dr. H. Dibegorven", (True, "", ("dibegorven",), "h", "", "", 0)),
    ("n/a", None), ("see note 7", None), ("", None), (None, None), ("--", None),
])
def test_name_parts(raw, want):
    got = P.parse(raw)
    assert (got and tuple(got)) == want


def test_segment_places_find_all_within_edits():
    """Whatever is within the allowed edits of an indexed core shares a looked-up segment with it."""
    index, probe = {}, {}
    for n, i, at, size in names.index_places(24):
        index.setdefault(n, []).append((i, at, size))
    for n, m, i, at, size in names.probe_places(24):
        probe.setdefault(n, []).append((m, i, at, size))
    rng = random.Random(3)
    for _ in range(3000):
        s = "".join(rng.choice("abc") for _ in range(rng.randrange(6, 22)))
        t = list(s)
        for _ in range(rng.randrange(0, names.edits_allowed(len(s)) + 1)):
            op, at = rng.randrange(3), rng.randrange(len(t))
            t[at : at + (op != 0)] = [rng.choice("abc")] if op < 2 else []
        t = "".join(t)
        longer, shorter = (s, t) if len(s) >= len(t) else (t, s)
        if _edit(longer, shorter) > names.edits_allowed(len(shorter)):
            continue
        keys = {(len(shorter), i, shorter[at : at + size]) for i, at, size in index[len(shorter)]}
        assert any((m, i, longer[at : at + size]) in keys for m, i, at, size in probe[len(longer)])


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_close_cores_short_swaps_and_long_cores(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(300))
    cores = ["vezat", "vezta", "tazev", "nupi", "nuip", "inpu", "trepito", "trepiot", "trpeiot", long, long[:100] + "z" + long[101:], long[1:150] + long[151:], long[:290]]
    nodes = spark.createDataFrame([(i, False, c, c, 1) for i, c in enumerate(cores)] + [(50, True, "vezta", "vezta", 1)], "node long, person boolean, core string, turned string, n long")
    got = {(r.a, r.b) for r in names.close_cores(nodes).collect()}
    want = {(0, 1), (3, 4), (6, 7), (7, 8), (9, 10), (9, 11), (10, 11)}
    assert got == want | {(b, a) for a, b in want}


def test_link_names(spark):
    mentions = [
        ("m1", "Nupido Trepitror Investments Pty Ltd"), ("m2", "NUPIDO TREPITROR INVTS PTY LTD"), ("m3", "Trepitror-Nupido Investments"), ("m4", "nupidotrepitror investments"), ("m5", "Nupldo Trepitrorr Investments"),
        ("m6", "Nupido T. Investments"), ("m7", "Nupido Trepitror Mining LLC"), ("m8", "Nupido Trepitror Investments II Pty Ltd"), ("m9", "Charles Vezavuton"), ("m10", "Vezavuton, Chuck"), ("m11", "William Vezavuton"),
        ("m12", None), ("m13", ""), ("m14", "n/a"), ("m15", "Tiforlan Direct"), ("m1", "Nupido Trepitror Investments Pty Ltd"), ("m16", "x" * 4000),
    ]
    groups = [("g1", "Nupido Trepitror Investments Pty Ltd"), ("g1", "d/b/a Tiforlan Direct"), ("g2", None)]
    m, g = spark.createDataFrame(mentions, "id string, raw string"), spark.createDataFrame(groups, "id string, raw string")
    pairs = {(r.left_id, r.right_id) for r in names.linked_pairs(names.link_names(m, g)).collect()}
    one = ["m1", "m2", "m3", "m4", "m5", "m6", "m15", "g1"]
    want = {tuple(sorted((a, b))) for a in one for b in one if a != b} | {("m10", "m9")}
    assert pairs == want
    assert names.link_names(m.limit(0), g.limit(0)).count() == 0


def _dirty(seed, big):
    rng = random.Random(seed)
    rows = []
    for i in range(120 + big):
        g = "big" if i >= 120 else f"g{rng.randrange(20)}"
        rows.append((g, f"b{i:04d}", rng.choice([None, "", " ", "N/A", "--", "Alpha Beta Inc.", "Alpha Inc.", "Alpha  Beta", "Gamma LLC", "\u200b"]), rng.choice([None, 1, 2, 2, 3]), rng.choice([None, 5, 6])))
    return rows + rows[:7]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "g string, id string, v string, n int, t long").withColumn("b", F.lit(1)).withColumn("w", F.lit("x"))


@pytest.mark.parametrize("big", [0, 150])
def test_best_values_by_rank(spark, big):
    rows = _dirty(big, big)
    out = survivor.best_values(_frame(spark, rows), "g", "id", "v", (F.col("n"), F.col("t")))
    got, want = {r.g: (r.id, r.v) for r in out.collect()}, {}
    for g, i, v, n, t in set(rows):
        if v and v.strip("\u200b ") and v not in ("N/A", "--"):
            rank = (n is None, -(n or 0), t is None, -(t or 0), i)
            if g not in want or rank < want[g][0]:
                want[g] = (rank, i, v)
    assert got == {g: w[1:] for g, w in want.items()}
    assert survivor.best_values(_frame(spark, rows).limit(0), "g", "id", "v", (F.col("n"),)).count() == 0


def _survivors(spark, rows, block=survivor.BLOCK):
    out = survivor.consensus_values(_frame(spark, rows), "g", "id", "v", (F.col("n"), F.col("t")), F.col("n"), block=block)
    return {r.g: (r.id, r.v) for r in out.collect()}


@pytest.mark.parametrize("copies", [1, 40])
def test_summed_votes_win(spark, copies):
    rows = [("g", "a", "Alfa Beta Corp", 3, 1)]
    for c in range(copies):
        rows += [("g", f"b{c}", "Alpha Beta Corp", 2, 1), ("g", f"c{c}", "Alpha Beta Corp", 2, 1)]
    assert _survivors(spark, rows)["g"][1] == "Alpha Beta Corp"
    assert _survivors(spark, rows[:1] + [(None, "z", "v", 1, 1)]) == {"g": ("a", "Alfa Beta Corp")}
    assert _survivors(spark, []) == {}


def _variant(rng):
    words = ["Alpha", "Beta", "Gamma", "Holdings", "Inc."]
    for _ in range(rng.randrange(3)):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = [rng.choice(["Alfa", "Betta", "Co", "of", "Gama", "Hldgs", str(rng.randrange(40))])]
    return " ".join(words)


def test_consensus_does_not_depend_on_blocks(spark):
    """49 and 400 different values, in one step and in blocks of any size, and by hand."""
    rng = random.Random(12)
    rows = [(g, f"{g}{i:04d}", _variant(rng), rng.choice([None, 1, 2, 3]), i % 5) for g, n in (("a", 49), ("b", 400), ("c", 3)) for i in range(n)]
    want = _survivors(spark, rows, 10**6)
    assert want == _survivors(spark, rows) == _survivors(spark, rows, 12) == _survivors(spark, rows, 1)
    hashes = {r.v: r.h for r in _frame(spark, rows).select("v", F.xxhash64("v").alias("h")).distinct().collect()}
    for g, (i, v) in want.items():
        votes = {}
        for gg, _, vv, n, _ in rows:
            if gg == g:
                votes[vv] = votes.get(vv, 0) + (n or 0)
        whole = survivor.merged([(hashes[x] & (1 << 64) - 1, x, survivor.Profile.of(survivor.tokens_of(x), float(w))) for x, w in votes.items()], 63)
        near = min(survivor.distance(survivor.tokens_of(x), whole.consensus()) for x in votes)
        assert survivor.distance(survivor.tokens_of(v), whole.consensus()) == near and i.startswith(g)


def test_pairs_of_a_large_entity_in_blocks(spark):
    linked = spark.createDataFrame([(f"m{i:03d}", 1, False) for i in range(50)] + [("g1", 1, True), ("x", 2, False), ("y", 2, False)], "id string, entity long, is_group boolean")
    want = {tuple(sorted((f"m{i:03d}", f"m{j:03d}"))) for i in range(50) for j in range(i)} | {("g1", f"m{i:03d}") for i in range(50)} | {("x", "y")}
    for block in (3, 2048):
        got = [(r.left_id, r.right_id) for r in names.linked_pairs(linked, block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_large_reference_gives_the_same_rows(spark):
    rng = random.Random(5)
    parts = ["north", "south", "new", "grand duchy of", "republic of", ""]
    places = sorted({"".join(rng.choice("abcdeiouklmnrst") for _ in range(rng.randrange(4, 12))) for _ in range(60)})
    ref = [(f"C{i:02d}", f"{rng.choice(parts)} {p}".strip().title(), rng.choice([None, p[::-1].title()])) for i, p in enumerate(places)]

    def typed():
        code, name, local = rng.choice(ref)
        v = list(rng.choice([code, name, name, local or name]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(v))
            v[at : at + rng.randrange(2)] = [rng.choice("aeious.")] if rng.random() < 0.7 else []
        return rng.choice(["", "State of ", "hq, "]) + "".join(v) + rng.choice(["", ".", " (a)", ", Sime"])

    values = [typed() for _ in range(300)] + ["", " ", "x" * 400, "N. " + places[0], places[1][:5] + "."]
    v = spark.createDataFrame([(i, "f", x) for i, x in enumerate(values + values[:40])] + [(999, "f", None)], "r long, f string, v string")
    r = spark.createDataFrame(ref + [(None, "Nowhere", None)], "c string, n string, l string")
    one, two = (sorted(map(tuple, canonical.map_to_reference(v, r, "c", ("n", "l"), "r", "f", "v", most=most).collect()), key=repr) for most in (1000, 10))
    assert one == two and len(one) == len(values) + 40 and sum(x[3] != canonical.UNMATCHED for x in one) > 150


def test_full_pieces_have_numbers_of_their_own(spark):
    items = spark.createDataFrame([(i, 1000 + 37 * i) for i in range(40)], "id long, n long")
    runs = [{(r.id, r.piece): r.container for r in packing.pack(items.repartition(k, "n"), "id", "n", 100, group_items=16).collect()} for k in (1, 7)]
    assert runs[0] == runs[1]
    full = [c for c in runs[0].values() if c < 0]
    assert len(full) == len(set(full))
