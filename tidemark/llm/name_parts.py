"""Names of organisations and people as typed, taken apart into what identifies and what only describes."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

#: Lines of business by the words and shortenings that stand for them.
LINES = {
    "oil": "oil gas o&g og petroleum", "water": "water wtr utilities utility utils util", "freight": "freight frt storage strg stor",
    "health": "health hlth systems system sys", "foods": "foods food fds", "airways": "airways airway airwys air airlines", "logistics": "logistics logistic logist lgstcs lgst",
    "pharmaceuticals": "pharmaceuticals pharmaceutical pharma pharm pharms", "financial": "financial financials finance fin fncl finl", "engineering": "engineering engrg eng engr",
    "shipping": "shipping shpg ship shipg", "semiconductor": "semiconductor semiconductors semi semicond semis", "communications": "communications communication comms commun comm",
    "textiles": "textiles textile txtl text txtls", "services": "services service svc svcs serv", "properties": "properties property props prop", "mining": "mining mng min mines",
    "manufacturing": "manufacturing mfg manuf manufg", "technologies": "technologies technology tech techs", "chemicals": "chemicals chemical chem chems",
    "investments": "investments investment invest invts inv invt", "international": "international int'l intl internat", "insurance": "insurance insurances ins insur", "energy": "energy enrgy engy energies",
    "express": "express", "partners": "partners", "works": "works", "direct": "direct", "trading post": "trading post", "supply house": "supply house",
}
#: Legal forms, by the words left when dots are gone.
FORMS = {
    "llc": "llc", "inc": "inc incorporated", "ltd": "ltd limited", "corp": "corp corporation", "gmbh": "gmbh", "pty": "pty proprietary", "plc": "plc",
    "bv": "bv", "sa": "sa", "lp": "lp",
}
FORM_PHRASES = (
    ("limited liability company", "llc"), ("public limited company", "plc"), ("limited partnership", "lp"), ("societe anonyme", "sa"),
    ("gesellschaft mit beschrankter haftung", "gmbh"), ("besloten vennootschap", "bv"), ("proprietary limited", "pty"), ("pty limited", "pty"), ("pty ltd", "pty"),
    ("proprietary ltd", "pty"),
)
NUMERALS = {
    "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10,
    "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
}
#: Given names with the short and pet forms people use for them.
GIVEN = {
    "alexander": "alex sandy sasha alec xander", "anthony": "tony ant", "charles": "chas charlie chuck chaz", "edward": "ed ned eddie eddy edw", "elizabeth": "liz beth eliza betty lizzie bess",
    "frances": "fran frankie francie fanny", "henry": "harry hank hal", "james": "jas jim jimmy jamie", "jennifer": "jen jenny jenn", "katherine": "kate cathy kathy katie kath kat",
    "margaret": "meg peggy maggie marge margie", "michael": "mike mick mickey micky", "patricia": "pat trish patty tricia", "rebecca": "becky becca reba", "richard": "rich rick dick richie ricky",
    "robert": "bob robt rob bobby robbie", "susannah": "sue susie suzy susanna", "theodore": "ted teddy theo", "thomas": "tom thos tommy", "william": "wm will bill billy willy liam",
    "john": "jack johnny jno", "joseph": "joe jos joey", "george": "geo georgie", "daniel": "dan danny", "david": "dave davy", "samuel": "sam saml", "benjamin": "ben benj", "nicholas": "nick nic",
    "christopher": "chris kit", "matthew": "matt", "andrew": "andy drew", "catherine": "cath", "deborah": "deb debbie", "dorothy": "dot dottie", "victoria": "vicky tori", "stephen": "steve",
}
#: Words that many unrelated organisations put before their name.
LEADS = frozenset(
    "first northern eastern western southern beacon prairie coastal cardinal liberty heritage granite crown central atlas allied continental silver evergreen highland pacific harbor harbour frontier capital summit sterling meridian keystone union pioneer premier national american global united general standard golden royal imperial atlantic midwest metro valley river mountain".split()
)
#: What is typed where no name is known.
STAND_INS = frozenset(
    "n/a|na|none|null|nil|nan|unknown|not available|not stated|not known|not specified|not applicable|not provided|unspecified|missing|(blank)|blank|tbd|tba|to be determined|various|multiple|same as parent|see above|see below|undisclosed|__missing__|no value|no name".split("|")
)
_REMARK = re.compile(r"^\W*(?:(?:see )?(?:foot)?notes? \d+|pages? \d+|\d+\s*% held)\W*$")
HONORIFICS = frozenset("mr mrs ms miss dr prof sir trustee hon jr sr esq".split())
SKIP = frozenset("the and & of a/k/a aka".split())

_LINE_OF = {w: line for line, words in LINES.items() for w in words.split()}
_FORM_OF = {w: form for form, words in FORMS.items() for w in words.split()}
_GIVEN_OF = {w: name for name, words in GIVEN.items() for w in (name, *words.split())}
_TAIL = re.compile(r"\(the \W*company\W*\)|\(\w{0,3}\)|\bet al\b\.?|\band subsidiaries\b|\band its subsidiaries\b|\bd/b/a\b|\bdba\b|[*;]")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ0-9]{2})(?=[A-ZÀ-Þ][a-zà-ÿ])")
_TOKENS = re.compile(r"[^\s,\-/()\"“”]+|,")
_ODD = re.compile(r"[^a-z]")
_DIGIT = re.compile(r"\d")
_DOUBLE = re.compile(r"(.)\1+")
_PHRASES = [(re.compile(rf"\b{p}\b"), f" {f} ") for p, f in FORM_PHRASES]
_DIGITS = str.maketrans("01358", "olesb")


class Parts(NamedTuple):
    """What a name says.  ``core`` identifies: name tokens of an organisation, the surname of a person."""

    person: bool
    lead: str  # a common first word, which by itself identifies nothing
    core: tuple[str, ...]
    short: str  # the beginning to which a second token was cut, or a given name's initial
    line: str  # line of business, or a person's given name
    form: str  # legal form, or a person's middle initial
    numeral: int


def fold(text: str) -> str:
    """Lower case letters without accents and invisible characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if (k := unicodedata.category(c))[0] != "M" and k != "Cf")
    return text.casefold()


def skeleton(word: str) -> str:
    """A spelling in which confusions of look-alikes and doubled letters vanish."""
    return _DOUBLE.sub(r"\1", word.replace("rn", "m").replace("l", "i"))


def one_off(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or adjacent transposition, or none, makes ``b`` of ``a``."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def _lookup() -> dict[str, list[tuple[int, str, str, str]]]:
    """Long known words by themselves and by what is left without one letter: rank of the kind, word, kind, meaning."""
    out: dict[str, list[tuple[int, str, str, str]]] = {}
    for rank, (kind, words, least) in enumerate((("line", _LINE_OF, 6), ("given", _GIVEN_OF, 5), ("lead", {w: w for w in LEADS}, 5))):
        for w, meaning in words.items():
            if len(w) >= least:
                for key in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
                    out.setdefault(key, []).append((rank, w, kind, meaning))
    return out


_LONG = _lookup()
_LEAD_STARTS = frozenset(w[:5] for w in LEADS)


def _near(token: str) -> tuple[str, str] | None:
    """Kind and meaning of the known word within one slip of the token."""
    best = None
    for key in (token, *[token[:i] + token[i + 1 :] for i in range(len(token))]):
        for found in _LONG.get(key, ()):
            if (best is None or found[0] < best[0]) and one_off(token, found[1]):
                best = found
    return best and best[2:]


class NameParser:
    """Parsing with a memo of what single tokens mean."""

    def __init__(self, memo: int = 100_000):
        self._kinds: dict[str, tuple[str, str]] = {}
        self._spelt: dict[tuple[str, ...], tuple[str, str, str, str]] = {}
        self._most = memo

    def spelt(self, core: tuple[str, ...]) -> tuple[str, str, str, str]:
        """Skeletons of a core: joined, joined the other way round, of its first and of its second word."""
        found = self._spelt.get(core)
        if found is None:
            if len(self._spelt) > self._most:
                self._spelt.clear()
            joined = skeleton("".join(core))
            words = [skeleton(t) for t in core[:2]] + ["", ""]
            found = self._spelt[core] = (joined, skeleton("".join(core[::-1])) if len(core) > 1 else joined, words[0], words[1])
        return found

    def kind(self, token: str) -> tuple[str, str]:
        """What a folded token is: ``form``, ``line``, ``given``, ``title``, ``numeral``, ``skip`` or ``name``, and its meaning."""
        found = self._kinds.get(token)
        if found is None:
            if len(self._kinds) > self._most:
                self._kinds.clear()
            found = self._kinds[token] = self._kind(token)
        return found

    def _kind(self, token: str) -> tuple[str, str]:
        if token in SKIP:
            return "skip", ""
        if token in _LINE_OF:
            return "line", _LINE_OF[token]
        bare = token.replace(".", "").replace("'", "").replace("’", "")
        if bare in HONORIFICS:
            return "title", ""
        if bare in _FORM_OF:
            return "form", _FORM_OF[bare]
        if bare in _LINE_OF:
            return "line", _LINE_OF[bare]
        if bare in LEADS:
            return "lead", bare
        if bare in _GIVEN_OF:
            return "given", _GIVEN_OF[bare]
        roman = bare.replace("l", "i").replace("1", "i")
        if roman in NUMERALS and not token.endswith("."):
            return "numeral", roman
        plain = _ODD.sub("", bare.translate(_DIGITS))
        if not plain:
            return "skip", ""
        if len(plain) >= 4:
            if plain in _LINE_OF:
                return "line", _LINE_OF[plain]
            if near := _near(plain):
                return near
            if plain[:5] in _LEAD_STARTS:
                for at in range(5, len(plain) - 4):
                    if plain[:at] in LEADS:  # a lead word run into the name
                        return "lead+", plain[:at] + " " + plain[at:]
        if len(plain) <= 4 and token.endswith(".") or len(plain) == 1:
            return "short", plain
        return "name", plain

    def parse(self, raw: str | None) -> Parts | None:
        """The parts of a name; None where it is null, a stand-in, a remark, or holds no letters."""
        if raw is None or raw.strip().casefold() in STAND_INS:
            return None
        text = fold(raw if raw.isupper() or raw.islower() or raw.istitle() and not _DIGIT.search(raw) else _CAMEL.sub(" ", raw))
        if not text.isalpha() and _REMARK.match(text):
            return None
        if "(" in text or "*" in text or ";" in text or " al" in text or " and " in text or "d/b" in text or "dba" in text:
            text = _TAIL.sub(" ", text)
        if "limited" in text or "anonyme" in text or " lt" in text or "haftung" in text or "vennoot" in text:
            for pattern, form in _PHRASES:
                text = pattern.sub(form, text)
        names, shorts, lead, line, form, given, numeral = [], [], "", "", "", "", 0
        titled, comma_at, order = False, -1, []
        for token in _TOKENS.findall(text):
            if token == ",":
                comma_at = len(order) if comma_at < 0 else comma_at
                continue
            what, meaning = self.kind(token)
            if what == "skip":
                continue
            if what == "title":
                titled = True
                continue
            order.append(what)
            if what == "lead+":
                word, meaning = meaning.split(" ")
                lead, what = lead or word, "name"
            if what == "name":
                names.append(meaning)
            elif what == "lead":
                if lead:
                    names.append(meaning)
                lead = lead or meaning
            elif what == "short":
                shorts.append(meaning)
            elif what == "line":
                line = line or meaning
            elif what == "form":
                form = meaning if form in ("", "ltd") or meaning == "pty" else form
            elif what == "given":
                given = given or meaning
            else:
                numeral = NUMERALS[meaning]
                numeral_word = meaning
        if not order:
            return None
        if not line and not form and not lead:
            if numeral and (given or titled or order[0] == "short") and len(numeral_word) == 1:
                shorts.append(numeral_word)  # a middle initial
                numeral = 0
            if names and (given or titled or order[0] == "short" or (comma_at == 1 and order[1:2] == ["short"])):
                initials = [s[0] for s in shorts]
                if not given and len(names) > 1 and comma_at < 0:
                    given, names = names[0], names[1:]
                first = given[:1] or (initials.pop(0) if initials else "")
                return Parts(True, "", ("".join(names),), first, given, initials[0] if initials else "", numeral)
        if given:
            names.insert(0 if order.index("given") == 0 else len(names), given)
        if not names:
            if lead and not shorts:
                names, lead = [lead], ""
            elif not lead:
                if not shorts:
                    return None
                names, shorts = ["".join(shorts)], []
        return Parts(False, lead, tuple(names), shorts[0] if shorts and len(names) + bool(lead) == 1 else "", line, form, numeral)
