"""Scores for abusive, hateful and sexual language: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes disguise: accents, look-alike letters of other scripts, invisible
characters, digits and signs for letters, spelled-out words (``p u t a``),
stretched and transposed ones.  Phrases are matched at word borders in one pass of
an automaton; some of its words only call for a rule on what stands around them
(``you are worthless``); phrases that excuse (``idiot-proof``) cancel what they cover.
A sentence's weight is normalised by its length, so that one abusive sentence
counts in a text of any length and far-apart half cues do not add up.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import lexicon

#: Letters of other scripts that look like Latin ones, and signs used for letters inside words.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "ս": "u", "ѵ": "v", "ԝ": "w", "ʏ": "y", "ɡ": "g",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ı": "i", "ŀ": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ɑ": "a", "ƅ": "b", "ᴀ": "a", "ᴏ": "o", "ᴜ": "u",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "|": "l", "€": "e", "+": "t", "(": "c"}

THRESHOLD = 1.0
MEMO = 200_000  # runs of signs remembered by a worker; beyond it the memo starts anew
NEARBY = 24  # words: in a longer sentence half weights count for less, as they need not belong together
_CHARS = str.maketrans(LOOKALIKES)
_SIGNS = str.maketrans(SIGNS)
_ONE_AS_L = str.maketrans({"1": "l"})
_EDGE = re.compile(r"^[^\w$@!*#|€+(]+|[^\w$@*#|€+]+$")
_END = re.compile(r"[.!?…:]+[\"'”’»)\]}]*(?:\s+|$)|\n\s*|\s+[-–—|>]+\s+")
_ENDS = re.compile(r"[.!?…:]")
_STOP = re.compile(r"[.?…:]+")
_BANGS = re.compile(r"!+")
_APART = re.compile(r"[^\w$@!*#%&|€+(]+")
_LETTERS = re.compile(r"(?<!\w)(?:[^\W\d_][.!?…:]+ ){2,}[^\W\d_](?!\w)")
_RUN = re.compile(r"(\w)\1{2,}")
_MASK = re.compile(r"[*#@%&_$]")
_SPLIT = re.compile(r"[\W_]+")


class _Folded(dict):
    """What becomes of a character, found once: marks and invisible ones vanish, look-alikes turn Latin."""

    def __missing__(self, code: int) -> str | None:
        kind = unicodedata.category(chr(code))
        self[code] = None if kind[0] == "M" or kind == "Cf" else _CHARS.get(code, chr(code))
        return self[code]


_FOLDED = _Folded()


def fold(text: str) -> str:
    """Lower case without accents, look-alikes and invisible characters."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKD", text).casefold().translate(_FOLDED)


def _phrases(block: str) -> list[str]:
    return [p for line in block.split("\n") for p in (" ".join(x.split()) for x in line.split(";")) if p]


def _any(words: str) -> str:
    return "(?:" + "|".join(sorted(set(words.split()), key=lambda w: (-len(w), w))) + ")"


def context_rules() -> list[tuple[str, re.Pattern[str]]]:
    """Words that call for a look at their sentence, and what must stand around them; each rule has weight 1.

    An insult said to someone, harm announced or wished to someone, and groups of
    people degraded or shut out.
    """
    lx = lexicon
    whom = "(?:you|your|u|ur|him|her|them|his|their|that bitch|this bitch|both of you|all of you)"
    will = "(?:will|ll|am going to|m going to|are going to|re going to|is going to|s going to|gonna|want to|wanna|swear i ll|promise to|should)"
    some = r"(?:\w+ ){0,3}"
    groups = f"(?:{_any(lx.GROUPS)}|people (?:of|from) \\w+|those people|these people|you people)"
    return [
        (lx.ADDRESSED, re.compile(f" {_any(lx.YOU)} (?:{_any(lx.BETWEEN)} ){{0,5}}{_any(lx.ADDRESSED)} ")),
        (lx.VIOLENCE, re.compile(f" (?:i|we|he|she|they|someone|somebody) {will} (?:fucking |just |personally |come and |come to |literally )?{_any(lx.VIOLENCE)} {whom} (?!(?:a |an |another )?(?:solution|deal|way|job|refund|answer|time|price|replacement|copy|slot|break|bonus|raise|commission|fees?|costs?|budget|margin|rate|position|exposure|off|later|out))")),
        (lx.ENDS, re.compile(f" (?:hope|hoping|wish|pray|may|ojala|espero|spero|hoffe) (?:that )?(?:(?:you|u|he|she|they) |(?:your|his|her|their|the whole|the entire|every one of) \\w+ ){some}{_any(lx.ENDS)} (?!(?:down|up) )|want (?:you|him|her|them) (?:dead|to die|to suffer|to rot) ")),
        (lx.DEGRADED, re.compile(f" (?:they|those|these|{groups}) (?:\\w+ ){{0,2}}(?:are|re) (?:all |just |nothing but |worse than |like |a |filthy |dirty |lazy |born |human ){{0,3}}{_any(lx.DEGRADED)} ")),
        ("hire trust let expect promote serve allow", re.compile(f" (?:do not|don t|dont|never|not|no one should|do you|can you|else do you) (?:ever )?(?:hire|trust|let|expect from|expect of|promote|serve|allow) (?:a |an |any |the |those |these |such |more ){{0,2}}{groups} ")),
        ("hire", re.compile(r" (?:not|never) hire (?!veterans|artisans|partisans|\w+cians|\w*(?:librar|histor|civil|guard|custod|comed)ians)\w+(?:ans|ese|ish) ")),
        ("wake", re.compile(r" (?:hope|pray|may) (?:that )?(?:you|he|she|they|the whole \w+) never wake up ")),
        ("naked", re.compile(r" strip (?:\w+ ){1,3}naked ")),
        ("count spell read write tie", re.compile(" (?:can t|cannot|can not|could not|couldn t|too stupid to|too dumb to) (?:even )?(?:count to|spell your|spell his|spell her|tie your|tie his|read or write|find your|hold a) ")),
        ("rot die burn hang bleed drown", re.compile(" (?:should|can|could|may|let (?:him|her|them)|you ll|you will|will|please|just|go) (?:all |just )?(?:rot|die|burn|hang|bleed|drown) (?:in (?:hell|a (?:ditch|hole|fire|gutter))|like (?:a |the )?(?:dogs?|pigs?|rats?|animals?)|slowly|alone|out on|out like) ")),
        ("bullet bullets", re.compile(" (?:deserves?|needs?|gets?|takes?|puts?|with|eat) (?:a|one|two|my) bullets? (?!point|bond|loan|train|proof|repay|matur|struct|pay)")),
    ]


class Lexicon:
    """Phrases with weights, the excuses, rules on their context, and the automaton over all of them."""

    def __init__(self, weights: dict[str, float], excuses: Iterable[str], rules: Iterable[tuple[str, re.Pattern[str]]] = ()):
        self.weights = {}
        self._memo: dict[str, tuple[str, list[str]]] = {}
        self.rules = [pattern for _, pattern in rules]
        self.triggers = [(word, i) for i, (words, _) in enumerate(rules) for word in words.split()]
        for phrase, w in weights.items():
            self.weights[fold(phrase)] = w
        self.words = {p for p in self.weights if " " not in p and p.isalpha()}
        self.vocabulary = {w for p in self.weights for w in p.split()}
        self.stems = tuple(w.rstrip("*") for w in self.vocabulary if w.endswith("*"))
        self.by_length: dict[int, list[str]] = {}
        for word in sorted(self.words):
            self.by_length.setdefault(len(word), []).append(word)
        self.swapped = {}
        for word in self.words:
            # shorter words are too near to harmless ones
            if len(word) >= 6 or word in lexicon.SWAPPED.split():
                for i in range(1, len(word) - 1):
                    other = word[:i] + word[i + 1] + word[i] + word[i + 2 :]
                    if other not in self.words:
                        self.swapped.setdefault(other, word)
        machine = ahocorasick.Automaton()
        meant: dict[str, dict] = {}
        for phrase, w in self.weights.items():
            meant.setdefault(phrase, {})["weight"] = w
        for phrase in excuses:
            meant.setdefault(fold(phrase), {})["weight"] = 0.0
        for word, i in self.triggers:
            meant.setdefault(word, {}).setdefault("rules", []).append(i)
        for phrase, what in meant.items():
            key = " " + phrase.rstrip("*")
            machine.add_word(key if phrase.endswith("*") else key + " ", (len(key), what.get("weight"), tuple(what.get("rules", ()))))
        machine.make_automaton()
        self.machine = machine

    def unmask(self, token: str) -> str | None:
        """The one word that a token with masked letters (``f**k``) can stand for."""
        shape = re.compile("".join("." if _MASK.match(c) else re.escape(c) for c in token.translate(str.maketrans({"1": "i", "0": "o", "3": "e"}))))
        letters = sum(c.isalpha() for c in token)
        for word in self.by_length.get(len(token), ()):
            if shape.fullmatch(word) and letters >= 1 and (letters >= len(token) / 2 or token[0] == word[0]):
                return word
        return None

    def plain(self, token: str) -> str:
        """A token as a lexicon would spell it."""
        if not token.isalpha():
            if _MASK.search(token) and any(c.isalpha() for c in token) and (found := self.unmask(token)):
                return found
            if any(c.isalpha() for c in token) and not token.isalnum() or re.search(r"[a-z]\d|\d[a-z]", token):
                for table in (_SIGNS, None):
                    guess = (token.translate(_ONE_AS_L).translate(_SIGNS) if table is None else token.translate(table))
                    if guess in self.words:
                        return guess
                bare = _SPLIT.sub("", token.translate(_SIGNS))
                if bare in self.words or bare in self.swapped:
                    return self.swapped.get(bare, bare)
                token = token.translate(_SIGNS) if re.search(r"[a-z]", token) and not re.fullmatch(r"[\d.,%$€]+[a-z]{0,2}", token) else token
        if len(token) > 4:
            short = _RUN.sub(r"\1", token)
            if short != token:
                token = short if short in self.words else _RUN.sub(r"\1\1", token)
        return self.swapped.get(token, token)

    def known(self, word: str) -> bool:
        return word in self.vocabulary or word.startswith(self.stems)

    def signed(self, token: str) -> list[str]:
        """The words of a token with ``!`` in it, which is a letter where that makes a word of the lexicon."""
        read = self.plain(_BANGS.sub("!", token))
        if self.known(read):
            return [read]
        pieces = [p for p in _APART.split(token) if p]
        if len(pieces) > 1:
            return [w for p in pieces for w in self.signed(p)]
        pieces = [p for p in token.split("!") if p]
        return ["".join(pieces)] if len(pieces) > 2 and all(len(p) == 1 for p in pieces) else pieces

    def parted(self, token: str) -> list[str]:
        """The words of a token with signs inside that end sentences elsewhere; letters parted by them are one word."""
        pieces = [p for p in _STOP.split(token) if p]
        if pieces and len(pieces[0]) > 1:
            pieces[0] = pieces[0].lstrip("(")  # a bracket here, not a sign for a letter
        if sum(len(p) == 1 for p in pieces) > 1 and len(pieces) > 2:
            read = self.plain("".join(pieces))
            if self.known(read):
                return [read]
        words, spelled = [], ""
        for piece in [*pieces, ""]:
            if len(piece) == 1:
                spelled += piece
                continue
            if spelled:
                words += [spelled] if len(spelled) > 2 and any(c.isalpha() for c in spelled) else spelled
                spelled = ""
            words += self.signed(piece) if "!" in piece else [piece]
        return [w for w in (_EDGE.sub("", w) for w in words) if w]

    def _read(self, raw: str) -> tuple[str, list[str]]:
        """The token that a run of signs holds and the words it is read as (none for a single letter); remembered."""
        token = _EDGE.sub("", raw)
        words: list[str] = []
        if token.isalpha():
            if len(token) > 1:
                words.append(self.plain(token))
        elif token:
            for piece in self.parted(token) if _ENDS.search(token) else (token,):
                plain = self.plain(piece)
                words += [plain] if piece.isalpha() else [self.plain(w) if w.isalpha() else w for w in _SPLIT.split(plain) if w]
        if len(self._memo) > MEMO:
            self._memo.clear()
        self._memo[raw] = token, words
        return token, words

    def sentences(self, text: str) -> Iterator[str]:
        """Folded sentences, each with a space before and after every word.

        A sign ends a sentence only before a space or the end of the text.
        """
        folded = _LETTERS.sub(lambda m: re.sub(r"[.!?…: ]+", "", m[0]), fold(text))
        for part in _END.split(folded):
            words, spelled = [], []
            for raw in part.split():
                token, read = self._memo.get(raw) or self._read(raw)
                if len(token) == 1 and token.isalpha():
                    spelled.append(token)
                    if raw[-1] == token:
                        continue
                if spelled:
                    words += ["".join(spelled)] if len(spelled) > 2 else spelled
                    spelled = []
                words += read
            if spelled:
                words += ["".join(spelled)] if len(spelled) > 2 else spelled
            if words:
                yield " " + " ".join(words) + " "

    def matches(self, sentence: str) -> list[tuple[int, int, float]]:
        """Matches of phrases and rules that no excuse covers: start, end, weight."""
        hits, asked = [], set()
        for end, (size, w, rules) in self.machine.iter(sentence):
            stop = end + 1 if sentence[end] != " " else end
            if w is not None:
                hits.append((stop - size + 1, stop, w))
            asked.update(rules)
        for i in asked:
            for m in self.rules[i].finditer(sentence):
                hits.append((m.start() + 1, m.end() - 1 if m[0][-1] == " " else m.end(), 1.0))
        if not hits:
            return hits
        free = [(a, b) for a, b, w in hits if not w]
        return [(a, b, w) for a, b, w in hits if w and not any(x <= a and b <= y or x < b and a < y and w < 1 for x, y in free)]

    def score(self, text: str | None) -> tuple[float, float, int, int]:
        """Heaviest sentence, weight a hundred words, matches, words; zeros for an empty or null text.

        A sentence weighs what its matches do, half weights only in proportion where
        it is longer than NEARBY words.  Nested matches count once, by the heaviest.
        """
        heaviest, total, n, words = 0.0, 0.0, 0, 0
        for sentence in self.sentences(text or ""):
            length = sentence.count(" ") - 1
            words += length
            full, halves, upto = 0.0, 0.0, -1
            for a, b, w in sorted(self.matches(sentence), key=lambda m: (m[0], -m[2], -m[1])):
                if a >= upto:
                    upto, n = b, n + 1
                    if w >= 1:
                        full += w
                    else:
                        halves += w
                elif w > 0.5:
                    full += 0.5
            weight = full + halves * min(1.0, NEARBY / max(1, length))
            heaviest, total = max(heaviest, weight), total + weight
        return heaviest, (100.0 * total / words if words else 0.0), n, words


def default_lexicon() -> Lexicon:
    weights: dict[str, float] = {}
    for block in (lexicon.HARM, lexicon.HATE, lexicon.SEXUAL):
        weights |= dict.fromkeys(_phrases(block), 1.0)
    insults, spared = lexicon.INSULTS.split(), set(lexicon.NO_PLURALS.split()) | set(lexicon.HALF.split())
    weights |= dict.fromkeys(insults, 1.0)
    weights |= dict.fromkeys((w + "s" for w in insults if len(w) > 3 and w[-1] != "s" and w + "s" not in spared and w not in spared), 1.0)
    weights |= dict.fromkeys(_phrases(lexicon.CONTEXT), 0.5) | dict.fromkeys(lexicon.HALF.split(), 0.5)
    return Lexicon(weights, _phrases(lexicon.EXCUSES), context_rules())


_LEXICON: list[Lexicon] = []


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """``doc_id, *keep, peak, density, n_matches, n_words`` of every document, whole texts, no shuffle.

    ``peak`` is the weight of the heaviest sentence, so that one abusive sentence
    in a very long text counts as it does alone; ``density`` is the weight of all
    sentences a hundred words.  Null and empty texts score zero.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(k) for k in keep], F.col(text).alias("_text"))
    kinds = dict(narrow.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _LEXICON:
            _LEXICON.append(default_lexicon())
        for batch in batches:
            scores = [_LEXICON[0].score(v.as_py()) for v in batch.column(batch.num_columns - 1)]
            peak, density, n, words = zip(*scores, strict=True) if scores else ((), (), (), ())
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            cols += [pa.array(peak, pa.float64()), pa.array(density, pa.float64()), pa.array(n, pa.int32()), pa.array(words, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *keep, "peak", "density", "n_matches", "n_words"])

    lead = ", ".join(f"`{c}` {kinds[c]}" for c in ["doc_id", *keep])
    return narrow.mapInArrow(run, f"{lead}, peak double, density double, n_matches int, n_words int")


def source_rates(scored: DataFrame, source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Documents, flagged ones, their rate and the mean density per source; null sources are a source."""
    flagged = F.col("peak") >= threshold
    return scored.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(flagged).alias("n_flagged"),
        (F.count_if(flagged) / F.count(F.lit(1))).alias("flagged_rate"), F.avg("density").alias("mean_density"),
    )
