"""Sentence boundaries across languages and scripts.

Document-centred disambiguation. Whether a period ends a sentence depends on
two questions, and both are put to unambiguous places first:

* Is the word before it an abbreviation? In a document it is one if it stands
  before a period that cannot end a sentence (a comma follows, or repeatedly a
  figure) and never without a period; it is none if it stands only without.
* Is the capitalised word after it a common word, which owes its capital to the
  beginning of a sentence, or a proper name? A document shows a common word by
  its small form, a name by its capital inside a sentence.

What a document leaves open is answered by the same counts over all documents.
They also tell of each abbreviation whether sentences end with it (*etc.*) or
go on (*Dr.*), by the share of common words that follow it, whether it is one
only before figures (*no.*), and, with the word before it, whether a short
number is an ordinal (*am 14. März*). Only where documents and corpus are both
silent, lists of fixed abbreviations are asked; they are a parameter and may be
empty. Scripts have their own terminators: full-width stops need no blank after
them, the danda and the Arabic question mark end sentences as they are, and
Thai has no terminator but blanks between its letters.

Blank lines, list marks and headings bound units first; a line break alone is
a blank. A terminator inside a quotation that the sentence goes on after does
not end it; closing marks belong to the sentence they close. The work on a unit
is linear in its length.

Defined results: null, empty and blank texts have no sentences; together the
sentences cover all but white space; texts of any length are cut whole.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut, is_small, spread

# Fixed values, asked last: abbreviations that a sentence goes on after ...
BEFORE_MORE = frozenset(
    "dr dra prof mr mrs ms st sr sra m mme mlle hr fr no nr núm num nº n° fig figs abb tab eq vol pp p cf vgl ca approx aprox env e.g eg i.e ie "
    "vs v z b d h u a c z.b d.h u.a p.ex p.ej ej ex subsp ssp var f cv bzw см рис табл т п ул стр напр डॉ श्री प्रो c.-à-d c-à-d resp art sect gen".split()
)
# ... and those that may also end one.
MAY_END = frozenset("etc usw al a.m p.m sp spp jr inc ltd co corp г гг д др н uu ff s.n et.al u.s ph.d".split())
# ... and small words after which a short number is an ordinal.
BEFORE_ORDINAL = frozenset("der die das dem den des am im vom zum zur beim bis jeder jede ab seit".split())
#: Corpus evidence needed for a word, and how much it must outweigh the rest.
EVIDENCE, OUTWEIGH = 5, 4
#: Share of common words among the capitalised words after an abbreviation below
#: which no sentence ends with it, and from which sentences do.
GOES_ON, ENDS_ON = 0.05, 0.2
#: Findings about a word, as bits.
ABBREVIATION, ENDS, NEVER, NUMBER, COMMON, PROPER, ORDINARY = 1, 2, 4, 8, 16, 32, 64

_OPEN = "\"'“‘„«‹([{（「『【〈《‚¿¡*_"
_CLOSE = "\"'”’»›)\\]}）」』】〉》“*_"
_QUOTES = set("\"'”’»›」』“")
_PAIR = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』"}
_QUOTE = re.compile(r"[\"“”„«»「」『』'*_]")
_END = re.compile(
    rf"(?P<wide>(?:[。！？｡．]|……|…(?=[^\s.…])|⋯⋯)+[。！？!?…]*|[।॥۔؟]+[!?]*)(?P<c1>[{_CLOSE}]*)"
    rf"|(?P<dots>\.{{2,}}|…+)(?P<mark>[!?]*)(?P<c2>(?:[^\S\n]?[»]|[{_CLOSE}])*)(?=\s|\Z|[぀-鿿])"
    rf"|(?P<bang>[!?]+\.?)(?P<c3>(?:[^\S\n]?[»]|[{_CLOSE}])*)(?=\s|\Z|[぀-鿿])"
    rf"|(?P<dot>\.)(?P<c4>(?:[^\S\n]?[»]|[{_CLOSE}])*)(?=\s|\Z|[぀-鿿])"
    rf"|(?P<tight>(?:(?<=[^\W\d_A-ZÀ-ÞА-Я]{{3}})|(?<=\d)|(?<=[)»”]))(?:\.|[!?]+))(?=[¿¡«„“]?(?:[A-ZÀ-ÞА-Я][^\W\d_A-ZÀ-ÞА-Я]|[A-Z]['’][^\W\d_]|[A-Z]{2}\d{3}|[A-Z]\.\s|[ऀ-ॿء-ي]))"
    rf"|(?P<caps>(?<=[A-ZÀ-ÞА-Я]{{3}})[.!?](?=[A-ZÀ-ÞА-Я]{{2}}))"
    rf"|(?P<thai>(?<=[ก-๛])\s+(?=[ก-๛]))"
)
# where a terminator may begin; ``_END`` then tells whether one does
_STOP = re.compile(r"[.!?…⋯。！？｡．।॥۔؟]")
_STOP_THAI = re.compile(r"[.!?…⋯。！？｡．।॥۔؟]|(?<=[ก-๛])\s")
_BLANK = re.compile(r"(?:\r\n|[\n\r  \x0b\x0c])(?:[^\S\n\r]*(?:\r\n|[\n\r  \x0b\x0c]))+")
_LINE = re.compile(r"\r\n|[\n\r  \x0b\x0c]")
_MARK = re.compile(r"[^\S\n]*(?:[•‣◦▪●·*+–—-]|\(?\d{1,3}[).]|\(?[a-z]\)|\d{1,2}(?:\.\d{1,2})+\.?|#{1,6})[^\S\n]+(?=\S)")
_AFTER = r"[\w’'ऀ-ॿ](?:[\w’'ऀ-ॿ-]*)"
_WORD = re.compile(_AFTER)
_WORD_AFTER = re.compile(rf"[\s{re.escape(_OPEN)}]*({_AFTER})")
_SEEN = re.compile(r"\S")
_INSIDE = re.compile(r"[A-ZÀ-ÞА-ЯЁ](?<=[a-zà-ÿа-яё,]\s.)[\w’']*")
_PARTS = re.compile(r"[^\W\d_]{1,3}(?:\.[^\W\d_]{1,4})+")
_GOES_ON = re.compile(r"(?:と|って|との|という|是|说|道|的|为|这|は|が|を)")
_CODE = re.compile(r"[A-Z]{0,2}\d{1,4}\Z|[A-Z]{2,5}-\d")
_LIST_MARK = re.compile(r"\(?\d{1,3}[).]\Z")
_THAI = re.compile(r"[ก-๛]")
_TERMINATOR = re.compile(r"[.!?]")
_MARKS = ".,;:!?()[]{}\"'“”„«»‚‘’*_…¿¡<>‹›#"
_WITHIN = frozenset(("Mn", "Mc", "Me", "Cf"))
_JOINT = frozenset("’'.-_°º")


def word_before(text: str, lo: int, dot: int) -> tuple[int, str]:
    """Where the word before a period at ``dot`` begins, and the word in small
    letters; the work is the word's length."""
    i = dot
    while i > lo and ((c := text[i - 1]).isalnum() or c in _JOINT or (c > "\x7f" and unicodedata.category(c) in _WITHIN)):
        i -= 1
    if i == dot or text[dot - 1] in ".-":
        return dot, ""
    while i < dot and text[i] in ".-":
        i += 1
    word = text[i:dot].strip("’'").lower()
    if not word.isascii():  # a soft hyphen or the like is no letter
        word = "".join(c for c in word if unicodedata.category(c) != "Cf")
    return i, word


def token_before(text: str, at: int) -> str:
    """The token, in small letters, that a blank parts from ``at``."""
    i = at
    while i and text[i - 1].isspace():
        i -= 1
    k = i
    while i < at and k and not text[k - 1].isspace():
        k -= 1
    return last_word(text[k:i])


def last_word(token: str) -> str:
    return _TERMINATOR.split(token.strip(_MARKS))[-1].lower()


def _dotted(token: str, word: str) -> bool:
    return token.startswith(".", token.rfind(word) + len(word))


class Facts:
    """What one text shows unambiguously, by its tokens between blanks."""

    def __init__(self, text: str):
        self.text, self.tokens = text, text.split()
        self._words: tuple[set[str], set[str], set[str]] | None = None

    def periods(self) -> Iterator[tuple[str, str, str]]:
        """(word, kind, what follows) of every period after a word: kind ``,`` a
        mark or ``a`` a small letter follows, ``0`` a figure or a code, ``A`` a capital; also
        ``#`` for a short number without a period. A number is named by the word
        before it."""
        tokens = self.tokens
        for i in [i for i, k in enumerate(tokens) if "." in k or (len(k) < 3 and k.isdigit())]:
            token = tokens[i]
            at = token.rfind(".")
            if at < 0:
                if i:
                    yield last_word(tokens[i - 1]) + " #", "#", ""
                continue
            mark = token[at + 1 : at + 2]
            if mark and mark not in ",;:":
                continue
            _, word = word_before(token, 0, at)
            if not word:
                continue
            if word.isdigit():
                if len(word) > 2 or not i:
                    continue
                word = last_word(tokens[i - 1]) + " #"
            if mark:
                yield word, ",", ""
                continue
            for k in (i + 1, i + 2):
                after = tokens[k].lstrip(_OPEN) if k < len(tokens) else "."
                if after:
                    break
            m = _WORD.match(after)
            if m is None or _LIST_MARK.match(after):
                continue
            c = after[0]
            figure = c.isdigit() or _CODE.match(after)
            yield word, "0" if figure else "A" if c.isupper() else "a" if c.islower() else "x", m.group().lower()

    def words(self) -> tuple[set[str], set[str], set[str]]:
        """Words without a period, words in small letters, and words with a
        capital inside a sentence."""
        if self._words is None:
            plain, small = set(), set()
            for k in set(self.tokens):
                word = k.strip(_MARKS)
                if word:
                    if word[0].islower():
                        small.add(word.lower())
                    if not _dotted(k, word):
                        plain.add(word.lower())
            self._words = plain, small, {w.lower() for w in _INSIDE.findall(self.text)}
        return self._words


class Knowledge:
    """What is known of words beside the text at hand: findings over the corpus
    as bits per word, and the lists that are asked last."""

    def __init__(
        self,
        abbreviations: Iterable[str] = (),
        common: Iterable[str] = (),
        findings: Mapping[str, int] | None = None,
        before_more: frozenset[str] = BEFORE_MORE,
        may_end: frozenset[str] = MAY_END,
        before_ordinal: frozenset[str] = BEFORE_ORDINAL,
    ):
        self.findings = dict(findings or {})
        for words, bit in ((abbreviations, ABBREVIATION), (common, COMMON)):
            for w in words:
                self.findings[w] = self.findings.get(w, 0) | bit
        self.before_more, self.may_end, self.before_ordinal = before_more, may_end, before_ordinal


class _Document:
    """Answers about words: from the text, else the corpus, else the lists."""

    def __init__(self, text: str, known: Knowledge):
        self.text, self.known, self.found = text, known, known.findings.get
        self._facts: Facts | None = None
        self._sure: dict[str, int] = {}

    def facts(self) -> Facts:
        if self._facts is None:
            self._facts = Facts(self.text)
            for word, kind, _ in self._facts.periods():
                if kind in ",0":  # a figure may begin a sentence, so one alone is no proof
                    self._sure[word] = self._sure.get(word, 0) + (2 if kind == "," else 1)
        return self._facts

    def abbreviation(self, word: str) -> bool:
        facts = self.facts()
        sure = self._sure.get(word, 0)
        if sure > 1 and word not in facts.words()[0]:
            return True
        bits = self.found(word, 0)
        if not (bits & ABBREVIATION if bits & (ABBREVIATION | ORDINARY) else word in self.known.before_more or word in self.known.may_end):
            return False
        return bool(sure) or word not in facts.words()[0]

    def before_figure(self, word: str) -> bool:
        """A figure after this word and a period goes on with the sentence."""
        return bool(self.found(word, 0) & NUMBER) or self.abbreviation(word) or word in self.known.before_more

    def kind(self, word: str) -> int:
        """COMMON or PROPER, 0 if not known."""
        low = word.lower()
        if len(low) == 1:
            return 0
        _, small, inside = self.facts().words()
        if (low in small) != (low in inside):
            return COMMON if low in small else PROPER
        return self.found(low, 0) & (COMMON | PROPER)

    def goes_on(self, word: str) -> bool:
        """No sentence ends with this abbreviation."""
        bits = self.found(word, 0)
        return bool(bits & NEVER) if bits & (ENDS | NEVER) else word in self.known.before_more

    def may_end(self, word: str) -> bool:
        bits = self.found(word, 0)
        return bool(bits & ENDS) if bits & (ENDS | NEVER) else word in self.known.may_end


def _units(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, where its first sentence may end) of blocks, list items
    and headings."""
    at = 0
    for lo, hi in [*((m.start(), m.end()) for m in _BLANK.finditer(text)), (len(text), len(text))]:
        begin = start = at
        at = hi
        lines = [start, *(m.end() for m in _LINE.finditer(text, start, lo))]
        for k, line in enumerate(lines):
            mark = _MARK.match(text, line, lo)
            if mark and line > begin:
                yield begin, line, _after_mark(text, begin, line)
                begin = line
        yield begin, lo, _after_mark(text, begin, lo)


def _after_mark(text: str, start: int, end: int) -> int:
    while start < end and text[start].isspace():
        start += 1
    m = _MARK.match(text, start, end)
    return m.end() if m else start


class _Quotes:
    """Places of the quotation marks of one unit, each asked by bisection."""

    def __init__(self, text: str, start: int, end: int):
        self.at: dict[str, list[int]] = {}
        for m in _QUOTE.finditer(text, start, end):
            self.at.setdefault(m.group(), []).append(m.start())
        self.any = any(c not in "'*_" for c in self.at)

    def _next(self, mark: str, at: int) -> int:
        places = self.at.get(mark, ())
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def _last(self, mark: str, lo: int, hi: int) -> int:
        places = self.at.get(mark, ())
        k = bisect_left(places, hi) - 1
        return places[k] if k >= 0 and places[k] >= lo else -1

    def _odd(self, mark: str, lo: int, hi: int) -> bool:
        places = self.at.get(mark, ())
        return bool((bisect_left(places, hi) - bisect_left(places, lo)) % 2)

    def open_before(self, lo: int, hi: int, mark: str) -> bool:
        """A quote that ``mark`` would close is open in [lo, hi)."""
        if mark == "“":  # closes „ and opens “
            return self._last("„", lo, hi) > self._last("“", lo, hi)
        return self._odd(mark, lo, hi)

    def inside(self, lo: int, hi: int) -> bool:
        """A quotation begun in [lo, hi) is open at ``hi`` and closed in this unit."""
        if not self.any:
            return False
        for a, b in _PAIR.items():
            p = self._last(a, lo, hi)
            if p >= 0 and not p < self._last(b, lo, hi):
                q = self._next(b, hi)
                other = self._next(a, hi)
                if q >= 0 and (other < 0 or q < other):
                    return True
        return self._odd('"', lo, hi) and self._next('"', hi) >= 0


class _Splitter:
    def __init__(self, text: str, known: Knowledge):
        self.text, self.doc = text, _Document(text, known)

    def spans(self) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for start, end, free in _units(self.text):
            self._unit(start, end, free, out)
        return out

    def _emit(self, lo: int, hi: int, out: list) -> None:
        text = self.text
        while lo < hi and text[lo].isspace():
            lo += 1
        while hi > lo and text[hi - 1].isspace():
            hi -= 1
        if lo < hi:
            out.append((lo, hi))

    def _unit(self, start: int, end: int, free: int, out: list) -> None:
        text, begin, at = self.text, start, free
        quotes = _Quotes(text, start, end)
        candidate = (_STOP_THAI if _THAI.search(text, start, end) else _STOP).search
        while at < end:
            c = candidate(text, at, end)
            if c is None:
                break
            m = _END.match(text, c.start(), end)
            if m is None:
                at = c.start() + 1
                continue
            at = m.end()
            wide, c1, dots, mark, c2, bang, c3, dot, c4, tight, caps, thai = m.groups()
            if thai:
                self._emit(begin, m.start(), out)
                begin = at
                continue
            first = begin if begin > start else free
            if tight or caps:
                if not quotes.inside(first, m.start()) and not self._joined(first, m.start()):
                    self._emit(begin, at, out)
                    begin = at
                continue
            closers = c1 or c2 or c3 or c4 or ""
            # an opening mark right after a stop belongs to what follows
            stop = m.end()
            kept = self._closing(quotes, first, m.end() - len(closers), closers)
            if kept < len(closers):
                stop = at = m.end() - len(closers) + kept
                closers = closers[:kept]
                if not wide and stop < end and not text[stop].isspace():
                    continue
            quoted = bool(closers) and any(c in _QUOTES for c in closers)
            if not quoted and quotes.inside(first, m.start()):
                continue
            seen = _SEEN.search(text, stop, end)
            if seen:
                rest = _WORD_AFTER.match(text, stop, end)
                word = rest.group(1) if rest else ""
                small = bool(word) and word[0].islower()
                if wide:
                    if quoted and not text[stop].isspace() and (_GOES_ON.match(text, stop) or self._opens_with_quote(first)) and text[stop] not in _OPEN:
                        continue
                    if quoted and small:
                        continue
                elif small and quoted:
                    continue
                elif dots:
                    if small and not mark:
                        continue
                elif dot and not quoted and not closers and not self._ends(first, m.start(), word, text[seen.start()]):
                    continue
            self._emit(begin, stop, out)
            begin = stop
        self._emit(begin, end, out)

    def _opens_with_quote(self, first: int) -> bool:
        m = _SEEN.search(self.text, first)
        return m is not None and m.group() in "“「『«„\""

    def _closing(self, quotes: _Quotes, first: int, at: int, marks: str) -> int:
        """How many of ``marks`` (at ``at``) close something opened in the sentence."""
        for k, c in enumerate(marks):
            if c in "“\"'*_" and not quotes.open_before(first, at + k, c):
                return k
        return len(marks)

    def _joined(self, lo: int, dot: int) -> bool:
        """A terminator without a blank after it stands inside an expression, or
        after an abbreviation."""
        text, i = self.text, dot
        while i > lo and (text[i - 1].isalnum() or text[i - 1] in "’'-_°º/"):
            i -= 1
            if text[i] == "/":
                return True
        if i > lo and text[i - 1] == "." and i < dot and not text[i:dot].isdigit():
            return True
        word = text[i:dot].strip("’'-").lower()
        return bool(word) and not word.isdigit() and self.doc.abbreviation(word)

    def _ends(self, lo: int, dot: int, word: str, nxt: str) -> bool:
        """Whether a lone period at ``dot`` ends its sentence."""
        if nxt in ",;:)":
            return False
        text, doc = self.text, self.doc
        at, low = word_before(text, lo, dot)
        if not low:
            return True
        capital, figure = bool(word) and word[0].isupper(), bool(word) and word[0].isdigit()
        if low.isdigit():
            return not (len(low) <= 2 and word and not figure and self._ordinal(lo, at))
        if len(low) == 1 and low.isalpha() and not text[dot - 1].islower():
            # an initial, unless a common word begins the next sentence
            return capital and len(word) > 1 and doc.kind(word) == COMMON and not self._after_initial(lo, at)
        shape = (len(low) == 1 and low.isalpha()) or _PARTS.fullmatch(low) is not None
        if not (shape or doc.abbreviation(low)):
            return not (figure and doc.before_figure(low))
        if not word or figure or word[0].islower():
            return False
        if not capital:
            return doc.may_end(low)
        if _CODE.match(word) or doc.goes_on(low):
            return False
        kind = doc.kind(word)
        return kind == COMMON or doc.may_end(low)

    def _ordinal(self, lo: int, at: int) -> bool:
        """The short number at ``at`` is an ordinal: it begins its sentence, or the
        sentence goes on after such numbers behind the word before it."""
        if at == lo:
            return True
        before = token_before(self.text, at)
        bits = self.doc.found(before + " #", 0)
        if bits & ABBREVIATION:
            return not bits & ENDS
        return before in self.doc.known.before_ordinal

    def _after_initial(self, lo: int, at: int) -> bool:
        """The letter follows another one with a period: J. O., z. B."""
        return bool(re.search(r"\b[^\W\d_]\.\s*\Z", self.text[max(lo, at - 6) : at]))


def sentence_spans(text: str | None, known: Knowledge | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence, in code points."""
    return _Splitter(text, known or Knowledge()).spans() if text else []


_COUNTS = ("soft", "number", "common_next", "cap_next", "plain", "small", "inside", "begins")


class Counts:
    """Counts over texts, by word: periods before a mark or small letter, before
    a figure, before a capitalised word that its text shows to be common, and
    before another; occurrences without a period, in small letters, with a capital
    inside a sentence; and texts in which it follows a period with a capital."""

    def __init__(self) -> None:
        self.tokens, self.capitals = Counter(), Counter()
        self.of: dict[str, Counter] = {c: Counter() for c in _COUNTS}

    def add(self, text: str) -> None:
        if text == text.lower() == text.upper() or not any(map(str.isupper, text)):
            return  # without capitals nothing can be told
        facts = Facts(text)
        self.tokens.update(facts.tokens)
        self.capitals.update(_INSIDE.findall(text))
        of, small = self.of, None
        for word, kind, after in set(facts.periods()):  # repetitions within a text are no more proof
            if kind in ",a":
                of["soft"][word] += 1
            elif kind == "0":
                of["number"][word] += 1
            elif kind == "A":
                if small is None:
                    small = {k.strip(_MARKS).lower() for k in set(facts.tokens) if k[0].islower()}
                if len(after) > 1:  # a single letter is most often an initial
                    of["common_next" if after in small else "cap_next"][word] += 1
                    of["begins"][after] += 1
                else:
                    of["cap_next"][word] += 1
            elif kind == "#":
                of["plain"][word] += 1

    def __len__(self) -> int:
        return len(self.tokens) + len(self.capitals)

    def rows(self) -> pa.RecordBatch:
        of = self.of
        for token, n in self.tokens.items():
            word = token.strip(_MARKS)
            if not word or not word[0].isalpha() or sum(map(str.isdigit, word)) > 2:
                continue
            low = word.lower()
            if not _dotted(token, word):
                of["plain"][low] += n
            if word[0].islower():
                of["small"][low] += n
        for word, n in self.capitals.items():
            of["inside"][word.lower()] += n
        words = list(set().union(*of.values()))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([of[c][w] for w in words], pa.int64()) for c in _COUNTS)], names=["word", *_COUNTS])


def findings(soft, number, common_next, cap_next, plain, small, inside, begins, both, either):
    """Bits of each word from its counts; the same for numbers and columns
    (``both`` and ``either`` are the logical operations). (flag, bit) pairs."""
    caps = common_next + cap_next
    dotted = soft + number + caps
    sure = soft + number
    never = both(caps >= EVIDENCE, common_next <= GOES_ON * caps)
    rare = both(dotted >= EVIDENCE, plain * OUTWEIGH < dotted)
    return (
        (either(both(sure >= EVIDENCE, sure * 2 >= dotted), both(rare, either(both(sure > 0, sure >= GOES_ON * dotted), never))), ABBREVIATION),
        (both(caps >= EVIDENCE, common_next >= ENDS_ON * caps), ENDS),
        (never, NEVER),
        (both(number >= EVIDENCE, number * 2 > dotted), NUMBER),
        (dotted >= EVIDENCE, ORDINARY),
        (both(both(begins >= EVIDENCE, small >= EVIDENCE), small > OUTWEIGH * inside), COMMON),
        (both(both(begins >= EVIDENCE, inside >= EVIDENCE), inside > OUTWEIGH * small), PROPER),
    )


def corpus_evidence(docs: DataFrame, text_col: str = "text", listed: Iterable[str] = BEFORE_MORE | MAY_END) -> DataFrame:
    """(word, bits) over all texts, of the words about which the counts tell
    something that a terminator can ask. ``ORDINARY`` is kept of ``listed`` words
    only: they are asked in the lists if the corpus is silent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.add(t)
                    if len(counts) > _HELD:
                        yield counts.rows()
                        counts = Counts()
        yield counts.rows()

    total = spread(docs.select(F.col(text_col).cast("string"))).mapInArrow(count, "word string, " + ", ".join(f"{c} long" for c in _COUNTS))
    total = total.groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    found = dict((bit, flag) for flag, bit in findings(*[F.col(c) for c in _COUNTS], lambda a, b: a & b, lambda a, b: a | b))
    words = sorted(listed)
    found[ORDINARY] = found[ORDINARY] & (F.col("word").isin(words) if words else F.lit(False))
    # what concerns abbreviations counts only where a word is one
    here = {bit: flag & found[ABBREVIATION] if bit in (ENDS, NEVER) else flag & ~found[ABBREVIATION] if bit == ORDINARY else flag for bit, flag in found.items()}
    bits: Column = sum((F.when(flag, bit).otherwise(0) for bit, flag in here.items()), F.lit(0))
    return total.select("word", bits.cast("int").alias("bits")).where("bits > 0")


#: Distinct tokens counted at a time.
_HELD = 300_000
_ROWS = 2048


def _cutter(get: Callable[[int, pa.RecordBatch], Knowledge]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                rows, starts, ends = [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    spans = sentence_spans(text, get(i, batch))
                    rows += [i] * len(spans)
                    starts += [a for a, _ in spans]
                    ends += [b for _, b in spans]
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["_id", "start_pos", "end_pos"])

    return cut_texts


def asked_words(text: str) -> set[str]:
    """All words that ``_Splitter`` can ask about in ``text``: those before a
    terminator, begun anywhere as a sentence may begin inside one, those after a
    period, and the words before short numbers."""
    out = set()
    for m in _STOP.finditer(text):
        dot = m.start()
        at, word = word_before(text, 0, dot)
        if word:
            out.add(word)
            run = text[at:dot]
            for i, c in enumerate(run):
                if c in ".’'-°º_":
                    out.add(run[i + 1 :].strip("’'-").lower())
            if len(word) <= 2 and word.isdigit():
                out.add(token_before(text, at) + " #")
        if m.group() == "." and (n := _WORD_AFTER.match(text, dot + 1)):
            out.add(n.group(1).lower())
    out.discard("")
    return out


def _asked_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(at, _ROWS)
            rows, words = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                mine = asked_words(text) if text else ()
                rows += [i] * len(mine)
                words += mine
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(words, pa.string())], names=["_id", "word"])


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **lists: frozenset[str]) -> DataFrame:
    """``id_col``, ``start_pos``, ``end_pos`` of every sentence.

    Two narrow passes over the texts. The corpus' findings are sent to all
    tasks if their counted number permits; else each document gets those that
    its own terminators ask about by a join, with the same result. ``lists``:
    other lists for ``Knowledge``, also empty ones.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    kind = src.schema["_id"].dataType.simpleString()
    ddl = f"_id {kind}, start_pos long, end_pos long"
    listed = lists.get("before_more", BEFORE_MORE) | lists.get("may_end", MAY_END)
    found = cut(corpus_evidence(docs, text_col, listed))
    if is_small(found):
        shared = docs.sparkSession.sparkContext.broadcast({r["word"]: r["bits"] for r in found.collect()})
        memo: list[Knowledge] = []

        def get(i: int, batch: pa.RecordBatch) -> Knowledge:
            if not memo:
                memo.append(Knowledge(findings=shared.value, **lists))
            return memo[0]

        done = spread(src).mapInArrow(_cutter(get), ddl)
    else:
        words = spread(src).mapInArrow(_asked_of, f"_id {kind}, word string")
        own = words.join(found, "word").groupBy("_id").agg(F.collect_list(F.struct("word", "bits")).alias("own")).withColumnRenamed("_id", "_own")

        def of_row(i: int, batch: pa.RecordBatch) -> Knowledge:
            return Knowledge(findings={r["word"]: r["bits"] for r in batch.column(2)[i].as_py() or ()}, **lists)

        done = src.join(own, F.col("_id").eqNullSafe(F.col("_own")), "left").select("_id", "_t", "own").mapInArrow(_cutter(of_row), ddl)
    return done.select(F.col("_id").alias(id_col), "start_pos", "end_pos")
