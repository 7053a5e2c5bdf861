"""Evaluation texts leaking into training texts.

Texts are reduced to their letters and digits: markup, entities, case, character
forms, spacing and punctuation vanish. Test items are cut into windows of
``m`` letters, and all windows are searched in all documents at once by
Wu-Manber multi-pattern search: a table over hashed blocks of ``B`` letters
gives how far no window can end, and the search leaps by that much without a
look at the letters between; where the shift is 0, the bucket of windows with
that last block and the same first letters is compared directly. Many places of
a batch of texts are walked in step in numpy.

Confirmed windows within an undisturbed stretch of ``ANCHOR`` letters are
anchors. From one the run is followed both ways over single differing words or
letters: at a difference both texts are searched a little ahead for the point
from which they agree again. A document holds an item if such a run covers at
least ``share`` of the item, in words, or in characters for scripts without
blanks. Items that share a window with more than ``SHARED`` others (a task line)
are followed only where more than that is in the document (``_Common``).

Each document is read once per block of items (blocks of ``ITEM_LETTERS``), in
one narrow pass without shuffle; nothing but the items travels.

Defined results: null, empty and blank texts hold nothing; an item without
letters is held by none; items repeated under several ids are each reported;
texts of any length are searched whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut, spread

#: Letters of test items searched in one pass over the corpus.
ITEM_LETTERS = 8_000_000
#: Undisturbed letters from which a run is followed: scripts with blanks, and without.
ANCHOR, ANCHOR_DENSE = 20, 9
#: Length of the windows; they start so close that every anchor holds one.
WINDOW, WINDOW_DENSE = 16, 8
#: Letters of a block in long windows; in others half a window.
B = 10
#: Items that share a window from which it is called common.
SHARED = 64
#: Letters of a text that one place walks.
_LANE = 512
#: How far ahead the two texts may meet again, and what must then agree.
AHEAD, AGREE = 34, 10
AHEAD_DENSE, AGREE_DENSE = 10, 4
#: Cost of a letter passed over, and how many ``agree`` a run may fall back.
COST, DROP = 1.2, 4
#: Letters searched at a time.
_PIECE = 1_500_000

_TAG = re.compile(r"</?[A-Za-z][^<>]*+>|<!--.*?-->", re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,10});")
_NOT_LETTER = re.compile(r"[\W_]+")
_DENSE = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")
# Letters of other scripts that look like Latin ones.
_LOOK_ALIKE = str.maketrans("аеорсухіјѕԁɡνοι", "aeopcyxijsdgvoi")
_CYRILLIC, _LATIN = re.compile(r"[Ͱ-ӿ]"), re.compile(r"[a-z]")


def plain(text: str) -> str:
    """Visible text without markup, in one form of each character."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_BASE)
    return text.casefold()


class _Base(dict):
    """Drops combining marks and invisible format characters; filled on the way."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = value = None if unicodedata.combining(c) or unicodedata.category(c) == "Cf" else code
        return value


_BASE = _Base()


def _unmixed(word: str) -> str:
    return word.translate(_LOOK_ALIKE) if _LATIN.search(word) and _CYRILLIC.search(word) else word


def letters(text: str) -> str:
    text = plain(text)
    if not text.isascii() and _CYRILLIC.search(text) and _LATIN.search(text):
        text = " ".join(map(_unmixed, text.split()))
    return _NOT_LETTER.sub("", text)


class Item:
    __slots__ = ("anchor", "dense", "ids", "letters", "m", "need", "units", "word_at")

    def __init__(self, item_id: int, text: str, share: float):
        words = [w for w in (letters(w) for w in re.split(r"[\W_]+", plain(text))) if w]
        self.ids, self.letters = [item_id], "".join(words)
        n = len(self.letters)
        self.dense = len(_DENSE.findall(self.letters)) * 2 > n
        # word_at[i]: words that begin before letter i, so a run's words are a difference
        if self.dense:
            self.units, self.word_at = n, np.arange(n + 1)
        else:
            ends = np.cumsum([len(w) for w in words]) if words else np.zeros(0, int)
            self.units = len(words)
            self.word_at = np.searchsorted(ends, np.arange(n + 1), "right")
        self.need = share * self.units
        self.anchor = min(ANCHOR_DENSE if self.dense else ANCHOR, max(n // 2, 1))
        self.m = min(WINDOW_DENSE if self.dense else WINDOW, self.anchor)

    def covered(self, lo: int, hi: int) -> int:
        """Units of which [lo, hi) holds all letters."""
        if self.dense:
            return hi - lo
        first = self.word_at[lo] + (1 if lo and self.word_at[lo] == self.word_at[lo - 1] else 0)
        return max(int(self.word_at[hi] - first), 0)


_LOADS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _classes(codes: np.ndarray) -> np.ndarray:
    """A byte for each letter, with room behind for a load of eight."""
    out = np.zeros(len(codes) + 8, np.uint8)
    out[: len(codes)] = codes ^ (codes >> np.uint32(8)) * np.uint32(37)
    return out


def _eights(classes: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number: blocks are read from
    the text only where they are asked for."""
    return np.ndarray(len(classes) - 7, np.uint64, classes.data, strides=(1,))


class WuManber:
    """Search for many windows of one length.

    ``shift``: by the hash of a block of letters, how far a window that holds it
    can at least still end behind it; blocks no window holds give the most.
    Windows are kept once each, in buckets by the hash of their last block, and
    within a bucket by their first letters.
    """

    def __init__(self, m: int, stride: int, items: list[Item]):
        self.m, self.b = m, B if m >= B + 4 else max(m // 2, 1)
        codes = [np.frombuffer(it.letters.encode("utf-32-le", "surrogatepass"), np.uint32) for it in items]
        where = [np.unique(np.append(np.arange(0, len(c) - m + 1, stride), len(c) - m)) for c in codes]
        every = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, m)[w] for c, w in zip(codes, where)])
        owner = np.repeat(np.arange(len(items)), [len(w) for w in where])
        start = np.concatenate(where)
        # equal windows of many items are one
        packed = np.ascontiguousarray(every).view(np.dtype((np.void, 4 * m))).ravel()
        _, first, same = np.unique(packed, return_index=True, return_inverse=True)
        windows = every[first]
        self.bits = int(np.clip(np.ceil(np.log2(16 * len(windows) * (m - self.b + 1) + 1)), 16, 28))
        flat = _classes(windows.ravel())
        at = np.arange(len(windows)) * m
        # a distance is kept in a byte: a longer one is only walked in two steps
        top = min(m - self.b + 1, 255)
        self.shift = np.full(1 << self.bits, top, np.uint8)
        for i in range(m - self.b + 1):
            np.minimum.at(self.shift, self._block(_eights(flat), at + i), np.uint8(min(m - self.b - i, 255)))
        key = self._key(_eights(flat), at)
        order = np.argsort(key, kind="stable")
        self.keys, self.windows = key[order], windows[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by = np.argsort(rank[same.ravel()], kind="stable")
        self.owner, self.start = owner[by], start[by]
        self.first = np.searchsorted(rank[same.ravel()][by], np.arange(len(order) + 1))
        self.visited = 0

    def _block(self, eights: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the block that begins at each place."""
        with np.errstate(over="ignore"):
            h = (eights[at] & np.uint64((1 << 8 * min(self.b, 8)) - 1)) * _LOADS[0]
            if self.b > 8:
                h ^= eights[at + (self.b - 8)] * _LOADS[1]
            return ((h ^ (h >> np.uint64(32))) * _LOADS[0] >> np.uint64(64 - self.bits)).astype(np.int64)

    def _key(self, eights: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bucket of the window that begins at each place, and its first letters."""
        with np.errstate(over="ignore"):
            head = (eights[at] & np.uint64((1 << 8 * min(self.m, 8)) - 1)) * _LOADS[1] >> np.uint64(self.bits)
        return (self._block(eights, at + (self.m - self.b)).astype(np.uint64) << np.uint64(64 - self.bits)) | head

    def candidates(self, classes: np.ndarray) -> np.ndarray:
        """Places where a window may begin. Many places of the text are walked in
        step: each looks up the block before it and leaps by its shift."""
        n, b = len(classes) - 8, self.b
        eights = _eights(classes)
        at = np.arange(self.m - 1, n, _LANE)
        stop = np.minimum(at + _LANE, n)
        out = []
        while len(at):
            self.visited += len(at)
            leap = self.shift[self._block(eights, at - (b - 1))]
            found = leap == 0
            if found.any():
                out.append(at[found])
            at = at + np.maximum(leap, 1)
            on = at < stop
            if not on.all():
                at, stop = at[on], stop[on]
        return np.sort(np.concatenate(out)) - (self.m - 1) if out else np.empty(0, np.int64)

    def search(self, codes: np.ndarray, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(positions, windows) of every window in a text."""
        none = np.empty(0, np.int64)
        if len(codes) < self.m:
            return none, none
        classes = _classes(codes) if classes is None else classes
        at = self.candidates(classes)
        key = self._key(_eights(classes), at)
        lo = np.searchsorted(self.keys, key, "left")
        hit = lo < len(self.keys)
        hit[hit] = self.keys[lo[hit]] == key[hit]
        at, lo, key = at[hit], lo[hit], key[hit]
        n = np.searchsorted(self.keys, key, "right") - lo
        p = np.repeat(at, n)
        entry = np.repeat(lo, n) + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        if not len(p):
            return none, none
        same = (np.lib.stride_tricks.sliding_window_view(codes, self.m)[p] == self.windows[entry]).all(axis=1)
        return p[same], entry[same]


def _step(agree: int) -> int:
    """Of a long enough agreement one of two neighbouring starts is even, so only
    every second is tried."""
    return 2 if agree > 8 else 1


def _meet(a: str, i: int, b: str, j: int, ahead: int, agree: int) -> tuple[int, int] | None:
    """Nearest point after (i, j) from which the texts agree again."""
    best = None
    window = b[j : j + ahead + agree]
    step = _step(agree)
    size = agree - step + 1
    where = {window[y : y + size]: y for y in range((len(window) - size) // step * step, -1, -step)}
    for x in range(min(ahead, len(a) - i - size) + 1):
        if best is not None and x >= best[0]:
            break
        y = where.get(a[i + x : i + x + size])
        if y is not None and (best is None or x + y < best[0]):
            best = (x + y, x, y)
    if best is not None and step == 2 and best[1] and best[2] and a[i + best[1] - 1] == b[j + best[2] - 1]:
        best = (best[0] - 2, best[1] - 1, best[2] - 1)
    return best and (i + best[1], j + best[2])


def _common(a: str, i: int, b: str, j: int) -> int:
    """Length of the common piece of a[i:] and b[j:]."""
    n, k, step = min(len(a) - i, len(b) - j), 0, 32
    while k < n:
        if a[i + k : i + k + step] == b[j + k : j + k + step] and k + step <= n:
            k += step
            step *= 2
        elif step > 1:
            step = max(step // 4, 1)
        else:
            break
    return min(k, n)


def follow(item: str, i: int, text: str, p: int, ahead: int, agree: int) -> tuple[int, int]:
    """End of the run that begins at (i, p), in both texts.

    Agreeing letters count for the run and passed-over ones against it; it ends
    where that sum was greatest, and is given up once far below.
    """
    score, best, end = 0.0, 0.0, (i, p)
    while True:
        k = _common(item, i, text, p)
        i, p, score = i + k, p + k, score + k
        if score > best:
            best, end = score, (i, p)
        met = _meet(item, i, text, p, ahead, agree)
        if met is None:
            return end
        score -= COST * max(met[0] - i, met[1] - p)
        if score < best - DROP * agree:
            return end
        i, p = met


class _Common:
    """The items that hold windows common to many items, such as a task line.

    A common window alone is no reason to follow a run in all its items. A run
    that holds an item goes, beside common letters, through at least one piece of
    ``agree`` letters that few items have, or else the item's common letters alone
    suffice to hold it (``always``). So of the items of a common window only
    those with such a piece in the document, and ``always``, are followed, and
    none is lost.
    """

    def __init__(self, items: list[Item], search: WuManber, shared: np.ndarray):
        """``shared``: which windows of ``search`` are common."""
        entry = np.repeat(np.arange(len(shared)), np.diff(search.first))
        here = shared[entry]
        order = np.lexsort((entry[here], search.owner[here]))
        owner, self.window, self.start = search.owner[here][order], entry[here][order], search.start[here][order]
        self.items = np.unique(owner)
        self.first = dict(zip(self.items.tolist(), zip(np.searchsorted(owner, self.items, "left").tolist(), np.searchsorted(owner, self.items, "right").tolist())))
        self.pieces: list[tuple[WuManber, np.ndarray, np.ndarray]] = []
        always = []
        for dense in (False, True):
            ks = np.array([k for k in self.items.tolist() if items[k].dense == dense], np.int64)
            ahead, agree = (AHEAD_DENSE, AGREE_DENSE) if dense else (AHEAD, AGREE)
            size = agree - _step(agree) + 1
            if not len(ks):
                continue
            pieces = WuManber(size, 1, [items[k] for k in ks])
            rare = np.diff(pieces.first) <= SHARED
            self.pieces.append((pieces, ks, rare))
            entry = np.repeat(np.arange(len(rare)), np.diff(pieces.first))
            common = ~rare[entry]
            order = np.lexsort((pieces.start[common], pieces.owner[common]))
            own, at = pieces.owner[common][order], pieces.start[common][order]
            # chains of common letters with no more between them than a run passes over
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (at[1:] - at[:-1] > size + ahead)
            lo = np.flatnonzero(new)
            for k, x, y in zip(own[lo].tolist(), at[lo].tolist(), (at[np.append(lo[1:], len(own)) - 1] + size).tolist()):
                it = items[ks[k]]
                if it.covered(x, y) >= it.need:
                    always.append(int(ks[k]))
        self.always = np.unique(np.array(always, np.int64))

    def anchors(self, codes: np.ndarray, begins: np.ndarray, doc: np.ndarray, window: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(documents, items, places, starts) to follow, of the common windows found."""
        edges = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            d = int(doc[lo])
            text = codes[begins[d] : begins[d + 1] - 1]
            wanted = [self.always]
            for pieces, ks, rare in self.pieces:
                _, found = pieces.search(text)
                found = np.unique(found)
                found = found[rare[found]]
                if len(found):
                    wanted.append(ks[np.concatenate([pieces.owner[pieces.first[w] : pieces.first[w + 1]] for w in found.tolist()])])
            by = np.argsort(window[lo:hi], kind="stable")
            windows, places = window[lo:hi][by], at[lo:hi][by]
            for k in np.unique(np.concatenate(wanted)).tolist():
                a, b = self.first[k]
                x, y = np.searchsorted(windows, self.window[a:b], "left"), np.searchsorted(windows, self.window[a:b], "right")
                n = y - x
                if n.any():
                    p = np.repeat(x, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yield np.full(len(p), d), np.full(len(p), k), places[p], np.repeat(self.start[a:b], n)


def _agreeing(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """How many letters agree from each a[x], b[y] on, in one direction."""
    out = np.zeros(len(x), np.int64)
    on = np.arange(len(x))
    while True:
        on = on[(x[on] >= 0) & (x[on] < len(a)) & (y[on] >= 0) & (y[on] < len(b))]
        on = on[a[x[on]] == b[y[on]]]
        if not len(on):
            return out
        out[on] += 1
        x, y = x + step, y + step


def _can_meet(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, ahead: int, letters: int, step: int) -> np.ndarray:
    """Whether some piece of ``letters`` (at most 8) within ``ahead`` of a[x] may
    equal one within ``ahead`` of b[y]; by classes, so it is only sure to say no."""
    out = np.zeros(len(x), bool)
    mask = np.uint64((1 << 8 * letters) - 1)
    reach = np.arange(ahead) * step
    ea, eb = _eights(a), _eights(b)
    for lo in range(0, len(x), 4096):
        pa_ = ea[np.clip(x[lo : lo + 4096, None] + reach, 0, len(ea) - 1)] & mask
        pb_ = eb[np.clip(y[lo : lo + 4096, None] + reach, 0, len(eb) - 1)] & mask
        met = np.zeros(len(pa_), bool)
        for k in range(ahead):
            met |= (pa_ == pb_[:, k : k + 1]).any(axis=1)
        out[lo : lo + 4096] = met
    return out


class Finder:
    """Search for one block of items in any text."""

    def __init__(self, rows: list[tuple[int, str]], share: float = 0.5):
        same: dict[str, Item] = {}
        for i, t in rows:
            it = Item(i, t or "", share)
            if it.letters in same:
                same[it.letters].ids.append(i)
            elif it.letters:
                same[it.letters] = it
        self.items = list(same.values())
        self.backward = [it.letters[::-1] for it in self.items]
        # all items' letters behind each other, to measure undisturbed stretches
        self.whole = np.frombuffer("".join(it.letters + "\x01" for it in self.items).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.offset = np.cumsum([0, *(len(it.letters) + 1 for it in self.items)])
        self.classes = _classes(self.whole)
        self.anchor, self.size = (np.array([getattr(it, c) for it in self.items], np.int64) for c in ("anchor", "m"))
        self.need = np.array([it.need for it in self.items], float)
        self.dense = np.array([it.dense for it in self.items], bool)
        by: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k, it in enumerate(self.items):
            by[it.m, it.anchor].append(k)
        self.searches = []
        for (m, anchor), ks in sorted(by.items()):
            search = WuManber(m, anchor - m + 1, [self.items[k] for k in ks])
            search.owner = np.array(ks)[search.owner]
            shared = np.diff(search.first) > SHARED
            self.searches.append((search, shared, _Common(self.items, search, shared) if shared.any() else None))

    def find(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(index of the text, item id) of every item held."""
        codes = np.frombuffer(("\x00".join(texts) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = _classes(codes)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        found = []
        for search, shared, common in self.searches:
            at, w = search.search(codes, classes)
            doc = np.searchsorted(begins, at, "right") - 1
            often = shared[w]
            if often.any():
                found += common.anchors(codes, begins, doc[often], w[often], at[often])
                at, w, doc = at[~often], w[~often], doc[~often]
            n = search.first[w + 1] - search.first[w]
            entry = np.repeat(search.first[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append((np.repeat(doc, n), search.owner[entry], np.repeat(at, n), search.start[entry]))
        doc, item, at, start = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 4
        backs: dict[int, str] = {}
        for d, k, anchors in self._anchors(codes, classes, begins, doc, item, at, start):
            if d not in backs:
                backs = {d: texts[d][::-1]}
            if self._held(self.items[k], self.backward[k], texts[d], backs[d], anchors):
                for i in self.items[k].ids:
                    yield d, i

    def _anchors(self, codes: np.ndarray, classes: np.ndarray, begins: np.ndarray, doc: np.ndarray, item: np.ndarray, at: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """(document, item, its anchors): the undisturbed stretches that are long
        enough, and from which a run can go on or which hold the item alone."""
        if not len(doc):
            return
        off = self.offset[item]
        # one window of each stretch: overlapping ones on a diagonal lie in the same
        order = np.lexsort((start, at - start, item))
        doc, item, at, start, off = (c[order] for c in (doc, item, at, start, off))
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (item[1:] != item[:-1]) | (at[1:] - start[1:] != at[:-1] - start[:-1]) | (start[1:] - start[:-1] > self.size[item[1:]])
        doc, item, at, start, off = (c[fresh] for c in (doc, item, at, start, off))
        p, i = at, off + start
        size = self.size[item]
        right = _agreeing(codes, self.whole, p + size, i + size, 1)
        left = _agreeing(codes, self.whole, p - 1, i - 1, -1)
        long = left + size + right >= self.anchor[item]
        doc, item, p, i, off, left, right, size = (c[long] for c in (doc, item, p, i, off, left, right, size))
        lo, hi = i - left, i + size + right
        dense = self.dense[item]
        on = hi - lo >= self.need[item]
        for d, ahead, agree in ((False, AHEAD, AGREE), (True, AHEAD_DENSE, AGREE_DENSE)):
            mine = np.flatnonzero(dense == d)
            letters = min(agree - _step(agree) + 1, 8)
            for x, y, back in ((p + size + right, hi, 0), (p - left, lo, letters)):
                on[mine] |= _can_meet(classes, self.classes, x[mine] - back, y[mine] - back, ahead + 2, letters, -1 if back else 1)
        doc, item, p, i = doc[on], item[on], p[on] - begins[doc[on]], (i - off)[on]
        order = np.lexsort((i, p, item, doc))
        doc, item, p, i = (c[order] for c in (doc, item, p, i))
        edges = np.append(np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))), len(doc)) if len(doc) else np.zeros(1, np.int64)
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield int(doc[x]), int(item[x]), list(zip(p[x:y].tolist(), i[x:y].tolist()))

    def _held(self, it: Item, back: str, text: str, text_back: str, anchors: list[tuple[int, int]]) -> bool:
        ahead, agree = (AHEAD_DENSE, AGREE_DENSE) if it.dense else (AHEAD, AGREE)
        n, t = len(it.letters), len(text)
        seen: list[tuple[int, int, int, int]] = []
        for p, i in anchors:
            if any(a <= i < b and c <= p < e and abs((p - i) - (c - a)) <= 2 * ahead for a, b, c, e in seen):
                continue
            hi, q = follow(it.letters, i, text, p, ahead, agree)
            lo, o = follow(back, n - i, text_back, t - p, ahead, agree)
            lo, o = n - lo, t - o
            if it.covered(lo, hi) >= it.need:
                return True
            seen.append((lo, hi, o, q))
        return False


_FINDERS: dict[str, Finder] = {}


def _finder(key: str, make: Callable[[], Finder]) -> Finder:
    """The tables of a block, made once in each worker process."""
    if key not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[key] = make()
    return _FINDERS[key]


def leaked(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = 0.5
) -> DataFrame:
    """``id_col`` and ``item_col`` of every document that holds ``share`` of an item as one run."""
    items = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    size = items.agg(F.sum(F.length("t")).alias("n"), F.max(F.length("t")).alias("m")).first()
    blocks = max(1, -(-(size["n"] or 0) // ITEM_LETTERS))
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).where("_t is not null")
    kind = src.schema["_id"].dataType.simpleString()
    sc = docs.sparkSession.sparkContext

    def searcher(shared, key: str):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = _finder(key, lambda: Finder(shared.value, share))
            for batch in batches:
                texts = [letters(t) for t in batch.column(1).to_pylist()]
                lo = 0
                while lo < len(texts):
                    hi, n = lo, 0
                    while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= _PIECE):
                        n += len(texts[hi])
                        hi += 1
                    found = sorted(set(finder.find(texts[lo:hi])))
                    if found:
                        rows = pa.array([lo + d for d, _ in found], pa.int64())
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([i for _, i in found], pa.int64())], names=["_id", "i"])
                    lo = hi

        return search

    out = None
    for b in range(blocks):
        # a block holds a bounded number of letters, so it may be sent to all
        block = [(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()]
        shared = sc.broadcast(block)
        part = spread(src).mapInArrow(searcher(shared, uuid4().hex), f"_id {kind}, i long")
        if blocks > 1:  # a block's items leave the tasks when its pass is done
            part = cut(part)
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("_id").alias(id_col), F.col("i").alias(item_col))
