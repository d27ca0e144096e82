"""Evaluation passages inside a corpus, by one Aho-Corasick automaton.

Items and documents are reduced to words: case, punctuation, markup, invisible
characters, letter forms and broken umlauts are normalised away.  Every run of
``SEED`` units of an item (words, or characters of Chinese items) enters one
automaton over the text without spaces; each document is scanned once and the
hits are mapped back to words and from there to the original text.  Around the
hits edit distances decide exactly: a passage counts if it covers at least
``MIN_UNITS`` units of the item of which at most one in eight is changed, added
or missing.  Units of sentences that occur word for word in several items count
for nothing and cost nothing.  Words that punctuation joins or splits ("short-range",
"short range") are one word in either form.

Which places are looked at follows from counting: ``e`` edits cut a passage of
``n`` units into at most ``e + 1`` kept runs, which hold at least
``n - e - (SEED - 1) (e + 1)`` seeds; with ``e`` at most ``n / 8`` and ``n`` less
than twice the least length (of a longer passage one half would do) that is at
least ``HITS``, on diagonals that differ by at most the edits.  A shared sentence inside a passage cuts one run more.

The held-out items are a stated set that fits one automaton: its seeds are built
on the driver and broadcast once; the corpus is not bounded.

Defined results: null and empty texts have no passages; repeated documents are
reported each; items without enough units of their own are never reported; an
empty table on either side gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framelake.runtime import spread

SEED = 5
MIN_UNITS = {True: 30, False: 20}  # Chinese characters, words


def _least_hits(need: int) -> int:
    return min(n - n // 8 - (SEED - 1) * (n // 8 + 1) for n in range(need, 2 * need))


HITS = {han: _least_hits(n) for han, n in MIN_UNITS.items()}
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_BROKEN = re.compile("[Â-Å][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]")
_MARKS = re.compile("[\u0300-\u036f\u20d0-\u20ff]")
_REST = re.compile(r"[^\w\s]|_")
_HAN = re.compile("[㐀-鿿]")
# a number at the head of a line is a list's, unless the line before is unfinished
_LIST = re.compile(r"(\A|[^\w\s,\-][ \t]*\r?\n|\n[ \t>]*\r?\n)([ \t>]*\d{1,2}\.[ \t]+)(?=\S)")
# fixed values: letters of other scripts that look like Latin ones
_ALIKE = str.maketrans(
    "авекмнорстухіјѕһԁοανρɡıӏ",
    "abekmhopctyxijshdoavpgil",
)
_INVISIBLE = {c: None for c in [0xAD, 0x180E, 0x61C, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, *range(0xFE00, 0xFE10)]}


def _repair(m: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m.group().encode(code).decode("utf-8")
        except UnicodeError:
            continue
    return m.group()


def fold(text: str) -> str:
    """Text of plain lower-case letters, digits and white space."""
    text = _TAG.sub("", text).translate(_INVISIBLE)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _BROKEN.sub(_repair, text))
        text = _MARKS.sub("", text).casefold().translate(_ALIKE)
    else:
        text = text.lower()
    return _REST.sub("", text)


def words(text: str) -> list[str]:
    """Normalised words; the numbers of list items are markup."""
    return fold(_LIST.sub(r"\1", text)).split()


@lru_cache(100_000)
def _stays(c: str) -> bool:
    return bool(fold(c))


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Where each of :func:`words` begins and ends in ``text``."""
    plain = list(text)
    for pattern, group in ((_LIST, 2), (_TAG, 0)):
        for m in pattern.finditer(text):
            plain[m.start(group) : m.end(group)] = "​" * (m.end(group) - m.start(group))
    out, start, last = [], None, 0
    for i, c in enumerate([*plain, " "]):
        if c.isspace():
            if start is not None:
                out.append((start, last + 1))
            start = None
        elif c.isalnum() or _stays(c):
            start, last = (i if start is None else start), i
    return out


def _sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.?!])\s+|(?<=[。？！])|(?<=[一-鿿][?!.])", text) if s.strip()]


def _compounds(text: str) -> set[tuple[str, ...]]:
    """Words that punctuation divides into parts."""
    out = set()
    for word in _TAG.sub("", text).translate(_INVISIBLE).split():
        parts = tuple(p for p in (fold(x) for x in re.split(r"[^\w]|_", word)) if p)
        if len(parts) > 1:
            out.add(parts)
    return out


class Item:
    """Units of one item, which of them belong to shared sentences, and its compounds."""

    def __init__(self, item_id: int, text: str, shared: set[str]) -> None:
        self.id, self.han = item_id, len(_HAN.findall(text)) * 4 > len(re.sub(r"\s", "", text))
        units, free = [], []
        for s in _sentences(text):
            w = words(s)
            u = list("".join(w)) if self.han else w
            units += u
            free += [" ".join(w) in shared] * len(u)
        self.units, self.free = units, np.array(free, bool)
        own = np.flatnonzero(~self.free)
        # shared sentences between own ones cut runs, once each
        self.cuts = int((np.diff(own) > 1).sum()) if len(own) else 0
        self.known = {u: c for c, u in enumerate(dict.fromkeys(units))}
        self.codes = np.array([self.known[u] for u in units])
        self.joined = {} if self.han else {"".join(p): len(p) for p in _compounds(text)}
        self.first_parts = {} if self.han else {p[0]: "".join(p) for p in _compounds(text)}
        self.most_parts = max(self.joined.values(), default=1)
        self.hits = max(1, HITS[self.han] - (SEED - 1) * self.cuts)

    def encode(self, units: list[str]) -> np.ndarray:
        """Codes of document units, split compounds joined again; -1 for what the item does not have."""
        if self.first_parts:
            out, i = [], 0
            while i < len(units):
                u = units[i]
                if u in self.first_parts:
                    for k in range(self.most_parts, 1, -1):
                        whole = "".join(units[i : i + k])
                        if whole in self.joined and i + k <= len(units):
                            u, i = whole, i + k - 1
                            break
                out.append(self.known.get(u, -1))
                i += 1
            return np.array(out, np.int64)
        return np.array([self.known.get(u, -1) for u in units], np.int64)


def read_items(rows: list[tuple[int, str | None]]) -> list[Item]:
    """Items with the sentences they share marked."""
    seen = Counter(s for _, text in rows for s in {" ".join(words(s)) for s in _sentences(text or "")})
    shared = {s for s, n in seen.items() if n > 1 and s}
    items = [Item(i, text, shared) for i, text in rows if text and text.strip()]
    return [it for it in items if (~it.free).sum() >= MIN_UNITS[it.han]]


def automaton(items: list[Item]) -> ahocorasick.Automaton | None:
    """All seeds of all items, each with the (item, position) pairs it stands at."""
    at: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for k, it in enumerate(items):
        for i in range(len(it.units) - SEED + 1):
            if not it.free[i : i + SEED].any():
                at["".join(it.units[i : i + SEED])].append((k, i))
    if not at:
        return None
    a = ahocorasick.Automaton()
    for seed, places in at.items():
        a.add_word(seed, (len(seed), places))
    a.make_automaton()
    return a


class Alignments:
    """Windows in which a passage may stand, decided many at a time.

    Each is the item from its possible beginnings on against a part of a document,
    along the diagonals on which its seeds lie.
    """

    def __init__(self, rows: int = 30_000) -> None:
        self.most_rows = rows
        self.waiting: list[tuple] = []
        self.rows = 0

    def add(self, tag: object, item: Item, codes: np.ndarray, start: np.ndarray, low: int, high: int) -> list:
        """Take one in; the decided ones are returned once there are enough."""
        self.waiting.append((tag, item, codes, start, low, high))
        self.rows += len(item.codes) - int(start[0])
        return self.decide() if self.rows >= self.most_rows else []

    def decide(self) -> list[tuple[object, list[tuple[int, int]]]]:
        """``tag, ranges`` of the windows that hold passages; ranges of the item, touching ones as one."""
        out = []
        for han in (True, False):
            todo = [w for w in self.waiting if w[1].han is han]
            if todo:
                out += [(w[0], r) for w, r in zip(todo, _ranges(todo, MIN_UNITS[han])) if r]
        self.waiting, self.rows = [], 0
        return out


def _ranges(todo: list[tuple], need: int) -> list[list[tuple[int, int]]]:
    """For each window the item ranges that stand in it with few enough edits.

    Edit distances from all starts of all windows side by side; a start is given
    up at more edits than the longest range of interest may have.
    """
    most, cost = (2 * need - 1) // 8, np.int16(99)
    width = max(high - low + 1 for *_, low, high in todo)
    misses, skips, starts, ends, owner, origin = [], [], [], [], [], []
    base = 0
    for c, (_, item, codes, start, low, high) in enumerate(todo):
        first, n, m = int(start[0]), len(item.codes), len(codes)
        rows = np.arange(first, n)
        at_doc = rows[:, None] + np.arange(low, low + width)[None, :]
        there = (at_doc >= 0) & (at_doc < m)
        there[:, high - low + 1 :] = False
        padded = np.r_[codes, -2]
        miss = (padded[np.where(there, at_doc, m)] != item.codes[rows][:, None]).astype(np.int16)
        if item.free.any():
            miss[item.free[rows]] *= cost
        miss[~there] = cost  # no unit of the window stands there
        misses.append(miss)
        skips.append((~item.free[rows]).astype(np.int16))
        starts.append(start - first + base)
        ends.append(np.full(len(start), base + n - first))
        owner.append(np.full(len(start), c))
        origin.append(np.full(len(start), first - base))
        base += n - first
    miss, skip = np.concatenate(misses), np.concatenate(skips)
    at, end, who, shift = map(np.concatenate, (starts, ends, owner, origin))
    start, length, column = at.copy(), np.zeros(len(at), np.int16), np.arange(width, dtype=np.int16)
    edits = np.zeros((len(at), width + 1), np.int16)
    highest = np.array([high - low for *_, low, high in todo])[who]
    edits[np.arange(width + 1)[None, :] > highest[:, None]] = cost
    got: list[dict[int, int]] = [{} for _ in todo]
    while len(at):
        passed = skip[at]
        now = edits[:, :-1]
        gone = edits[:, 1:] + passed[:, None]  # the item's unit is missing
        now += miss[at]
        np.minimum(now, gone, out=now)
        now -= column
        np.minimum.accumulate(now, axis=1, out=now)
        now += column
        length += passed
        least = now.min(1)
        for j in np.flatnonzero((length >= need) & (8 * least <= length)):
            got[who[j]][int(start[j] + shift[j])] = int(at[j] + shift[j]) + 1
        at += 1
        keep = (at < end) & (least <= most) & (length < 2 * need)
        if not keep.all():
            start, at, end, who, shift, length, edits = (x[keep] for x in (start, at, end, who, shift, length, edits))
    out = []
    for found in got:
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found.items()):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b))
            else:
                merged.append((a, b))
        out.append(merged)
    return out


def _starts(item: Item, at: np.ndarray) -> np.ndarray:
    """Where a passage could begin, by the number of seeds (at item positions ``at``) that it must hold."""
    n, need = len(item.units), MIN_UNITS[item.han]
    if item.cuts:  # a passage may be longer by the shared sentences in it
        return np.arange(n) if len(at) >= item.hits else at[:0]
    below = np.zeros(n + 1, np.int32)
    below[np.asarray(at) + 1] = 1
    below = below.cumsum()
    ok = np.zeros(n, bool)
    for length in range(need, min(2 * need, n + 1)):
        edits = length // 8
        least = length - edits - (SEED - 1) * (edits + 1)
        ok[: n - length + 1] |= below[length - SEED + 1 : n + 1 - SEED + 1] - below[: n - length + 1] >= least
    return np.flatnonzero(ok)


def _bands(item: Item, hits: list[tuple[int, int]]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
    """Hits on diagonals as close as a passage's may be, with the possible beginnings."""
    hits = sorted(hits, key=lambda h: h[0] - h[1])
    diagonal = [d - i for d, i in hits]
    width = (2 * MIN_UNITS[item.han] - 1) // 8 + sum(p - 1 for p in item.joined.values()) + (int(item.free.sum()) if item.cuts else 0)
    lo, end = 0, 0
    for hi in range(len(hits)):
        # bands are maximal: one ends where the next hit is too far from its first
        if hi + 1 < len(hits) and diagonal[hi + 1] - diagonal[lo] <= width:
            continue
        if hi + 1 - lo >= item.hits and hi + 1 > end:
            at = np.array(sorted({i for _, i in hits[lo : hi + 1]}))
            if len(at) >= item.hits:
                starts = _starts(item, at)
                if len(starts):
                    yield hits[lo : hi + 1], starts
            end = hi + 1
        while hi + 1 < len(hits) and diagonal[hi + 1] - diagonal[lo] > width:
            lo += 1


def windows(w: list[str], items: list[Item], auto: ahocorasick.Automaton) -> Iterator[tuple]:
    """(item index, band of hits, codes, starts, lowest, highest diagonal) wherever a passage of an item may stand in the words ``w``."""
    flat = "".join(w)
    raw: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for last, (size, places) in auto.iter(flat):
        for k, i in places:
            raw[k].append((last + 1 - size, i, last + 1))
    raw = {k: h for k, h in raw.items() if len(h) >= items[k].hits}
    if not raw:
        return
    word_at = {b: i for i, b in enumerate(accumulate(map(len, w), initial=0))}
    for k, spots in raw.items():
        it = items[k]
        if it.han:
            hits = [(first, i) for first, i, _ in spots]
        else:
            hits = [(word_at[first], i) for first, i, end in spots if first in word_at and end in word_at]
        if len(hits) < it.hits:
            continue
        units = flat if it.han else w
        longest = 2 * MIN_UNITS[it.han] + (int(it.free.sum()) if it.cuts else 0)
        edge, split = longest // 8, sum(x - 1 for x in it.joined.values())
        for band, starts in _bands(it, hits):
            d0, d1 = band[0][0] - band[0][1], band[-1][0] - band[-1][1]
            a, b = max(0, d0 + int(starts[0]) - edge - split), min(len(units), d1 + int(starts[-1]) + longest + edge + split)
            yield k, band, it.encode(units[a:b]), starts, d0 - a - edge - split, d1 - a + edge


def place(band: list[tuple[int, int]], ranges: list[tuple[int, int]], w: list[str], han: bool) -> Iterator[tuple[int, int]]:
    """First and last word of each passage, from its outermost seeds."""
    for p, q in ranges:
        inside = [d for d, i in band if p <= i and i + SEED <= q + 1] or [d for d, _ in band]
        first, last = min(inside), max(inside) + SEED - 1
        if han:
            begin = list(accumulate(map(len, w), initial=0))
            first, last = (bisect_right(begin, v) - 1 for v in (first, last))
        yield first, min(last, len(w) - 1)


def find(docs: list[tuple[int, str | None]], items: list[Item], auto: ahocorasick.Automaton | None) -> list[tuple[int, int, int, int]]:
    """(document, item, start, end) in the original texts; passages that touch are one."""
    spans: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
    if auto is None:
        return []
    queue = Alignments()

    def settle(done: list) -> None:
        for (doc_id, k, band, body, w), ranges in done:
            at = word_offsets(body)
            for lo, hi in place(band, ranges, w, items[k].han):
                spans[doc_id, items[k].id].add((at[min(lo, len(at) - 1)][0], at[min(hi, len(at) - 1)][1]))

    for doc_id, body in docs:
        if body:
            w = words(body)
            for k, band, *window in windows(w, items, auto):
                settle(queue.add((doc_id, k, band, body, w), items[k], *window))
    settle(queue.decide())
    out: list[tuple[int, int, int, int]] = []
    for (doc_id, item_id), places in spans.items():
        for lo, hi in sorted(places):
            if out and out[-1][:2] == (doc_id, item_id) and lo <= out[-1][3]:
                out[-1] = (*out[-1][:3], max(out[-1][3], hi))
            else:
                out.append((doc_id, item_id, lo, hi))
    return out


def leaks(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, start, end`` for each passage of an item that a document holds."""
    spark = docs.sparkSession
    rows = [(r[0], r[1]) for r in items.select(item_key, item_text).dropDuplicates([item_key]).collect()]
    read = read_items(sorted(rows, key=lambda r: (r[0] is None, r[0])))
    shipped = spark.sparkContext.broadcast((read, automaton(read)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, auto = shipped.value
        for b in batches:
            cols = list(zip(*find(list(zip(b["doc_id"].to_pylist(), b["text"].to_pylist())), mine, auto))) or [[], [], [], []]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start", "end"])

    return spread(docs.selectExpr(f"cast(`{key}` as bigint) doc_id", f"`{text}` text"), "doc_id").mapInArrow(run, "doc_id bigint, item_id bigint, start bigint, end bigint")
