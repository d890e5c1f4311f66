"""Benchmark decontamination: CGK embedding, bit sampling and exact edit distance.

The CGK embedding reads a word sequence by a random walk: at step j it writes the current word and moves on if
the j-th random bit of that word is set. Two sequences at edit distance k walk together except for
stretches after each edit, so their embeddings differ in few places, and sampling a few places gives equal keys with a
high chance. Several walks with several samples each make the recall. Words are letters and digits in lower
case; words in no item are one symbol.

An item of n words matches where its edit distance to a passage, in words, is at most ``ratio`` * n =: d. Some word among the
first d + 1 of the item is then matched exactly, so the walks of an item start at each of them, and those of a document where it has
such a word and enough item words follow: neither loses a match. Items are grouped by size, and a window is as long as the walk
of its group.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewatlas.llm.common import mixed, seeds, slices

#: Edits allowed per item word; walks; samples of each walk; places in a sample.
RATIO, WALKS, SAMPLES, PLACES = 0.2, 3, 8, 4
#: Shorter items are found by exact pieces instead of walks.
MIN_ITEM_WORDS = 8
#: Items are shipped to the tasks in blocks of at most so many characters.
BLOCK_CHARS = 16_000_000

WORDS = re.compile(r"\w+")
#: Scripts without spaces (Thai to Myanmar, Khmer, kana, Han): each letter is a word.
SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
ANY_SPACELESS, LETTERS = re.compile(f"[{SPACELESS}]"), re.compile(rf"[^\W{SPACELESS}]+|(?=\w)[{SPACELESS}]")


def item_words(text: str | None) -> list[str]:
    if not text:
        return []
    return (WORDS if text.isascii() or not ANY_SPACELESS.search(text) else LETTERS).findall(text.lower())


def edit_end(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """(least edit distance, smallest end of a passage of ``text`` with it), any start: Myers' bit-parallel rows."""
    m, masks = len(pattern), defaultdict(int)
    for i, w in enumerate(pattern):
        masks[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (m, 0)
    for at, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best[0]:
            best = (score, at)
    return best


def edit_passage(pattern: list[str], text: list[str]) -> tuple[int, int, int]:
    """(distance, start, end) of the best passage of ``text``: the shortest with the smallest end."""
    distance, end = edit_end(pattern, text)
    _, length = edit_end_anchored(pattern[::-1], text[:end][::-1], distance)
    return distance, end - length, end


def edit_end_anchored(pattern: list[str], text: list[str], distance: int) -> tuple[int, int]:
    """(distance, shortest prefix of ``text`` within it): plain rows, the texts are short."""
    row = list(range(len(pattern) + 1))
    if row[-1] <= distance:
        return row[-1], 0
    for at, w in enumerate(text, 1):
        last, row[0] = row[0], at
        for i, p in enumerate(pattern, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (p != w))
        if row[-1] <= distance:
            return row[-1], at
    return row[-1], len(text)


class SizeGroup:
    """Items of about one size: their start words, their vocabulary and the key tables of each walk and sample."""

    def __init__(self, items: list[tuple[int, list[int]]], n_words: int, ratio: float, number: int):
        low = min(len(w) for _, w in items)
        self.edits = max(int(len(w) * ratio) for _, w in items)
        self.reach = max(4, low - self.edits)
        self.steps = max(PLACES, (self.reach * 3) // 2)
        self.need = max(1, self.reach - self.edits)
        self.start, self.known = np.zeros(n_words, dtype=bool), np.zeros(n_words, dtype=bool)
        suffixes = []
        for item, w in items:
            self.known[w] = True
            for a in range(int(len(w) * ratio) + 1):
                self.start[w[a]] = True
                suffixes.append((item, a, w[a:]))
        rng = np.random.default_rng([17, number])
        self.places = [[np.sort(rng.choice(self.steps, PLACES, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)]
        self.factors = [seeds(self.steps, 1 + self.steps * (r + WALKS * number)) | np.uint64(1) for r in range(WALKS)]
        flat = np.concatenate([np.array(w, dtype=np.int64) for *_, w in suffixes])
        ends = np.cumsum([len(w) for *_, w in suffixes])
        starts = np.concatenate([[0], ends[:-1]])
        self.owner = np.array([(item, a) for item, a, _ in suffixes], dtype=np.int64)
        self.tables = []
        for keys in self.keys(flat, starts, ends):
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order))

    def keys(self, words: np.ndarray, at: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """A key for each start, for each walk and sample; ``ends`` bounds each sequence."""
        spread = mixed(np.arange(int(words.max(initial=0)) + 2, dtype=np.uint64))
        padded = np.append(words, -1)
        for factors, samples in zip(self.factors, self.places, strict=True):
            place, seen = at.copy(), np.empty((self.steps, len(at)), dtype=np.int64)
            for j in range(self.steps):
                symbol = np.where(place < ends, padded[np.minimum(place, len(words))], -1)
                seen[j] = symbol
                place += ((spread[symbol + 1] * factors[j]) >> np.uint64(63)).astype(np.int64)
            for chosen in samples:
                key = np.zeros(len(at), dtype=np.uint64)
                for j in chosen:
                    key = key * np.uint64(0x100000001B3) + seen[j].view(np.uint64)
                yield mixed(key)

    def candidates(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(place, item, offset) rows whose keys meet; ``ends`` is for each word the end of its text."""
        total = np.concatenate([[0], np.cumsum(self.known[words])])
        at = np.flatnonzero(self.start[words])
        at = at[total[np.minimum(at + self.reach, ends[at])] - total[at] >= self.need]
        found = []
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            for keys, (table, order) in zip(self.keys(words, part, ends[part]), self.tables, strict=True):
                low, high = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
                hit = np.flatnonzero(high > low)
                if len(hit):
                    n = high[hit] - low[hit]
                    row = np.repeat(hit, n)
                    entry = order[np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    found.append(np.column_stack([part[row], self.owner[entry]]))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)


class ShortItems:
    """Items of few words: of d + 1 pieces of an item with at most d edits one stands in the text as it is."""

    def __init__(self, items: list[tuple[int, list[int]]], ratio: float):
        pieces = defaultdict(list)
        for item, w in items:
            n = int(len(w) * ratio) + 1
            for i in range(n):
                a, b = len(w) * i // n, len(w) * (i + 1) // n
                pieces[b - a].append((item, a, w[a:b]))
        self.tables = []
        for length, own in sorted(pieces.items()):
            flat = np.array([w for *_, w in own], dtype=np.int64).ravel()
            keys = self.keys(flat, np.arange(0, len(flat), length), length)
            order = np.argsort(keys, kind="stable")
            self.tables.append((length, keys[order], np.array([(item, a) for item, a, _ in own], dtype=np.int64)[order]))

    @staticmethod
    def keys(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        key = np.zeros(len(at), dtype=np.uint64)
        for k in range(length):
            key = mixed(key * np.uint64(0x100000001B3) + words[at + k].astype(np.uint64))
        return key

    def candidates(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """As in ``SizeGroup``."""
        found = [np.zeros((0, 3), dtype=np.int64)]
        for length, table, owner in self.tables:
            at = np.arange(len(words))
            at = at[at + length <= ends]
            keys = self.keys(words, at, length)
            low, high = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
            n = high - low
            entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.column_stack([np.repeat(at, n), owner[entry]]))
        return np.unique(np.concatenate(found), axis=0)


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[object, str | None]], ratio: float = RATIO, min_item_words: int = MIN_ITEM_WORDS):
        split = [(key, item_words(text)) for key, text in items]
        self.items = [(key, w) for key, w in split if w]
        self.vocabularies = [frozenset(w) for _, w in self.items]
        self.ratio = ratio
        self.ids: dict[str, int] = {}
        for _, w in self.items:
            for word in w:
                self.ids.setdefault(word, len(self.ids) + 1)
        groups, short = defaultdict(list), []
        for i, (_, w) in enumerate(self.items):
            if len(w) < min_item_words:
                short.append((i, [self.ids[x] for x in w]))
                continue
            groups[round(math.log(len(w), 1.25))].append((i, [self.ids[x] for x in w]))
        self.groups = [SizeGroup(g, len(self.ids) + 1, ratio, k) for k, g in sorted(groups.items())]
        if short:
            self.groups.append(ShortItems(short, ratio))

    def find(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text its matches (item key, start, end, distance, item words), in words of the text."""
        out: list[list[tuple]] = [[] for _ in texts]
        split = [item_words(t) for t in texts]
        sizes = [len(w) for w in split]
        if not sum(sizes) or not self.groups:
            return out
        ids = np.fromiter(map(self.ids.get, chain.from_iterable(split), repeat(0)), dtype=np.int32, count=sum(sizes))
        last = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(split)), sizes)
        ends = last[owner]
        for group in self.groups:
            rows = group.candidates(ids, ends)
            seen: set[tuple[int, int, int]] = set()
            for place, item, offset in rows.tolist():
                text = int(owner[place])
                begin = place - int(last[text] - sizes[text])
                if (text, item, begin - offset) in seen:
                    continue
                key, pattern = self.items[item]
                d = int(len(pattern) * self.ratio)
                low = max(0, begin - offset - d)
                near = split[text][low : begin + len(pattern) - offset + d]
                # each word but d of the item must be there
                common = sum(map(self.vocabularies[item].__contains__, near))
                distance, a, b = edit_passage_within(pattern, near, d) if common >= len(pattern) - d else (d + 1, 0, 0)
                if distance > d:
                    seen.add((text, item, begin - offset))
                    continue
                seen.update((text, item, x) for x in range(low + a - d, low + a + d + 1))
                out[text].append((key, low + a, low + b, distance, len(pattern)))
        return [_apart(m) for m in out]


def edit_passage_within(pattern: list[str], text: list[str], d: int) -> tuple[int, int, int]:
    """``edit_passage`` where the distance is at most d; else only the distance counts."""
    distance, end = edit_end(pattern, text)
    return edit_passage(pattern, text) if distance <= d else (distance, 0, end)


def _apart(found: list[tuple]) -> list[tuple]:
    """Of overlapping matches of one item the closest, then the first."""
    kept: list[tuple] = []
    for m in sorted(set(found), key=lambda m: (m[3], m[1], m[2])):
        if all(k[0] != m[0] or k[2] <= m[1] or m[2] <= k[1] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m[1], m[2]))


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The items (item_id, text) in blocks of about ``block_chars`` characters, cut by hash: a stated query set."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // block_chars + 1
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b) if n > 1 else items
        yield sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def matches(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """(doc_id, item_id, start, end, distance, item_words, similarity): passages of documents that are benchmark items up to edits.

    ``start`` and ``end`` (outside) count the document's words. Of overlapping matches with one item the closest counts, then the
    first. Null and empty texts have no match; a null doc_id or item_id is carried; repeated rows repeat
    their matches; repeated items count once; items of any length are sought, each letter of a script without spaces is a word; an empty table on
    either side gives no rows. Other columns are ignored.
    """
    schema = "doc_id long, item_id long, start long, end long, distance long, item_words long"
    names = ["doc_id", "item_id", "start", "end", "distance", "item_words"]
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for block in item_blocks(benchmark):
        matcher = Matcher(block, **settings)

        def run(batches: Iterator[pa.RecordBatch], matcher: Matcher = matcher) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    found = matcher.find(part.column("text").to_pylist())
                    rows = [(d, *m) for d, own in zip(part.column("doc_id").to_pylist(), found, strict=True) for m in own]
                    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out.withColumn("similarity", 1 - F.col("distance") / F.col("item_words"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` without any match, all columns as they are; ``matches`` says what a match is."""
    out = docs
    for block in item_blocks(benchmark):
        matcher = Matcher(block, **settings)

        def run(batches: Iterator[pa.RecordBatch], matcher: Matcher = matcher) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    found = matcher.find(part.column("text").to_pylist())
                    yield part.filter(pa.array([not m for m in found], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out
