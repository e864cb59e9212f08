"""Benchmark decontamination by template canonicalisation.

Texts become templates: words in lower case without surrounding punctuation, numbers, names and units replaced by
typed placeholders (slots). Windows of template words are hash-joined with those of the benchmark; windows of mostly
slots are lengthened until they hold LITERALS other words, and are keyed by the slots' values besides. A hit is extended
to both sides while the template words are equal, and hits are put together to one alignment that pairs each word
once. There one value of the item must stand for one value of the document and the other way round, so that a
question with new names and numbers is found and a table that merely looks alike isn't; slots that say otherwise
don't count. What was found by values alone counts where the values are equal.

An item counts as contained when matched words cover COVERAGE of its template (and as much of the aligned slots agree, and
one word in WINDOW is no slot or has the same value), or RUN template words on end with 2 * LITERALS such words.
Words without a letter or digit ("|", "***") don't count as words. A name is a capitalised word of two letters or more;
names in a row are one slot. What begins a sentence may be a name or not, so it is a slot too, and one of its own kind of
value: "How" stands for "How" as "Tom" for "Anna". A unit is a word of UNITS after a number.

The benchmark is the query set: its index is broadcast in blocks of at most BLOCK windows, whose size is bounded
by that; a larger benchmark takes more passes over the documents, each settled and its block released before the next
block is built. Documents are never shuffled.

Null or empty texts, and items of fewer than SHORTEST template words, contain and match nothing. Items shorter than
a window are matched whole. Rows with equal ids are rows of their own; extra columns stay as they are.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.llm.common import Batches, byte_rows, mix64, settle, slices, windows

WINDOW = 5
SHORTEST = 4
LITERALS = 3  # words of a window that aren't slots, at least
COVERAGE = 0.8
RUN = 13
BLOCK = 1_000_000

# Fixed word lists.
UNITS = (
    "% cm mm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds lb lbs ounce "
    "ounces oz ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months "
    "year years dollar dollars cent cents euro euros usd eur degree degrees celsius fahrenheit percent mph kmh watt watts volt volts"
).split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice".split()

_INNER = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_NUMERAL = re.compile(r"[$€£]?\d[\d.,:/]*\d*(?:%|st|nd|rd|th)?")
_LIT, _NUM, _NAME, _UNIT, _NONE = range(5)
_VALUED, _STEP = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)  # odd
_PLACEHOLDER = np.array([0, 0x51D3, 0x7A11, 0x3E97], np.uint64)  # of slots, by kind


class _Kinds(dict):
    """raw word (bytes) -> (hash of the word, kind, does it end a sentence), as one number; bounded."""

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        text = raw.decode("utf-8", "replace")
        found = _INNER.search(text)
        if not found:
            code = _NONE
        else:
            word = found.group()
            low = word.lower()
            if _NUMERAL.fullmatch(word) or low in _NUMBER_SET:
                code = _NUM
            elif low in _UNIT_SET:
                code = _UNIT
            elif word[0].isupper() and word[1:] != word[1:].upper():
                code = _NAME
            else:
                code = _LIT
            code |= (xxhash.xxh64_intdigest(low.encode()) >> 4) << 4
        ends = raw.rstrip(b"\"')]}").endswith((b".", b"!", b"?", b":"))
        self[raw] = code = code | (8 if ends else 0)
        return code


_NUMBER_SET, _UNIT_SET = frozenset(NUMBERS), frozenset(UNITS)


class Template:
    """hashes: of template words; slots: 0 for literals, else the kind; values: of slots; words: index of the source word."""

    def __init__(self, text: bytes | None, cache: _Kinds):
        raw = (text or b"").replace(b"\n", b" .\n ").split() if text and b"\n" in text else (text or b"").split()
        codes = np.fromiter(map(cache.__getitem__, raw), np.uint64, len(raw))
        kind = (codes & np.uint64(7)).astype(np.int64)
        begins = np.ones(len(raw), bool)
        begins[1:] = (codes[:-1] & np.uint64(8)) != 0
        real = kind != _NONE
        # What begins a sentence is seen through words that aren't any, as "." between lines.
        seen = np.flatnonzero(real)
        open_ = np.add.reduceat(begins[1:].astype(np.int64), seen[:-1]) > 0 if len(seen) > 1 else np.zeros(0, bool)
        kind, value = kind[seen], codes[seen] >> np.uint64(4)
        first = np.ones(len(seen), bool)
        first[1:] = open_
        after_number = np.zeros(len(seen), bool)
        after_number[1:] = kind[:-1] == _NUM
        kind[(kind == _UNIT) & ~after_number] = _LIT
        name = kind == _NAME
        head = np.ones(len(seen), bool)
        head[1:] = ~(name[1:] & name[:-1]) | first[1:]
        if not head.all():
            at = np.flatnonzero(head)
            value = np.bitwise_xor.reduceat(value * np.where(name, np.arange(1, len(value) + 1, dtype=np.uint64) - np.repeat(at, np.diff([*at, len(value)])).astype(np.uint64), np.uint64(1)), at)
            kind, seen = kind[at], seen[at]
        self.slots, self.values, self.words = kind, value, seen
        self.hashes = np.where(kind == _LIT, value, _PLACEHOLDER[np.minimum(kind, 3)])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of windows of ``n`` words, or more until they hold LITERALS literals; and, keyed also
        by the values of their slots, of those with fewer literals among ``n`` words."""
        count, need = len(self.hashes), min(LITERALS, n)
        if count < n:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        literal = self.slots == _LIT
        at, before = np.flatnonzero(literal), np.concatenate([[0], np.cumsum(literal)])
        start = np.arange(count - n + 1)
        few = start[before[n:] - before[:-n] < need]
        if not len(few):
            return start, start + n, windows(self.hashes, n)
        plain = windows(self.hashes, n)
        plain[few] = 0
        keep = np.ones(len(start), bool)
        keep[few] = False
        parts = [(start[keep], start[keep] + n, plain[keep])]
        valued = windows(np.where(literal, self.values, mix64(self.hashes ^ self.values * _VALUED)), n)[few] ^ _VALUED
        parts.append((few, few + n, valued))
        if n == WINDOW:
            long_ = few[before[few] + need <= len(at)]
            if len(long_):
                end = at[before[long_] + need - 1] + 1
                parts.append((long_, end, self._spans(long_, end)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of spans of any length, from sums over all words before each."""
        scale = np.full(len(self.hashes) + 1, _STEP, np.uint64)
        scale[0] = 1
        scale = np.multiply.accumulate(scale)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(self.hashes) * scale[:-1], dtype=np.uint64)])
        back = np.full(len(self.hashes) + 1, pow(int(_STEP), -1, 1 << 64), np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        return mix64((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


class Index:
    """Windows of some items, sorted by hash; item and offset of each; the items' templates."""

    def __init__(self, items: list[tuple[int, bytes | None]]):
        cache = _Kinds()
        self.ids, self.templates = [], []
        hashes, where = [], []
        for item, text in items:
            template = Template(text, cache)
            if len(template.hashes) >= SHORTEST:
                start, _, found = template.windows(min(WINDOW, len(template.hashes)))
                where.append(np.stack([np.full(len(start), len(self.ids)), start], 1))
                hashes.append(found)
                self.ids.append(item)
                self.templates.append((template.hashes, template.slots, template.values))
        self.hashes = np.concatenate([*hashes, np.empty(0, np.uint64)])
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.where = self.hashes[order], np.concatenate([*where, np.empty((0, 2), np.int64)])[order]
        self.lengths = sorted({min(WINDOW, len(t[0])) for t in self.templates})
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def contained(self, template: Template) -> list[tuple[int, int, int, int, int]]:
        """(item, covered words, words of the item, first and last source word) of the contained items."""
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for n in self.lengths:
            start, end, hashes = template.windows(n)
            some = self.coarse[(hashes >> np.uint64(44)).astype(np.int64)]
            if not some.any():
                continue
            start, end, hashes = start[some], end[some], hashes[some]
            left, right = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, hashes, "right")
            for k in np.flatnonzero(right > left):
                for item, offset in self.where[left[k] : right[k]]:
                    if min(WINDOW, len(self.templates[item][0])) == n:
                        hits.setdefault(int(item), []).append((int(start[k]), int(offset), int(end[k] - start[k])))
        return [x for item, found in hits.items() if (x := self._aligned(item, found, template))]

    def _aligned(self, item: int, found: list[tuple[int, int, int]], template: Template):
        """Alignments are taken apart by where they start in the document, so that repeats don't mix."""
        size, best = len(self.templates[item][0]), None
        found.sort(key=lambda x: (x[0] - x[1], x[0]))
        groups: list[list[tuple[int, int, int]]] = []
        for hit in found:  # alignments that differ by a few inserted or lost words belong together
            if groups and (hit[0] - hit[1]) - (groups[-1][-1][0] - groups[-1][-1][1]) <= max(2, size // 8):
                groups[-1].append(hit)
            else:
                groups.append([hit])
        for group in groups:
            stretches = self._stretches(item, group, template)
            if sum(x[2] for x in stretches) >= min(RUN, COVERAGE * size) and (x := self._judged(item, _monotone(stretches), template)):
                best = max(best or (0,), x)
        return best and (self.ids[item], best[0], size, -best[1], best[2])

    def _stretches(self, item: int, group: list[tuple[int, int, int]], template: Template) -> list[tuple[int, int, int, bool]]:
        """Hits extended to both sides over equal template words: start, offset, words, and whether literals found it."""
        hashes, slots, _ = self.templates[item]
        by_shift: dict[int, list[tuple[int, int]]] = {}
        for start, offset, n in group:
            by_shift.setdefault(start - offset, []).append((offset, n))
        out = []
        for shift, hits in by_shift.items():
            low, high = max(0, -shift), min(len(hashes), len(template.hashes) - shift)
            same = (hashes[low:high] == template.hashes[low + shift : high + shift]).astype(np.int8)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], same, [0]]))) + low
            firm: dict[int, bool] = {}
            for offset, n in hits:
                k = int(np.searchsorted(edges[::2], offset, "right")) - 1
                firm[k] = firm.get(k, False) or int((slots[offset : offset + n] == _LIT).sum()) >= min(LITERALS, n)
            out += [(int(edges[2 * k]) + shift, int(edges[2 * k]), int(edges[2 * k + 1] - edges[2 * k]), x) for k, x in firm.items()]
        return out

    def _judged(self, item: int, chosen: list[tuple[int, int, int, bool]], template: Template):
        """Covered words, first and last word if the alignment makes the item contained.

        Each value goes with the value it meets most often, one to one; slots that say otherwise aren't covered.
        """
        _, slots, values = self.templates[item]
        size = len(slots)
        covered, firm, slot_words, meets = np.zeros(size, bool), np.zeros(size, bool), 0, {}
        for start, offset, n, by_literals in chosen:
            mine, theirs = values[offset : offset + n], template.values[start : start + n]
            free = slots[offset : offset + n] != _LIT
            covered[offset : offset + n] = ~free
            firm[offset : offset + n] = ~free | (mine == theirs)
            slot_words += int(free.sum())
            for k in np.flatnonzero(free if by_literals else free & (mine == theirs)):
                kind = int(slots[offset + k])
                meets.setdefault(((kind, int(mine[k])), (kind, int(theirs[k]))), []).append(offset + k)
        there, back, fit = set(), set(), 0
        for (a, b), where in sorted(meets.items(), key=lambda x: (-len(x[1]), x[0][0] != x[0][1], x[1][0])):
            if a not in there and b not in back:
                there.add(a), back.add(b)
                covered[where], fit = True, fit + len(where)
        firm &= covered
        count = int(covered.sum())
        whole = count >= COVERAGE * size and fit >= COVERAGE * slot_words and firm.sum() * WINDOW >= count
        if not whole:
            within, sure = (np.concatenate([[0], np.cumsum(x)]) for x in (covered, firm))
            if not ((within[RUN:] - within[:-RUN] == RUN) & (sure[RUN:] - sure[:-RUN] >= 2 * LITERALS)).any():
                return None
        first, last = min(x[0] for x in chosen), max(x[0] + x[2] for x in chosen) - 1
        return count, -int(template.words[first]), int(template.words[last])


def _monotone(stretches: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, int, bool]]:
    """One alignment: the longest stretch, then of the others what lies before or after the chosen ones on both sides."""
    chosen: list[tuple[int, int, int, bool]] = []
    for start, offset, n, by_literals in sorted(stretches, key=lambda x: (-x[2], abs(x[0] - x[1]), x)):
        best = (0, 0, 0)
        for k in range(len(chosen) + 1):
            low = max(0, chosen[k - 1][0] + chosen[k - 1][2] - start, chosen[k - 1][1] + chosen[k - 1][2] - offset) if k else 0
            high = min(n, chosen[k][0] - start, chosen[k][1] - offset) if k < len(chosen) else n
            best = max(best, (high - low, low, k))
        length, low, k = best
        if length >= min(WINDOW, n):
            chosen.insert(k, (start + low, offset + low, length, by_literals))
    return chosen


def _found(batches: Batches, index) -> Batches:
    cache = _Kinds()
    for batch in slices(batches):
        ids, rows = batch.column("doc_id"), []
        for k, text in enumerate(byte_rows(batch, "text")):
            rows += [(k, *x) for x in index.value.contained(Template(text, cache))]
        at, item, covered, size, first, last = zip(*rows, strict=True) if rows else ((),) * 6
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (item, covered, size)), pa.array([c / s for c, s in zip(covered, size, strict=True)], pa.float64()), *(pa.array(x, pa.int64()) for x in (first, last))],
            ["doc_id", "item_id", "n_matched", "n_item", "coverage", "first_word", "last_word"],
        )


def _clean(batches: Batches, index) -> Batches:
    cache = _Kinds()
    for batch in slices(batches):
        yield batch.filter(pa.array([not index.value.contained(Template(t, cache)) for t in byte_rows(batch, "text")], pa.bool_()))


def _blocks(benchmark: DataFrame):
    """The benchmark's items as broadcast indexes of at most about BLOCK windows, and whether another follows."""
    send = benchmark.sparkSession.sparkContext.broadcast
    items, size = [], 0
    for r in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        if size >= BLOCK:
            yield send(Index(items)), True
            items, size = [], 0
        items.append((r.item_id, r.text.encode()))
        size += len(r.text.split())
    if items:
        yield send(Index(items)), False


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document (doc_id, text) and benchmark item (item_id, text) that it contains.

    doc_id, item_id, n_matched and n_item (template words), coverage, first_word, last_word (words of the text,
    line breaks counted as one). Documents without a row contain no item.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, n_matched long, n_item long, coverage double, first_word long, last_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index, more in _blocks(benchmark):
        found = docs.select("doc_id", "text").mapInArrow(partial(_found, index=index), schema)
        if more:
            found = settle(found)
            index.unpersist()
        out = out.union(found)
    return out


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; all columns stay."""
    for index, more in _blocks(benchmark):
        docs = docs.mapInArrow(partial(_clean, index=index), docs.schema)
        if more:
            docs = settle(docs)
            index.unpersist()
    return docs
