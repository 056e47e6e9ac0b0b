"""Benchmark contamination: documents that hold an item, or a lightly edited one, in a window of the item's size.

Texts are words (lower case, without punctuation at their ends). A window of as many words as the item is contaminated
if the word edit distance is at most ``EDIT_SHARE`` of the item's words. The CGK walk embeds windows and items: it reads
a string and advances on random bits of the symbol read, so that edit distance becomes Hamming distance. Bit-sampling
tables over several independent walks propose (stretch of windows, item) candidates; exact edit distances confirm them.
The embedding stretches k edits to as much as k squared, so an item of more than ``SEGMENT_OVER`` words is embedded as
segments of ``SEGMENT_WORDS`` words: k edits leave at least one segment its share of them, and windows of that size are
compared with all segments. Recall by test is above 0.99 at the full edit bound at every length.

Windows that cannot qualify are never embedded: k edits leave n - q + 1 - qk of an item's q-word runs, and a window with
fewer is skipped; that count loses nothing. Over each proposed stretch one bit-parallel scan gives, for every end, the
least distance of the item to any run of words with that end; where it is within the bound, the distance of the window
itself is computed, so the best window of a proposed stretch is exact. A text that is shorter than the item, but within
the bound, is one window.

Items are the stated query set: they go to the tasks in blocks of a bounded size, one scan of the documents per block.
Null texts are empty and match nothing; items without words match nothing; equal items are reported each by its own id.
Several windows that match one item give the one with the fewest edits, then the first. Repeated rows are reported once
each. Texts of any length are searched whole, in slabs of bounded size. Only the named columns are read for hits; what is
dropped or kept carries all columns, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import distinct_hashes, gram_hashes, map_arrow, mix64, slabs, small_batches

EDIT_SHARE = 0.15
#: Independent walks, tables per walk, coordinates per table of ``cgk_keys``.
WALKS, TABLES, BITS = 12, 8, 3
#: Items of more words than the first are embedded as segments of the second.
SEGMENT_OVER, SEGMENT_WORDS = 64, 48
#: Windows that are embedded at a time.
EMBED_WINDOWS = 20_000
#: Items and their characters in one block.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 20_000_000
#: Entries of the bit table that most word runs are looked up in alone.
SIEVE = 1 << 22
HITS = "doc_id long, item_id long, window_start long, edits int, item_words int"


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, number of words before each text)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
    coded = split.values.dictionary_encode()
    bare = pc.utf8_trim(coded.dictionary, characters="".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127), 0xA1, 0xAB, 0xBB, 0xBF, *range(0x2010, 0x2028)])))
    hashes = distinct_hashes(bare)
    blank = np.asarray(pc.equal(bare, "").to_numpy(zero_copy_only=False), bool)
    number = coded.indices.to_numpy(zero_copy_only=False)
    real = ~blank[number] if len(blank) else np.zeros(0, bool)
    before = np.concatenate(([0], np.cumsum(real)))[np.asarray(split.offsets)]
    return (hashes[number][real] if len(number) else np.zeros(0, np.uint64)), before


def masks_of(a: list[int]) -> dict[int, int]:
    """The places of each symbol as a bit vector."""
    at: dict[int, int] = {}
    for k, s in enumerate(a):
        at[s] = at.get(s, 0) | 1 << k
    return at


def edit_distance(a: list[int], b: list[int], most: int, at: dict[int, int] | None = None) -> int:
    """Levenshtein distance of two symbol lists by bit vectors; anything above ``most`` is most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    return min([len(a), *_scores(masks_of(a) if at is None else at, len(a), b, 1)][-1], most + 1)


def _scores(at: dict[int, int], n: int, b: list[int], border: int):
    """After each symbol of ``b`` the distance of the n symbols to what was read (border 1) or to the best run that ends there (0)."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    for s in b:
        eq = at.get(s, 0)
        vertical = eq | minus
        across = ((((eq & plus) + plus) ^ plus) | eq) & full
        hp, hm = minus | (full & ~(across | plus)), plus & across
        score += bool(hp & top) - bool(hm & top)
        hp, hm = (hp << 1 | border) & full, hm << 1 & full
        plus, minus = hm | (full & ~(vertical | hp)), hp & vertical
        yield score


def cgk_keys(windows: np.ndarray) -> np.ndarray:
    """LSH keys (walks * tables, windows) of all walks over windows of equal length; the same for items of that length.

    Coordinates are drawn from the first 2n steps, in which a walk reads about n symbols; later ones would mostly
    compare padding with padding. A key that read nothing but padding says nothing of the window, so it is mixed with
    all of it and meets only equal ones.
    """
    many, n = windows.shape
    steps = 2 * n
    rng = np.random.default_rng([WALKS, TABLES, BITS, n])
    salts = rng.integers(0, 2**63, (steps, WALKS, 1)).astype(np.uint64)
    chosen: dict[int, list[tuple[int, int, int]]] = {}
    for (w, t, b), j in np.ndenumerate(rng.integers(0, steps, (WALKS, TABLES, BITS))):
        chosen.setdefault(int(j), []).append((w, t, b))
    # past its end a string reads as padding; all walks advance together
    flat = np.concatenate((windows, np.zeros((many, 1), np.uint64)), axis=1).ravel()
    origin = np.arange(many) * (n + 1)
    place = np.zeros((WALKS, many), np.int64)
    keys = np.zeros((WALKS, TABLES, many), np.uint64)
    empty = np.ones((WALKS, TABLES, many), bool)
    for j in range(max(chosen) + 1):
        symbol = flat[origin + place]
        for w, t, b in chosen.get(j, ()):
            empty[w, t] &= symbol[w] == 0
            keys[w, t] ^= mix64(symbol[w] + np.uint64((b * TABLES + t + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        bit = (symbol ^ salts[j]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)
        place = np.minimum(place + bit.astype(np.int64), n)
    keys ^= np.where(empty, mix64(windows.sum(axis=1)), np.uint64(0))
    return keys.reshape(WALKS * TABLES, many)


def segment_size(n: int) -> int:
    """Words that are embedded together of an item of ``n`` words."""
    return n if n <= SEGMENT_OVER else SEGMENT_WORDS


class Items:
    """A block of items, ready to be searched for: q-word runs, and the LSH keys of each item's segments."""

    def __init__(self, ids: list[int], texts: list[str], edit_share: float = EDIT_SHARE):
        hashes, before = words_of(texts)
        self.ids, self.words = ids, [hashes[a:b] for a, b in zip(before[:-1], before[1:])]
        self.most = [int(edit_share * len(w)) for w in self.words]
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by q: run hashes in order, the item of each, a sieve
        self.needed: list[tuple[int, int]] = []
        by_q: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            n, most = len(w), self.most[k]
            q = next((q for q in (5, 4, 3, 2, 1) if n - q + 1 - q * most >= 1), 0)
            self.needed.append((q, n - q + 1 - q * most))
            if q:
                by_q.setdefault(q, []).append(k)
        for q, members in by_q.items():
            grams = [gram_hashes(self.words[k], q) for k in members]
            flat, owner = np.concatenate(grams), np.repeat(members, [len(g) for g in grams])
            order = np.argsort(flat, kind="stable")
            sieve = np.zeros(SIEVE, bool)
            sieve[(flat & np.uint64(SIEVE - 1)).astype(np.int64)] = True
            self.runs[q] = (flat[order], owner[order], sieve)
        self.masks: dict[int, dict[int, int]] = {}  # of items that were met
        self.keys: dict[int, np.ndarray] = {}  # by item: (walks * tables, segments)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            if len(w):
                by_size.setdefault(segment_size(len(w)), []).append(k)
        for size, members in by_size.items():
            cuts = [[*range(0, len(self.words[k]) - size, size), len(self.words[k]) - size] for k in members]
            keys = cgk_keys(np.stack([self.words[k][o : o + size] for k, own in zip(members, cuts) for o in own]))
            ends = np.cumsum([len(own) for own in cuts])
            self.keys.update(zip(members, np.split(keys, ends[:-1], axis=1)))

    def _places(self, hashes: np.ndarray, text_of: np.ndarray):
        """(item, the places in order at which a run of the item stands), where it has enough of them."""
        for q, (flat, owner, sieve) in self.runs.items():
            grams = gram_hashes(hashes, q)
            hit = np.flatnonzero(sieve[(grams & np.uint64(SIEVE - 1)).astype(np.int64)])
            hit = hit[text_of[hit] == text_of[hit + q - 1]]
            lo, hi = np.searchsorted(flat, grams[hit]), np.searchsorted(flat, grams[hit], side="right")
            hit, lo, hi = hit[hi > lo], lo[hi > lo], hi[hi > lo]
            if not len(hit):
                continue
            at = np.repeat(hit, hi - lo)
            item = owner[np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)))[:-1], hi - lo) + np.arange(len(at))]
            order = np.lexsort((at, item))
            item, at = item[order], at[order]
            fresh = np.concatenate(([True], (item[1:] != item[:-1]) | (at[1:] != at[:-1])))
            item, at = item[fresh], at[fresh]
            bounds = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1], [True])))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b - a >= self.needed[item[a]][1]:
                    yield int(item[a]), q, at[a:b]

    def _stretches(self, k: int, q: int, places: np.ndarray, text_of: np.ndarray, before: np.ndarray) -> list[tuple[int, int]]:
        """(first, last) window starts inside one text whose windows share enough runs with item ``k``."""
        n, least = len(self.words[k]), self.needed[k][1]
        # a window from s holds the runs at s .. s + n - q; some run is its first, so starts lie just before runs
        first, last = places[: len(places) - least + 1], places[least - 1 :]
        close = (last - first <= n - q) & (text_of[first] == text_of[last])
        first, last = first[close], last[close]
        text = text_of[first]
        low, high = np.maximum(before[text], last - n + q), np.minimum(first, before[text + 1] - n)
        out: list[list[int]] = []
        for a, b in zip(low.tolist(), high.tolist()):
            if b < a:
                continue
            if out and a <= out[-1][1]:
                out[-1][1] = max(b, out[-1][1])
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def _short(self, k: int, places: np.ndarray, text_of: np.ndarray, before: np.ndarray) -> list[int]:
        """The texts shorter than item ``k``, within its bound, that share enough runs with it."""
        n, most, least = len(self.words[k]), self.most[k], self.needed[k][1]
        text, times = np.unique(text_of[places], return_counts=True)
        size = before[text + 1] - before[text]
        return text[(times >= least) & (size < n) & (size >= n - most)].tolist()

    def _proposed(self, hashes: np.ndarray, regions: list[tuple[int, int, int]]) -> np.ndarray:
        """For each (item, first word, word after the last): whether a window in it shares a table's key with a segment of the item."""
        out = np.zeros(len(regions), bool)
        by_size: dict[int, list[int]] = {}
        for r, (k, _, _) in enumerate(regions):
            by_size.setdefault(segment_size(len(self.words[k])), []).append(r)
        for size, members in by_size.items():
            many = [max(1, regions[r][2] - regions[r][1] - size + 1) for r in members]
            owner = np.repeat(members, many)
            start = np.concatenate([np.arange(regions[r][1], regions[r][1] + m) for r, m in zip(members, many)])
            end = np.array([regions[r][2] for r in members]).repeat(many)
            for first in range(0, len(start), EMBED_WINDOWS):
                part = slice(first, first + EMBED_WINDOWS)
                at = start[part, None] + np.arange(size)
                # a text shorter than the item is padded
                windows = np.where(at < end[part, None], hashes[np.minimum(at, len(hashes) - 1)], np.uint64(0))
                keys, own = cgk_keys(windows), owner[part]
                bounds = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    r = own[a]
                    if not out[r]:
                        out[r] = any((keys[:, a:b] == segment[:, None]).any() for segment in self.keys[regions[r][0]].T)
        return out

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item id, first word of the window, edits, item words): the best window of each text and item."""
        hashes, before = words_of(texts)
        text_of = np.repeat(np.arange(len(texts)), np.diff(before))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        todo: list[tuple[int, int, int, int]] = []  # item, text, first and last window start; no last one for a text that is one window
        for k, q, places in self._places(hashes, text_of):
            todo += [(k, text, int(before[text]), -1) for text in self._short(k, places, text_of, before)]
            todo += [(k, int(text_of[a]), a, b) for a, b in self._stretches(k, q, places, text_of, before)]
        regions = [(k, a, int(before[text + 1]) if b < 0 else b + len(self.words[k])) for k, text, a, b in todo]
        for (k, text, a, b), proposed in zip(todo, self._proposed(hashes, regions).tolist()):
            if not proposed:
                continue
            item, most, n = self.words[k].tolist(), self.most[k], len(self.words[k])
            if k not in self.masks:
                self.masks[k] = masks_of(item)
            at = self.masks[k]
            if b < 0:
                edits = edit_distance(item, hashes[a : before[text + 1]].tolist(), most, at)
                if edits <= most:
                    best[text, k] = (edits, 0)
                continue
            read = hashes[a : b + n].tolist()
            # no window is nearer than the best run with its end, so the nearest ends go first and spare others
            ends = sorted((score, s) for s, score in enumerate(_scores(at, n, read, 0), 1 - n) if s >= 0 and score <= most)
            for score, s in ends:
                start = a + s - int(before[text])
                if (text, k) in best and best[text, k] <= (score, start):
                    continue
                edits = edit_distance(item, read[s : s + n], most, at)
                if edits <= most:
                    best[text, k] = min(best.get((text, k), (edits, start)), (edits, start))
        return [(text, self.ids[k], start, edits, len(self.words[k])) for (text, k), (edits, start) in sorted(best.items())]


def _blocks(items: DataFrame, item_id: str, text: str):
    """Item blocks of bounded size, in the order of a streamed read."""
    ids, texts, size = [], [], 0
    for r in items.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).toLocalIterator():
        if ids and (len(ids) >= BLOCK_ITEMS or size + len(r.t) > BLOCK_CHARS):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t)
    if ids:
        yield ids, texts


def find_contamination(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", edit_share: float = EDIT_SHARE) -> DataFrame:
    """One row per document and item that it holds: the window with the fewest edits."""
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    out = None
    for ids, texts in _blocks(items, item_id, item_text):

        def run(batches, ids=ids, texts=texts):
            import pyarrow as pa

            block = Items(ids, texts, edit_share)
            for batch in batches:
                own, rows = batch.column("doc_id").to_pylist(), []
                for first, held in slabs(batch.column("body").to_numpy(zero_copy_only=False)):
                    rows += [(own[first + t], *rest) for t, *rest in block.search(held)]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split()[0] for c in HITS.split(", ")])

        part = docs.mapInArrow(run, HITS)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], HITS) if out is None else out


def drop_contaminated(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", edit_share: float = EDIT_SHARE) -> DataFrame:
    """``df`` without the documents that hold an item; all columns stay, and no row moves between tasks."""
    small_batches(df.sparkSession)
    names, at = df.columns, df.columns.index(text)
    for ids, texts in _blocks(items, item_id, item_text):

        def run(batches, ids=ids, texts=texts):
            import pyarrow as pa

            block = Items(ids, texts, edit_share)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, held in slabs(batch.column(at).to_numpy(zero_copy_only=False)):
                    keep[[first + t for t, *_ in block.search(held)]] = False
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep)).columns, names)

        df = map_arrow(df, run, df.schema)
    return df
