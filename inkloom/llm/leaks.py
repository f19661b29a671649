"""Problem 8: evaluation items that stand, whole or in part, in the documents.

Method: texts are read column by column and folded to a skeleton in which confusable letters are equal.
Windows of items and documents are embedded by the CGK random walk, which turns edit distance into Hamming
distance; bit-sampling hashes over the embedding, repeated, find window pairs, and each candidate is
verified by an exact word alignment that counts the item's words in one run.

The items are the stated query set: they are hashed once, in blocks of a checked size, and each block meets all
documents in one pass without a shuffle. (Documents have about 16 keys for every third word, several times their own
size, so that a shuffle by key would cost more than a pass for every 5,000 items.)

Defined results: null, empty and blank texts hold nothing; items with null or no words leak nowhere; equal items
are each reported; documents of any length are searched whole.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkloom.llm.columns import reading_order, running_text
from inkloom.llm.confusions import skeleton

#: Letters of a window, steps of the walk, hash tables, sampled positions of each.
WINDOW, STEPS, TABLES, SAMPLED = 40, 84, 16, 14
#: Document windows begin at every STRIDE-th word, item windows at every word.
STRIDE = 3
#: Items are searched in blocks of so many (about 50 windows each).
ITEM_BLOCK = 5_000
#: The share of an item's words that must stand in one run.
SHARE = 0.5
#: The share of a run's words that must match, misread letters allowed: texts of one pattern with other words stay below.
MATCHED = 0.85
SEED = 20_240_601
BITS = 22


@functools.cache
def _code_table() -> np.ndarray:
    """Character code to one of 64 symbols; 0 is the blank."""
    table = np.zeros(0x500, np.uint8)
    for c in range(1, 0x500):
        table[c] = 1 + (c * 2654435761 >> 7) % 62
    for i, c in enumerate("abdeghijklmnprtuvwxyz0123489"):
        table[ord(c)] = 1 + i
    table[32] = 0
    return table


@functools.cache
def _walk() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The walk's random bits by step and symbol, the sampled positions of each table and their factors."""
    rng = np.random.default_rng(SEED)
    bits = rng.integers(0, 2, (STEPS, 64)).astype(np.int32)
    # Positions that the walk reaches while still inside most windows.
    positions = np.stack([np.sort(rng.choice(STEPS - 8, SAMPLED, replace=False)) for _ in range(TABLES)])
    factors = rng.integers(1, 2**63, (TABLES, SAMPLED), dtype=np.uint64) | np.uint64(1)
    return bits, positions, factors


def _encode(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _code_table()[np.minimum(code, 0x4FF)]


def window_keys(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash keys of the windows at starts, one column for each table."""
    bits, positions, factors = _walk()
    n = len(starts)
    at = starts.astype(np.int64).copy()
    last = len(symbols) - 1
    walk = np.empty((STEPS, n), np.uint8)
    for j in range(STEPS):
        c = symbols[np.minimum(at, last)]
        walk[j] = c
        at += bits[j][c]
    keys = np.zeros((TABLES, n), np.uint64)
    for t in range(TABLES):
        acc = np.zeros(n, np.uint64)
        for p, f in zip(positions[t], factors[t], strict=True):
            acc += (walk[p].astype(np.uint64) + np.uint64(1)) * f
            acc ^= acc >> np.uint64(29)
        keys[t] = acc
    return keys


def _word_starts(symbols: np.ndarray) -> np.ndarray:
    blank = symbols == 0
    start = ~blank
    start[1:] &= blank[:-1]
    return np.flatnonzero(start)


class ItemIndex:
    """The windows of a block of items, by hash key and table."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [skeleton(t).split() for _, t in items]
        self.near = ItemWords(self.words)
        text = "  ".join(" ".join(w) for w in self.words) + " " * (WINDOW + STEPS)
        symbols = _encode(text)
        owner = np.zeros(len(symbols), np.int32)
        at = 0
        for k, w in enumerate(self.words):
            size = len(" ".join(w))
            owner[at : at + size + 2] = k
            at += size + 2
        starts = _word_starts(symbols)
        ends = np.searchsorted(np.arange(len(symbols)), starts + WINDOW)
        inside = owner[np.minimum(ends, len(owner) - 1)] == owner[starts]
        starts = starts[inside]
        keys = window_keys(symbols, starts)
        self.sorted_keys, self.sorted_item = [], []
        self.filter = np.zeros((TABLES, 1 << BITS), bool)
        for t in range(TABLES):
            order = np.argsort(keys[t], kind="stable")
            self.sorted_keys.append(keys[t][order])
            self.sorted_item.append(owner[starts][order])
            self.filter[t][(keys[t] >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def candidates(self, keys: np.ndarray) -> set[tuple[int, int]]:
        """(window, item) pairs that share a key."""
        out: set[tuple[int, int]] = set()
        for t in range(TABLES):
            near = np.flatnonzero(self.filter[t][(keys[t] >> np.uint64(64 - BITS)).astype(np.int64)])
            if not len(near):
                continue
            mine = keys[t][near]
            lo = np.searchsorted(self.sorted_keys[t], mine, "left")
            hi = np.searchsorted(self.sorted_keys[t], mine, "right")
            for w, a, b in zip(near[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                for item in set(self.sorted_item[t][a:b].tolist()):
                    out.add((int(w), item))
        return out


def _near(a: str, b: str) -> bool:
    """Equal, or one edit apart (two in long words)."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1 or min(la, lb) < 3:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(la, lb) - i and a[la - 1 - j] == b[lb - 1 - j]:
        j += 1
    return max(la, lb) - i - j <= (1 if max(la, lb) < 8 else 2)


def _ends(word: str) -> tuple[str, ...]:
    """Beginning and end of a word: words one edit apart (two in long ones) have one of them in common."""
    n = len(word)
    if n < 3:
        return ()
    return ("<" + word[0], ">" + word[-1]) if n == 3 else ("<" + word[:2], ">" + word[-2:], "<" + word[0], ">" + word[-1]) if n == 4 else ("<" + word[:2], ">" + word[-2:])


class ItemWords:
    """The distinct words of the items, and for words of documents which of them are equal or an edit apart.

    What is found for a word is remembered for later documents; the memory is emptied when it is full, which costs
    time but changes nothing.
    """

    MOST = 300_000

    def __init__(self, items: list[list[str]]):
        self.number: dict[str, int] = {}
        self.places: dict[str, list[str]] = {}
        for w in dict.fromkeys(w for words in items for w in words):
            self.number[w] = len(self.number)
            for e in _ends(w):
                self.places.setdefault(e, []).append(w)
        self.items = [[self.number[w] for w in words] for words in items]
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.MOST:
                self.known.clear()
            near = {x for e in _ends(word) for x in self.places.get(e, ()) if abs(len(x) - len(word)) < 2 and _near(word, x)}
            if word in self.number:
                near.add(word)
            found = self.known[word] = tuple(self.number[x] for x in near)
        return found


def may_match(item: list[int], here: set[int], need: float) -> bool:
    """Whether any stretch of need words of the item has the share MATCHED of them, equal or an edit apart, among those here.

    A run that best_run or chained_run accepts is such a stretch, so nothing is turned down that these would accept.
    """
    least, total = math.inf, 0.0
    before = [0.0]
    for i, w in enumerate(item, 1):
        total += (1 - MATCHED) if w in here else -MATCHED
        before.append(total)
        if i >= need:
            least = min(least, before[math.floor(i - need)])
            if total >= least - 1e-9:
                return True
    return False


def holds(item: list[str], region: list[str], need: float) -> bool:
    """Whether a run in the region covers so many words of the item: by a chain of equal words, else by alignment."""
    covered, matched, _, _ = chained_run(item, region)
    # Too few equal words may still be enough that differ by an edit.
    return covered >= need and matched >= 0.9 * covered or best_run(item, region) >= need


def best_run(item: list[str], doc: list[str]) -> int:
    """How many of the item's words the best run in the document covers.

    Local alignment of words: a run may hold misread words and one longer insertion such as an advert; the words
    between its first and last match count as covered if the share MATCHED of them match; a lower share is another text of the same pattern.
    """
    n, m = len(item), len(doc)
    match, miss, open_gap, extend, drop = 2.0, -4.0, -5.0, -0.06, -4.0
    known: dict[tuple[str, str], bool] = {}
    prev = [0.0] * (m + 1)
    prev_from = [(0, 0)] * (m + 1)
    best, best_span = 0.0, (0, 0, 0)
    for i in range(1, n + 1):
        a = item[i - 1]
        cur, cur_from = [0.0] * (m + 1), [(i, 0)] * (m + 1)
        gap, gap_from = -1e9, (i, 0)
        for j in range(1, m + 1):
            b = doc[j - 1]
            key = (a, b)
            same = known.get(key)
            if same is None:
                same = known[key] = _near(a, b)
            diag = prev[j - 1]
            if same:
                score = diag + match
                src = prev_from[j - 1] if diag > 0 else (i - 1, 0)
                src = (src[0], src[1] + 1)
            else:
                score, src = diag + miss, prev_from[j - 1]
                up = prev[j] + drop
                if up > score:
                    score, src = up, prev_from[j]
            if gap > score:
                score, src = gap, gap_from
            if score <= 0:
                cur[j], cur_from[j] = 0.0, (i, 0)
            else:
                cur[j], cur_from[j] = score, src
                if same and score > best:
                    best, best_span = score, (src[0], i, src[1])
            opened = cur[j] + open_gap
            gap += extend
            if opened > gap:
                gap, gap_from = opened, cur_from[j]
        prev, prev_from = cur, cur_from
    first, last, matched = best_span
    covered = last - first
    return covered if matched >= MATCHED * covered else 0


def chained_run(item: list[str], doc: list[str]) -> tuple[int, int, int, int]:
    """(item words covered, words matched, first and last position in doc) of the best chain of equal words.

    Steps of a chain skip at most four words on either side; one step may skip an insertion of up to 45.
    """
    places: dict[str, list[int]] = {}
    for j, w in enumerate(doc):
        places.setdefault(w, []).append(j)
    pairs = [(i, j) for i, w in enumerate(item) for j in places.get(w, ())]
    best, best_score = (0, 0, 0, 0), 0
    # Chains by their last pair: (matched, first item word, first position, long steps used, score).
    chains: list[tuple[int, int, int, int, int]] = []
    low = 0
    for k, (i, j) in enumerate(pairs):
        while pairs[low][0] < i - 5:
            low += 1
        top = (1, i, j, 0, 1)
        for x in range(low, k):
            pi, pj = pairs[x]
            if pi >= i or pj >= j:
                continue
            n, fi, fj, far, score = chains[x]
            score += 1 - 2 * (i - pi - 1)
            if j - pj > 5:
                if far or j - pj > 45:
                    continue
                far = 1
                score -= 3
            else:
                score -= max(0, j - pj - (i - pi))
            if score > top[4]:
                top = (n + 1, fi, fj, far, score)
        chains.append(top)
        if top[4] > best_score:
            best_score = top[4]
            best = (i - top[1] + 1, top[0], top[2], j)
    return best


def leaked_items(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(item_id, doc_id): the document, read column by column, holds the share of the item's words in one run.

    docs needs doc_id and text; n_columns and boxes are used where they are there.
    """
    out, block = None, []

    def search(block: list[tuple[int, str]]) -> DataFrame:
        part = _search_block(docs, block, share)
        return part if out is None else out.unionByName(part)

    for r in items.where("text is not null and item_id is not null").select("item_id", "text").toLocalIterator():
        if skeleton(r[1]):
            block.append((r[0], r[1]))
        if len(block) == ITEM_BLOCK:
            out, block = search(block), []
    return search(block) if block or out is None else out


def _columns(docs: DataFrame) -> DataFrame:
    if "boxes" in docs.columns and "n_columns" in docs.columns:
        return docs.select("doc_id", "text", "n_columns", docs["boxes.x0"].alias("x0"), docs["boxes.x1"].alias("x1"), docs["boxes.y0"].alias("y0"))
    return docs.select("doc_id", "text")


def page_texts(batch: pa.RecordBatch) -> list[str]:
    """The running text of each document of a batch made by _columns."""
    cols = [c.to_pylist() for c in batch.columns[1:]]
    if len(cols) == 1:
        return [running_text(t.split("\n")) if t else "" for t in cols[0]]
    return [running_text(reading_order(t, a, b, y, n)) if t else "" for t, n, a, b, y in zip(*cols, strict=True)]


def _search_block(docs: DataFrame, items: list[tuple[int, str]], share: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not items:
            return
        index = _index_of(tuple(items))
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                ids = batch.column(0).to_pylist()
                folded = [skeleton(t) for t in page_texts(batch)]
                pad = " " * (STEPS + 2)
                sizes = [len(t) + len(pad) for t in folded]
                text = pad.join(folded) + pad
                symbols = _encode(text)
                starts = _word_starts(symbols)
                if not len(starts):
                    continue
                first = np.concatenate([[0], np.cumsum(sizes)])
                doc_of = np.searchsorted(first, starts, "right") - 1
                # Every STRIDE-th word of each document.
                word_no = np.arange(len(starts)) - np.searchsorted(doc_of, doc_of, "left")
                pick = np.flatnonzero(word_no % STRIDE == 0)
                hits = index.candidates(window_keys(symbols, starts[pick]))
                spots: dict[tuple[int, int], list[int]] = {}
                for w, item in hits:
                    k = pick[w]
                    spots.setdefault((int(doc_of[k]), item), []).append(int(word_no[k]))
                rows: list[tuple[int, int]] = []
                words: dict[int, list[str]] = {}
                near: dict[int, list[tuple[int, ...]]] = {}
                for (d, item), at in sorted(spots.items()):
                    ws = words.get(d)
                    if ws is None:
                        ws = words[d] = folded[d].split()
                        near[d] = [index.near.of(w) for w in ws]
                    own = index.words[item]
                    reach = len(own) + 40
                    need = share * len(own)
                    at.sort()
                    checked = -1
                    for a in at:
                        if a <= checked:
                            continue
                        lo, hi = max(0, a - reach), min(len(ws), a + reach)
                        checked = a + 20
                        if may_match(index.near.items[item], set().union(*near[d][lo:hi]), need) and holds(own, ws[lo:hi], need):
                            rows.append((index.ids[item], ids[d]))
                            break
                if rows:
                    a, b = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["item_id", "doc_id"])

    return _columns(docs).mapInArrow(run, "item_id long, doc_id long")


def brute_force(texts: dict[int, str], items: list[tuple[int, str]], share: float = SHARE) -> set[tuple[int, int]]:
    """(item_id, doc_id) by verification of every item against every whole document, to measure the search's recall."""
    words = [skeleton(t).split() for _, t in items]
    near = ItemWords(words)
    out: set[tuple[int, int]] = set()
    for doc, text in texts.items():
        ws = skeleton(text).split()
        here = set().union(*map(near.of, ws))
        for k, (item, _) in enumerate(items):
            if words[k] and may_match(near.items[k], here, share * len(words[k])) and holds(words[k], ws, share * len(words[k])):
                out.add((item, doc))
    return out


@functools.lru_cache(maxsize=2)
def _index_of(items: tuple[tuple[int, str], ...]) -> ItemIndex:
    return ItemIndex(list(items))
