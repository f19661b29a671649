"""Problem 7: token ids of every document by a public byte-level BPE vocabulary.

Method: merge replay over the words of a block of the corpus. The distinct words of a block are
laid out as one sequence of symbols; an inverted index leads from each adjacent token pair to its
positions, and the merges present are applied in rank order, each touching only its positions
and their two neighbours. Blocks are the Arrow batches of a task; ids of words met before in
the same Python worker are reused, so nothing is shuffled and little is replayed twice.

Defined results: null and empty texts give an empty list; text that looks like a special token is
plain text; lone surrogates cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes remembered per Python worker, about; beyond it the memory is emptied and words are replayed again.
MEMORY_BYTES = 256 << 20
#: Stretches of more characters, such as lines of a script without blanks or encoded bytes, are replayed each time.
LONG_STRETCH = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """All merges of a rank file, replayed over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.ranks = ranks
        self.token_bytes = {i: t for t, i in ranks.items()}
        self.pair_ids: dict[tuple[int, int], int] = {}

    def merged(self, a: int, b: int) -> int:
        """Id of the token that the pair merges to, or -1."""
        key = (a, b)
        found = self.pair_ids.get(key)
        if found is None:
            found = self.pair_ids[key] = self.ranks.get(self.token_bytes[a] + self.token_bytes[b], -1)
        return found

    def encode_words(self, words: list[str]) -> list[list[int]]:
        sym: list[int] = []
        bounds = [0]
        for w in words:
            sym.extend([self.byte_ids[b] for b in w.encode("utf-8")])
            sym.append(-1)
            bounds.append(len(sym))
        n = len(sym)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        merged = self.merged
        index: dict[int, list[int]] = {}
        for p in range(n - 1):
            a, b = sym[p], sym[p + 1]
            if a >= 0 and b >= 0 and (m := merged(a, b)) >= 0:
                index.setdefault(m, []).append(p)
        # A merged token is made by several pairs; all share the rank, and are applied left to right.
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            m = heapq.heappop(queue)
            for p in sorted(index.pop(m)):
                a = sym[p]
                if a < 0:
                    continue
                q = nxt[p]
                if q >= n or sym[q] < 0 or merged(a, sym[q]) != m:
                    continue
                after = nxt[q]
                sym[p], sym[q] = m, -2
                nxt[p] = after
                if after < n:
                    prv[after] = p
                before = prv[p]
                if before >= 0 and sym[before] >= 0 and (k := merged(sym[before], m)) >= 0:
                    if k not in index:
                        index[k] = []
                        heapq.heappush(queue, k)
                    index[k].append(before)
                if after < n and sym[after] >= 0 and (k := merged(m, sym[after])) >= 0:
                    if k not in index:
                        index[k] = []
                        heapq.heappush(queue, k)
                    index[k].append(p)
        return [[s for s in sym[bounds[i] : bounds[i + 1]] if s >= 0] for i in range(len(words))]


#: A stretch without white space together with the one space before it, or white space. Word limits of
#: the public pattern never fall elsewhere than inside or at the ends of such a stretch.
SPACE = "\t-\r \u0085   -     　"
STRETCH = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class Encoder:
    def __init__(self, rank_path: str, pattern: str):
        import regex

        self.words = regex.compile(pattern)
        self.replay = MergeReplay(load_ranks(rank_path))
        self.known: dict[str, list[int]] = {}
        self.known_words: dict[str, list[int]] = {}
        self.size = 0

    def learn(self, stretches: set[str]) -> dict[str, list[int]]:
        """The ids of stretches not met before; those of usual length are remembered."""
        split = {s: self.words.findall(s) for s in stretches}
        new = list({w for ws in split.values() for w in ws if w not in self.known_words})
        once = dict(zip(new, self.replay.encode_words(new), strict=True))
        out = {s: [i for w in ws for i in (once[w] if w in once else self.known_words[w])] for s, ws in split.items()}
        for memory, found in ((self.known_words, once), (self.known, out)):
            for s, ids in found.items():
                if len(s) <= LONG_STRETCH:
                    memory[s] = ids
                    # An entry, its text and its list; small numbers are shared objects.
                    self.size += 200 + 2 * len(s) + 12 * len(ids)
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [STRETCH.findall(t) if t else [] for t in texts]
        if self.size > MEMORY_BYTES:
            self.known, self.known_words, self.size = {}, {}, 0
        known = self.known
        missing = {s for c in cut for s in c if s not in known}
        fresh = self.learn(missing) if missing else {}
        out = []
        for c in cut:
            ids: list[int] = []
            extend = ids.extend
            for s in c:
                extend(known[s] if s in known else fresh[s])
            out.append(ids)
        return out


@functools.lru_cache(maxsize=2)
def encoder_for(rank_path: str, pattern: str) -> Encoder:
    """One encoder per Python worker: what a task has learned serves the next one of that worker."""
    return Encoder(rank_path, pattern)


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", tokenizer_dir: str | None = None) -> DataFrame:
    """One row per input row: the id and ``ids``, the token ids of the text.

    ``tokenizer_dir`` is the folder of the rank files; by default that of the installed package.
    """
    import os

    import numpy as np
    import public_tokenizers as P

    path = os.path.join(tokenizer_dir or os.path.dirname(P.path("x")), f"{vocabulary}.tiktoken")
    pattern = P.PATTERN
    id_field = df.select(id_col).schema[0]
    schema = T.StructType([T.StructField(id_col, id_field.dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                ids = encoder.encode(batch.column(1).to_pylist())
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)
