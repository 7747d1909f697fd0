"""Token ids of texts by a public byte-level BPE vocabulary, by an index of the occurrences of pairs.

Distinct pieces of the texts of a batch are laid out in one array of symbols. An index has all positions of every pair of neighbours that the vocabulary
merges; the lowest active rank is taken, applied at all its positions at once, and the lists of the pairs beside them are updated. A merge can only make pairs
of higher rank, since its product was learned before them, so every rank is taken once.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where the vocabulary lies unless the caller says otherwise, and the pattern that cuts text into pieces.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers; beyond, it forgets all and goes on.
REMEMBERED = 1_000_000
#: Characters of text that are encoded together.
SLICE_CHARS = 4_000_000

_loaded: dict[int, Encoder] = {}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: itself where it is printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Encoder:
    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        ids = model["vocab"]
        self.of_byte = [ids[c] for c in byte_letters()]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[ids[a], ids[b]] = k
            self.merged.append(ids[a + b])
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, pieces: list[str]) -> None:
        """Ids of pieces not seen before."""
        sym: list[int] = []
        starts: list[int] = []
        of_byte = self.of_byte
        for p in pieces:
            starts.append(len(sym))
            sym.extend([of_byte[b] for b in p.encode("utf-8", "surrogatepass")])
            sym.append(-1)  # ends a piece; no pair has it
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        rank_of, merged = self.rank.get, self.merged
        places: dict[int, list[int]] = {}
        for p in range(len(sym) - 1):
            r = rank_of((sym[p], sym[p + 1]))
            if r is not None:
                places.setdefault(r, []).append(p)
        pairs = {r: (sym[at[0]], sym[at[0] + 1]) for r, at in places.items()}
        heap = list(places)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            a, b = pairs[r]
            new = merged[r]
            for p in sorted(places.pop(r)):
                q = nxt[p]
                if sym[p] != a or q >= len(sym) or sym[q] != b:
                    continue  # an earlier merge took one of the two
                after, before = nxt[q], prv[p]
                sym[p], sym[q], nxt[p] = new, -2, after
                if after < len(sym):
                    prv[after] = p
                for left, x, y in ((before, sym[before] if before >= 0 else -1, new), (p, new, sym[after] if after < len(sym) else -1)):
                    s = rank_of((x, y))
                    if s is not None:
                        if s not in places:
                            places[s] = []
                            pairs[s] = (x, y)
                            heapq.heappush(heap, s)
                        places[s].append(left)
        for k, p in enumerate(pieces):
            at, out = starts[k], []
            while sym[at] != -1:
                out.append(sym[at])
                at = nxt[at]
            self.known[p] = tuple(out)

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = list({p for pieces in cut for p in pieces if p not in self.known})
        if fresh:
            self.learn(fresh)
        known = self.known
        return [[i for p in pieces for i in known[p]] for pieces in cut]


def encoder(vocabulary: bytes) -> Encoder:
    """One encoder for each vocabulary and worker."""
    key = hash(vocabulary)
    if key not in _loaded:
        _loaded[key] = Encoder(vocabulary)
    return _loaded[key]


def slices(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= SLICE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _vocabulary(df: DataFrame, path: str):
    """The file's bytes on every executor: some megabytes, a fixed size."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def token_ids(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>): ids of the whole text without special tokens; an empty list for an empty text and for null.

    Strings that look like special tokens are ordinary text. Other columns are ignored; a repeated key comes out as often as it comes in."""
    shared = _vocabulary(df, path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            at = 0
            for part in slices(b.column(1).to_pylist()):
                ids = enc.encode(part)
                sizes = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes[-1]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(flat))], ["key", "ids"])
                at += len(part)

    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, keep: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and n_tokens of each row; 0 for empty and null texts."""
    shared = _vocabulary(df, path)
    schema = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            if b.num_rows:
                n = [len(i) for part in slices(b.column(len(keep)).to_pylist()) for i in enc.encode(part)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], [*(f"k{i}" for i in range(len(keep))), "n_tokens"])

    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, f"{schema}, n_tokens bigint")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens")
