"""Byte-level BPE encoding with segment trees, and decoding.

Leaf ``i`` of a piece's tree holds rank and place of the pair that starts at symbol ``i``; every inner node holds the
smaller of its two, so the root is the leftmost pair of lowest rank. Merging it changes the pairs at most at three leaves,
each a path of logarithmic length to the root. It ends when the root has no pair. Pieces of like length are worked on
together, one tree per row of a matrix; long pieces have a tree of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.tokens import Encoded, TextEncoder, byte_letters

TOKENIZER = "byte_bpe_50k.json"
PLACE_BITS, NONE = 32, np.int64(2**62)
LONG = 256
#: Bytes of text that are encoded at once; the arrays of a batch take some forty times as much.
BATCH_BYTES = 1 << 18


class Bpe:
    """The tables of a byte-level BPE tokenizer file, and what can be done with them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.library = Tokenizer.from_file(path)
        vocabulary, letters = described["model"]["vocab"], byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([vocabulary[c] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in described["model"]["merges"]]
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order
        self.rank_of = {int(k): r for r, k in enumerate(keys)}
        self.special = {t["content"]: t["id"] for t in described.get("added_tokens", [])}
        known = {i: bytes(to_byte[c] for c in token) for token, i in vocabulary.items() if all(c in to_byte for c in token)}
        known |= {i: token.encode() for token, i in self.special.items()}
        self.token_bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, unit: str) -> list[bytes | int]:
        """What the merges stay within, and ids of special tokens."""
        found: list[bytes | int] = []
        for part in self.split_special.split(unit) if self.split_special else [unit]:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                found += [part[s:e].encode() for _, (s, e) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return found

    def encode_units(self, units: list[str]) -> Encoded:
        cut = [self.pieces(u) for u in units]
        known = list(dict.fromkeys(p for own in cut for p in own if isinstance(p, bytes)))
        ids, counts = self.encode_pieces(known)
        of = {p: own.tolist() for p, own in zip(known, np.split(ids, np.cumsum(counts)[:-1]))}
        of |= {i: [i] for i in self.special.values()}
        flat = [[i for p in own for i in of[p]] for own in cut]
        return np.array([i for own in flat for i in own], np.uint32), np.array(list(map(len, flat)), np.int64)

    def encode_words(self, words: list[str]) -> Encoded:
        return self.encode_pieces([w.encode() for w in words])

    def encode_pieces(self, pieces: list[bytes]) -> Encoded:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts, starts, made, used = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [], 0
        leaves = 2
        while leaves <= LONG:
            at = np.flatnonzero((sizes <= leaves) & (sizes > (leaves // 2 if leaves > 2 else 0)))
            step = max(1, (1 << 17) // leaves)
            for i in range(0, len(at), step):
                chosen = at[i : i + step]
                symbols, alive = self._merge_rows([pieces[j] for j in chosen], sizes[chosen], leaves)
                made.append(symbols[alive].astype(np.uint32))
                counts[chosen] = alive.sum(axis=1)
                starts[chosen] = used + np.cumsum(counts[chosen]) - counts[chosen]
                used += len(made[-1])
            leaves *= 2
        for j in np.flatnonzero(sizes > LONG):
            made.append(self._merge_one(pieces[j]))
            counts[j], starts[j] = len(made[-1]), used
            used += len(made[-1])
        if not made:
            return np.zeros(0, np.uint32), counts
        moved = starts - (np.cumsum(counts) - counts)
        return np.concatenate(made)[np.arange(used) + np.repeat(moved, counts)], counts

    def _ranks(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at] << PLACE_BITS | place, NONE)

    def _merge_rows(self, pieces: list[bytes], sizes: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each piece, and which of them are left after all merges."""
        rows, places = len(pieces), np.arange(leaves)
        alive = places < sizes[:, None]
        symbols = np.zeros((rows, leaves), np.int64)
        symbols[alive] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.where(places + 1 < sizes[:, None], places + 1, leaves)
        before = np.broadcast_to(places - 1, (rows, leaves)).copy()
        tree = np.full((rows, 2 * leaves), NONE)
        pair = np.nonzero(places + 1 < sizes[:, None])
        tree[pair[0], leaves + pair[1]] = self._ranks(symbols[pair], symbols[pair[0], pair[1] + 1], pair[1])
        node = leaves // 2
        while node:
            tree[:, node : 2 * node] = np.minimum(tree[:, 2 * node : 4 * node : 2], tree[:, 2 * node + 1 : 4 * node : 2])
            node //= 2

        def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaves + leaf
            tree[row, node] = value
            for _ in range(leaves.bit_length() - 1):
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        live = np.arange(rows)
        while True:
            root = tree[live, 1]
            live, root = live[root < NONE], root[root < NONE]
            if not len(live):
                return symbols, alive
            place, rank = root & ((1 << PLACE_BITS) - 1), root >> PLACE_BITS
            symbols[live, place] = self.merged[rank]
            gone = after[live, place]
            alive[live, gone] = False
            follower = after[live, gone]
            after[live, place] = follower
            has = follower < leaves
            before[live[has], follower[has]] = place[has]
            put(live, gone, np.full(len(live), NONE))
            fresh = np.full(len(live), NONE)
            fresh[has] = self._ranks(symbols[live[has], place[has]], symbols[live[has], follower[has]], place[has])
            put(live, place, fresh)
            leader = before[live, place]
            has = leader >= 0
            r, p, at = live[has], leader[has], place[has]
            put(r, p, self._ranks(symbols[r, p], symbols[r, at], p))

    def _merge_one(self, piece: bytes) -> np.ndarray:
        """The same for one long piece, without a matrix."""
        symbols = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        size, none = len(symbols), int(NONE)
        leaves = 1 << (size - 1).bit_length()
        after, before = [*range(1, size), -1], list(range(-1, size - 1))
        rank_of, merged = self.rank_of, self.merged.tolist()

        def entry(i: int, j: int) -> int:
            rank = rank_of.get(symbols[i] << 32 | symbols[j])
            return none if rank is None else rank << PLACE_BITS | i

        tree = [none] * leaves + [entry(i, i + 1) for i in range(size - 1)] + [none] * (leaves - size + 1)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = leaves + leaf
            tree[node] = value
            while node > 1:
                node >>= 1
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    return
                tree[node] = least

        while tree[1] < none:
            place, rank = tree[1] & ((1 << PLACE_BITS) - 1), tree[1] >> PLACE_BITS
            gone = after[place]
            symbols[place], symbols[gone] = merged[rank], -1
            after[place] = after[gone]
            if after[gone] >= 0:
                before[after[gone]] = place
            put(gone, none)
            put(place, entry(place, after[place]) if after[place] >= 0 else none)
            if before[place] >= 0:
                put(before[place], entry(before[place], place))
        return np.array([s for s in symbols if s >= 0], np.uint32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> tuple[Bpe, TextEncoder]:
    bpe = Bpe(path)
    return bpe, TextEncoder(bpe.encode_words, bpe.encode_units)


def default_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def encoded(docs: DataFrame, per_text: Callable[[Bpe, np.ndarray], dict], schema: str, path: str | None = None,
            text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and what ``per_text`` makes of each text's ids (unsigned 32-bit); null is encoded as empty."""
    path = path or default_path()
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    chosen = docs.select(*kept, F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Workers are used again, and may hold what an earlier stage read.
        pa.default_memory_pool().release_unused()
        bpe, encoder = load(path)
        for batch in small_batches(batches, len(keep)):
            ids, counts = encoder.batch(batch.column(len(keep)).to_pylist())
            made = [per_text(bpe, own) for own in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array([m[n] for m in made], t) for n, t in fields]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"k{i}" for i in range(len(keep))), *(n for n, _ in fields)])

    from pyspark.sql.pandas.types import to_arrow_schema

    made_schema = docs.sparkSession.createDataFrame([], schema).schema
    fields = [(f.name, f.type) for f in to_arrow_schema(made_schema)]
    full = ", ".join([*(f"k{i} {chosen.schema[i].dataType.simpleString()}" for i in range(len(keep))), schema])
    found = chosen.mapInArrow(run, full)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[n for n, _ in fields])


def small_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """All rows in batches of about ``BATCH_BYTES`` of text, one row at least."""
    for whole in batches:
        yield from by_bytes(whole, column, BATCH_BYTES)


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``most`` bytes, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _digests(bpe: Bpe, ids: np.ndarray) -> dict:
    text = bpe.decode(ids.tolist())
    return {
        "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
        "decoded_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Number of ids, digest of the ids, digest of the text decoded from them, one row per row."""
    return encoded(docs, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", path, text, keep)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and the ids of the whole text as ``array<int>``."""
    return encoded(docs, lambda bpe, ids: {"n_tokens": len(ids), "ids": ids.astype(np.int32)}, "n_tokens long, ids array<int>", path, text, keep)


def encode_and_decode(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What ``encode`` and ``round_trip`` return, in one pass."""
    schema = "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"
    return encoded(docs, lambda bpe, ids: _digests(bpe, ids) | {"ids": ids.astype(np.int32)}, schema, path, text, keep)


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``text``; null ids give null."""
    path = path or default_path()
    chosen = rows.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{ids}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = load(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(len(keep)).to_pylist()]
            columns = [*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"k{i}" for i in range(len(keep))), "text"])

    full = ", ".join([*(f"k{i} {chosen.schema[i].dataType.simpleString()}" for i in range(len(keep))), "text string"])
    found = chosen.mapInArrow(run, full)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")
