"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

A long piece is read through a window. Text that follows can change the tokens before it only
through a chain of merges of rising rank, each taking in one more token on the left; the merge
list bounds how far such a chain reaches (:meth:`Merges.lookahead`). A token that ends that
far before the end of the window is final, so it is emitted and forgotten: the memory is a
window, whatever the length of the text. The decoder keeps the bytes of an unfinished
character and nothing else.
"""

from __future__ import annotations

import codecs
import heapq
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from predlens.llm.batches import in_small_batches

# Fixed value: the pattern by which byte-level tokenizers of this kind cut text into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _latin_pieces() -> re.Pattern:
    """The same cut for texts within Latin letters, with the classes written out: twice as fast."""
    latin = [chr(c) for c in range(LATIN)]
    letters, digits = (re.escape("".join(c for c in latin if unicodedata.category(c)[0] == kind)) for kind in "LN")
    space = re.escape("".join(c for c in latin if regex.match(r"\s", c)))
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


LATIN = 0x250
LATIN_PIECES = _latin_pieces()
BEYOND_LATIN = re.compile(f"[^\x00-{chr(LATIN - 1)}]")

LARGEST_FILE = 64 * 2**20  # a vocabulary file is broadcast; a larger one is refused
CACHED_PIECES = 400_000
SHORT = 32  # symbols up to which a plain scan for the best merge beats a heap
BITS = 32  # a merge's code is its rank, then these bits for the token it makes
TOKEN = 2**BITS - 1
NEVER = 2**62


def byte_of_character() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself, or the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in plain]
    return {chr(byte): byte for byte in plain} | {chr(256 + i): byte for i, byte in enumerate(others)}


class Merges:
    """Ranked merges over token ids."""

    def __init__(self, ranked: list[tuple[int, int, int]], sizes: dict[int, int]):
        """``ranked``: (left, right, merged) in rank order; ``sizes``: bytes of each token."""
        self.best = {(left, right): rank << BITS | merged for rank, (left, right, merged) in enumerate(ranked)}
        self.sizes = sizes
        self.reach = self.lookahead(ranked)
        self.step = max(256, max(sizes.values(), default=1))

    def lookahead(self, ranked: list[tuple[int, int, int]]) -> int:
        """Bytes by which later text can move the end of the settled tokens back.

        A merge (u, v) moves it over u. The next one of the chain, of a higher rank, needs a
        right part that starts with u, so ``reach[u]`` is the longest chain so far that ended
        by taking u in, and the left edges of v are all that has to be looked up.
        """
        first: dict[int, int] = {}
        reach: dict[int, int] = {}
        longest = 0
        known = {token for token, size in self.sizes.items() if size == 1}
        for left, right, merged in ranked:
            if left not in known or right not in known:
                raise ValueError("a merge uses a token that no earlier merge makes")
            known.add(merged)
            first.setdefault(merged, left)
            chain, edge = 0, right
            while edge is not None:
                chain = max(chain, reach.get(edge, 0))
                edge = first.get(edge)
            chain += self.sizes[left]
            reach[left] = max(reach.get(left, 0), chain)
            longest = max(longest, chain)
        return longest

    def merged(self, tokens: list[int]) -> list[int]:
        """Merge by lowest rank, the leftmost first, until nothing merges."""
        if len(tokens) > SHORT:
            return self._merged_by_heap(tokens)
        code = self.best.get
        codes = [code(pair, NEVER) for pair in zip(tokens, tokens[1:])]
        while codes and (lowest := min(codes)) != NEVER:
            i = codes.index(lowest)
            tokens[i : i + 2] = [lowest & TOKEN]
            del codes[i]
            if i:
                codes[i - 1] = code((tokens[i - 1], tokens[i]), NEVER)
            if i < len(codes):
                codes[i] = code((tokens[i], tokens[i + 1]), NEVER)
        return tokens

    def _merged_by_heap(self, tokens: list[int]) -> list[int]:
        best, n = self.best, len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(best[pair], i, pair) for i, pair in enumerate(zip(tokens, tokens[1:])) if pair in best]
        heapq.heapify(heap)
        while heap:
            code, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or tokens[i] != pair[0] or tokens[j] != pair[1]:
                continue
            tokens[i], tokens[j] = code & TOKEN, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (new := best.get((tokens[a], tokens[b]))):
                    heapq.heappush(heap, (new, a, (tokens[a], tokens[b])))
        return [token for token in tokens if token >= 0]

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """The tokens of a sequence of single-byte tokens, each as soon as it is settled."""
        window: list[int] = []
        full = self.reach + self.step
        for symbol in symbols:
            window.append(symbol)
            if len(window) == full:
                passed = 0
                for token in self.merged(window[:]):
                    if passed + self.sizes[token] > self.step:
                        break
                    passed += self.sizes[token]
                    yield token
                del window[:passed]
        yield from self.merged(window)


def _pack(tokens) -> bytes:
    return array("i", tokens).tobytes()


class Pieces(dict):
    """The packed ids of the pieces met so far; started anew when it is full."""

    def __init__(self, merges: Merges, byte: list[int]):
        super().__init__()
        self.merges, self.byte = merges, byte

    def __reduce__(self):
        return Pieces, (self.merges, self.byte)

    def __missing__(self, piece: str) -> bytes:
        symbols = [self.byte[b] for b in piece.encode()]
        if len(symbols) > SHORT:
            return _pack(self.merges.stream(symbols))
        if len(self) >= CACHED_PIECES:
            self.clear()
        self[piece] = found = _pack(self.merges.merged(symbols))
        return found


class Tokenizer:
    """Encoder and decoder of one vocabulary file (byte-level BPE in the tokenizers format)."""

    def __init__(self, spec: dict):
        model, cut = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("not a plain byte-level BPE file")
        character = byte_of_character()
        vocabulary = model["vocab"]
        self.text = {token: bytes(character[c] for c in written) for written, token in vocabulary.items() if all(c in character for c in written)}
        self.added = {entry["content"]: entry["id"] for entry in spec.get("added_tokens", [])}
        self.text |= {token: content.encode() for content, token in self.added.items()}
        sizes = {token: len(data) for token, data in self.text.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], sizes)
        self.byte = [vocabulary[c] for c, _ in sorted(character.items(), key=lambda pair: pair[1])]
        self.pieces = Pieces(self.merges, self.byte)

    @staticmethod
    def read(path: str) -> Tokenizer:
        if os.path.getsize(path) > LARGEST_FILE:
            raise ValueError(f"{path} is too large to be sent to every executor")
        with open(path, encoding="utf-8") as file:
            return Tokenizer(json.load(file))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; an added token's content counts as that token."""
        return np.frombuffer(self.packed(text), np.int32)

    def packed(self, text: str) -> bytes:
        if not any(content in text for content in self.added):
            return self._packed_plain(text)
        longest_first = sorted(self.added, key=len, reverse=True)
        parts = regex.split("(" + "|".join(map(regex.escape, longest_first)) + ")", text)
        return b"".join(_pack([self.added[part]]) if i % 2 else self._packed_plain(part) for i, part in enumerate(parts))

    def _packed_plain(self, text: str) -> bytes:
        cut = PIECES if BEYOND_LATIN.search(text) else LATIN_PIECES
        return b"".join(map(self.pieces.__getitem__, cut.findall(text)))

    def decode(self, ids: Iterable[int], step: int = 4096) -> str:
        machine = Decoder(self.text)
        ids = ids if isinstance(ids, list) else list(ids)
        return "".join(machine.feed(ids[i : i + step]) for i in range(0, len(ids), step)) + machine.finish()


class Decoder:
    """Ids to text, bit by bit; its state is the bytes of an unfinished character."""

    def __init__(self, text: dict[int, bytes]):
        self.text = text
        self.characters = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.characters.decode(b"".join(map(self.text.__getitem__, ids)))

    def finish(self) -> str:
        return self.characters.decode(b"", final=True)


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([field for field in df.schema.fields if field.name != name] + [T.StructField(name, kind)])


def encode_texts(df: DataFrame, path: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """``df`` with the ids of its texts, an array of int; a NULL text has none, like an empty one.

    A column of the name ``into`` is replaced. Rows are independent, so nothing is shuffled.
    """
    tokenizer = df.sparkSession.sparkContext.broadcast(Tokenizer.read(path))

    def encoded(batches):
        for batch in batches:
            ids = [tokenizer.value.packed(value or "") for value in batch.column(text).to_pylist()]
            offsets = np.cumsum([0] + [len(packed) // 4 for packed in ids], dtype=np.int32)
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield _replaced(batch, into, pa.ListArray.from_arrays(pa.array(offsets), flat))

    return in_small_batches(df).mapInArrow(encoded, _with(df, into, T.ArrayType(T.IntegerType())))


def decode_ids(df: DataFrame, path: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; NULL ids give an empty text.

    Bytes that are no UTF-8 become replacement characters. A column of the name ``into`` is replaced.
    """
    tokenizer = df.sparkSession.sparkContext.broadcast(Tokenizer.read(path))

    def decoded(batches):
        for batch in batches:
            lists = batch.column(ids)
            flat, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
            known = lists.is_valid().to_numpy(zero_copy_only=False)
            rows = (flat[a:b].tolist() if valid else [] for a, b, valid in zip(edges[:-1], edges[1:], known))
            yield _replaced(batch, into, pa.array(map(tokenizer.value.decode, rows), pa.string()))

    return in_small_batches(df).mapInArrow(decoded, _with(df, into, T.StringType()))


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [i for i, column in enumerate(batch.schema.names) if column != name]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [values], [batch.schema.names[i] for i in kept] + [name])
