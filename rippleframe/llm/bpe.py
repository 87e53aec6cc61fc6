"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

The merges of a rank file define, for every byte string, exactly one token sequence.  That sequence is the only one
whose adjacent pairs are all *compatible* (a pair (a, b) is compatible if merging the bytes of a + b gives back
[a, b]).  This local test makes the encoding a rational relation: a nondeterministic transducer reads bytes, guesses the
token being read (a node of the vocabulary's trie) and remembers the last token; a completed token must be compatible
with the one before.  We determinise it by subsets with residual outputs, lazily: a deterministic state is made when a
text first reaches it.  What all hypotheses of a state agree on is emitted at once, so the lookahead is bounded by the
longest token.  What is remembered (states, pieces, pairs) is bounded in bytes and forgotten beyond that; results do
not depend on it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._common import column, kept_columns, sub_batches, table

#: Bytes of text that are encoded before their rows are handed on.
EMIT_BYTES = 2_000_000
#: Bytes of states that a worker remembers; pieces get a quarter of it, twice.
MEMORY = 288 << 20

#: Characters for which ``re`` and ``regex`` agree on the pattern's classes: the Latin blocks without superscripts,
#: fractions and the information separators.
_UNSAFE = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+")


class PieceSplitter:
    """Matches of the public split pattern, in order; together they are the whole text."""

    def __init__(self, pattern: str):
        import public_tokenizers

        self._regex = regex.compile(pattern)
        self._fast = pattern == public_tokenizers.PATTERN

    def __call__(self, text: str) -> list[str]:
        if self._fast and not _UNSAFE.search(text):
            return _FAST.findall(text)
        return [m.group() for m in self._regex.finditer(text)]


class MergeTransducer:
    """Deterministic byte-to-token transducer for one rank table, built as texts need it."""

    def __init__(self, ranks: dict[bytes, int], max_bytes: int = MEMORY):
        self.ranks = ranks
        self.token_bytes = {i: b for b, i in ranks.items()}
        #: The trie: (node, byte) to child, both in one number; the token that ends at a node; whether it has children.
        self._child: dict[int, int] = {}
        self._token_at: list[int] = [-1]
        self._inner = bytearray(1)
        for raw, token in ranks.items():
            node = 0
            for c in raw:
                key = node << 8 | c
                child = self._child.get(key)
                if child is None:
                    child = self._child[key] = len(self._token_at)
                    self._token_at.append(-1)
                    self._inner.append(0)
                    self._inner[node] = 1
                node = child
            self._token_at[node] = token
        self._max_bytes = max_bytes
        self._compatible: dict[int, bool] = {}
        self._spines: dict[int, tuple[bool, list[int], list[int]]] = {}
        self._never = max(ranks.values()) + 1
        self._reset()

    def _reset(self) -> None:
        #: States by number: their hypotheses (residual output, last token, trie node), and the number of each such set.
        self._hypotheses: list[tuple] = []
        self._numbers: dict[tuple, int] = {}
        #: (state, byte) in one number to the next state, or to it and the tokens that are then certain.
        self._arcs: dict[int, int | tuple[int, tuple[int, ...]]] = {}
        self._bytes = 0
        self._start = self._state((((), -1, 0),))

    def _state(self, hypotheses: tuple) -> int:
        number = self._numbers.get(hypotheses)
        if number is None:
            number = self._numbers[hypotheses] = len(self._hypotheses)
            self._hypotheses.append(hypotheses)
            self._bytes += 190 + 150 * len(hypotheses)  # as CPython lays them out, rounded up
        return number

    def merge(self, raw: bytes) -> list[int]:
        """The defining procedure: join the adjacent pair of lowest rank, leftmost first, until none is left."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _derivation(self, token: int) -> tuple[bool, list[int], list[int]]:
        """Whether merging the token's bytes gives it back; the tokens that end and that begin it, shortest first."""
        known = self._spines.get(token)
        if known is None:
            raw = self.token_bytes[token]
            parts = [raw]
            if len(raw) > 1:
                parts = [raw[i : i + 1] for i in range(len(raw))]
                while len(parts) > 2:
                    rank, at = min((self.ranks.get(parts[i] + parts[i + 1], self._never), i) for i in range(len(parts) - 1))
                    if rank == self._never:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 1:
                known = (True, [token], [token])
            elif len(parts) > 2:
                known = (False, [], [])
            else:
                known = (True, [*self._derivation(self.ranks[parts[1]])[1], token], [*self._derivation(self.ranks[parts[0]])[2], token])
            self._spines[token] = known
        return known

    def _crosses(self, last: int, token: int) -> bool:
        """Whether merging both tokens' bytes joins parts across their border.

        The part on either side of the border grows along the token's derivation, in the order of ranks; the border is
        crossed when the two parts there form a token whose turn comes before the next growth of either.
        """
        left, right = self._derivation(last)[1], self._derivation(token)[2]
        i = j = 0
        while True:
            joined = self.ranks.get(self.token_bytes[left[i]] + self.token_bytes[right[j]], self._never)
            grow_left = left[i + 1] if i + 1 < len(left) else self._never
            grow_right = right[j + 1] if j + 1 < len(right) else self._never
            if joined < grow_left and joined <= grow_right and joined < self._never:
                return True
            if grow_left == grow_right == self._never:
                return False
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def _fits(self, last: int, token: int) -> bool:
        key = (last + 1) * self._never + token
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) > 300_000:
                self._compatible.clear()
            known = self._derivation(token)[0] and (last < 0 or not self._crosses(last, token))
            self._compatible[key] = known
        return known

    def step(self, state: int, byte: int) -> int | tuple[int, tuple[int, ...]]:
        """The arc of a state for a byte: the next state, and the tokens that are now certain if there are any."""
        found = []
        for residual, last, node in self._hypotheses[state]:
            child = self._child.get(node << 8 | byte)
            if child is None:
                continue
            token = self._token_at[child]
            if token >= 0 and self._fits(last, token):
                found.append(((*residual, token), token, 0))
            if self._inner[child]:
                found.append((residual, last, child))
        if not found:
            raise ValueError("the rank table has no token for a byte")
        shared = 0
        first = found[0][0]
        while all(len(r) > shared and r[shared] == first[shared] for r, _, _ in found):
            shared += 1
        target = tuple(sorted([(r[shared:], last, node) for r, last, node in found]))
        arc = self._arcs[state << 8 | byte] = (self._state(target), first[:shared]) if shared else self._state(target)
        self._bytes += 260 if shared else 150
        return arc

    def encode_piece(self, raw: bytes) -> list[int]:
        """Tokens of one piece; a piece that is itself a token stays whole."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        if self._bytes > self._max_bytes:
            self._reset()
        out: list[int] = []
        state, known = self._start, self._arcs.get
        for byte in raw:
            arc = known(state << 8 | byte)
            if arc is None:
                arc = self.step(state, byte)
            if arc.__class__ is int:
                state = arc
            else:
                state, emitted = arc
                out += emitted
        for residual, _, node in self._hypotheses[state]:
            if node == 0:
                return out + list(residual)
        raise ValueError("no token sequence ends here")


class Utf8Machine:
    """Incremental UTF-8 state machine: feed byte chunks, get the text of all characters that are complete."""

    def __init__(self):
        self._held = b""

    @staticmethod
    def _open_tail(data: bytes) -> int:
        """How many last bytes begin a character that is not complete yet (0 to 3)."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return back if back < need else 0
        return 0

    def feed(self, chunk: bytes) -> str:
        data = self._held + chunk
        cut = len(data) - self._open_tail(data)
        self._held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self._held = self._held, b""
        return rest.decode("utf-8", "replace")


class _PieceCache(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers.

    Two generations of at most ``bound`` bytes each: when the young one is full it becomes the old one, so what is still
    in use moves on and the rest goes.
    """

    def __init__(self, transducer: MergeTransducer, bound: int = MEMORY // 4):
        super().__init__()
        self._transducer, self._bound, self._bytes = transducer, bound, 0
        self._old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self._old.get(piece)
        if packed is None:
            packed = np.array(self._transducer.encode_piece(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= 64:
            if self._bytes >= self._bound:
                self._old, self._bytes = dict(self), 0
                self.clear()
            self._bytes += 220 + 2 * len(piece) + len(packed)
            self[piece] = packed
        return packed


class ByteBpe:
    """Encoder and decoder over one public rank file."""

    def __init__(self, rank_file: str, pattern: str, memory: int = MEMORY):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(raw): int(rank) for raw, rank in map(bytes.split, lines)}
        self.transducer = MergeTransducer(ranks, memory)
        self._split = PieceSplitter(pattern)
        self._cache = _PieceCache(self.transducer, memory // 4)
        size = max(ranks.values()) + 1
        table_ = [b""] * size
        for raw, rank in ranks.items():
            table_[rank] = raw
        self._length = np.array([len(x) for x in table_], np.int64)
        self._start = np.concatenate(([0], np.cumsum(self._length)))[:-1]
        self._pool = np.frombuffer(b"".join(table_), np.uint8)

    def encode_packed(self, text: str) -> bytes:
        get = self._cache.__getitem__
        return b"".join(map(get, self._split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_bytes(self, packed: bytes, chunk: int = 65_536) -> Iterator[bytes]:
        """Bytes of the packed ids, chunk by chunk."""
        ids = np.frombuffer(packed, "<u4")
        for at in range(0, len(ids), chunk):
            part = ids[at : at + chunk].astype(np.int64)
            length = self._length[part]
            ends = np.cumsum(length)
            index = np.arange(ends[-1]) + np.repeat(self._start[part] - (ends - length), length)
            yield self._pool[index].tobytes()

    def decode(self, ids) -> str:
        machine = Utf8Machine()
        return "".join(map(machine.feed, self.decode_bytes(np.asarray(ids, "<u4").tobytes()))) + machine.finish()


_LOADED: dict[tuple[str, str, int], ByteBpe] = {}


def codec(name_or_path: str, pattern: str | None = None, memory: int = MEMORY) -> ByteBpe:
    """The codec of a public rank file (its name, or any path), loaded once in each Python process."""
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    key = (name_or_path, pattern, memory)
    if key not in _LOADED:
        path = name_or_path if "/" in name_or_path else public_tokenizers.path(name_or_path)
        _LOADED[key] = ByteBpe(path, pattern, memory)
    return _LOADED[key]


def encode_documents(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests_only: bool = False, decode: bool | str = True, memory: int = MEMORY) -> DataFrame:
    """Columns ``keep`` of every row, then ``ids`` (array<int>) and, unless ``decode`` is false, ``decoded`` (string); where
    it is "digest", ``decoded_sha256`` stands for the decoded text, which then never leaves the worker.

    ``digests_only`` gives n_tokens, ids_sha256 and decoded_sha256 of the same ids and decoded bytes instead, so that
    the arrays never leave the worker.  A null or empty text has no ids; every other column may be null; repeated rows
    give repeated results; an empty table gives no row; a column of ``keep`` that has a result's name goes out with
    ``_input`` added.  Each row is worked on alone: no shuffle, and memory in proportion to one text beside ``memory``
    for what a worker remembers, on which results do not depend.
    """
    results = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} if digests_only else {"ids": pa.list_(pa.int32())} | ({"decoded_sha256" if decode == "digest" else "decoded": pa.string()} if decode else {})
    columns, names, schema = kept_columns(docs, keep, results)
    schema += "".join(f", {n} {'bigint' if k == pa.int64() else 'array<int>' if n == 'ids' else 'string'}" for n, k in results.items())

    def digests(bpe, packed):
        machine, sha = Utf8Machine(), hashlib.sha256()
        for chunk in bpe.decode_bytes(packed):
            sha.update(machine.feed(chunk).encode("utf-8"))
        sha.update(machine.finish().encode("utf-8"))
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), sha.hexdigest()

    def run(batches):
        bpe = codec(vocabulary, memory=memory)
        for batch in batches:
            for lo, hi in sub_batches(batch.column(len(names)), EMIT_BYTES):
                part = batch.slice(lo, hi - lo)
                packed = [bpe.encode_packed(t or "") for t in part.column(len(names)).to_pylist()]
                if digests_only:
                    made = list(zip(*(digests(bpe, p) for p in packed), strict=True))
                elif decode == "digest":
                    made = [[np.frombuffer(p, "<i4") for p in packed], [digests(bpe, p)[2] for p in packed]]
                else:
                    made = [[np.frombuffer(p, "<i4") for p in packed]] + ([[bpe.decode(np.frombuffer(p, "<u4")) for p in packed]] if decode else [])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *(pa.array(list(m), k) for m, k in zip(made, results.values(), strict=True))], names=[*names, *results])

    return docs.select(*columns, column(text)).mapInArrow(run, schema.removeprefix(", "))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of every document's encoding and of what decodes from it; null and empty texts have no token."""
    return encode_documents(table(spark, sf_dir, "documents"), digests_only=True)
