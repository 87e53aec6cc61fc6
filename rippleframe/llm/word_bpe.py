"""BPE with word ends by a prefix-sharing trie of the distinct words, and decoding.

A word's encoding is the only token sequence whose adjacent pairs are all *compatible* (merging the symbols of a + b
gives back [a, b]) and whose tokens merging gives back.  So every prefix of a word has one last token, and the encoding
of what precedes that token is the encoding of a shorter prefix.  The distinct words of a batch go into a trie in sorted
order, which visits it depth first: each node gets its prefix's last token from those of its ancestors, once, however
many words share the prefix.  A word's last symbol carries the end of the word, so it is an edge of its own alphabet.
Encodings are read off the path backwards, from last token to last token.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import column, kept_columns, sub_batches, table

#: Bytes of text whose words are encoded together.
EMIT_BYTES = 2_000_000
#: Bytes of trie nodes and encoded words that a worker remembers; both are forgotten beyond it.
MEMORY = 128 << 20
#: Words of more bytes are encoded without a place in the trie.
LONG_WORD = 128
END = "</w>"

#: Characters on whose classes, lower case and normal form ``re`` and the vocabulary's library agree: the Latin blocks
#: without superscripts, fractions, the information separators and the dotted capital I.
_UNSAFE = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ÿĀ-įı-ɏ]")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:_|[^\s\w])+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes stand for themselves, the others follow U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class MergeTable:
    """Tokens of one merge list, and which of them may stand side by side."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        self.ids = vocabulary
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        #: Token of a byte string inside a word, and at a word's end.
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        size = max(vocabulary.values()) + 1
        self.length = [0] * size
        self._parts: list[tuple[int, int] | None] = [None] * size
        self._rank = [-1] * size
        self._joined: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if self._parts[whole] or self._rank[a] >= rank or self._rank[b] >= rank:
                raise ValueError("a token of the merge list comes from two merges, or before its parts")
            self._parts[whole], self._rank[whole], self._joined[a, b] = (a, b), rank, rank
        made = set()
        for text, token in vocabulary.items():
            ends = text.endswith(END)
            letters = text.removesuffix(END)
            if self._parts[token] is None and len(letters) != 1:
                continue  # neither a symbol nor made by a merge: never the encoding of anything
            raw = bytes(byte_of[c] for c in letters)
            (self.final if ends else self.inner)[raw] = token
            self.length[token] = len(raw)
            made.add(token)
        if any(b not in self.inner or b not in self.final for b in (bytes([i]) for i in range(256))):
            raise ValueError("the vocabulary lacks the symbol of a byte")
        self.longest = max(self.length)
        self._never = len(merges)
        self._ends: dict[int, list[int]] = {}
        self._begins: dict[int, list[int]] = {}
        self._sound: dict[int, bool] = {}
        self._fits: dict[int, bool] = {}

    def _chain(self, token: int, side: int, known: dict[int, list[int]]) -> list[int]:
        """The tokens that end (side 1) or begin (side 0) a token while it is merged, shortest first."""
        chain = known.get(token)
        if chain is None:
            parts = self._parts[token]
            chain = known[token] = [token] if parts is None else [*self._chain(parts[side], side, known), token]
        return chain

    def _crossing(self, a: int, b: int) -> tuple[int, int, int] | None:
        """The first merge across the border of a and b: its rank and the two tokens there, None if there is none.

        The tokens at the border grow in the order of ranks; of equal ranks the leftmost goes first.
        """
        left, right = self._chain(a, 1, self._ends), self._chain(b, 0, self._begins)
        i = j = 0
        while True:
            rank = self._joined.get((left[i], right[j]), self._never)
            grow_left = self._rank[left[i + 1]] if i + 1 < len(left) else self._never
            grow_right = self._rank[right[j + 1]] if j + 1 < len(right) else self._never
            if rank < grow_left and rank <= grow_right and rank < self._never:
                return rank, left[i], right[j]
            if grow_left == grow_right == self._never:
                return None
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def sound(self, token: int) -> bool:
        """Whether merging the token's symbols gives the token."""
        known = self._sound.get(token)
        if known is None:
            parts = self._parts[token]
            known = parts is None or (self.sound(parts[0]) and self.sound(parts[1]) and self._crossing(*parts) == (self._rank[token], *parts))
            self._sound[token] = known
        return known

    def fits(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow ``last`` (-1: the word's beginning)."""
        key = (last + 1) * len(self.length) + token
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 300_000:
                self._fits.clear()
            known = self._fits[key] = self.sound(token) and (last < 0 or self._crossing(last, token) is None)
        return known

    def last_token(self, raw: bytes, end: int, lasts, final: bool) -> int:
        """Last token of the encoding of raw[:end], from those of its prefixes (``lasts[d]`` for raw[:d])."""
        known = self.final if final else self.inner
        for start in range(max(0, end - self.longest), end):
            token = known.get(raw[start:end])
            if token is not None and self.fits(lasts[start], token):
                return token
        raise ValueError("the merge list has no encoding for a word")

    def merge(self, raw: bytes) -> list[int]:
        """The defining procedure: join the adjacent pair of lowest rank, leftmost first, until none is left."""
        parts = [self.inner[raw[i : i + 1]] for i in range(len(raw) - 1)] + [self.final[raw[-1:]]]
        whole = {pair: token for token, pair in enumerate(self._parts) if pair}
        while len(parts) > 1:
            rank, at = min((self._joined.get((parts[i], parts[i + 1]), self._never), i) for i in range(len(parts) - 1))
            if rank == self._never:
                break
            parts[at : at + 2] = [whole[parts[at], parts[at + 1]]]
        return parts


class PrefixTrie:
    """Nodes of word prefixes with their last tokens, made as words need them."""

    def __init__(self, merges: MergeTable):
        self._merges = merges
        self.clear()

    def clear(self) -> None:
        #: (node, symbol) to child in one number; a symbol is a byte, or 256 + the byte that ends a word.
        self._child: dict[int, int] = {}
        self._last = array("i", [-1])

    @property
    def n_bytes(self) -> int:
        return 150 * len(self._last)  # as CPython lays out an entry of the dictionary, rounded up

    def encode_sorted(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of distinct words in ascending order: one depth-first visit of their part of the trie."""
        merges, child, last, length = self._merges, self._child, self._last, self._merges.length
        nodes, lasts, before, out = [0], array("i", [-1]), b"", []
        for raw in words:
            # of the word before, what is shared and not its end stays on the path
            shared, most = 0, min(len(raw), len(before)) - 1
            while shared < most and raw[shared] == before[shared]:
                shared += 1
            del nodes[shared + 1 :], lasts[shared + 1 :]
            for d in range(shared, len(raw)):
                final = d + 1 == len(raw)
                key = nodes[d] << 9 | (raw[d] | final << 8)
                node = child.get(key)
                if node is None:
                    node = child[key] = len(last)
                    last.append(merges.last_token(raw, d + 1, lasts, final))
                nodes.append(node)
                lasts.append(last[node])
            out.append(self._read(lasts, len(raw), length))
            before = raw
        return out

    @staticmethod
    def _read(lasts, end: int, length: list[int]) -> list[int]:
        tokens = []
        while end:
            tokens.append(lasts[end])
            end -= length[lasts[end]]
        return tokens[::-1]

    def encode_alone(self, raw: bytes) -> list[int]:
        """The same propagation along one path that is not kept."""
        lasts = array("i", [-1])
        for d in range(1, len(raw) + 1):
            lasts.append(self._merges.last_token(raw, d, lasts, d == len(raw)))
        return self._read(lasts, len(raw), self._merges.length)


class WordBpe:
    """Encoder and decoder over one public vocabulary file with word ends."""

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        split = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["end_of_word_suffix"] != END or split != [_SPLIT] or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError("the vocabulary file describes another kind of tokenizer")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be plain strings of the raw text")
        self.merges = MergeTable(model["vocab"], model["merges"])
        self.trie = PrefixTrie(self.merges)
        self._added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added_at = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if self._added else None
        self._library = Tokenizer.from_file(path)
        self._memory, self._held = memory, 0
        #: Word to its ids as little-endian unsigned 32-bit integers.
        self._known: dict[str, bytes] = {}
        names = model["vocab"] | self._added
        self._name = [""] * (max(names.values()) + 1)
        for name, token in names.items():
            self._name[token] = name
        self._decimal = [str(i) for i in range(len(self._name))]

    def words(self, text: str) -> list[str]:
        """Words of a text without added tokens, after normalisation."""
        if not _UNSAFE.search(text):
            return _FAST.findall(text.lower())
        # the library's own tables of characters: Python's are of another Unicode version
        normal = self._library.normalizer.normalize_str(text)
        if not _UNSAFE.search(normal):
            return _FAST.findall(normal)
        bytes_of = _letters_to_bytes()
        return [bytes(map(bytes_of.__getitem__, w)).decode("utf-8") for w, _ in self._library.pre_tokenizer.pre_tokenize_str(normal)]

    def _pieces(self, text: str) -> list:
        """Words (str) and added tokens' ids (int) of a text, in order."""
        if self._added_at is None or not self._added_at.search(text):
            return self.words(text)
        out: list = []
        for part in self._added_at.split(text):
            token = self._added.get(part)
            out.extend(self.words(part) if token is None else [token])
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text; the distinct words that are not known yet are encoded together."""
        if self._held + self.trie.n_bytes > self._memory:
            self._known.clear()
            self.trie.clear()
            self._held = 0
        pieces = [self._pieces(t) for t in texts]
        known = self._known
        new = {w for p in pieces for w in p if w.__class__ is str and w not in known}
        by_bytes = {w.encode("utf-8"): w for w in new}
        short = sorted(raw for raw in by_bytes if len(raw) <= LONG_WORD)
        once: dict = {i: np.array([i], "<u4").tobytes() for i in self._added.values()}
        for raw, ids in zip(short, self.trie.encode_sorted(short), strict=True):
            packed = known[by_bytes[raw]] = np.array(ids, "<u4").tobytes()
            self._held += 230 + 2 * len(raw) + len(packed)
        for raw, word in by_bytes.items():
            if len(raw) > LONG_WORD:
                once[word] = np.array(self.trie.encode_alone(raw), "<u4").tobytes()
        plain = known.__getitem__
        return [b"".join(map(plain, p)) if all(map(known.__contains__, p)) else b"".join(known.get(w) or once[w] for w in p) for p in pieces]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode(self, ids) -> str:
        """The tokens' names, word ends included, with a space between them: the file names no decoder."""
        return " ".join(map(self._name.__getitem__, ids))

    def decimal(self, ids) -> str:
        return " ".join(map(self._decimal.__getitem__, ids))


_BYTES: dict[str, int] = {}
_LOADED: dict[tuple[str, int], WordBpe] = {}


def _letters_to_bytes() -> dict[str, int]:
    if not _BYTES:
        _BYTES.update({c: b for b, c in enumerate(byte_letters())})
    return _BYTES


def codec(name_or_path: str, memory: int = MEMORY) -> WordBpe:
    """The codec of a public vocabulary file (its name, or any path), loaded once in each Python process."""
    import public_tokenizers

    key = (name_or_path, memory)
    if key not in _LOADED:
        _LOADED[key] = WordBpe(name_or_path if "/" in name_or_path else public_tokenizers.path(name_or_path), memory)
    return _LOADED[key]


def encode_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests_only: bool = False, memory: int = MEMORY) -> DataFrame:
    """Columns ``keep`` of every row, then ``ids`` (array<int>) and ``decoded`` (string).

    ``digests_only`` gives n_tokens, ids_sha256 (of the decimal ids with a space between them) and decoded_sha256 of the
    same ids and decoded text instead.  A null, empty or blank text has no ids and decodes to an empty text; every other
    column may be null; repeated rows give repeated results; an empty table gives no row; a column of ``keep`` that has
    a result's name goes out with ``_input`` added.  Strings of added tokens inside a text are those tokens.  Each row
    is worked on alone, without a shuffle, in memory in proportion to one text beside ``memory`` for what a worker
    remembers, on which results do not depend; a word of any length is encoded whole.
    """
    results = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} if digests_only else {"ids": pa.list_(pa.int32()), "decoded": pa.string()}
    columns, names, schema = kept_columns(docs, keep, results)
    schema += "".join(f", {n} {'bigint' if k == pa.int64() else 'array<int>' if n == 'ids' else 'string'}" for n, k in results.items())

    def run(batches):
        bpe = codec(vocabulary, memory)
        for batch in batches:
            for lo, hi in sub_batches(batch.column(len(names)), EMIT_BYTES):
                part = batch.slice(lo, hi - lo)
                made = []
                for packed in bpe.encode_batch([t or "" for t in part.column(len(names)).to_pylist()]):
                    ids = np.frombuffer(packed, "<u4")
                    listed = ids.tolist()
                    if digests_only:
                        made.append((len(listed), hashlib.sha256(bpe.decimal(listed).encode()).hexdigest(), hashlib.sha256(bpe.decode(listed).encode("utf-8")).hexdigest()))
                    else:
                        made.append((ids.astype(np.int32), bpe.decode(listed)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *(pa.array(list(m), k) for m, k in zip(zip(*made, strict=True), results.values(), strict=True))], names=[*names, *results])

    return docs.select(*columns, column(text)).mapInArrow(run, schema.removeprefix(", "))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of every document's encoding and of what decodes from it; null and empty texts have no token."""
    return encode_documents(table(spark, sf_dir, "documents"), digests_only=True)
