"""BPE encoding by longest matches with backtracking, decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives longest token matches.
A sequence of tokens is the one that the merges make if, and only if, each two
neighbours are compatible: merging their joined text would stop at these two.
So the encoder takes longest matches, checks each new pair against the
compatibility table, takes shorter tokens where it fails and steps back where
none is left.  Positions proved dead are never tried again, which bounds the
work by the text's length.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .shared import prepare

#: Entries that a worker keeps of its word cache and of its pair table.
CACHE = 600_000

WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts of these characters only are their own NFC form and have the same
#: classes in every Unicode version.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-įı-ſ]*")

SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """Encoder and decoder of one word-end BPE vocabulary file.

    A word is held as one character a byte; the last byte's character is
    moved up by 256, as the word end belongs to it.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        alphabet = _byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.units: dict[str, int] = {}
        self.text: dict[int, str] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            last = token.endswith(self.end) and token != self.end
            body = "".join(chr(alphabet[c]) for c in (token[: -len(self.end)] if last else token))
            body = body[:-1] + chr(ord(body[-1]) + 256) if last else body
            self.units[body], self.text[i] = i, body
            self.automaton.add_word(body, i)
        self.automaton.make_automaton()
        for a, b in model["merges"]:
            i = vocab[a + b]
            self.pairs[vocab[a], vocab[b]] = i
            self.split.setdefault(i, (vocab[a], vocab[b]))
        for i in self.text:
            self.split.setdefault(i, (i, i))
        self.length = {i: len(t) for i, t in self.text.items()}
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        # Decoding: token i is blob[start[i]:start[i] + size[i]].
        by_id = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        parts = [by_id.get(i, "").encode() + b" " for i in range(max(by_id) + 1)]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(p) for p in parts], np.int32)
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges keep ``left`` and ``right`` apart (the pair-compatibility table)."""
        key = left << 20 | right
        if (known := self.fits.get(key)) is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            known = self.fits[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        # Undo merges at the seam, the latest first; a merge across it that
        # comes before those still undone would have been made.
        bound = float("inf")
        while True:
            across = self.pairs.get((left, right))
            if across is not None and across < bound:
                return False
            split_left, split_right = self.split[left], self.split[right]
            left_whole, right_whole = split_left[0] == left, split_right[0] == right
            if left_whole and right_whole:
                return True
            if right_whole or (left > right and not left_whole):
                bound, left = left, split_left[1]
            else:
                bound, right = right + 1, split_right[0]

    def encode_units(self, word: str) -> list[int]:
        length, fits, apart = self.length, self.fits, self.compatible
        # Token matches by start, shorter ones first.
        starts: list[list[int]] = [[] for _ in word]
        for end, token in self.automaton.iter(word):
            starts[end + 1 - length[token]].append(token)
        tokens: list[int] = []
        at, last, dead = 0, -1, set()
        while at < len(word):
            found = starts[at]
            while found:
                token = found[-1]
                if at + length[token] not in dead:
                    if last < 0:
                        break
                    fit = fits.get(last << 20 | token)
                    if apart(last, token) if fit is None else fit:
                        break
                found.pop()
            if found:
                tokens.append(token)
                at, last = at + length[token], token
            elif tokens:
                dead.add(at)
                at -= length[tokens.pop()]
                starts[at].pop()
                last = tokens[-1] if tokens else -1
            else:
                raise ValueError(f"no tokens cover {word!r}")
        return tokens

    def _word(self, word: str) -> bytes:
        raw = word.encode().decode("latin-1")
        tokens = self.encode_units(raw[:-1] + chr(ord(raw[-1]) + 256))
        return struct.pack(f"<{len(tokens)}I", *tokens)

    def _pieces(self, text: str) -> list[str]:
        alphabet = _byte_alphabet()
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(alphabet[c] for c in p).decode("utf-8") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _learn(self, chunks: set[str], whole: bool) -> None:
        cache = self.cache
        if len(cache) >= CACHE:
            cache.clear()
        for chunk in chunks:
            if chunk not in cache:
                pieces = [chunk] if whole else WORDS.findall(chunk)
                if pieces == [chunk]:
                    cache[chunk] = self._word(chunk)
                else:
                    cache[chunk] = b"".join(cache.get(p) or self._word(p) for p in pieces)

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit little-endian."""
        parts = []
        for segment in self.cut.split(text) if self.cut else [text]:
            if segment in self.special:
                parts.append(np.array([self.special[segment]], "<u4").tobytes())
                continue
            # Pieces of plain text don't span white space, so its words are encoded
            # one by one; elsewhere the vocabulary's own splitter decides.
            plain = PLAIN.fullmatch(segment) is not None
            chunks = segment.lower().split() if plain else self._pieces(segment)
            try:
                parts.append(b"".join(map(self.cache.__getitem__, chunks)))
            except KeyError:
                self._learn(set(chunks), not plain)
                parts.append(b"".join(map(self.cache.__getitem__, chunks)))
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts with single spaces between, as UTF-8."""
        parts = []
        for lo in range(0, len(ids), 1 << 14):
            some = ids[lo : lo + (1 << 14)]
            size = self.size[some]
            ends = np.cumsum(size, dtype=np.int32)
            parts.append(self.blob[np.repeat(self.start[some] - ends + size, size) + np.arange(ends[-1], dtype=np.int32)].tobytes())
        return b"".join(parts)[:-1]


@functools.lru_cache(2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """One row a document: ``doc_id``, ``n_tokens``, digests of the ids and of the decoded text.

    ``with_ids`` adds ``ids array<int>`` and ``decoded string``.  A null or
    empty text has no tokens and decodes to the empty text.  Repeated rows
    and null ids stay; other columns are ignored.  Needs no shuffle.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in batches:
            counts, id_hashes, text_hashes, all_ids, texts = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text or "")
                decoded = bpe.decode(ids)
                counts.append(len(ids))
                id_hashes.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_hashes.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
                    texts.append(decoded.decode("utf-8"))
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(id_hashes, pa.string()), "decoded_sha256": pa.array(text_hashes, pa.string())}
            if with_ids:
                out |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    more = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}{more}")
