"""BPE encoding and decoding with a vocabulary file of word pieces, without the library that the file is made for.

A text is cut at special tokens, normalised (NFC, white space to spaces, lower case by character) and split into words. A word's
bytes become letters, its last letter carries the word end, and pairs of neighbours are merged: a priority queue holds
(rank, place) of every pair that has a merge, a doubly linked list holds the symbols, and what the queue gives up is skipped
if the symbols at its place no longer merge to the same one. Decoding joins the vocabulary's strings.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.llm.common import table

VOCABULARY = "word_bpe_49k.json"
#: How vocabularies of this kind split a normalised text; white space is what Unicode calls so.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: str.split() also cuts at these, which aren't white space in Unicode.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Chunks between white space, and words, that a worker remembers in the newer half of its memory; their length at most. Of what is
#: remembered, the older half goes when the newer one is full.
REMEMBERED, LONGEST = 250_000, 64
#: Rows and characters that are encoded or decoded at once.
ROWS, CHARACTERS = 256, 4_000_000


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> list[str]:
    """The letter for each byte: itself if it is printable Latin, else the next one from U+0100."""
    printable = [0x21 <= x <= 0x7E or 0xA1 <= x <= 0xAC or 0xAE <= x <= 0xFF for x in range(256)]
    return [chr(x if printable[x] else 256 + printable[:x].count(False)) for x in range(256)]


class Bpe:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or model.get("dropout") or model.get("ignore_merges") or spec["decoder"]:
            raise ValueError(f"{file} isn't a vocabulary of lower-case word pieces")
        self.file, self.library = file, None
        self.vocab, self.end, letters = model["vocab"], model["end_of_word_suffix"] or "", byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left, self.right, self.made = ([self.vocab[t] for t in x] for x in zip(*((a, b, a + b) for a, b in pairs), strict=True))
        if len(set(self.made)) < len(self.made):
            raise ValueError(f"{file} has two merges that make one symbol")
        self.ranks = {pair: rank for rank, pair in enumerate(zip(self.left, self.right, strict=True))}
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        self.letters = {ord(c): x for x, c in enumerate(letters)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: t for t, i in chain(self.vocab.items(), self.special.items())}
        longest = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(longest)})") if longest else None
        self.known_words: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.known_chunks: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.known: set[str] = set(map(chr, range(0x250)))

    def merged(self, ids: list[int]) -> list[int]:
        """`ids` after all merges, the lowest rank first and the leftmost of equal ones."""
        n, get = len(ids), self.ranks.get
        queue = [rank << 32 | i for i, pair in enumerate(pairwise(ids)) if (rank := get(pair)) is not None]
        if not queue:
            return ids
        left, right, made = self.left, self.right, self.made
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapify(queue)
        while queue:
            e = heappop(queue)
            i, rank = e & 0xFFFFFFFF, e >> 32
            j = after[i]
            # stale: the symbol is gone or the last one, or other symbols stand there now
            if ids[i] != left[rank] or j == n or ids[j] != right[rank]:
                continue
            ids[i], ids[j] = new, _ = made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := get((new, ids[k]))) is not None:
                    heappush(queue, rank << 32 | i)
            if (k := before[i]) >= 0 and (rank := get((ids[k], new))) is not None:
                heappush(queue, rank << 32 | k)
        return [x for x in ids if x >= 0]

    def word(self, w: str) -> bytes:
        new, old = self.known_words
        got = new.get(w) or old.get(w)
        if got is None:
            raw = w.encode()
            ids = [self.inner[x] for x in raw]
            ids[-1] = self.last[raw[-1]]
            got = array("I", self.merged(ids)).tobytes()
        if len(w) <= LONGEST:
            new[w] = got
        return got

    def chunk(self, c: str) -> bytes:
        """Ids of what stands between white space."""
        if c.isalpha():
            return self.word(c)
        if c[:-1].isalpha() and c[-1] in ".,":
            return self.word(c[:-1]) + self.word(c[-1])
        return b"".join(map(self.word, WORD.findall(c)))

    def chunks_of(self, text: str) -> list[str] | None:
        """What stands between white space, normalised; None of a text with characters that this Python's Unicode tables lack."""
        if strange := set(text) - self.known:
            new = {c for c in strange if unicodedata.category(c) != "Cn"}
            self.known |= new
            if strange - new:
                return None
        if not text.isascii():
            # by character: the lower case of a whole text would end words with another sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [c for c in SPACE.split(text) if c] if SEPARATORS.search(text) else text.split()

    def newer(self, text: str) -> bytes:
        """Ids of a text that only the tables of the file's library can normalise and split into words."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.file)
        text = self.library.normalizer.normalize_str(text)
        words = [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return b"".join(map(self.word, words))

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        found = self.chunks_of(text)
        if found is None:
            return self.newer(text)
        if len(self.known_words[0]) > REMEMBERED:
            self.known_words = ({}, self.known_words[0])
        if len(self.known_chunks[0]) > REMEMBERED:
            self.known_chunks = ({}, self.known_chunks[0])
        new, old = self.known_chunks
        long = {}
        for c in {c for c in found if c not in new}:
            (new if len(c) <= LONGEST else long)[c] = old.get(c) or self.chunk(c)
        if long:
            return b"".join(long.get(c) or new[c] for c in found)
        return b"".join(map(new.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        special = lambda t: array("I", [self.special[t]]).tobytes()
        return b"".join(special(t) if i % 2 else self.plain(t) for i, t in enumerate(self.cut.split(text)))

    def tokens(self, ids: bytes) -> list[str]:
        """Vocabulary strings; numbers that no string has are passed over."""
        return [t for t in map(self.strings.get, array("I", ids)) if t is not None]

    def decode(self, ids: bytes) -> str:
        return " ".join(self.tokens(ids))

    def words(self, ids: bytes) -> str:
        """Readable text: word ends become spaces, letters the bytes that they stand for."""
        special, end = self.special, self.end
        text = "".join(f"{t}{end}" if t in special else t for t in self.tokens(ids))
        raw = bytearray()
        for w in text.split(end) if end else [text]:
            raw += (w.encode() if w in special else bytes(self.letters[ord(c)] for c in w)) + b" "
        return raw.decode(errors="replace").rstrip(" ")


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows and bytes; a longer text is a part of its own."""
    for b in batches:
        size, at = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist(), 0
        while at < b.num_rows:
            n, total = 1, size[at]
            while at + n < b.num_rows and n < ROWS and total + size[at + n] <= CHARACTERS:
                total += size[at + n]
                n += 1
            yield b.slice(at, n)
            at += n


def encode(docs: DataFrame, file: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens and ids, packed as little-endian unsigned 32-bit numbers.

    Null and empty texts, and those of white space, have no ids. Strings of special tokens in a text are those tokens. A text of any
    length is encoded whole, in time n log n for a word of n bytes. Repeated rows stay; equal texts have equal ids. Other
    columns are ignored, and a doc_id may be null; an empty table gives no rows.
    """
    file = file or vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(file)
        for b in pieces(batches, 1):
            ids = [bpe.encode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, file: str | None = None, readable: bool = False) -> DataFrame:
    """`encoded` (doc_id, n_tokens, ids) with `decoded`: the vocabulary's strings, special tokens included, with spaces between;
    or, if `readable`, words as they were written, in lower case and with one space between. Null ids decode as none."""
    file = file or vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(file)
        turn = bpe.words if readable else bpe.decode
        for b in pieces(batches, 2):
            yield b.append_column("decoded", pa.array([turn(x or b"") for x in b.column(2).to_pylist()], pa.string()))

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(table(spark, sf_dir, "documents")))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
