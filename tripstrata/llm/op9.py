"""Packing: shortest pack first over the length histogram, then patterns joined back to pieces by rank.

Documents are tokenised and cut into full sequences and a rest. The histogram of piece lengths (one row per length, so at
most `width` rows) goes to the driver, which places lengths longest first into the pack with the most room and updates
pattern counts; pieces that fit nowhere open packs that hold as many of their length as there is room for. A piece finds its pattern by its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripstrata.llm.common import Scratch, table

WIDTH = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Distinct words whose ids a worker remembers in each half of its memory.
REMEMBERED = 250_000
#: Latin letters and numbers up to U+024F, as the tokenizer's own pattern has them.
LETTERS, NUMBERS = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾"
#: Texts of these characters only are cut into words here; all others go to the tokenizer as a whole.
PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in the vocabulary: itself if it is printable Latin, else the next one from U+0100."""
    out, spare = {}, 256
    for x in range(256):
        plain = 0x21 <= x <= 0x7E or 0xA1 <= x <= 0xFF and x != 0xAD
        out[x] = x if plain else spare
        spare += not plain
    return out


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers.

    The tokenizer's words never hold white space, so what stands between white space is cut into words, and each word goes to
    the tokenizer's model once and is remembered. Of what is remembered, the older half goes when the newer half is full;
    what is used moves to the newer half.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.tokens: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.words: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def word(self, w: str) -> bytes:
        new, old = self.words
        got = new.get(w) or old.get(w)
        if got is None:
            raw = w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
            got = array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()
        new[w] = got
        return got

    def token(self, t: str) -> bytes:
        if t.isalpha():
            return self.word(t)
        if t[:-1].isalpha() and t[-1] in ".,":
            return self.word(t[:-1]) + self.word(t[-1])
        return b"".join(map(self.word, WORD.findall(t)))

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.tokens[0]) > REMEMBERED:
            self.tokens = ({}, self.tokens[0])
        if len(self.words[0]) > REMEMBERED:
            self.words = ({}, self.words[0])
        new, old = self.tokens
        todo = [x.lower().split() if PLAIN.fullmatch(x) and "<|" not in x else None for x in texts]
        for t in set(chain.from_iterable(x for x in todo if x)) - new.keys():
            new[t] = old.get(t) or self.token(t)
        whole = lambda x: np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
        return [whole(x) if tokens is None else b"".join(map(new.__getitem__, tokens)) for x, tokens in zip(texts, todo, strict=True)]


def shortest_pack_first(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, list[int]]]:
    """Patterns (count, lengths) that hold just the pieces of the histogram."""
    by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    rooms = np.zeros(width + 1, bool)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                each = width // length
                for n, k in ((left // each, each), (1, left % each)):
                    if n and k:
                        by_room[width - k * length].append((n, [length] * k))
                        rooms[width - k * length] = True
                break
            room = length + int(fits[-1])
            count, lengths = by_room[room].pop()
            used = min(count, left)
            if used < count:
                by_room[room].append((count - used, lengths))
            rooms[room] = bool(by_room[room])
            by_room[room - length].append((used, [*lengths, length]))
            rooms[room - length] = True
            left -= used
    return [p for room in sorted(by_room) for p in by_room[room]]


def lay_out(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where the pieces of a length go by their rank."""
    used: dict[int, int] = defaultdict(int)
    out, first = [], 0
    for count, lengths in patterns:
        at = 0
        for n in lengths:
            out.append((n, used[n], first, at))
            used[n] += count
            at += n
        first += count
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, file: str | None = None, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row.

    Every document has its ids and then `end_id`; a null or empty text just that. A text of any length is encoded whole and cut into full
    sequences and a rest; pieces of equal length are told apart by their rank, by task and place in it. Rows with one doc_id (or none) are
    documents of their own, told apart by `row`. Other columns are ignored; an empty table gives no rows.
    """
    file = file or tokenizer_file()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, row, ranks = Encoder(file), TaskContext.get().partitionId(), 0, defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, out = b.slice(at, 256), []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.ids(part.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, width):
                        length = min(width, n - start)
                        out.append(((task << 40) + row, doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, task, ranks[length]))
                        ranks[length] += 1
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], NAMES)

    NAMES = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place"]
    with Scratch(docs.sparkSession) as s:
        text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        cut = s.save(text.mapInArrow(pieces, ", ".join(f"{n} long" for n in NAMES)), "pieces")
        by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
        histogram = {x["length"]: x["n"] for x in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
        layout = lay_out(shortest_pack_first(histogram, width))
        # a row per length and pattern that holds it: bounded by the lengths, not by the documents
        shared = docs.sparkSession.sparkContext.broadcast(layout)
        before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        firsts = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            order = (table[:, 0] << 48) + table[:, 1]
            for b in batches:
                length, rank = b.column(b.schema.get_field_index("length")).to_numpy(), b.column(b.schema.get_field_index("rank")).to_numpy()
                at = table[np.searchsorted(order, (length << 48) + rank, "right") - 1]
                b = b.append_column("sequence_id", pa.array(at[:, 2] + rank - at[:, 1]))
                yield b.append_column("offset", pa.array(at[:, 3]))

        ranked = cut.join(firsts, ["length", "task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", (F.col("first") + F.col("place")).alias("rank"))
        kinds = ", ".join(f"{n} long" for n in [*ranked.columns, "sequence_id", "offset"])
        return s.keep(ranked.mapInArrow(place, kinds).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("row")
