"""Packing of token streams into fixed windows by minimum bin slack.

Each task tokenises its documents as a stream and packs them from a bounded pool, so nothing is shuffled
and memory doesn't depend on the number of documents. A document's whole windows go out at once; what remains of it
waits in the pool as one piece, and only that part of its tokens is kept. The pool is bounded by tokens and by pieces. A window takes the longest waiting piece, and a dynamic programme over a bitset of
reachable lengths picks the multiset of further pieces that comes closest to the capacity. A piece is cut
only where that still leaves slack, and at the end of a partition, where the last tokens go into sequences
whose lengths are powers of two. No sequence is padded.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections import deque
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import cells, mapped, spread

#: Distinct words or parts of words whose ids a Python worker remembers: two generations of this many.
CACHED_WORDS = 80_000
#: Characters that are tokenised at once; longer texts are taken piece by piece, cut at white space.
CHUNK_CHARS = 1 << 20
#: Rows and bytes of a batch that leaves a task.
OUT_ROWS, OUT_BYTES = 4096, 8 << 20


#: The normaliser and splitter for which a plain word's ids are those the model gives its lower-cased parts.
PLAIN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A plain text: printable ASCII, its white space, and composed Latin letters whose lower case is one letter.
PLAIN = re.compile(r"[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e]*")
#: Its parts, in lower case: contractions, runs of letters, single digits, runs of other marks.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017e]+|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u017e]+")


def byte_letters() -> dict[int, str]:
    """For byte-level models: byte -> the character that stands for it, itself where it is printable."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Remembered(dict):
    """A bounded memo. Full, it becomes the old generation, from which entries that are still used come back.
    Very long keys are not remembered."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.made(key)
        if len(key) > 256:
            return value
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PartIds(Remembered):
    """Lower-cased part of a plain text -> its ids, straight from the tokenizer's model."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, byte_letters()

    def made(self, part: str) -> bytes:
        written = part if part.isascii() else part.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()


class WordIds(Remembered):
    """UTF-8 word -> its ids as little-endian 32-bit integers; of() gives those of a text.

    A tokenizer that never joins characters across white space gives a text the ids of its words in order.
    Where the tokenizer has the normaliser and splitter above, the parts of plain texts go to its model directly,
    which is several times as fast; words of all other texts go through the whole tokenizer.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        told = json.loads(tokenizer_json)
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        plain = (told.get("normalizer") or {}).get("normalizers") == PLAIN_NORMALIZER and (
            steps[0].get("pattern") == {"Regex": PLAIN_SPLIT}
            and [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex", True)
        )
        added = [re.escape(x["content"]) for x in told.get("added_tokens") or []]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.parts = PartIds(self.tokenizer.model) if plain else None

    def made(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids).tobytes()

    def of(self, text: str) -> bytes:
        return b"".join(map(self._of, chunks(text)))

    def _of(self, text: str) -> bytes:
        if self.parts is None:
            return b"".join(map(self.__getitem__, text.encode("utf-8").split()))
        if PLAIN.fullmatch(text) and not self.added.search(text):
            return b"".join(map(self.parts.__getitem__, PARTS.findall(text.lower())))
        return b"".join(self._plain(w) for w in text.encode("utf-8").split())

    def _plain(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if PLAIN.fullmatch(text) and not self.added.search(text):
            return b"".join(map(self.parts.__getitem__, PARTS.findall(text.lower())))
        return self[word]


@functools.lru_cache(maxsize=1)
def word_ids(tokenizer_json: str) -> WordIds:
    """One memo a Python worker, which its later tasks find filled."""
    return WordIds(tokenizer_json)


def chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Parts of text of about this size, cut only at a space or line end."""
    at = 0
    while len(text) - at > size:
        ends = [p for p in (text.find(" ", at + size), text.find("\n", at + size)) if p >= 0]
        if not ends:
            break
        yield text[at : min(ends)]
        at = min(ends)
    yield text[at:] if at else text


class SlackPacker:
    """Packs (key, length) into sequences of at most capacity; see the module's text."""

    def __init__(self, capacity: int, pool_tokens: int, pool_pieces: int = 1 << 15):
        self.capacity, self.pool_tokens, self.pool_pieces = capacity, max(pool_tokens, 2 * capacity), pool_pieces
        self.waiting: dict[int, deque] = {}
        self.present = 0  # bit n: pieces of length n wait
        self.tokens = self.pieces = 0

    def _put(self, key, start: int, length: int) -> None:
        self.waiting.setdefault(length, deque()).append((key, start))
        self.present |= 1 << length
        self.tokens += length
        self.pieces += 1

    def _take(self, length: int) -> tuple:
        pieces = self.waiting[length]
        key, start = pieces.popleft()
        if not pieces:
            del self.waiting[length]
            self.present ^= 1 << length
        self.tokens -= length
        self.pieces -= 1
        return key, start, length

    def add(self, key, length: int) -> Iterator[list[tuple]]:
        start = 0
        while length - start >= self.capacity:
            yield [(key, start, self.capacity)]
            start += self.capacity
        if length > start:
            self._put(key, start, length - start)
        if self.tokens > self.pool_tokens:
            while self.tokens > self.pool_tokens // 2:
                yield self._fill()
        if self.pieces > self.pool_pieces:
            while self.pieces > self.pool_pieces // 2 and self.tokens >= self.capacity:
                yield self._fill()

    def _fill(self) -> list[tuple]:
        """One full sequence; at least capacity tokens wait."""
        out = [self._take(self.present.bit_length() - 1)]
        room = self.capacity - out[0][2]
        for length, count in self.closest(room):
            out += [self._take(length) for _ in range(count)]
            room -= length * count
        while room:
            key, start, length = self._take(self.present.bit_length() - 1)
            cut = min(room, length)
            out.append((key, start, cut))
            if length > cut:
                self._put(key, start + cut, length - cut)
            room -= cut
        return out

    def closest(self, room: int) -> list[tuple[int, int]]:
        """(length, count) of waiting pieces whose sum is the largest possible up to room.

        Bit s of reach tells that some multiset sums to s. Counts are taken in powers of two, so that a
        length that waits n times costs log n steps; steps keep the bitset before each for the way back.
        """
        steps, reach, mask = [], 1, (1 << (room + 1)) - 1
        lengths = self.present & mask
        while lengths and not reach >> room & 1:
            length = lengths.bit_length() - 1
            lengths ^= 1 << length
            left, times = min(len(self.waiting[length]), room // length), 1
            while left:
                times = min(times, left)
                steps.append((length, times, reach))
                reach |= reach << length * times & mask
                left -= times
                times *= 2
        at, counts = reach.bit_length() - 1, {}
        for length, times, before in reversed(steps):
            if not before >> at & 1:
                at -= length * times
                counts[length] = counts.get(length, 0) + times
        return list(counts.items())

    def finish(self) -> Iterator[list[tuple]]:
        while self.tokens >= self.capacity:
            yield self._fill()
        whole, self.capacity = self.capacity, 0
        while self.tokens:
            self.capacity = 1 << (self.tokens.bit_length() - 1)
            while self.present.bit_length() - 1 > self.capacity:  # a piece may be longer than the sequence
                key, start, length = self._take(self.present.bit_length() - 1)
                self._put(key, start, self.capacity)
                self._put(key, start + self.capacity, length - self.capacity)
            yield self._fill()
        self.capacity = whole


def pack_documents(
    docs: DataFrame,
    tokenizer_json: str,
    *,
    capacity: int = 4096,
    end_id: int = 2,
    pool_tokens: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Packs all rows into sequences of at most capacity tokens.

    tokenizer_json is the text of a tokenizer file (it is read on the driver and broadcast, so executors need
    no file). A document's tokens are the ids of its text and then end_id. Returns a row for each piece:
    id_col, start (tokens of the document before the piece), length, doc_tokens, sequence_id, offset (place in
    the sequence), ids (binary, little-endian unsigned 32-bit).

    A null or empty text is the single token end_id. Repeated rows are packed each. A null id stays null.
    An empty table gives no rows. Other columns are ignored. A text of any length is tokenised in parts of
    about a million characters. Sequence ids are unique and, over the same input partitions, repeatable.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)
    source = spread(docs.select(id_col, text_col))
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("ids", T.BinaryType())]
    )

    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, packer = word_ids(shared.value), SlackPacker(capacity, pool_tokens)
        end, held, rows = array("I", [end_id]).tobytes(), {}, []
        number, size = TaskContext.get().partitionId() << 40, 0
        kinds = None

        def placed(sequence):
            nonlocal number, size
            offset = 0
            for key, start, length in sequence:
                doc = held[key]
                rows.append((doc[0], start, length, doc[2], number, offset, doc[1][4 * (start - doc[4]) : 4 * (start - doc[4] + length)]))
                offset += length
                size += 4 * length
                doc[3] -= length
                if not doc[3]:
                    del held[key]
            number += 1

        def flushed():
            nonlocal size
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], [f.name for f in schema])
            rows.clear()
            size = 0
            return out

        def stream():
            nonlocal kinds
            for batch in batches:
                kinds = [batch.schema.field(id_col).type, *[pa.int64()] * 5, pa.binary()]
                yield from cells([batch], id_col, text_col)

        for key, (doc_id, text) in enumerate(stream()):
            tokens = words.of(text or "") + end
            n = len(tokens) // 4
            held[key] = [doc_id, tokens, n, n, 0]
            for sequence in packer.add(key, n):
                placed(sequence)
                if len(rows) >= OUT_ROWS or size >= OUT_BYTES:
                    yield flushed()
            if key in held and n > capacity:  # its whole windows have gone out; what waits is its tail
                first = n - n % capacity
                held[key][1], held[key][4] = tokens[4 * first :], first
        for sequence in packer.finish():
            placed(sequence)
            if len(rows) >= OUT_ROWS or size >= OUT_BYTES:
                yield flushed()
        if rows:
            yield flushed()

    return mapped(source, run, schema)
