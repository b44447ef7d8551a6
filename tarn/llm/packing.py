"""Sum-of-squares online packing of token sequences into windows.

Let N(h) be the number of open windows filled to level h. A document is placed where the sum of N(h)^2 over
0 < h < capacity becomes smallest: for each level h that has an open window and room, the sum changes by
N(h + s)^2 up and N(h)^2 down; a new window is level 0, a full one leaves the array. The array of levels is all the state,
so each partition of the input packs its own stream with no shuffle. At its end the open windows that are filled least are emptied
piece by piece into the gaps of the others, fullest first, so that a partition leaves at most one window padded and no more
ids move than there were gaps.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tarn.llm.common import arrow_schema, columns_of, compact, kept, read_table
from tarn.session import share_package

CAPACITY, END_ID, TOKENIZER = 2048, 1, "word_bpe_49k.json"
#: Sequences that a partition can number.
PARTITION_SHIFT = 40
#: Latin letters (without the one that two characters are the small form of), and at most one mark after them.
LATIN = re.compile("([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,]?)").fullmatch
#: Words whose ids a worker keeps.
KEPT_WORDS = 1 << 19


class Levels:
    """The level array with the open windows at each level."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """The window and level that a piece of this size goes to."""
        n, most = self.counts, self.capacity - size
        # change of the sum of squares: (n[h+s]+1)^2 - n[h+s]^2, unless h+s is full, and (n[h]-1)^2 - n[h]^2
        change = 2 * n[size:] + 1
        change[most] = 0
        change[1:] += 1 - 2 * n[1 : most + 1]
        usable = n[: most + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        level = most - int(np.argmin(change[::-1]))  # of equal ones the fullest
        if level:
            n[level] -= 1
            window = self.windows[level].pop()
        else:
            window, self.made = self.made, self.made + 1
        if level + size < self.capacity:
            n[level + size] += 1
            self.windows[level + size].append(window)
        return window, level


def pack(lengths: Iterator[int], capacity: int = CAPACITY) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Lists of final pieces (document, start, length, window, offset); every id lies in one. Windows of capacity ids
    are final at once, open ones when they fill or at the end. Windows number from 0 without gaps."""
    levels, open_pieces = Levels(capacity), {}
    for doc, length in enumerate(lengths):
        done = []
        whole = length // capacity * capacity
        for start in range(0, whole, capacity):
            done.append((doc, start, capacity, levels.made, 0))
            levels.made += 1
        if size := length - whole:
            window, level = levels.place(size)
            held = open_pieces.setdefault(window, [])
            held.append((doc, whole, size, window, level))
            if level + size == capacity:
                done += open_pieces.pop(window)
        yield done
    yield closed({w: [p[:3] for p in held] for w, held in open_pieces.items()}, capacity)


def closed(open_pieces: dict[int, list[tuple[int, int, int]]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Final pieces of the windows that are open at the end, all full but one. The windows that stay take the least numbers, so that none is missing."""
    level = {w: sum(size for _, _, size in held) for w, held in open_pieces.items()}
    order = sorted(open_pieces, key=lambda w: (-level[w], w))
    front, back = 0, len(order) - 1
    while front < back:
        to, donor = order[front], order[back]
        if not (gap := capacity - level[to]):
            front += 1
            continue
        doc, start, size = open_pieces[donor].pop()
        cut = min(size, gap)
        open_pieces[to].append((doc, start, cut))
        if cut < size:
            open_pieces[donor].append((doc, start + cut, size - cut))
        level[to], level[donor] = level[to] + cut, level[donor] - cut
        back -= not level[donor]
    done = []
    for number, window in zip(sorted(order), order[: back + 1], strict=False):
        at = 0
        for doc, start, size in open_pieces[window]:
            done.append((doc, start, size, number, at))
            at += size
    return done


class WordIds(dict):
    """Texts to ids, equal to the tokenizer's own; as a dict, the ids (bytes) of words seen so far, up to about KEPT_WORDS.

    The pre-tokenizer drops white space and the normalizer works within words, so a text's ids are those of its words
    one after the other. A word of Latin letters and at most one full stop or comma after them is two tokens of the
    pre-tokenizer, whose ids are found apart and whatever the case of the letters.
    """

    def __init__(self, tokenizer) -> None:
        from tokenizers import pre_tokenizers

        super().__init__()
        self.tokenizer = tokenizer
        self.cores: dict[str, bytes] = {}
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(128, 0x250) if chr(c).isalpha()}
        self.marks = {"": b"", **{m: self.slowly(m) for m in ".,"}}

    def slowly(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def of_letters(self, word: str) -> bytes:
        """Small Latin letters are in their normal form and one word of the pre-tokenizer, so only the model is left to do."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.translate(self.table))]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if m := LATIN(word):
            core = m[1].lower()
            ids = self.cores.get(core)
            if ids is None:
                ids = self.cores[core] = self.of_letters(core)
            ids += self.marks[m[2]]
        else:
            ids = self.slowly(word) if word else b""
        self[word] = ids
        return ids

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > KEPT_WORDS:
            self.clear()
        if len(self.cores) > KEPT_WORDS // 2:
            self.cores.clear()
        return [np.frombuffer(b"".join(map(self.__getitem__, t.replace("\n", " ").split(" "))), "<u4") for t in texts]


def encoder(path: str | None) -> WordIds:
    """One for each file and worker; it lives on from task to task."""
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return kept(("word ids", path), lambda: WordIds(Tokenizer.from_file(path)))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """docs to pieces: doc_id, start, length, ids (array), doc_tokens, sequence_id, offset. path: the tokenizer's file; by default the
    public one that is installed on each machine.

    A null or empty text is the end id alone; texts of any length go whole. Rows that share a doc_id are documents of their own; ids may be
    null. Further columns are left out. An empty table gives no rows.
    """
    share_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_packer(path, capacity, False), "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long")


def _packer(path: str | None, capacity: int, digests: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    ids_type = "ids_crc32 long" if digests else "ids array<int>"
    schema = arrow_schema(f"doc_id long, start long, length long, {ids_type}, doc_tokens long, sequence_id long, offset long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        first = TaskContext.get().partitionId() << PARTITION_SHIFT
        ids: dict[int, tuple] = {}  # of documents with a piece that is not final: at most a window's ids each
        sizes: list[int] = []

        def lengths() -> Iterator[int]:
            for x in columns_of(batches, 256):
                for doc_id, tokens in zip(x["doc_id"], encode([t or "" for t in x["text"]]), strict=True):
                    tokens = np.append(tokens, np.uint32(END_ID))
                    ids[len(sizes)] = (doc_id, tokens)
                    sizes.append(len(tokens))
                    yield len(tokens)

        out: list[list] = [[] for _ in schema]
        for k, done in enumerate(pack(lengths(), capacity)):
            for doc, start, length, window, offset in done:
                doc_id, tokens = ids[doc]
                base = sizes[doc] - len(tokens)
                own = tokens[start - base : start - base + length]
                row = (doc_id, start, length, zlib.crc32(own.astype("<u4").tobytes()) if digests else own.astype(np.int32), sizes[doc], first + window, offset)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                if start + length == sizes[doc]:
                    del ids[doc]
            if k in ids and (whole := sizes[k] // capacity * capacity):
                ids[k] = (ids[k][0], ids[k][1][whole:].copy())
            if len(out[0]) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                out = [[] for _ in schema]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def packed_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    share_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_packer(path, CAPACITY, True), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(read_table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs' pieces, as of pack_documents, with the ids' checksum instead of the ids."""
    return packed_digests(compact(docs, docs.count(), docs))
