"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The agenda holds candidate merges, best score first and leftmost among equal ones. When a candidate comes up it is skipped, for good,
if a keyed hash of (seed, document, occurrence of the word in it, left end, right end) falls under the dropout rate; a later
merge of other pieces may still cover its place. With rate 0 the result is the library's own. No text that decodes otherwise
can come up: a literal U+2581, which stands for a space in pieces, is written in bytes, as is any character that has no piece.

Merges never cross two characters that follow each other in no piece, as at the start of a run of spaces or before a comma, so
a text is cut there into words. The agenda runs for many words at once, step by step, in arrays. A worker keeps the ids of words it
has seen, with the candidates that come up when none is skipped: an occurrence whose key skips none of them has these ids, the
others go through the agenda with their own keys.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tarn.llm.common import arrow_schema, columns_of, kept, read_table

SEED, RATE, MODEL = 42, 0.1, "piece_bpe_32k.model"
SPACE = "▁"
#: Words that a worker keeps; beyond that it begins anew.
KEPT_WORDS = 1 << 18
#: Occurrences, and ids to decode, that are worked on together; words in one step of the agenda.
BLOCK, ROWS = 1 << 16, 1 << 13
#: Characters that may begin a word of their own; longer words than SHORT go one by one.
MARKS, SHORT = ".,;:!?", 48
MASK = (1 << 64) - 1
NEVER = np.inf
GOLDEN, LEFT, RIGHT, MIX, LAST = 0x9E3779B97F4A7C15, 0x9E3779B1, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93


def place(start: int, end: int) -> int:
    return start * LEFT + end * RIGHT & MASK


def skipped(key: int, start: int, end: int) -> int:
    """24 bits for a candidate; it is skipped if they are under rate * 2^24."""
    h = (key ^ place(start, end)) * MIX & MASK
    return ((h ^ h >> 29) * LAST & MASK) >> 40


def skipped_all(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The same for arrays of keys and places."""
    h = (keys ^ places) * np.uint64(MIX)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(LAST)) >> np.uint64(40)


def occurrence_keys(document: int, first: int, count: int) -> np.ndarray:
    """The keys of a document's words from the first-th on."""
    h = np.uint64(document) + np.arange(first, first + count, dtype=np.uint64) * np.uint64(GOLDEN)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(27))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes starts[k] .. starts[k] + sizes[k] - 1 of all k, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """Pieces, scores and the byte pieces of a model, and what encoding and decoding need of them."""

    def __init__(self, path: str | None = None) -> None:
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(MODEL)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        # id and rank of each piece that merges may make; a smaller rank is a better score
        known = {p: (i, -sp.get_score(i)) for i, p in enumerate(self.pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.id = {p: i for p, (i, _) in known.items()}
        self.rank = {p: r for p, (_, r) in known.items() if len(p) > 1}
        # a full stop, comma or the like that follows a letter in no piece begins a word of its own
        pairs = {p[k : k + 2] for p in known for k in range(len(p) - 1)}
        marks = "".join(m for m in MARKS if not any(q[1] == m and q[0].isalpha() for q in pairs))
        assert not any(q[1] == SPACE and q[0] != SPACE for q in pairs), "a piece has a space after another character"
        self.word = re.compile(rf" +(?:[^\W\d_]+(?=[{re.escape(marks)}])|[^ \n]*)|[^ \n]+|\n" if marks else r" +[^ \n]*|[^ \n]+|\n")
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        # what two pieces (by id) merge into: an open hash table, and the ranks by id; 0 is no merge, as the first id is of no piece
        self.ranks = np.full(len(self.pieces), NEVER)
        for p, r in self.rank.items():
            self.ranks[self.id[p]] = r
        merges = [(self.id[p[:k]], self.id[p[k:]], self.id[p]) for p in self.rank for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id]
        self.bits = max(10, (8 * len(merges)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        for (a, b, made), at in zip(merges, self.slots(np.array([m[0] for m in merges]), np.array([m[1] for m in merges])).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = at + 1 & (1 << self.bits) - 1
            self.keys[at], self.values[at] = a << 32 | b, made
        # ids of characters by code point; unknown for those that have no piece
        self.unknown = len(self.pieces)
        self.characters = np.full(max(ord(p) for p in self.id if len(p) == 1) + 2, self.unknown, np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.characters[ord(p)] = i

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * np.uint64(LAST) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of the piece that two pieces merge into, or 0."""
        want, at, out = a.astype(np.int64) << 32 | b, self.slots(a, b), np.zeros(len(a), np.int32)
        todo = np.arange(len(a))
        while len(todo):
            have = self.keys[at]
            hit = have == want
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (have >= 0)
            todo, want, at = todo[on], want[on], at[on] + 1 & (1 << self.bits) - 1
        return out

    def agenda(self, words: list[str], keys: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The agenda for words (with SPACE for spaces) of like lengths. Returns ids and how many each has and, without keys, the same of the
        candidates that came up.

        A piece stands in the column of its first character; next and before are the columns of its neighbours. Without keys nothing is skipped.
        """
        n, sizes = len(words), np.array([len(w) for w in words])
        width = int(sizes.max())
        code = np.zeros((n, width), np.int64)
        code[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        piece = self.characters[np.minimum(code, len(self.characters) - 1)]
        columns = np.arange(width)
        piece[columns >= sizes[:, None]] = -1
        after = np.minimum(columns + 1, sizes[:, None]).astype(np.int32)  # sizes[k] is the end of word k
        before = np.tile(columns - 1, (n, 1)).astype(np.int32)
        made = np.zeros((n, width), np.int32)
        rank = np.full((n, width), NEVER)
        if width > 1:
            row, col = np.nonzero(columns[1:] < sizes[:, None])
            made[row, col] = self.merge_of(piece[row, col], piece[row, col + 1])
            rank[row, col] = self.ranks[made[row, col]]
        rows, step, came = np.arange(n), 0, []

        def offer(row: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            got = self.merge_of(piece[row, left], piece[row, right])
            made[row, left], rank[row, left] = got, self.ranks[got]

        while len(rows):
            best = rank[rows].argmin(axis=1)
            on = rank[rows, best] < NEVER
            rows, best = rows[on], best[on]
            right = after[rows, best]
            end = after[rows, right]
            places = best.astype(np.uint64) * np.uint64(LEFT) + end.astype(np.uint64) * np.uint64(RIGHT)
            if keys is None:
                came.append((rows, np.full(len(rows), step), places))
                go, left = rows, best
            else:
                merge = skipped_all(keys[rows], places) >= np.uint64(limit)
                rank[rows[~merge], best[~merge]] = NEVER
                go, left, right, end = rows[merge], best[merge], right[merge], end[merge]
            step += 1
            piece[go, left] = made[go, left]
            piece[go, right], rank[go, right], rank[go, left] = -1, NEVER, NEVER
            after[go, left] = end
            more = end < sizes[go]
            before[go[more], end[more]] = left[more]
            offer(go[more], left[more], end[more])
            back = before[go, left]
            more = back >= 0
            offer(go[more], back[more], left[more])
        on = piece >= 0
        ids, sizes = piece[on], on.sum(axis=1)
        if len(odd := np.flatnonzero((piece == self.unknown).any(axis=1))):
            rows_of = np.split(ids, np.cumsum(sizes)[:-1])
            for k in odd.tolist():
                starts = [*np.flatnonzero(on[k]).tolist(), len(words[k])]
                rows_of[k] = np.array(self.ids_of([words[k][a:b] for a, b in zip(starts, starts[1:], strict=False)]), np.int32)
            ids, sizes = np.concatenate(rows_of), np.array([len(r) for r in rows_of])
        if not came:
            return ids, sizes, np.zeros(0, np.uint64), np.zeros(n, np.int64)
        row, step_of, places = (np.concatenate([x[j] for x in came]) for j in range(3))
        return ids, sizes, places[np.lexsort((step_of, row))], np.bincount(row, minlength=n)

    def agendas(self, words: list[str], keys: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for words of up to SHORT characters and any lengths."""
        words = [w.replace(" ", SPACE) for w in words]
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        found = []
        for at in range(0, len(words), ROWS):
            part = order[at : at + ROWS]
            found.append(self.agenda([words[k] for k in part.tolist()], None if keys is None else keys[part], limit))
        ids, sizes, places, steps = (np.concatenate(x) for x in zip(*found, strict=True))
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        return ids[ragged((np.cumsum(sizes) - sizes)[back], sizes[back])], sizes[back], places[ragged((np.cumsum(steps) - steps)[back], steps[back])], steps[back]

    def merged_long(self, word: str, key: int, limit: int) -> list[str]:
        """The pieces of a word of any length under one key, with a heap, for time n log n."""
        rank, n = self.rank, len(word)
        piece: list[str | None] = list(word)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(rank[p], k, p) for k in range(n - 1) if (p := word[k : k + 2]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, at, made = heapq.heappop(agenda)
            a = piece[at]
            if a is None or (b_at := right[at]) < 0 or len(a) + len(piece[b_at]) != len(made):
                continue  # one of the two has been merged meanwhile
            if limit and skipped(key, at, at + len(made)) < limit:
                continue
            piece[at], piece[b_at] = made, None
            after = right[at] = right[b_at]
            if after >= 0:
                left[after] = at
                if (p := made + piece[after]) in rank:
                    heapq.heappush(agenda, (rank[p], at, p))
            before = left[at]
            if before >= 0 and (p := piece[before] + made) in rank:
                heapq.heappush(agenda, (rank[p], before, p))
        return [p for p in piece if p is not None]

    def ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if (got := self.id.get(p)) is not None:
                out.append(got)
            else:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def ids_directly(self, word: str, key: int, limit: int) -> list[int]:
        """Spaces become SPACE first; a literal SPACE stays apart and becomes bytes."""
        out: list[int] = []
        for part in re.split(f"({SPACE})", word):
            out += [self.bytes[b] for b in SPACE.encode()] if part == SPACE else self.ids_of(self.merged_long(part.replace(" ", SPACE), key, limit))
            key = (key + len(part) + 1) * GOLDEN & MASK
        return out

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids decode to; encoding puts one space before a text, which is still there."""
        out = [self.raw[ragged(self.raw_start[part], self.raw_size[part])] for part in (ids[k : k + BLOCK] for k in range(0, len(ids), BLOCK))]
        return np.concatenate(out) if out else np.zeros(0, np.uint8)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return self.bytes_of(np.asarray(ids, np.int64)).tobytes()[1:].decode("utf-8", "surrogatepass")


class Ragged:
    """Rows of numbers of one type, one after the other."""

    def __init__(self, kind: str) -> None:
        self.data, self.starts, self.sizes, self.rows, self.used = np.zeros(4096, kind), np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0, 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.rows + len(sizes) > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, self.starts]), np.concatenate([self.sizes, self.sizes])
        while self.used + len(flat) > len(self.data):
            self.data = np.concatenate([self.data, self.data])
        own = slice(self.rows, self.rows + len(sizes))
        self.data[self.used : self.used + len(flat)] = flat
        self.sizes[own] = sizes
        self.starts[own] = self.used + np.cumsum(sizes) - sizes
        self.rows, self.used = own.stop, self.used + len(flat)

    def take(self, at: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.starts[at], self.sizes[at])]


class Encoder:
    """Texts to ids; keeps what the agenda does to the words seen so far when nothing is skipped."""

    def __init__(self, vocabulary: Vocabulary, seed: int = SEED, rate: float = RATE) -> None:
        self.vocabulary, self.seed, self.limit = vocabulary, seed, int(rate * (1 << 24))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.places = Ragged("<u2"), Ragged("<u8")

    def learn(self, words: list[str]) -> None:
        ids, sizes, places, steps = self.vocabulary.agendas(words, None, 0)
        self.number.update(zip(words, range(self.ids.rows, self.ids.rows + len(words)), strict=True))
        self.ids.extend(ids, sizes)
        self.places.extend(places, steps)

    def walk(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all occurrences, and how many each has."""
        if not words:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        if new := [w for w in set(words).difference(self.number) if len(w) <= SHORT and SPACE not in w]:
            self.learn(sorted(new))
        get = self.number.get
        at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        known = np.maximum(at, 0)
        size = self.places.sizes[known] if self.places.rows else np.zeros(len(words), np.int64)
        size = np.where(at >= 0, size, 0)
        skips = skipped_all(np.repeat(keys, size), self.places.data[ragged(self.places.starts[known], size)]) < np.uint64(self.limit)
        hit = np.zeros(len(words), bool)
        hit[np.repeat(np.arange(len(words)), size)[skips]] = True
        sizes = np.where(at >= 0, self.ids.sizes[known], 0)
        other, others = np.zeros(0, np.int32), np.zeros(0, np.int64)
        apart = np.flatnonzero(hit)
        if len(apart):
            other, others, _, _ = self.vocabulary.agendas([words[k] for k in apart.tolist()], keys[apart], self.limit)
        if len(long := np.flatnonzero(at < 0)):
            directly = [np.array(self.vocabulary.ids_directly(words[k], int(keys[k]), self.limit), np.int32) for k in long.tolist()]
            apart, other, others = np.concatenate([apart, long]), np.concatenate([other, *directly]), np.concatenate([others, [len(x) for x in directly]])
        sizes[apart] = others
        out = np.zeros(int(sizes.sum()), np.uint16)
        starts = np.cumsum(sizes) - sizes
        plain = np.ones(len(words), bool)
        plain[apart] = False
        out[ragged(starts[plain], sizes[plain])] = self.ids.take(known[plain])
        out[ragged(starts[apart], sizes[apart])] = other
        return out, sizes

    def encode_all(self, texts: list[str], keys: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """uint16 ids of all texts, and where each text's begin and the last one's end. As the library does, an empty text has none and any other
        gets a space before it."""
        if len(self.number) > KEPT_WORDS:
            self.clear()
        words: list[str] = []
        parts: list[np.ndarray] = []
        counts = [0]
        for text, key in zip(texts, keys, strict=True):
            found = self.vocabulary.word.findall(" " + text) if text else []
            words += found
            counts.append(len(found))
            parts.append(occurrence_keys(xxhash.xxh64_intdigest(str(key).encode(), self.seed), 0, len(found)))
        own = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        found = [self.walk(words[k : k + BLOCK], own[k : k + BLOCK]) for k in range(0, len(words), BLOCK)]
        sizes = np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)])
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        return np.concatenate([np.zeros(0, np.uint16), *(i for i, _ in found)]), ends

    def encode(self, text: str, key: int | None = None) -> np.ndarray:
        return self.encode_all([text], [key])[0]


def encoder(path: str | None, seed: int, rate: float) -> Encoder:
    """One for each setting and worker; it lives on from task to task."""
    return kept(("sub-words", path, seed, rate), lambda: Encoder(Vocabulary(path), seed, rate))


def encode_column(docs: DataFrame, path: str | None = None, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """A row per row of docs: doc_id, ids (array), n_tokens, ids_crc32 (32-bit little-endian ids), decoded_sha256 of what the ids decode to.

    A null text is empty, an empty one has no ids; texts of any length go whole. Equal texts of one doc_id are segmented alike,
    of other doc_ids by other keys; a null doc_id is a key of its own. Further columns are left out. An empty table gives no rows.
    """
    ddl = "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, decoded_sha256 string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, seed, rate)
        for x in columns_of(batches, 128):
            found, ends = encode.encode_all([t or "" for t in x["text"]], x["doc_id"])
            flat, cuts = found.astype("<i4"), ends.tolist()
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()))
            both = list(zip(cuts[:-1], cuts[1:], strict=True))
            digests = [hashlib.sha256(encode.vocabulary.bytes_of(flat[a:b])[1:]).hexdigest() for a, b in both]
            crcs = [zlib.crc32(flat[a:b]) for a, b in both]
            yield pa.RecordBatch.from_arrays([pa.array(x["doc_id"], pa.int64()), ids.cast(schema.field("ids").type), pa.array(np.diff(ends)), pa.array(crcs, pa.int64()), pa.array(digests, pa.string())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def decode_column(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encode_column's doc_id and ids to doc_id and text; null ids give a null text."""
    ddl = "doc_id long, text string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for x in columns_of(batches, 128):
            yield pa.RecordBatch.from_arrays([pa.array(x["doc_id"], pa.int64()), pa.array([None if i is None else vocabulary.decode(i) for i in x["ids"]], pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, ddl)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(read_table(spark, sf_dir, "documents"))
