"""Exact substring dedup over sorted suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts earlier in the corpus. Sorting every suffix would shuffle
the corpus a hundredfold, so only some suffixes stand for all strings: of the GRAM-grams in a string the one with the
least hash is its anchor (all of them at a tie). Equal strings have their anchors at the same places, so they are found at them:

1. anchors: each anchor's gram hash and context hash (all bytes of any string it may stand for) go, packed, to buckets by gram
   hash. Equal contexts are put together before the shuffle and again after it: all but the first are removed whole.
   A gram with one context left needs nothing more. The first ones of the other contexts are asked for by document.
2. suffixes: the suffixes at the anchors asked for are range-partitioned by their leading token, the gram's 32 bytes, with
   sampled splitters. Equal strings have equal grams there, so they share a bucket: what a comparison across a boundary would look at
   differs in the leading token already. A bucket sorts its suffixes, and what stands before them, by multikey quicksort
   on 8-byte tokens; common prefix lengths of neighbours then say, exactly, which strings are equal.
3. each document's removed intervals are joined to it.

Copies do not meet as such: a context that a third of all documents share is one row per task in step 1 and one in all in step 2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import ROW_ID, arrow_schema, columns_of, read_table, shuffle_partitions, with_row_id

LENGTH, GRAM = 100, 32
#: Grams in a string; bytes before an anchor that its strings may have.
WINDOW = LENGTH - GRAM + 1
BEFORE = WINDOW - 1
#: Bytes of a document hashed at once, and what is read around them.
PIECE, MARGIN = 1 << 20, 2 * LENGTH
#: Anchors, and suffixes, that a task holds before it hands them on.
FLUSH, FLUSH_SUFFIXES = 1 << 20, 1 << 16
#: Rows, at most about, whose leading tokens are sampled for the splitters, and tokens of each.
SAMPLE_ROWS, SAMPLE_EACH = 2000, 32
#: Bytes of text for a bucket, at least.
BUCKET_BYTES = 64 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
NO_ID = -(1 << 63)  # a null doc_id counts as the smallest

_table = np.random.default_rng(42).integers(0, 1 << 64, 256, np.uint64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR^i and FACTOR^-i modulo 2^64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(FACTOR), -1, 1 << 64))
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, f, np.uint64))]) for f in (FACTOR, inverse)]
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding(a: np.ndarray, size: int, op: np.ufunc) -> np.ndarray:
    """op over each run of size neighbours."""
    have = 1
    while have * 2 <= size:
        a = op(a[:-have], a[have:])
        have *= 2
    return op(a[: len(a) - (size - have)], a[size - have :]) if have < size else a


def anchors(pieces: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, ...]:
    """pieces: bytes, first and end of the part whose anchors are wanted. Returns arrays: piece, place in it, gram hash,
    context hash, bytes before and bytes from the anchor that its context has."""
    sizes = np.array([len(b) for b, _, _ in pieces])
    data = np.frombuffer(b"".join([b for b, _, _ in pieces]), np.uint8)
    n = len(data)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_table[data] * power[:n], out=sums[1:])
    ends = np.cumsum(sizes)
    grams = mixed((sums[GRAM:] - sums[: n + 1 - GRAM]) * inverse[: n + 1 - GRAM])
    for e in ends[:-1].tolist():
        grams[max(0, e - GRAM + 1) : e] = ~np.uint64(0)  # grams that two pieces share
    edge = np.zeros(WINDOW - 1, np.uint64)
    best = sliding(np.concatenate([edge, sliding(grams, WINDOW, np.minimum), edge]), WINDOW, np.maximum)
    at = np.flatnonzero(grams == best)
    piece = np.searchsorted(ends, at, side="right")
    start, end = ends[piece] - sizes[piece], ends[piece]
    low, high = (np.array([p[k] for p in pieces])[piece] + start for k in (1, 2))
    ok = (at >= low) & (at < high) & (at + GRAM <= end)
    at, piece, start, end = at[ok], piece[ok], start[ok], end[ok]
    left, right = np.maximum(at - BEFORE, start), np.minimum(at + LENGTH, end)
    before, after = at - left, right - at
    context = mixed((sums[right] - sums[left]) * inverse[left]) + mixed((before * 256 + after).astype(np.uint64) * FACTOR)
    return piece, at - start, grams[at], context, before.astype(np.uint8), after.astype(np.uint8)


FIELDS = (("gram", "<u8"), ("context", "<u8"), ("did", "<i8"), ("rid", "<i8"), ("at", "<u4"), ("before", "u1"), ("after", "u1"))
WIDTH = sum(np.dtype(t).itemsize for _, t in FIELDS)


def to_blob(columns: dict[str, np.ndarray]) -> bytes:
    """Column after column, which compresses better than row after row."""
    return b"".join(columns[name].astype(kind).tobytes() for name, kind in FIELDS)


def from_blobs(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {name: [] for name, _ in FIELDS}
    for blob in blobs:
        rows, at = len(blob) // WIDTH, 0
        for name, kind in FIELDS:
            parts[name].append(np.frombuffer(blob, kind, rows, at))
            at += rows * np.dtype(kind).itemsize
    return {name: np.concatenate(parts[name]) if parts[name] else np.zeros(0, kind) for name, kind in FIELDS}


def first_of_context(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by gram, context and place in the corpus, and which in it are the first of their context."""
    order = np.lexsort((c["at"], c["rid"], c["did"], c["context"], c["gram"]))
    gram, context = c["gram"][order], c["context"][order]
    first = np.ones(len(order), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
    return order, first


def pieces_of(data: bytes) -> Iterator[tuple[bytes, int, int, int]]:
    """bytes, wanted part, and the place in the document where they begin."""
    for core in range(0, len(data), PIECE):
        low, high = max(0, core - MARGIN), min(len(data), core + PIECE + MARGIN)
        yield data[low:high], core - low, min(core + PIECE, len(data)) - low, low


def anchor_blobs(buckets: int):
    """The function of step 1: documents to rows bucket, known (removed for certain), blob."""
    schema = arrow_schema("bucket int, known boolean, blob binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        pending: list[tuple[bytes, int, int, int, int, int]] = []
        rows = spread = 0

        def work() -> int:
            piece, at, gram, context, before, after = anchors([p[:3] for p in pending])
            base, did, rid = (np.array([p[k] for p in pending], np.int64) for k in (3, 4, 5))
            held.append({"gram": gram, "context": context, "did": did[piece], "rid": rid[piece], "at": at + base[piece], "before": before, "after": after})
            pending.clear()
            return len(at)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal spread
            c = {name: np.concatenate([h[name] for h in held]) for name, _ in FIELDS}
            held.clear()
            order, first = first_of_context(c)
            known, kept = order[~first], order[first]
            out: list[tuple[int, bool, bytes]] = []
            for k in range(0, len(known), 1 << 16):
                spread += 1
                out.append(((TaskContext.get().partitionId() * 31 + spread) % buckets, True, to_blob({name: v[known[k : k + (1 << 16)]] for name, v in c.items()})))
            bucket = (c["gram"][kept] >> np.uint64(20)) % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            kept, bucket = kept[by], bucket[by]
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(kept)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    own = kept[a:b]
                    own = own[np.lexsort((c["at"][own], c["rid"][own]))]
                    out.append((int(bucket[a]), False, to_blob({name: v[own] for name, v in c.items()})))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        size = 0
        for x in columns_of(batches, 256):
            for rid, did, text in zip(x[ROW_ID], x["doc_id"], x["text"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                if len(data) < LENGTH:
                    continue
                for p in pieces_of(data):
                    pending.append((*p, NO_ID if did is None else did, rid))
                    size += len(p[0])
                    if size >= PIECE:
                        rows, size = rows + work(), 0
                        if rows >= FLUSH:
                            yield from flush()
                            rows = 0
        if pending:
            rows += work()
        if rows:
            yield from flush()

    return run


def removed(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """An interval as one number; numbers under 0 ask for the suffix at -1 - number."""
    return start.astype(np.int64) << 9 | size.astype(np.int64)


def compare_contexts(table: pa.Table) -> pa.Table:
    """Step 1 in a bucket: rows rid, v."""
    known, blobs = table.column("known").to_pylist(), table.column("blob").to_pylist()
    sure = from_blobs([b for b, k in zip(blobs, known, strict=True) if k])
    c = from_blobs([b for b, k in zip(blobs, known, strict=True) if not k])
    order, first = first_of_context(c)
    again, lead = order[~first], order[first]
    gram = c["gram"][lead]
    more = np.zeros(len(lead), bool)  # other contexts have this gram too
    more[1:] |= gram[1:] == gram[:-1]
    more[:-1] |= gram[1:] == gram[:-1]
    ask = lead[more]
    rid, v = [c["rid"][ask]], [-1 - c["at"][ask].astype(np.int64)]
    for x, which in ((sure, slice(None)), (c, again)):
        at, before, after = (x[n][which].astype(np.int64) for n in ("at", "before", "after"))
        rid.append(x["rid"][which])
        v.append(removed(at - before, before + after))
    return pa.table({"rid": pa.array(np.concatenate(rid), pa.int64()), "v": pa.array(np.concatenate(v), pa.int64())})


def suffix_blobs(splitters: np.ndarray):
    """The function of step 2: documents with what is asked for to rows bucket, blob."""
    schema = arrow_schema("bucket int, blob binary")
    keep = 24 + LENGTH + BEFORE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes, bytes]] = []

        def flush() -> pa.RecordBatch:
            out: dict[int, list[bytes]] = {}
            lead = np.array([h[3][:GRAM] for h in held], splitters.dtype)
            for b, (did, rid, at, after, before) in zip(np.searchsorted(splitters, lead, side="right").tolist(), held, strict=True):
                out.setdefault(b, []).append(np.array([did, rid, at << 16 | len(after) << 8 | len(before)], "<i8").tobytes() + after.ljust(LENGTH, b"\0") + before.ljust(BEFORE, b"\0"))
            held.clear()
            assert all(len(x) == keep for x in out[next(iter(out))])
            return pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([b"".join(x) for x in out.values()], pa.binary())], schema=schema)

        for x in columns_of(batches, 256):
            for rid, did, text, numbers in zip(x[ROW_ID], x["doc_id"], x["text"], x["vs"], strict=True):
                asked = sorted({-1 - v for v in numbers or () if v < 0})
                if not asked:
                    continue
                data = (text or "").encode("utf-8", "surrogatepass")
                for at in asked:
                    held.append((NO_ID if did is None else did, rid, at, data[at : at + LENGTH], data[max(0, at - BEFORE) : at][::-1]))
                    if len(held) >= FLUSH_SUFFIXES:
                        yield flush()
        if held:
            yield flush()

    return run


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """An order of rows of bytes (a multiple of 8 wide): sorted by the first token, then what is equal so far by the next."""
    tokens = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(tokens[:, 0], kind="quicksort")
    tied = np.zeros(len(order), np.int64)  # number of the run of equal rows so far
    for k in range(tokens.shape[1]):
        column = tokens[order, k]
        new = np.ones(len(order), bool)
        new[1:] = (column[1:] != column[:-1]) | (tied[1:] != tied[:-1])
        tied = np.cumsum(new)
        if k + 1 == tokens.shape[1]:
            break
        runs = np.bincount(tied, minlength=tied[-1] + 1)[tied] > 1 if len(tied) else new
        at = np.flatnonzero(runs)
        if not len(at):
            break
        part = order[at]
        order[at] = part[np.lexsort((tokens[part, k + 1], tied[at]))]
    return order


def common_prefixes(rows: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it in order; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 15):
        b = min(len(order), a + (1 << 15))
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[a:b] = np.minimum(same, np.minimum(sizes[order[a:b]], sizes[order[a - 1 : b - 1]]))
    return out


def compare_suffixes(table: pa.Table) -> pa.Table:
    """Step 2 in a bucket: rows rid, v of the strings that start earlier too."""
    raw = np.frombuffer(b"".join(table.column("blob").to_pylist()), np.uint8).reshape(-1, 24 + LENGTH + BEFORE)
    head = np.ascontiguousarray(raw[:, :24]).view("<i8")
    raw = raw[np.lexsort((head[:, 2], head[:, 1], head[:, 0]))]  # by place in the corpus, so that the first of equals is the earliest
    head = np.ascontiguousarray(raw[:, :24]).view("<i8")
    rid, at, after, before = head[:, 1], head[:, 2] >> 16, head[:, 2] >> 8 & 255, head[:, 2] & 255
    n = len(raw)
    sides = []
    for rows, sizes in ((raw[:, 24 : 24 + LENGTH], after), (raw[:, 24 + LENGTH :], before)):
        rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))
        order = multikey_order(rows)
        sides.append((order, common_prefixes(rows, sizes, order)))
    again = np.zeros((n, WINDOW + 2), bool)  # by bytes before the anchor, with an empty column at either end
    for o in range(WINDOW):
        valid = np.flatnonzero((before >= o) & (after >= LENGTH - o))
        if len(valid) < 2:
            continue
        key = np.zeros(n, np.int64)
        for (order, shared), size in zip(sides, (LENGTH - o, o), strict=True):
            number = np.zeros(n, np.int64)
            number[order] = np.cumsum(shared < size)
            key = key * (n + 1) + number
        _, earliest = np.unique(key[valid], return_index=True)
        again[valid, o + 1] = True
        again[valid[earliest], o + 1] = False
    step = np.diff(again.astype(np.int8), axis=1)
    who, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)  # a run of strings low .. high - 1
    return pa.table({"rid": pa.array(rid[who], pa.int64()), "v": pa.array(removed(at[who] - (high - 1), LENGTH + high - 1 - low), pa.int64())})


def sampled_splitters(keyed: DataFrame, buckets: int) -> np.ndarray:
    """Leading tokens that cut what is sampled into even parts; the sample is of bounded size."""
    kind = f"S{GRAM}"  # bytes in their order; zeros at the end don't count, which only keeps tokens together
    rows = keyed.count()
    if rows == 0:
        return np.zeros(0, kind)

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in columns_of(batches, 64):
            out = []
            for text in x["text"]:
                data = (text or "").encode("utf-8", "surrogatepass")
                if len(data) >= LENGTH:
                    at = np.concatenate([low + anchors([(part, a, b)])[1] for part, a, b, low in pieces_of(data)])
                    out += [data[k : k + GRAM] for k in at[:: max(1, len(at) // SAMPLE_EACH)].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["lead"])

    share = min(1.0, SAMPLE_ROWS / rows)
    drawn = keyed.where(F.xxhash64(ROW_ID).bitwiseAND(F.lit((1 << 30) - 1)) < int(share * (1 << 30))).select("text")
    found = np.array(sorted(bytes(r.lead) for r in drawn.mapInArrow(leads, "lead binary").collect()), kind)
    return np.unique(found[np.arange(1, buckets) * len(found) // buckets]) if len(found) else found


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed runs, start and end in bytes).

    Null text is empty; documents under LENGTH bytes lose nothing. A null doc_id counts as the smallest, and rows that
    share a doc_id come in the order of the table, so of repeated rows the later lose what the first keeps.
    """
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(4 * shuffle_partitions(spark), total // BUCKET_BYTES)
    keyed = with_row_id(docs.select("doc_id", "text")).select(ROW_ID, F.col("doc_id").cast("long").alias("doc_id"), "text")
    blobs = keyed.mapInArrow(anchor_blobs(buckets), "bucket int, known boolean, blob binary")
    first = blobs.groupBy("bucket").applyInArrow(compare_contexts, "rid long, v long")
    gather = lambda df: df.groupBy("rid").agg(F.collect_list("v").alias("vs")).withColumnRenamed("rid", ROW_ID)  # noqa: E731  within one document
    asked = keyed.join(gather(first), ROW_ID, "left")
    suffixes = asked.mapInArrow(suffix_blobs(sampled_splitters(keyed, buckets)), "bucket int, blob binary")
    second = suffixes.groupBy("bucket").applyInArrow(compare_suffixes, "rid long, v long")
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"
    schema = arrow_schema(ddl)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in columns_of(batches, 256):
            out: list[list] = [[] for _ in schema]
            for did, text, numbers in zip(x["doc_id"], x["text"], x["vs"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                runs: list[list[int]] = []
                for v in sorted(v for v in numbers or () if v >= 0):
                    a, b = v >> 9, (v >> 9) + (v & 511)
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                row = (did, len(data), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [{"start": a, "stop": b} for a, b in runs])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return keyed.join(gather(first.unionByName(second)), ROW_ID, "left").mapInArrow(cut, ddl)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(read_table(spark, sf_dir, "documents")).drop("spans")
