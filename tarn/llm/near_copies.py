"""SimHash near-dedup at a similarity: rows whose sets of five-word shingles have a Jaccard similarity of at least LEAST.

At this similarity two SimHash fingerprints differ in too many bits for shards of agreeing bits, so the BK-trees are sharded
otherwise, without losing a pair: with shingles in one fixed order, two sets of similarity t share one of the first
n - ceil(t n) + 1 shingles of each, so a shard is the rows that have one shingle there. Of the first shingle that two sets share
more is known: in the smaller set it is even among the first n - ceil(2 t n / (1 + t)) + 1 ("short"; in both, if they are of one
size). Shards without a short row are none. Frequent shingles (by a sample) come
last in the order, which keeps boilerplate out of the shards; the order changes the work, never the result.

1. In each shard a row meets its leader, the least node: first in a task, then the tasks' leaders among each other, so that a
   shingle that a third of all rows have is one row per task. Of each row's leaders that are within RADIUS of its fingerprint,
   the one met most often is compared with it in full. What is similar forms components.
2. Shards whose rows are in several components are searched again: the distinct fingerprints of a shard are a BK-tree, in which each row
   outside the largest component looks for those of other components within RADIUS. First only
   the nearest one is compared in full, which joins most of what belongs together, then, of the components that are left,
   all that are within RADIUS.

Besides, the parity of a set's shingles in each of 768 buckets differs in at most as many bits as two sets differ in shingles, which
similar sets bound; that tells sets apart that are alike but not enough, before any text is read. A fingerprint has 128 bits; RADIUS is five standard deviations over the distance that sets of similarity LEAST have (the
chance that it hides such a pair is below one in a million), while sets that share nothing are three below theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.bk_tree import BKForest, bits_between
from tarn.llm.common import ROW_ID, arrow_schema, checkpoint, columns_of, kept, map_columns, shuffle_partitions, with_row_id
from tarn.llm.components import again, connected_components

SEED = 42
#: Words of a shingle; similarity as a fraction; differing bits of fingerprints.
SHINGLE, LEAST, RADIUS = 5, (4, 5), 46
#: Rows that the order is drawn from (by hash), its buckets, and from how many of them on a bucket is frequent.
SAMPLED, ORDER_BITS, FREQUENT = 1 << 11, 22, 4
#: Bits of the filter of rows whose texts are compared; fixed, 2 MB. A fuller filter shuffles texts in vain, but no pair is missed.
ROW_BITS = 1 << 24
#: Entries that a task holds before it hands them on, and about how many a bucket gets.
FLUSH, BUCKET_ENTRIES = 1 << 19, 1 << 21
#: Words whose hashes a worker keeps; shingles whose bits are counted at once.
KEPT_WORDS, COUNT_ROWS = 1 << 16, 1 << 15
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
PAIR, ENTRY = 1, 2
#: Columns of a node's fingerprint and parity.
PRINT, PARITY = ("f0", "f1"), tuple(f"p{k}" for k in range(12))
BITS = PRINT + PARITY
#: Pairs that are looked at together.
PAIRS_AT_ONCE = 1 << 19


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case (bytes.lower and bytes.split know ASCII only)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 of the shingles as they come; all words are one shingle where there are no more, no words give none."""
    words = words_of(text)
    if not words:
        return []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(line[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


class WordHashes(dict):
    """Words to their hashes; keeps those of words seen so far."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of the shingles, sorted. Texts without a word share one shingle, so that they are copies of each other."""
    words, known = words_of(text), kept(("word hashes",), WordHashes)
    if len(known) > KEPT_WORDS:
        known.clear()
    own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(len(own), SHINGLE)
    n = len(own) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += own[k : k + n] * FACTORS[k]
    return np.unique(mixed(total))


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """128 bits, as two signed numbers; a bit is 1 if set in over half of the hashes."""
    counts = np.zeros(128, np.int64)
    for at in range(0, len(found), COUNT_ROWS):
        part = found[at : at + COUNT_ROWS]
        both = np.stack([part, mixed(part * FACTORS[0])], axis=1)
        counts += np.unpackbits(both.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint32)
    a, b = np.packbits(counts * 2 > len(found)).view(np.int64).tolist()
    return a, b


def parity(found: np.ndarray) -> list[int]:
    """Whether each of 768 buckets has an odd number of the hashes, as signed numbers."""
    odd = np.bincount((found % np.uint64(64 * len(PARITY))).astype(np.int64), minlength=64 * len(PARITY)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def may_differ(total: np.ndarray) -> np.ndarray:
    """In how many shingles two sets of total shingles together may differ and be similar enough."""
    a, b = LEAST
    return total - 2 * ((a * total + a + b - 1) // (a + b))


def prefix(found: np.ndarray, buckets: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order (rank of the bucket, hash), as tokens whose last bit is 0 where they are short."""
    n, (a, b) = len(found), LEAST
    size, short = n - (a * n + b - 1) // b + 1, n - (2 * a * n + a + b - 1) // (a + b) + 1
    if len(buckets):
        own = (found & np.uint64((1 << ORDER_BITS) - 1)).astype(np.int64)
        at = np.minimum(np.searchsorted(buckets, own), len(buckets) - 1)
        rank = np.where(buckets[at] == own, ranks[at], 0)
        found = found[np.argsort(rank, kind="stable")]
    return (found[:size] & ~np.uint64(1)) | (np.arange(size) >= short).astype(np.uint64)


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    (a, b), both = LEAST, len(np.intersect1d(s, t, assume_unique=True))
    return b * both >= a * (len(s) + len(t) - both)


def frequent_buckets(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of shingles that many rows have, sorted, and their ranks: the bit lengths of their counts."""
    share = min(1.0, SAMPLED / max(1, docs.count()))
    drawn = docs.select("text").where(F.xxhash64("text").bitwiseAND(F.lit((1 << 30) - 1)) < int(share * (1 << 30)))

    def count(rows: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for x in rows:
            own = [np.unique(shingle_set(t) & np.uint64((1 << ORDER_BITS) - 1)) for t in x["text"]]
            bucket, n = np.unique(np.concatenate(own), return_counts=True)
            yield {"bucket": bucket.astype(np.int64), "n": n}

    found = map_columns(drawn, count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy("bucket").toPandas()
    return found["bucket"].to_numpy(np.int64), np.array([int(n).bit_length() for n in found["n"]], np.int64)


def led(token: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries: those of the leaders (the least short node of each token, or the least), the pairs (row, leader) of tokens that have a
    short row, and all entries of tokens that have several nodes."""
    order = np.lexsort((node, token))  # short ones come first in a token
    token, node = token[order], node[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node = token[new], node[new]
    head = np.ones(len(token), bool)
    head[1:] = (token[1:] ^ token[:-1]) & ~1 != 0
    cuts = np.flatnonzero(head)
    sizes = np.diff(np.append(cuts, len(token)))
    first, several = np.repeat(cuts, sizes), np.repeat(sizes > 1, sizes)
    met = ~head & (token[first] & 1 == 0)
    pairs = np.unique(np.stack([node[met], node[first[met]]]), axis=1) if met.any() else np.zeros((2, 0), np.int64)
    return np.stack([token[head], node[head]]), pairs, np.stack([token[several], node[several]])


def to_blob(both: np.ndarray) -> bytes:
    return np.ascontiguousarray(both, "<i8").tobytes()


def from_blobs(blobs: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros((2, 0), np.int64), *(np.frombuffer(b, "<i8").reshape(2, -1) for b in blobs)], axis=1)


def entry_blobs(order, buckets: int):
    """Documents to rows bucket, kind, blob: leaders' entries by bucket (kind 0), and what is known in the task already."""
    schema = arrow_schema("bucket int, kind int, blob binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        held, spread = 0, TaskContext.get().partitionId() * 31

        def flush() -> pa.RecordBatch:
            nonlocal held, spread
            own, pairs, shared = led(np.concatenate(tokens), np.concatenate(nodes))
            tokens.clear()
            nodes.clear()
            held = 0
            bucket = (own[0].view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            own, bucket = own[:, by], bucket[by]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
            out = [(int(bucket[a]), 0, to_blob(own[:, a:b])) for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]
            for kind, both in ((PAIR, pairs), (ENTRY, shared)):
                for at in range(0, both.shape[1], 1 << 16):
                    spread += 1
                    out.append((spread % buckets, kind, to_blob(both[:, at : at + (1 << 16)])))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for x in columns_of(batches, 256):
            for text in x["text"]:
                found = shingle_set(text)
                own = prefix(found, *order.value).view(np.int64)
                tokens.append(own)
                nodes.append(np.full(len(own), node_of(found)))
                held += len(own)
                if held >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    return run


def meet(table: pa.Table) -> pa.Table:
    """A bucket's rows kind, a, b: pairs (row, leader), and entries (token, node) of shared tokens."""
    kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
    own, known_pairs, known = (from_blobs([b for b, k in zip(blobs, kinds, strict=True) if k == kind]) for kind in (0, PAIR, ENTRY))
    _, pairs, shared = led(*own)
    tokens = shared[0] & ~1
    shared = shared[:, np.isin(tokens, tokens[shared[0] & 1 == 0])]  # leaders are short where any row is
    parts = [(PAIR, pairs), (PAIR, known_pairs), (ENTRY, shared), (ENTRY, known)]
    a, b = np.concatenate([both for _, both in parts], axis=1)
    return pa.table({"kind": pa.array(np.repeat([k for k, _ in parts], [both.shape[1] for _, both in parts]), pa.int32()), "a": pa.array(a), "b": pa.array(b)})


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that are sorted by token, in pieces that cut no token's run, and where the runs begin and end in each."""
    held: list[pa.RecordBatch] = []

    def piece() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        token = table.column("token").to_numpy()
        return table, np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column("token").to_numpy()
        last = held[-1].column("token")[-1].as_py() if held else None
        cut = int(np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))[-1])  # where the last run begins
        if cut or (last is not None and last != token[0]):
            if cut:
                held.append(batch.slice(0, cut))
            yield piece()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield piece()


def search(cuts: np.ndarray, node: np.ndarray, size: np.ndarray, prints: np.ndarray, odd: np.ndarray, comp: np.ndarray, late: np.ndarray, nearest: bool) -> np.ndarray:
    """Pairs (greater, smaller node) of rows of one shard, but of two components, whose sizes, fingerprints and parities allow the similarity.

    cuts: where the shards begin, and the end of the last. late: rows that are not short. nearest: only the nearest one of each row that looks, which any row does that
    is not in its shard's largest component. A shard's distinct fingerprints are a BK-tree.
    """
    (a, b), n = LEAST, len(node)
    shard = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    order = np.lexsort((prints[:, 1], prints[:, 0], shard))
    node, size, prints, odd, comp, late = (x[order] for x in (node, size, prints, odd, comp, late))
    new = np.append(True, (shard[1:] != shard[:-1]) | (prints[1:] != prints[:-1]).any(axis=1))
    firsts = np.flatnonzero(new)  # rows of equal fingerprints are one node of the tree
    many = np.diff(np.append(firsts, n))
    trees = BKForest(shard[firsts], prints[firsts])
    # the largest component of each shard is only looked up, so that its rows aren't compared with each other
    by = np.lexsort((comp, shard))
    head = np.flatnonzero(np.append(True, (comp[by][1:] != comp[by][:-1]) | (shard[by][1:] != shard[by][:-1])))
    counts = np.diff(np.append(head, n))
    best = np.lexsort((-counts, shard[by][head]))
    best = best[np.append(True, np.diff(shard[by][head][best]) > 0)]
    asks = np.flatnonzero(comp != comp[by][head][best][shard])
    upto, out, at = np.cumsum(np.diff(cuts)[shard[asks]]), [], 0
    while at < len(asks):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        own = asks[at:end]
        i, j, apart = trees.within(prints[own], trees.roots[shard[own]], RADIUS)
        sizes = many[j]
        i, apart = np.repeat(own[i], sizes), np.repeat(apart, sizes)
        j = np.repeat(firsts[j] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(i))
        on = (comp[i] != comp[j]) & (b * np.minimum(size[i], size[j]) >= a * np.maximum(size[i], size[j]))
        on &= ~((late[i] & (size[i] <= size[j])) | (late[j] & (size[j] <= size[i])))
        i, j, apart = i[on], j[on], apart[on]
        on = bits_between(odd[i], odd[j]) <= may_differ(size[i] + size[j])
        i, j, apart = i[on], j[on], apart[on]
        if nearest:
            by = np.lexsort((node[j], apart, i))
            i, j = i[by], j[by]
            on = np.append(True, i[1:] != i[:-1])[: len(i)]
            i, j = i[on], j[on]
        u, v = node[i], node[j]
        out.append(np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1))
        at = end
    return np.unique(np.concatenate([np.zeros((2, 0), np.int64), *out], axis=1), axis=1)


def searched(shards: DataFrame, nearest: bool) -> DataFrame:
    """shards: token, node, size, BITS, comp, late, by token. Returns u > v of the pairs of two components that may be similar, or the nearest."""
    schema = arrow_schema("u long, v long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 0), np.int64)
        for table, cuts in whole_runs(batches):
            node, size, comp, late = (table.column(c).to_numpy().astype(np.int64) for c in ("node", "size", "comp", "late"))
            prints, odd = (np.stack([table.column(c).to_numpy().view(np.uint64) for c in names], axis=1) for names in (PRINT, PARITY))
            found = np.unique(np.concatenate([found, search(cuts, node, size, prints, odd, comp, late > 0, nearest)], axis=1), axis=1)
            if found.shape[1] >= FLUSH:  # a pair is found in many shards, of which a task has several
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)
                found = found[:, :0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)

    return shards.mapInArrow(run, "u long, v long").distinct()


def verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough. pairs is a checkpoint; of each node's rows one text is read."""
    asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    rep = rows.select(ROW_ID, "node").join(asked, "node", "left_semi").groupBy("node").agg(F.min(ROW_ID).alias(ROW_ID))
    bit = F.pmod(F.xxhash64(ROW_ID), F.lit(ROW_BITS))
    maps = rep.select((bit + 1).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
    on = np.zeros((ROW_BITS // 32768, 4096), np.uint8)
    for r in maps.collect():  # at most ROW_BITS bits
        on[r.k - 1] = np.frombuffer(r.m, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(on.tobytes())

    def texts(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        data = held.value
        for x in batches:
            own = [x["text"][k] for k, b in enumerate(x["bit"]) if data[b >> 3] >> (b & 7) & 1]
            yield {"node": [node_of(shingle_set(t)) for t in own], "text": own}

    # a row that the filter lets through in vain has its own right node, so it only repeats pairs
    found = map_columns(with_row_id(docs.select("text")).withColumn("bit", bit), texts, "node long, text string")

    def compare(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        last, t = None, None
        for x in batches:
            out = []
            for k, (v, p, q) in enumerate(zip(x["v"], x["p"], x["q"], strict=True)):
                if t is None or v != last:
                    last, t = v, shingle_set(q)
                if similar(shingle_set(p), t):
                    out.append(k)
            yield {c: [x[c][k] for k in out] for c in ("u", "v")}

    side = lambda c, text: found.select(F.col("node").alias(c), F.col("text").alias(text))
    both = pairs.select("u", "v").join(side("u", "p"), "u").join(side("v", "q"), "v")
    return map_columns(both.select("u", "v", "p", "q"), compare, "u long, v long", rows=128).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """A row per row of docs (which is stable): __row_id, doc_id, component_id, keep_row, as of simhash.near_dedup.

    Rows of equal sets are one node, by a 64-bit hash of the set.
    """
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(frequent_buckets(docs))

    def describe(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for x in batches:
            sets = [shingle_set(t) for t in x["text"]]
            bits = [(*fingerprint(s), *parity(s)) for s in sets]
            yield {ROW_ID: x[ROW_ID], "doc_id": x["doc_id"], "node": [node_of(s) for s in sets], "size": [len(s) for s in sets]} | {c: [v[k] for v in bits] for k, c in enumerate(BITS)}

    rows = map_columns(with_row_id(docs.select("doc_id", "text")), describe, f"{ROW_ID} long, doc_id long, node long, size int, {', '.join(f'{c} long' for c in BITS)}", rows=256)
    rows = checkpoint(rows, docs.count(), docs)
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    most = total // LEAST[1] + n  # entries
    buckets = max(shuffle_partitions(spark), most // BUCKET_ENTRIES)
    found = docs.select("text").mapInArrow(entry_blobs(order, buckets), "bucket int, kind int, blob binary").groupBy("bucket").applyInArrow(meet, "kind int, a long, b long")
    found = checkpoint(found, most)

    # one row per node; what else is known of it is the same in all its rows
    nodes = rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", *BITS)))
    led_by = found.where(F.col("kind") == PAIR).groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.count("*").alias("met"))
    side = lambda c: nodes.select(F.col("node").alias(c), F.struct("size", *BITS).alias(f"n_{c}"))
    bits_in = lambda names: " + ".join(f"bit_count(n_u.{c} ^ n_v.{c})" for c in names)
    (least, of), both = LEAST, "(n_u.size + n_v.size)"
    may = f"""{of} * least(n_u.size, n_v.size) >= {least} * greatest(n_u.size, n_v.size) and {bits_in(PRINT)} <= {RADIUS}
        and {bits_in(PARITY)} <= {both} - 2 * (({least} * {both} + {least + of - 1}) div {least + of})"""
    compared = checkpoint(led_by.join(side("u"), "u").join(side("v"), "v").where(F.expr(may)).groupBy("u").agg(F.max_by("v", F.struct("met", "v")).alias("v")), n)
    joined = connected_components(verified(docs, rows, compared))

    entries = found.where(F.col("kind") == ENTRY).select(F.col("a").bitwiseAND(F.lit(-2)).alias("token"), F.col("b").alias("node"), F.col("a").bitwiseAND(F.lit(1)).alias("late")).distinct()
    for nearest in (True, False):
        owned = entries.join(joined, "node", "left").select("token", "node", "late", F.coalesce("root", "node").alias("comp"))
        open_tokens = owned.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("late").alias("late")).where("low <> high and late = 0").select("token")
        shards = owned.join(open_tokens, "token").join(nodes, "node")
        # not by token itself: Spark would leave this shuffle out where a join has dealt by token, and then read that join's parts as it likes
        shards = shards.repartition(shuffle_partitions(spark), again("token")).sortWithinPartitions("token", "comp", "node")
        more = checkpoint(searched(shards, nearest).join(compared, ["u", "v"], "left_anti"), n)
        if not more.isEmpty():
            links = joined.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(verified(docs, rows, more))
            joined = connected_components(links)
            compared = compared.select("u", "v").unionByName(more)
    rooted = rows.select(ROW_ID, "doc_id", "node").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("d"), F.col(ROW_ID).alias("r"))
    tops = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(order).alias("keep"))
    return rooted.join(tops, "root").select(ROW_ID, "doc_id", "component_id", F.col("keep.r").alias("keep_row"))
