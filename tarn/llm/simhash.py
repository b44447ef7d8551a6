"""SimHash near-dedup: 64-bit fingerprints, linked within a Hamming radius through BK-trees.

A BK-tree keys a node's children by their integer Hamming distance to it; a search with radius r follows only the
edges d - r .. d + r. Over one tree for all fingerprints that prunes little (random distances crowd around 32), so the
tree is sharded without losing a pair: the 64 bits are cut into BLOCKS blocks, and two fingerprints that differ in at
most r bits agree in at least BLOCKS - r of them. A shard holds the fingerprints that agree in one choice of that many
blocks. Shard trees grow with the corpus, so they are not broadcast: each is built where its fingerprints shuffle to,
and that task searches it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.bk_tree import BKTree
from tarn.llm.common import ROW_ID, arrow_schema, checkpoint, map_columns, read_table, stable, with_row_id, without_rows
from tarn.llm.components import again, connected_components
from tarn.llm.near_copies import near_copies, shingle_hashes

SHINGLE, RADIUS, BLOCKS = 3, 3, 5
#: Shingles whose bits are counted at once.
COUNT_ROWS = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    h = np.array(shingle_hashes(text, shingle), dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), COUNT_ROWS):
        bits = np.unpackbits(h[at : at + COUNT_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little")


def shard_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks of the bits that a shard's fingerprints agree in."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def links_of_run(prints: list[int], nodes: list[int], radius: int) -> tuple[list[int], list[int]]:
    """Edges that join what is within the radius in one shard: a spanning forest, not all pairs."""
    tree, top = BKTree(), list(range(len(prints)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    u, v = [], []
    for k, value in enumerate(prints):
        for j in tree.within(value, radius):
            a, b = find(k), find(j)
            if a != b:
                top[a] = b
                u.append(nodes[k])
                v.append(nodes[j])
        tree.add(value)
    return u, v


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """prints: node (long), fp (long, distinct values). Returns edges u, v that connect what chains of links connect."""
    masks = shard_masks(blocks, radius)
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(masks)]))
    shards = prints.select("node", "fp", keys.alias("s")).select("node", "fp", "s.t", "s.key")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = arrow_schema("u long, v long")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the rows of the last shard seen, which may go on in the next batch
        for batch in _with_end(batches):
            if batch is not None:
                cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "fp", "node")]
                if rest is not None:
                    cols = [np.concatenate([a, b]) for a, b in zip(rest, cols, strict=True)]
            elif rest is not None:
                cols = rest
            else:
                return
            t, key, fp, node = cols
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            if batch is not None:
                last = int(cuts[-1]) if len(cuts) else 0
                rest = [c[last:] for c in cols]
                starts, ends = np.concatenate([[0], cuts[:-1]])[: len(cuts)], cuts
            else:
                starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(t)]])
            u, v = [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if b - a > 1:
                    x, y = links_of_run(fp[a:b].view(np.uint64).tolist(), node[a:b].tolist(), radius)
                    u += x
                    v += y
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)

    return shards.repartition(n, "t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(link, "u long, v long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def _fingerprints(rows: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    for x in rows:
        yield {ROW_ID: x[ROW_ID], "doc_id": x["doc_id"], "fp": [signed(fingerprint(t)) for t in x["text"]]}


def near_dedup(docs: DataFrame) -> DataFrame:
    """A row per row of docs: __row_id, doc_id, fp (long), component_id, keep_row.

    component_id is the smallest doc_id reachable through links; rows with a null doc_id link as others do, and a
    component of null doc_ids alone has a null component_id. keep_row is the __row_id that stays for the component.
    Null and empty texts have fingerprint zero. An empty table gives no rows.
    """
    prints = checkpoint(map_columns(with_row_id(docs.select("doc_id", "text")), _fingerprints, f"{ROW_ID} long, doc_id long, fp long"), docs.count(), docs)
    # equal fingerprints are one node, so a large group of copies is one row from here on
    nodes = prints.groupBy("fp").agg(F.min(ROW_ID).alias("node"), F.min("doc_id").alias("least"), F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("d"), F.col(ROW_ID).alias("r"))).alias("keep"))
    joined = connected_components(near_links(nodes.select("node", "fp")))
    rooted = nodes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tops = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("keep").alias("keep")).withColumn("top", again("root")).drop("root")
    named = rooted.select("fp", "root").join(tops, F.col("root") == F.col("top")).select("fp", "component_id", F.col("keep.r").alias("keep_row"))
    return prints.join(named, "fp").select(ROW_ID, "doc_id", "fp", "component_id", "keep_row")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each component of near copies (five words, similarity 0.8): that of the smallest doc_id.

    The three words and three bits above are op3's alone; most pairs of this similarity differ in more bits. Null and empty
    texts are copies of each other; a null doc_id counts as the largest, of rows that share a doc_id one stays. An empty table gives no rows.
    """
    docs = stable(docs)
    gone = near_copies(docs).where(F.col(ROW_ID) != F.col("keep_row")).select(ROW_ID)
    return without_rows(docs, gone)
