import random

import numpy as np
import xxhash

from tarn.llm import near_copies
from tarn.llm import simhash as s
from tarn.llm.bk_tree import BKForest, BKTree
from tarn.llm.common import read_table
from tarn.llm.components import connected_components

from .helpers import documents, odd_rows


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """prints: list of (doc_id, fingerprint)."""
    top = list(range(len(prints)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= s.RADIUS:
                top[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(prints):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return [least.get(find(k)) for k in range(len(prints))]


def test_fingerprint():
    for text in ("", None, "One", "one two", "One two  three", "Ä Ö ü x\x0by\x1cz", "a b c d e f g " * 50, "!!"):
        assert s.fingerprint(text) == plain_fingerprint(text)


def test_bk_tree():
    r = random.Random(1)
    values = [r.getrandbits(16) for _ in range(300)]
    tree = s.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.within(q, 3)) == [k for k, v in enumerate(values) if (q ^ v).bit_count() <= 3]


def test_shards_miss_no_pair():
    r = random.Random(2)
    masks = s.shard_masks()
    for _ in range(500):
        a = r.getrandbits(64)
        b = a
        for _ in range(3):
            b ^= 1 << r.randrange(64)
        assert any((a ^ b) & m == 0 for m in masks)


def test_links_and_components(spark):
    r = random.Random(3)
    prints = []
    for _ in range(30):
        v = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            prints.append(v)
            for _ in range(r.randint(1, 5)):
                v ^= 1 << r.randrange(64)
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(k, s.signed(v)) for k, v in enumerate(prints)], "node long, fp long")
    got = {x.node: x.root for x in connected_components(s.near_links(nodes)).collect()}
    want = plain_components(list(enumerate(prints)))
    assert [got.get(k, k) for k in range(len(prints))] == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    for most in (0, 1000):  # in rounds, and in one task
        got = {x.node: x.root for x in connected_components(edges, most).collect()}
        assert got == dict.fromkeys(range(201), 0) | {500: 500, 501: 500}


def test_components_in_rounds_as_in_one_task(spark):
    r = random.Random(9)
    edges = spark.createDataFrame([(r.randrange(300), r.randrange(300)) for _ in range(160)], "u long, v long")
    one, rounds = ({x.node: x.root for x in connected_components(edges, most).collect()} for most in (1000, 0))
    assert one == rounds
    assert connected_components(edges.where("false")).count() == connected_components(edges.where("false"), -1).count() == 0


def test_whole_table(spark, sf):
    docs = [(r.doc_id, plain_fingerprint(r.text)) for r in read_table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = {d: (f"{v:016x}", c) for (d, v), c in zip(docs, plain_components(docs), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in s.op3_simhash(spark, sf).collect()} == want


def test_odd_rows_and_empty_table(spark, tmp_path):
    docs = documents(spark, odd_rows(), tmp_path / "d")
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in s.near_dedup(docs).collect()), key=str)
    prints = [(r[0], plain_fingerprint(r[1])) for r in odd_rows()]
    assert got == sorted(((d, s.signed(v), c) for (d, v), c in zip(prints, plain_components(prints), strict=True)), key=str)
    kept = s.near_dedup_stage(spark, docs, "")
    assert kept.schema.names == docs.schema.names and kept.count() == s.near_dedup(docs).select("component_id").distinct().count()
    assert s.near_dedup(docs.where("false")).count() == 0


def plain_near_copies(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                top[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(texts))]


def test_stage_joins_all_of_similarity_four_fifths(spark, tmp_path):
    r = random.Random(5)
    texts = []
    for _ in range(25):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randint(3, 150))] + ["the same license line in all of these texts here"]
        for _ in range(r.randint(1, 14)):
            texts.append(" ".join(words))
            for _ in range(r.randint(1, 4)):
                words[r.randrange(len(words))] = f"w{r.randrange(3000)}"
    r.shuffle(texts)
    want = plain_near_copies(texts)
    docs = documents(spark, list(enumerate(texts)), tmp_path / "d")
    assert 40 < len(set(want)) < len(texts) - 40
    assert sorted(x.doc_id for x in s.near_dedup_stage(spark, docs, "").collect()) == sorted(set(want))
    assert s.near_dedup(docs).select("component_id").distinct().count() > len(set(want))  # three bits leave near copies


def test_prefixes_lose_no_pair():
    r, none = random.Random(8), (np.zeros(0, np.int64), np.zeros(0, np.int64))
    ranks = (np.arange(0, 1 << near_copies.ORDER_BITS, 3), np.arange(0, 1 << near_copies.ORDER_BITS, 3) % 5)
    similar = 0
    for _ in range(600):
        n = r.randrange(1, 60)
        both = [r.getrandbits(64) for _ in range(n)]
        sets = [np.unique(np.array(both + [r.getrandbits(64) for _ in range(r.randrange(n // 4 + 1))], np.uint64)) for _ in range(2)]
        if not near_copies.similar(*sets):
            continue
        similar += 1
        for order in (none, ranks):
            p, q = (near_copies.prefix(x, *order) for x in sorted(sets, key=len))
            short = {int(t) >> 1 for t in p if not int(t) & 1}
            assert short & {int(t) >> 1 for t in q}
            if len(sets[0]) == len(sets[1]):
                assert short & {int(t) >> 1 for t in q if not int(t) & 1}
        a, b = (near_copies.parity(x) for x in sets)
        assert sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True)) <= near_copies.may_differ(len(sets[0]) + len(sets[1]))
    assert similar > 100


def test_forest_as_trees_one_by_one():
    r = random.Random(12)
    groups = []
    for _ in range(20):
        base = [r.getrandbits(128) for _ in range(3)]
        own = {r.choice(base) ^ sum(1 << r.randrange(128) for _ in range(r.randrange(30))) for _ in range(r.randint(1, 60))}
        groups.append([x & (1 << 128) - 1 for x in own])
    words = lambda own: np.array([[x & (1 << 64) - 1, x >> 64] for x in own], np.uint64)
    forest = BKForest(np.repeat(np.arange(20), [len(g) for g in groups]), words([x for g in groups for x in g]))
    edges = dict(zip(forest.keys.tolist(), forest.children.tolist(), strict=True))
    for g, (own, root) in enumerate(zip(groups, forest.roots.tolist(), strict=True)):
        tree = BKTree()
        for x in own:
            tree.add(x)
        assert {(root + k) * forest.edges + d: root + child for k, c in enumerate(tree.children) for d, child in c.items()}.items() <= edges.items()
        asked = [x ^ (1 << r.randrange(128)) for x in own]
        for radius in (0, 5, 46, 128):
            asks, nodes, apart = forest.within(words(asked), np.full(len(asked), root), radius)
            got = sorted(zip(asks.tolist(), (nodes - root).tolist(), apart.tolist(), strict=True))
            assert got == sorted((k, j, (x ^ own[j]).bit_count()) for k, x in enumerate(asked) for j in tree.within(x, radius))
    assert len(edges) == sum(map(len, groups)) - 20


def test_search_asks_the_trees_and_finds_all(monkeypatch):
    r = np.random.default_rng(6)
    n, cuts = 120, np.array([0, 50, 51, 120])
    base = r.integers(0, 1 << 63, (12, 2), dtype=np.uint64)
    comp = r.integers(0, 12, n)
    prints = base[comp]
    for _ in range(8):
        prints[np.arange(n), r.integers(0, 2, n)] ^= np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)
    prints[10:14] = prints[10]  # one node of the tree
    comp, node, size, late = comp * 5 + r.integers(0, 4, n), r.permutation(n), r.integers(90, 110, n), r.integers(0, 4, n) == 0
    odd = np.zeros((n, 12), np.uint64)
    depths = []

    def built(self, group, values, init=BKForest.__init__):
        init(self, group, values)
        depths.append(len(set((self.keys // self.edges).tolist())))

    monkeypatch.setattr(BKForest, "__init__", built)
    want = set()
    for a, b in ((0, 50), (51, 120)):
        of = comp[a:b].tolist()
        best = max(sorted(set(of)), key=of.count)
        for i in range(a, b):
            for j in range(a, b):
                bits = sum(int(x ^ y).bit_count() for x, y in zip(prints[i], prints[j], strict=True))
                small = (late[i] and size[i] <= size[j]) or (late[j] and size[j] <= size[i])
                if comp[i] != best and comp[i] != comp[j] and bits <= near_copies.RADIUS and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j]) and not small:
                    want.add((int(max(node[i], node[j])), int(min(node[i], node[j]))))
    got = near_copies.search(cuts, node, size, prints, odd, comp, late, False)
    assert set(zip(*got.tolist(), strict=True)) == want and len(want) > 20
    assert depths and depths[0] > 10  # nodes with children: not the roots alone
