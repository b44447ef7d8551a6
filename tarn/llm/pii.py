"""Information-theoretic sanitisation of personal data.

Base spans (email, ip, card, phone) are the protected entities. A term in a document with an entity may give it away; how
strongly is estimated from the corpus: with n documents, PMI(e; t) = log2(n_et * n / (n_e * n_t)), at most IC(e) = log2(n / n_e),
where t says as much as e itself. A term that reaches GENERALISE of IC(e) over at least SUPPORT documents is generalised,
one that reaches REMOVE of it is removed. All counts are of whole documents, outside base spans.

Most entities occur once or twice. A pair of fewer than SUPPORT documents is judged by pooled evidence instead: the PMI of
the term with the entity's kind and, for an email, its domain, over at least SUPPORT documents and smoothed towards
independence by SUPPORT documents more. A flagged term is replaced wherever it stands in the documents that hold the entity.
A term's document count is taken over all documents, in a second pass that a Bloom filter of the terms in question (of fixed
size) keeps small.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import ROW_ID, checkpoint, compact, free_name, map_columns, read_table, stable, with_row_id

KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")
LEAST_LETTERS = 3
SUPPORT, GENERALISE, REMOVE = 3, 0.6, 0.9
#: Bits of the filter of terms; fixed, 2 MB. A fuller filter counts terms in vain, but no term is missed.
TERM_BITS = 1 << 24
#: Distinct words that a worker counts before it hands them on, and code points that a task counts.
COUNTED_WORDS, COUNTED_SIZE = 1 << 17, 1 << 28

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(rf"[^\W\d_]{{{LEAST_LETTERS},}}")

Span = tuple[int, int, int]  # start, place in KINDS, end


def emails(text: str) -> list[Span]:
    """From each @ leftwards, in time linear in the text."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            found.append((start, 0, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    return found


def luhn(digits: str) -> bool:
    return sum(n if k % 2 == 0 else sum(divmod(2 * n, 10)) for k, n in enumerate(map(int, reversed(digits)))) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def base_spans(text: str) -> list[Span]:
    found = emails(text) if "@" in text else []
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


def key_of(name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), 42) - (1 << 63)


def entities(text: str, base: list[Span]) -> list[tuple[int, int, int | None]]:
    """The distinct (entity, kind, domain) of the base spans, as hashes; an entity is one of kind and value, a domain is an email's."""
    found = {}
    for a, kind, b in base:
        value = text[a:b].lower() if kind == 0 else digits_of(text[a:b]) if kind > 1 else text[a:b]
        found[key_of(f"{kind}:{value}")] = (key_of(f"kind {kind}"), key_of(f"domain {value.rpartition('@')[2]}") if kind == 0 else None)
    return [(e, *classes) for e, classes in found.items()]


def free_terms(text: str, base: list[Span]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the terms of the whole text that touch no base span."""
    ends = np.maximum.accumulate([b for _, _, b in base]).tolist() if base else []
    starts = [a for a, _, _ in base]
    k = 0
    for m in TERM.finditer(text):
        while k < len(starts) and starts[k] < m.end():  # spans that begin before the term's end
            k += 1
        if k == 0 or ends[k - 1] <= m.start():
            yield m[0].lower(), m.start(), m.end()


def detect(docs: DataFrame) -> DataFrame:
    """A row per row of docs: __row_id, doc_id, size (code points), base (array of start, kind, end), held (array of entity, kind, domain) and,
    where an entity is held, free (array of term, start, stop)."""

    def run(rows: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for x in rows:
            texts = [t or "" for t in x["text"]]
            base = [base_spans(t) for t in texts]
            held = [[dict(zip(("entity", "kind", "domain"), e, strict=True)) for e in entities(t, b)] for t, b in zip(texts, base, strict=True)]
            free = [[dict(zip(("term", "start", "stop"), w, strict=True)) for w in free_terms(t, b)] if b else [] for t, b in zip(texts, base, strict=True)]
            yield {ROW_ID: x[ROW_ID], "doc_id": x["doc_id"], "size": list(map(len, texts)), "base": [[{"start": a, "kind": k, "stop": b} for a, k, b in spans] for spans in base], "held": held, "free": free}

    ddl = f"{ROW_ID} long, doc_id long, size int, base array<struct<start:int,kind:int,stop:int>>, held array<struct<entity:long,kind:long,domain:long>>, free array<struct<term:string,start:int,stop:int>>"
    return map_columns(with_row_id(docs.select("doc_id", "text")), run, ddl)


def term_counts(docs: DataFrame, terms: DataFrame, tasks: int) -> DataFrame:
    """term, n_t: the number of rows of docs that hold each of terms (a column term, distinct) outside base spans.

    tasks: at most so many, since each gives a row for each term that it has seen.
    """
    hashes = [F.xxhash64("term"), F.shiftrightunsigned(F.xxhash64("term"), 32)]
    at = terms.select(F.explode(F.array(*[h.bitwiseAND(F.lit(TERM_BITS - 1)) + 1 for h in hashes])).alias("b"))
    maps = at.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
    bits = np.zeros((TERM_BITS // 32768, 4096), np.uint8)
    for row in maps.collect():  # at most TERM_BITS bits
        bits[row.k - 1] = np.frombuffer(row.m, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def count(rows: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        on, counts = held.value, Counter()
        seen: dict[str, bool] = {}
        mask, digest = TERM_BITS - 1, xxhash.xxh64_intdigest
        for x in rows:
            for text in x["text"]:
                text = text or ""
                base = base_spans(text)
                for w in {w for w, _, _ in free_terms(text, base)} if base else set(map(str.lower, TERM.findall(text))):
                    ok = seen.get(w)
                    if ok is None:
                        h = digest(w.encode("utf-8", "surrogatepass"), 42)
                        a, b = h & mask, h >> 32 & mask
                        ok = bool(on[a >> 3] >> (a & 7) & on[b >> 3] >> (b & 7) & 1)
                        if len(seen) >= COUNTED_WORDS:
                            seen.clear()
                        seen[w] = ok
                    if ok:
                        counts[w] += 1
            if len(counts) >= COUNTED_WORDS:
                yield {"term": list(counts), "n": list(counts.values())}
                counts = Counter()
        yield {"term": list(counts), "n": list(counts.values())}

    return map_columns(docs.select("text").coalesce(tasks), count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t")).join(terms, "term", "left_semi")


def terms_by_key(detected: DataFrame) -> DataFrame:
    """__row_id, key, term of each document's entities and classes (kinds, domains) in at least SUPPORT documents; less can't be judged by itself."""
    keys = detected.where(F.size("held") > 0).select(ROW_ID, F.explode(F.expr("array_distinct(filter(flatten(transform(held, x -> array(x.entity, x.kind, x.domain))), x -> x is not null))")).alias("key"))
    known = keys.groupBy("key").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= SUPPORT)
    own = keys.join(known, "key").groupBy(ROW_ID).agg(F.collect_list(F.struct("key", "n_e")).alias("keys"))  # within one document
    terms = detected.where(F.size("held") > 0).select(ROW_ID, F.expr("array_distinct(transform(free, x -> x.term))").alias("terms")).join(own, ROW_ID)
    return terms.select(ROW_ID, F.explode("keys").alias("k"), "terms").select(ROW_ID, "k.*", F.explode("terms").alias("term"))


def disclosing(docs: DataFrame, detected: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """key, term, own, pooled of the pairs over at least support documents: 4 generalised, 5 removed, 0 neither, as an
    entity's own pair and, smoothed, as a class's."""
    pairs = terms_by_key(detected).groupBy("key", "term").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e")).where(F.col("n_et") >= support)
    n, size = detected.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    pairs = checkpoint(pairs, n)
    if pairs.isEmpty():
        return pairs.select("key", "term", F.lit(0).alias("own"), F.lit(0).alias("pooled"))
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, size // COUNTED_SIZE)
    found, n = pairs.join(term_counts(docs, pairs.select("term").distinct(), tasks), "term"), float(n)
    ic = F.log2(F.lit(n) / F.col("n_e"))

    def judged(more: int):
        n_et, n_t = F.col("n_et") + more * F.col("n_e") / n, F.col("n_t").cast("double") + more
        pmi = F.log2(n_et * n / (F.col("n_e") * n_t))
        return F.when((ic <= 0) | (pmi < generalise * ic), 0).when(pmi >= remove * ic, 5).otherwise(4)

    found = checkpoint(found.select("key", "term", judged(0).alias("own"), judged(support).alias("pooled")), int(n))
    # a pair that is neither still keeps its classes' word from counting, but only for terms that some pair flags
    return found.join(found.where("own > 0 or pooled > 0").select("term").distinct(), "term", "left_semi")


def marked(detected: DataFrame, judged: DataFrame) -> DataFrame:
    """__row_id, term, kind of the terms to replace in each document: an entity's own pair counts where it is judged, else its classes' pairs."""
    hits = terms_by_key(detected).join(judged, ["key", "term"]).select(ROW_ID, "key", "term", "own", "pooled")
    held = detected.where(F.size("held") > 0).select(ROW_ID, F.explode("held").alias("h")).select(ROW_ID, "h.*")
    own = held.select(ROW_ID, "entity").join(hits.select(ROW_ID, F.col("key").alias("entity"), "term", "own"), [ROW_ID, "entity"])
    classes = held.select(ROW_ID, "entity", F.explode(F.array("kind", "domain")).alias("key")).where("key is not null")
    pooled = classes.join(hits.where("pooled > 0").select(ROW_ID, "key", "term", "pooled"), [ROW_ID, "key"])
    both = own.select(ROW_ID, "entity", "term", "own", F.lit(0).alias("pooled")).unionByName(pooled.select(ROW_ID, "entity", "term", F.lit(None).cast("int").alias("own"), "pooled"))
    kinds = both.groupBy(ROW_ID, "entity", "term").agg(F.coalesce(F.max("own"), F.max("pooled")).alias("kind"))
    return kinds.where("kind > 0").groupBy(ROW_ID, "term").agg(F.max("kind").alias("kind"))


def sanitising_spans(docs: DataFrame) -> DataFrame:
    """A row per row of docs: __row_id, doc_id, base and more (arrays of start, kind, stop), more being terms to generalise or remove.

    A null text is empty, a term that two entities ask for is removed if either says so. An empty table gives no rows.
    """
    rows = docs.count()
    detected = checkpoint(detect(docs), rows, docs)
    judged = checkpoint(disclosing(docs, detected), rows)
    free = detected.where(F.size("held") > 0).select(ROW_ID, F.explode("free").alias("x")).select(ROW_ID, "x.*")
    more = free.join(marked(detected, judged), [ROW_ID, "term"])
    more = more.groupBy(ROW_ID).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop"))).alias("more"))  # within one document
    return detected.select(ROW_ID, "doc_id", "base").join(more, ROW_ID, "left")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitising_spans(read_table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")
    more = F.coalesce("more", F.expr("cast(array() as array<struct<start:int,kind:int,stop:int>>)"))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.array_sort(F.concat("base", more))).alias("spans"), F.size(more).cast("long").alias("n_terms"))


def sanitised(text: str, spans: list[Span]) -> str:
    """text with its spans replaced; spans that overlap are replaced as one, by the label of the first."""
    out, end = [], 0
    for a, k, b in sorted(spans):
        if a >= end:
            out += [text[end:a], LABELS[k]]
            end = b
        else:
            end = max(end, b)
    return "".join(out) + text[end:]


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data and disclosing terms replaced in text, and n_chars brought up to date where it is there.

    Texts without @ and digits hold none and go straight through, null and empty ones among them; only the others meet the spans. Repeated
    rows are replaced alike, other columns stay as they are, whatever their names. An empty table gives no rows.
    """
    docs = stable(docs)
    names, schema = docs.columns, docs.schema
    row, spans, may = (free_name(docs, c) for c in ("__row", "__spans", "__may"))
    found = sanitising_spans(docs).where(F.size("base") > 0)
    found = found.select(F.col(ROW_ID).alias(row), F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<start:int,kind:int,stop:int>>)"))).alias(spans))
    rows = with_row_id(docs, row).withColumn(may, F.coalesce(F.col("text").rlike("[@0-9]"), F.lit(False)))
    clean = rows.where(~F.col(may)).drop(row, may)

    def put(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for x in batches:
            new = [sanitised(t, [(s["start"], s["kind"], s["stop"]) for s in own or ()]) for t, own in zip(x["text"], x[spans], strict=True)]
            sizes = {"n_chars": [n if own is None else len(t) for t, own, n in zip(new, x[spans], x["n_chars"], strict=True)]} if "n_chars" in names else {}
            yield {c: x[c] for c in names} | {"text": new} | sizes

    return compact(clean.unionByName(map_columns(rows.where(may).drop(may).join(found, row, "left").drop(row), put, schema)), docs.count(), docs)
