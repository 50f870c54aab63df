"""Near-duplicate groups by an LSH forest over word shingles.

Each distinct text has 128 min-hashes, dealt to 16 trees of depth 8. A tree is a sorted order of the texts by its
eight values. Neighbours in an order whose common prefix is at least `SHALLOW` values long are candidates. Where few
texts share such a prefix all of them meet; where many do, neighbours within `WIDTH` places of the order meet at
first, and those share the longest prefixes: the depth adapts to the region. The texts of such crowded regions are
joined afterwards by an exact prefix filter on their shingles, for links between components; a bound on the shingles
that two texts don't share, from bit sums of either set, drops pairs of texts that are alike but not similar enough
before they become rows. A sketch (one byte of every second min-hash) that travels along drops candidates that cannot
be similar. Of texts that candidates connect within a region each meets the smallest one, its hub, and where that is
not likely similar the likeliest others; all other candidates of a text in a small region are kept in reserve, and
they are tried where it is not in its hub's component after that. So pairs grow with texts and not with the squares
of groups.

Every link is confirmed on the two full shingle sets. Equal texts are one node from the start. Groups are the
connected components of confirmed links, found by min-label propagation with pointer jumping over written tables.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, forget, release, stored

WORDS, PERCENT = 5, 75
TREES, DEPTH, SHALLOW = 16, 8, 3
HASHES = TREES * DEPTH
WIDTH, SMALL = 48, 96  # neighbours that meet in a large region; regions up to this size meet as a whole
MAYBE, LIKELY = 34, 52  # of 64 sketch bytes: four standard errors below 0.75, one above it
HOT = 4096  # rows of a region beyond which it is cut into ranges over several tasks
SUMS = 16  # words of 64 bit sums of a set: the parity of the shingles that fall on each bit
FREQUENT = 1 << 14  # shingles whose number of texts orders them; others come before these
SETS = "doc_id long, n_shingles long, class binary, signature binary, sketch binary"
PAIRS = "a long, b long"
FOUND = "x long, hub long, tries array<long>, partners array<long>"

_random = np.random.default_rng(20240501)
ODD = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
PLACES = _random.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def word_hashes() -> Memo:
    return Memo(lambda w: xxhash.xxh3_64_intdigest(w, 7), 150_000)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only


def shingles(words: list[bytes]) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; fewer words than `WORDS` are one shingle, none are none."""
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 11)] if words else [], np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    s = h[:n] * PLACES[0]
    for j in range(1, WORDS):
        s += h[j : j + n] * PLACES[j]
    return np.unique((s ^ (s >> np.uint64(31))) * MIX)


def signature(s: np.ndarray) -> tuple[bytes, bytes]:
    """(two bytes of each min-hash, one byte of every second)."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(low, (s[i : i + 4096, None] * ODD + ADD).min(axis=0), out=low)
    low = (low ^ (low >> np.uint64(29))) * MIX
    return (low >> np.uint64(48)).astype(">u2").tobytes(), ((low >> np.uint64(40)) & np.uint64(255)).astype(np.uint8)[::2].tobytes()


def sets(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs`; class: 128 bits of the word sequence (null: no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(word_hashes())
        for b in batches:
            n, classes, signatures, sketches = [], [], [], []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                s = shingles(words)
                sig = signature(s) if words else (None, None)
                n.append(len(s))
                classes.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                signatures.append(sig[0])
                sketches.append(sig[1])
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (classes, signatures, sketches))], names=["doc_id", "n_shingles", "class", "signature", "sketch"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SETS)


def met(ids: np.ndarray, sketch: np.ndarray) -> list[tuple[int, int, list[int], list[int]]]:
    """(x, hub, tries, partners) of one region, whose rows are in the order of their tree.

    The hub is the smallest id that x is connected to by candidates. Tries are to be confirmed at first: the hub
    where it may be similar and, where it is not likely to be, the most similar candidate and the most similar one
    that likely is. All candidates of x come along as partners, to be tried if x and its hub turn out to be in
    different components. A crowded region needs none: see across().
    """
    m = len(ids)
    if m <= SMALL:
        alike = (sketch[:, None, :] == sketch[None, :, :]).sum(axis=2)
        i, j = np.nonzero(np.triu(alike >= MAYBE, 1))
    else:
        parts = [(k, np.nonzero((sketch[k:] == sketch[:-k]).sum(axis=1) >= MAYBE)[0]) for k in range(1, min(WIDTH, m - 1) + 1)]
        i = np.concatenate([p for _, p in parts])
        j = np.concatenate([p + k for k, p in parts])
    if not len(i):
        return []
    order = np.argsort(ids, kind="stable")  # row of each rank
    hub = np.empty(m, np.int64)
    hub[order] = np.arange(m)  # ranks of ids
    while True:
        new = hub.copy()
        np.minimum.at(new, i, hub[j])
        np.minimum.at(new, j, hub[i])
        new = np.minimum(new, new[order[new]])  # follow the hub's own hub
        if (new == hub).all():
            break
        hub = new
    row = order[hub]
    alike = (sketch == sketch[row]).sum(axis=1)
    x, y = np.concatenate([i, j]), np.concatenate([j, i])
    same = (sketch[x] == sketch[y]).sum(axis=1)
    by = np.lexsort((ids[y], -same, x))  # by x, most similar first
    x, y = x[by], y[by]
    begin, end = np.searchsorted(x, np.arange(m)), np.searchsorted(x, np.arange(m), side="right")
    out = []
    for k in np.unique(np.concatenate([i, j])):
        if row[k] == k:
            continue
        own = y[begin[k] : end[k]]
        tries = [int(ids[row[k]])] if alike[k] >= MAYBE else []
        if alike[k] < LIKELY:
            near = own[alike[own] >= LIKELY]
            tries += [int(ids[q]) for q in {*own[:1].tolist(), *near[:1].tolist()} - {row[k]}]
        out.append((int(ids[k]), int(ids[row[k]]), tries, ids[own].tolist() if m <= SMALL else []))
    return out


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions of sorted rows (key, id, sketch). A region over several batches is held `most` rows at a time."""
    most, held = 4 * HOT, None
    for b in batches:
        if not b.num_rows:
            continue
        part = (b.column(0).to_numpy(), b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, HASHES // 2))
        held = part if held is None else tuple(np.concatenate(x) for x in zip(held, part, strict=True))
        last = int(np.searchsorted(held[0], held[0][-1]))  # where the last key begins
        if len(held[0]) - last > most:
            yield from regions(*held)
            held = tuple(x[-WIDTH:] for x in held)
        elif last:
            yield from regions(*(x[:last] for x in held))
            held = tuple(x[last:] for x in held)
    if held is not None and len(held[0]):
        yield from regions(*held)


def regions(keys: np.ndarray, ids: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    starts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
    sizes = np.diff(starts)
    two = starts[:-1][sizes == 2]  # most regions: at once
    two = two[(sketch[two] == sketch[two + 1]).sum(axis=1) >= MAYBE]
    out = [(max(x, y), min(x, y), [min(x, y)], []) for x, y in zip(ids[two].tolist(), ids[two + 1].tolist(), strict=True) if x != y]
    for k in np.nonzero(sizes > 2)[0]:
        out += met(ids[starts[k] : starts[k + 1]], sketch[starts[k] : starts[k + 1]])
    yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["x", "hub", "tries", "partners"])


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, hub, tries, partners as in met(), by region; doc_id of texts in crowded regions) of `nodes` (id, signature, sketch)."""
    step = 2 * DEPTH
    trees = F.array(*(F.struct(F.xxhash64(F.lit(t), F.substring("signature", step * t + 1, 2 * SHALLOW)).alias("key"), F.substring("signature", step * t + 1, step).alias("at")) for t in range(TREES)))
    rows = nodes.select("id", "sketch", F.explode(trees).alias("t")).select("t.key", "t.at", "id", "sketch")
    keys = stored(rows.groupBy("key").count().where(F.col("count") > SMALL), "regions")
    crowd = stored(rows.select("key", F.col("id").alias("doc_id")).join(keys.select("key").hint("merge"), "key").select("doc_id").distinct(), "crowd")
    hot = keys.where(F.col("count") > HOT).select("key").hint("merge")

    def pairs(some: DataFrame) -> DataFrame:
        return some.sortWithinPartitions("key", "at", "id").select("key", "id", "sketch").mapInArrow(neighbours, FOUND)

    if hot.isEmpty():
        return pairs(rows.repartition("key")), crowd
    return pairs(rows.join(hot, "key", "left_anti").repartition("key")).union(pairs(rows.join(hot, "key", "left_semi").repartitionByRange("key", "at", "id"))), crowd


def texts_of(found: DataFrame, crowd: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts of the documents in `found` and `crowd`: only these travel from here on. Merge joins at any size, so plans don't change."""
    needed = found.select(F.explode(F.array("x", "hub")).alias("doc_id")).union(crowd).distinct()  # each candidate is an x or a hub
    return stored(docs.select("doc_id", "text").join(needed.hint("merge"), "doc_id", "left_semi").distinct(), "texts")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose full sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[str, np.ndarray] = OrderedDict()

        def of(text: str) -> np.ndarray:
            if (s := kept.get(text)) is None:
                s = kept[text] = shingles(words_of(text))
                if len(kept) > 64:
                    kept.popitem(last=False)
            return s

        for batch in batches:
            yes = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, t = of(x), of(y)
                if min(len(s), len(t)) * 100 < PERCENT * max(len(s), len(t)):
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= PERCENT * (len(s) + len(t) - both):
                    yes.append((a, b))
            yield pa.record_batch([pa.array([p[k] for p in yes], pa.int64()) for k in (0, 1)], names=["a", "b"])

    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")).hint("merge"), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")).hint("merge"), "b")
    return stored(joined.select("a", "b", "x", "y").mapInArrow(check, PAIRS), "links")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, texts that have them) of the `FREQUENT` most frequent ones, in order of the shingles.

    A task counts what it reads before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 1000):
                sets_ = [shingles(words_of(t)).view(np.int64) for t in b.column(0).slice(i, 1000).to_pylist()]
                s, n = np.unique(np.concatenate([*sets_, np.array([], np.int64)]), return_counts=True)
                yield pa.record_batch([pa.array(s), pa.array(n.astype(np.int64))], names=["s", "n"])

    counts = texts.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") > SMALL)
    top = sorted((r["s"], r["n"]) for r in counts.orderBy(F.desc("n"), "s").limit(FREQUENT).collect())
    return np.array([s for s, _ in top], np.int64), np.array([n for _, n in top], np.int64)


def parities(s: np.ndarray) -> np.ndarray:
    """The bit sums of a set: the parity of its shingles on each of 64 * SUMS bits."""
    place = (s >> np.uint64(64 - 6 - SUMS.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=64 * SUMS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def across(crowd: DataFrame, texts: DataFrame, groups: DataFrame) -> DataFrame:
    """All pairs (x, y) of texts of `crowd` in different components of `groups` whose full sets may be similar enough.

    A prefix filter with sizes and places, which loses no pair: sets are in one order of all shingles, in which the
    most frequent come last by their number, and a pair's first common shingle is early in both. Where the bit sums
    of two sets differ the sets do, so the bits that differ are a lower bound of what two texts don't share. Of two
    texts in different components one isn't in the lowest component that has their shingle; only such ones ask, so a
    group that is one component already asks nothing.
    """
    often, many = frequent(texts.join(crowd.hint("merge"), "doc_id", "left_semi"))
    shared = texts.sparkSession.sparkContext.broadcast((often, many))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, many = shared.value
        for b in batches:
            for i, c, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                s = shingles(words_of(text))
                n, own = len(s), s.view(np.int64)
                at = np.minimum(np.searchsorted(often, own), max(0, len(often) - 1))
                weight = np.where(often[at] == own, many[at], 0) if len(often) else np.zeros(n, np.int64)
                early = np.lexsort((own, weight))[: n - -(-PERCENT * n // 100) + 1]
                m, sums = len(early), parities(s)
                yield pa.record_batch([pa.array(own[early]), *(pa.array(np.full(m, v), pa.int64()) for v in (i, c, n)), pa.array(np.arange(1, m + 1)), pa.ListArray.from_arrays(np.arange(0, SUMS * m + 1, SUMS, dtype=np.int32), np.tile(sums, m))], names=["s", "id", "c", "n", "place", "sums"])

    own = texts.join(crowd.hint("merge"), "doc_id", "left_semi").join(groups.select(F.col("id").alias("doc_id"), "component").hint("merge"), "doc_id", "left")
    own = own.select("doc_id", F.coalesce("component", "doc_id").alias("c"), "text")
    probes = stored(own.mapInArrow(run, "s long, id long, c long, n long, place long, sums array<long>"), "prefixes")
    lowest = probes.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("s", "low")
    x = probes.join(lowest.hint("merge"), "s").where("c <> low").selectExpr("s", "low", "id x", "c cx", "n nx", "place px", "sums ux")
    y = probes.selectExpr("s", "id y", "c cy", "n ny", "place py", "sums uy")
    differ = " + ".join(f"bit_count(ux[{k}] ^ uy[{k}])" for k in range(SUMS))
    may = f"cx <> cy and (cy = low or x < y) and 100 * least(nx, ny) >= {PERCENT} * greatest(nx, ny) and {100 + PERCENT} * (1 + least(nx - px, ny - py)) >= {PERCENT} * (nx + ny) and {100 + PERCENT} * ({differ}) <= {100 - PERCENT} * (nx + ny)"
    out = stored(ordered(x.join(y.hint("merge"), "s").where(may)), "across")
    release(probes)
    return out


def linked(found: DataFrame, crowd: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links (a, b) of `found`, enough of them to connect whatever any candidate would connect.

    Tries first. Every candidate pair joins two texts of a region with one hub; where both are in the hub's component
    it can't change anything, and where one is not all its partners are tried. Texts of `crowd` are also tried with
    all texts of it that are in other components and may be similar.
    """
    texts = texts_of(found, crowd, docs)
    first = stored(ordered(found.select("x", F.explode("tries").alias("y"))), "tries")
    links = confirmed(first, texts)
    groups = components(links)
    mine, hubs = groups.select(F.col("id").alias("x"), F.col("component").alias("cx")), groups.select(F.col("id").alias("hub"), F.col("component").alias("ch"))
    apart = found.where("size(partners) > 0").join(mine, "x", "left").join(hubs, "hub", "left").where(F.coalesce("cx", "x") != F.coalesce("ch", "hub"))
    others = across(crowd, texts, groups)
    rest = stored(ordered(apart.select("x", F.explode("partners").alias("y"))).union(others).distinct().join(first, ["a", "b"], "left_anti"), "rest")
    more = None if rest.isEmpty() else confirmed(rest, texts)
    release(texts, first, others, rest)
    return links if more is None else links.union(more)


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for each id in `links` (a, b)."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    labels = stored(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("id"), F.least("u", "low").alias("component")), "labels")
    while True:
        lower = both.join(labels, both.u == labels.id).groupBy("v").agg(F.min("component").alias("low"))
        new = labels.join(lower, labels.id == lower.v, "left").select("id", F.least("component", "low").alias("next"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
        new = stored(new.join(jump, "next").select("id", F.least("next", "beyond").alias("component"), "was"), "labels")
        changed = new.where("component <> was").limit(1).count()
        release(labels)
        labels = new
        if not changed:
            return labels.select("id", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id, text).

    Texts without words are linked with nothing. Rows with an equal doc_id are one document: what links to one of
    them links to it. Rows without doc_id are linked with nothing, have no component and are kept. A link at exactly
    the threshold counts. Texts of any length are read whole; a text's set is held once at a time.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    table = stored(sets(docs), "sets")
    known = table.where("class is not null and doc_id is not null")
    classes = stored(known.groupBy("class").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    firsts = known.join(classes.select("class", F.col("id").alias("doc_id")), ["class", "doc_id"]).select(F.col("doc_id").alias("id"), "signature", "sketch").dropDuplicates(["id", "signature"])
    nodes = stored(firsts, "nodes")
    pairs, crowd = candidates(nodes)
    found = stored(pairs, "found")
    groups = components(linked(found, crowd, docs))
    release(nodes, found, crowd)
    copies = classes.where("n > 1").select("class", F.col("id").alias("first"))
    rows = table.select("doc_id", "n_shingles", "class").join(copies, "class", "left").withColumn("id", F.coalesce("first", F.when(F.col("class").isNotNull(), F.col("doc_id"))))
    rows = rows.join(groups, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_firsts(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all columns whatever their names, that are the first of their group.

    Texts without words and rows without doc_id are groups of their own and stay; rows of one doc_id stay or go together.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").union(docs.where("doc_id is null")).select(docs.columns)
