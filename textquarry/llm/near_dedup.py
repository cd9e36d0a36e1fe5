"""MinHash near-dedup (operator 8): bottom-k sketches from one hash function.

Every document becomes the set of its distinct 5-word shingles, hashed once to 64 bits. Documents of
equal sets fall into one class at once, whatever its size; only one of each class goes on.

1. Sketch: the K smallest hashes of the set. A pair with Jaccard 0.75 or more shares, among the K
   smallest of its union, Binomial(K, >= 0.75) values, so fewer than SHARED of them (27 of 64, six
   standard deviations below) with a chance below 1e-8. Sets of at most K hashes are kept whole:
   two of them share 0.75 of either exactly. A larger partner of such a set of n has at most n / 0.75
   hashes and loses those above K, so at least K - n / 3 common values are retained by both.
2. Inverted lists: a list holds the classes that retain a value. Since a true pair shares at least
   SHARED of its retained values, it shares one of the K - SHARED + 1 rarest of either: only those
   values of a sketch enter lists, rarest first by the number of classes retaining them. Passages that
   many documents share thus make no long lists.
3. Short lists (up to SHORT classes) give pairs. Longer ones, which come from large groups of near
   copies, are gathered in homes. Where a home fills more than one chunk of bounded size, all its classes
   are first held against a few pivots, one a round; what has a link to a pivot's component is settled.
   Then chunks that meet in any long list are compared chunk by chunk, unless both hold only settled
   classes of one home, which are connected already; this emits a spanning forest, never all pairs.
4. Union sketch: a pair stays if the K smallest of its two sketches' union hold at least SHARED common
   values. Then the full sets decide: 100 * intersection >= 75 * union.
5. Components by min-label propagation with pointer jumping over the links, in tables of the shared
   folder. Nothing but counts comes to the driver.

Hot values and homes (a third of all classes may share one) are dealt to up to SALTS tasks by a hash of
the class, and only the salts a value really has are joined.

Null or empty text has no shingles and no link, and goes round the joins. Rows with null doc_id are never
linked and are kept, with null component. Repeated rows share a class and are all returned. Rows of equal id
and different text count as one document for reaching others. Long texts count whole; a class larger than a
chunk is a chunk of its own. An empty table gives no rows. Columns other than doc_id and text are not read,
so extra ones with any names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, map_arrow, materialize
from .words import LOWER_BYTES, WordHashes, shingle_set, texts

WIDTH = 5
PERCENT = 75
K = 64
SHARED = 27
SHORT = 24
#: Shingles in a chunk of the long lists' classes: 8 MB of hashes.
CHUNK_SHINGLES = 1_000_000
#: Candidate ids up to this number (8 MB) are broadcast to select texts; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Tasks over which one value or home is dealt; bits of a long, so at most 64.
SALTS = 64
#: Pivots held against the classes of a home of several chunks.
PIVOT_ROUNDS = 3


def _pack(v: np.ndarray) -> bytes:
    return v.astype("<u8").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype="<u8")


def _set_of(text: bytes, cache: WordHashes, width: int) -> np.ndarray:
    return shingle_set(cache.of(text.translate(LOWER_BYTES).split()), width)


def _digest(items: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None


def sketch(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, n (set size), digest (of the whole set; null if empty), sketch (the k smallest, ascending)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in it:
            sets = [_set_of(t, cache, width) for t in texts(batch, "text")]
            digest = [_digest(s) for s in sets]
            low = [s[:k].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(low, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, run, "doc_id long, n long, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, width: int = WIDTH, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """key (digest of the set), items (packed sorted hashes) of all texts of the documents named in ids."""
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(F.broadcast(ids) if few(ids, broadcast_ids) else ids, "doc", "left_semi")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in it:
            sets = [_set_of(t, cache, width) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in sets], pa.binary()), pa.array(map(_pack, sets), pa.binary())], ["key", "items"])

    return wanted.transform(map_arrow, run, "key binary, items binary").where("key is not null")


def _salt(key: str = "key") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALTS))


def _with_salts(rows: DataFrame, by: str, *figures: Column, keep: str = "true") -> DataFrame:
    """Figures of each value of `by`, once for each salt its rows have: joined on both, a hot value's rows meet in
    many tasks. The salts travel as the bits of one long, so the aggregate combines before the shuffle."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _salt().cast("int"))
    found = rows.groupBy(by).agg(*figures, F.bit_or(bit).alias("bits"))
    has = lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1)) == 1
    return found.where(keep).withColumn("salt", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), has))).drop("bits")


def inverted_lists(classes: DataFrame, k: int = K, shared: int = SHARED) -> DataFrame:
    """value, key, n, df, home: the retained values through which a class is looked for, where others have them
    too, each with the class's most common one."""
    each = classes.select("key", "n", F.explode("sketch").alias("value"))
    common = _with_salts(each, "value", F.count("*").alias("df"), keep="df > 1")
    seen = each.withColumn("salt", _salt()).join(common, ["value", "salt"]).groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("seen"))
    size = F.least("n", F.lit(k))
    # Of a set kept whole, a partner kept whole holds so many, and one that is cut down to k at least so many.
    whole, cut = F.ceil(F.col("n") * PERCENT / 100.0), F.ceil(F.lit(k) - F.col("n") * (100 - PERCENT) / PERCENT)
    need = F.when(F.col("n") > k, F.lit(shared)).otherwise(F.least(whole, cut))
    rare = size - F.size("seen")  # those that no other class retains come first
    first = F.greatest(F.lit(0), size - need + 1 - rare).cast("int")
    out = seen.select("key", "n", F.slice("seen", F.lit(1), first).alias("kept")).where(F.size("kept") > 0)
    out = out.select("key", "n", F.element_at("kept", -1).alias("home"), F.explode("kept").alias("s"))
    return out.select("s.value", "key", "n", "s.df", "home")


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def short_links(lists: DataFrame, classes: DataFrame, sets: DataFrame, k: int = K, shared: int = SHARED, short: int = SHORT) -> DataFrame:
    """a, b: links between classes that meet in a short list."""
    brief = lists.where(F.col("df") <= short).select("value", "key")
    other = brief.select("value", F.col("key").alias("b"))
    pairs = brief.withColumnRenamed("key", "a").join(other, "value").where("a < b").select("a", "b").distinct()
    low = classes.select("key", "n", "sketch")
    pairs = pairs.join(low.withColumnsRenamed({"key": "a", "n": "n_a", "sketch": "s_a"}), "a").where("n_a > 0")
    pairs = pairs.join(low.withColumnsRenamed({"key": "b", "n": "n_b", "sketch": "s_b"}), "b")
    pairs = pairs.where((100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")))
    # The common values among the k smallest of the union.
    unsigned = lambda x: x.bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  the order of unsigned hashes
    union = F.slice(F.transform(F.array_sort(F.transform(F.array_union("s_a", "s_b"), unsigned)), unsigned), 1, k)
    overlap = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), union))
    pairs = pairs.where((F.least("n_a", "n_b") <= k) | (overlap >= shared)).select("a", "b")
    joined = pairs.join(sets.withColumnsRenamed({"key": "a", "items": "i_a"}), "a").join(sets.withColumnsRenamed({"key": "b", "items": "i_b"}), "b")

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ok = [_linked(_unpack(x), _unpack(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return joined.select("a", "b", "i_a", "i_b").transform(map_arrow, verify, "a binary, b binary")


def _chunked(members: DataFrame, chunk: int, apart: str = "settled") -> DataFrame:
    """members (key, n, home, settled) with chunk and parts: the classes of a home, those settled apart, are dealt
    by hash to as many chunks as their shingles fill."""
    members = members.withColumn("side", F.xxhash64("home", apart))
    fill = _with_salts(members, "side", F.sum("n").alias("total")).select("side", "salt", F.ceil(F.col("total") / chunk).cast("int").alias("parts"))
    dealt = members.withColumn("salt", _salt()).join(fill, ["side", "salt"])
    return dealt.select(*[c for c in members.columns if c != "side"], "parts", F.xxhash64("side", F.pmod(F.xxhash64(F.lit(1), "key"), F.col("parts"))).alias("chunk"))


def _pivot_links(members: DataFrame, sets: DataFrame, chunk: int, rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """members with settled where a class is known to be connected with its home's first pivot, and the links found
    on the way. Only homes of several chunks take part. A round's pivot is the smallest class neither settled nor
    tried before."""
    links: list[DataFrame] = []
    members = members.withColumn("tried", F.lit(False))
    for turn in range(rounds):
        placed = materialize(_chunked(members.withColumn("whole", F.lit(True)), chunk, "whole").where("parts > 1"), "placed")
        pivots = placed.where("not settled and not tried").groupBy("home").agg(F.min("key").alias("key"))
        if pivots.isEmpty():
            break
        asked = placed.select("chunk", "home").distinct().join(pivots, "home").select("chunk", "key", F.lit(True).alias("is_pivot"))
        rows = placed.select("chunk", "key", F.lit(False).alias("is_pivot")).unionByName(asked).join(sets, "key")
        found = materialize(rows.groupBy("chunk").applyInArrow(_against_pivot, "a binary, b binary"), "pivot-links")
        links.append(found)
        chosen = pivots.select("key", F.lit(True).alias("chosen"))
        near = found.select(F.explode(F.array("a", "b")).alias("key")).distinct().withColumn("met", F.lit(True))
        state = members.join(near, "key", "left").join(chosen, "key", "left")
        state = state.withColumn("met", F.col("met").isNotNull() | F.col("chosen").isNotNull()).withColumn("tried", F.col("tried") | F.col("chosen").isNotNull())
        # A pivot's neighbours are settled if it is the first, or if one of them is settled already.
        joins = state.where("met").groupBy("home").agg(F.max("settled").alias("old")).where(F.col("old") | (turn == 0)).select("home", F.lit(True).alias("joins"))
        state = state.join(joins, "home", "left")
        settled = F.col("settled") | (F.col("met") & F.col("joins").isNotNull())
        members = materialize(state.select("key", "n", "home", settled.alias("settled"), "tried"), "members")
    return members, links


def _pairs(links: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"a": pa.array([min(x) for x in links], pa.binary()), "b": pa.array([max(x) for x in links], pa.binary())})


def _against_pivot(rows: pa.Table) -> pa.Table:
    """Links of a chunk's classes with the pivot."""
    keys, items, is_pivot = (rows[c].to_pylist() for c in ("key", "items", "is_pivot"))
    pivots, links = {k: _unpack(x) for k, x, p in zip(keys, items, is_pivot, strict=True) if p}, []
    for key, mine in pivots.items():
        links += [(key, k) for k, x, p in zip(keys, items, is_pivot, strict=True) if not p and k != key and _linked(mine, _unpack(x))]
    return _pairs(links)


def long_links(lists: DataFrame, sets: DataFrame, short: int = SHORT, chunk: int = CHUNK_SHINGLES, rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """a, b: a spanning forest of the links between classes that meet in a long list."""
    lists = lists.where(F.col("df") > short)
    # Lists that share classes come to share a home, so that a group of near copies stays together.
    top = _with_salts(lists, "value", F.max("home").alias("top"))
    members = lists.select("value", "key", "n", _salt().alias("salt")).join(top, ["value", "salt"]).groupBy("key", "n").agg(F.max("top")["value"].alias("home"))
    members = materialize(members.withColumn("settled", F.lit(False)), "members")
    members, links = _pivot_links(members, sets, chunk, rounds)
    placed = materialize(_chunked(members, chunk), "chunks")
    met = lists.select("value", "key").join(placed.select("key", "chunk", F.when(F.col("settled"), F.col("home")).alias("done")), "key").select("value", "chunk", "done").distinct()
    other = met.withColumnsRenamed({"chunk": "c2", "done": "d2"})
    tasks = met.withColumnRenamed("chunk", "c1").join(other, "value").where("c1 <= c2 and not coalesce(done = d2, false)").select("c1", "c2").distinct()
    sides = tasks.select("c1", "c2", F.explode(F.array_distinct(F.array("c1", "c2"))).alias("chunk"))
    rows = sides.join(placed.select("key", "chunk"), "chunk").join(sets, "key").select("c1", "c2", "chunk", "key", "items")
    return reduce(DataFrame.unionByName, [*links, rows.groupBy("c1", "c2").applyInArrow(_compare_chunks, "a binary, b binary")])


def _compare_chunks(rows: pa.Table) -> pa.Table:
    """Links across two chunks (or within one) by counting common hashes through one chunk's postings."""
    rows = rows.sort_by("key")
    keys, chunk, of = rows["key"].to_pylist(), rows["chunk"].to_numpy(), [_unpack(x) for x in rows["items"].to_pylist()]
    first, second = np.flatnonzero(chunk == rows["c1"][0].as_py()), np.flatnonzero(chunk == rows["c2"][0].as_py())
    sizes, parent = np.array([len(x) for x in of]), np.arange(len(of))
    hashes, owner = np.concatenate([of[i] for i in first] or [np.zeros(0, "<u8")]), np.repeat(first, sizes[first])
    order = np.argsort(hashes, kind="stable")
    hashes, owner, links = hashes[order], owner[order], []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for j in second:
        lo, hi = np.searchsorted(hashes, of[j], "left"), np.searchsorted(hashes, of[j], "right")
        met = hi > lo
        lo, n = lo[met], (hi - lo)[met]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, int)
        both = np.bincount(owner[at], minlength=len(of))
        for i in np.flatnonzero((100 * both >= PERCENT * (sizes + sizes[j] - both)) & (both > 0)):
            a, b = find(int(i)), find(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((keys[i], keys[j]))
    return _pairs(links)


def components(links: DataFrame) -> DataFrame:
    """doc, component (smallest doc reachable) of all that have a link. Each round a document takes the
    smallest label among its neighbours and then its label's label; ends when no label falls."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnsRenamed({"doc": "b", "label": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(near, labels["doc"] == near["a"]).select("doc", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("doc").alias("at"), F.col("label").alias("far"))
        step = step.join(jump, F.col("next") == F.col("at"), "left").select("doc", "label", F.least("next", F.coalesce("far", "next")).alias("next"))
        step = materialize(step, "labels")
        labels = step.select("doc", F.col("next").alias("label"))
        if step.where("next < label").isEmpty():
            return labels.withColumnRenamed("label", "component")


def near_duplicates(docs: DataFrame, k: int = K, shared: int = SHARED, short: int = SHORT, chunk: int = CHUNK_SHINGLES, width: int = WIDTH, rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row of docs."""
    rows = materialize(sketch(docs, k, width), "sketches")
    whole = rows.where("doc_id is not null and digest is not null")
    classes = materialize(whole.groupBy("digest", "n").agg(F.min("doc_id").alias("doc"), F.first("sketch").alias("sketch")).withColumnRenamed("digest", "key"), "classes")
    lists = materialize(inverted_lists(classes, k, shared), "lists")
    ids = classes.join(lists.select("key").distinct(), "key", "left_semi").select("doc").distinct()
    sets = materialize(full_sets(docs, ids, width), "sets").dropDuplicates(["key"])
    links = short_links(lists, classes, sets, k, shared, short).unionByName(long_links(lists, sets, short, chunk, rounds))
    # From here on a class goes by its smallest id.
    of = classes.select("key", "doc")
    links = links.join(of.withColumnsRenamed({"key": "a", "doc": "d_a"}), "a").join(of.withColumnsRenamed({"key": "b", "doc": "d_b"}), "b")
    links = links.where("d_a <> d_b").select(F.col("d_a").alias("a"), F.col("d_b").alias("b"))
    # An id with several texts joins their classes.
    several = whole.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high").select("doc_id")
    same = whole.join(several, "doc_id", "left_semi").select("doc_id", F.col("digest").alias("key")).distinct().join(of, "key").select("doc_id", "doc")
    extra = same.join(same.groupBy("doc_id").agg(F.min("doc").alias("a")), "doc_id").where("a < doc").select("a", F.col("doc").alias("b"))
    found = components(links.unionByName(extra))
    reached = classes.join(found, "doc", "left").select(F.col("key").alias("digest"), F.coalesce("component", "doc").alias("component"))
    out = whole.join(reached, "digest").select("doc_id", "n", "component")
    alone = rows.where("doc_id is null or digest is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    out = out.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, whose id is its component's smallest. Up to BROADCAST_IDS ids that
    go are broadcast, so that no text moves; beyond it the anti-join shuffles. Rows without an id stay."""
    gone = materialize(near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    return docs.join(F.broadcast(gone) if few(gone, BROADCAST_IDS) else gone, docs["doc_id"] == gone["gone_id"], "left_anti")
