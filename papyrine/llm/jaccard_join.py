"""Exact n-gram Jaccard join by prefixes of token combinations.

A text's set holds its distinct k-word shingles (64-bit hashes); two texts link
when ``den * |x & y| >= num * |x | y|``.  If x and y link, at most
``p - 1 = |x| - ceil(num |x| / den)`` tokens of x are missing in y, so a prefix
of x (in any order shared by all sets) from which p tokens cannot all be missing
meets the prefix of y.  The steps:

1. One map computes the size and digest of every set; equal sets join by digest,
   and one of them goes on.
2. Tokens that one set alone holds are *unique*.  A set with p of them can link with
   nothing and leaves here: two shuffles count them among the tokens of the first
   two fifths of the hash range (see ``lone_tokens``), so that no filter fills up
   however large the table is.  Of the sets left, tokens under a hash bound (half of
   all) are *low*, and a twice-seen Bloom filter over their low tokens (bounded size,
   see ``bloom``) tells the unique ones.  Order: unique low tokens, rare low tokens,
   frequent low tokens, then the tokens over the bound, each by hash.  Sets are
   recognised in later passes over the texts by Bloom filters of their keys; one let
   through by mistake is a set like others, and costs time only.
3. Repeated low tokens of the sets left are counted.  Those in more than
   ``frequent`` sets form the frequent class (at most ``max_frequent`` of them;
   the bound on the count is raised until they fit, which changes cost only).
4. Index: rare tokens enter singly; frequent tokens enter as combinations of k
   within hash groups.  A group of g of them stands for g - k + 1 prefix tokens
   (if fewer than that are missing, k meet), so the prefix is extended until it
   stands for p tokens.  Groups are made for bands of sizes, and a set enters
   each band in which it can meet a partner.  k is 2 at first.
5. Candidates: first every set of a key is compared with one pivot of the key.
   Links make components (of the sets left; their copies join them at the end).  After that, the sets of a key that lie outside the
   key's largest component are its *stragglers*; up to ``bound`` of them become
   pivots and are compared with all sets of the key in other components.  A key
   with no more stragglers than that is done.  Sets of the other keys are indexed
   again by combinations of three tokens, which splits these keys, and
   go through the same step.  Beyond the longest combinations the step is repeated
   without the pivots that have had their turn, until every key is done.  So a
   step compares each row of the index with at most ``bound`` others, however
   large a group is, and the pairs of a group are never listed.

   A pair is emitted only if its sizes, the unique tokens of both and the bits in
   which their odd sketches differ leave room for the overlap, and only under the
   first key of both that is done in this step (of the four first of each).
   Pairs are verified on the whole sets.

No link between different components is lost: two sets that share a key end in
one component or are compared.

Defined results: a null or empty text, or one without words, has an empty set
and links with nothing; with fewer than k words the whole sequence is the one
shingle; texts of any length are taken whole; an empty table gives no rows;
repeated rows are copies; rows that share an id are one node (linked if any of
their texts is); a null id links with nothing and has a null component; the
component is the smallest id, so ties do not arise.  Columns other than the id
and the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import arrow_map, collect_shuffles, drop, stash
from . import kernels
from .bloom import PARTIAL_SCHEMA, TwiceSeen, collect_twice, partials, slices_for
from .graph import connected_components
from .lone_tokens import SENT, Sender, lone_counts

#: Share of the hash range that is low.
LOW_SHARE = 0.5
#: Share of the hash range whose unique tokens are counted to let sets leave.
COUNTED_SHARE = 0.4
#: Words of 64 bits in a set's odd sketch.
SKETCH_WORDS = 8
_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def missing_allowed(n: int, num: int, den: int) -> int:
    """How many tokens of a set of ``n`` a partner may lack."""
    return n - -(-num * n // den)


_LOW_BOUND = np.uint64(int(LOW_SHARE * (1 << 64)))
_COUNTED_BOUND = np.uint64(int(COUNTED_SHARE * (1 << 64)))


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def odd_sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the number of tokens in each of the sketch's bins.

    Two sketches differ in at most as many bits as their sets differ in tokens,
    so the bits that differ bound the overlap from above, whatever the collisions.
    """
    bins = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % (64 * SKETCH_WORDS), minlength=64 * SKETCH_WORDS)
    return np.packbits(bins & 1).view(np.int64)


def _batch_sets(b: pa.RecordBatch, k: int):
    for part in kernels.portions(*kernels.text_buffer(b.column("text"))):
        yield from kernels.shingle_sets(kernels.hash_words(*part), k)


def profiles(thin: DataFrame, k: int) -> DataFrame:
    """One row a document: size and digest of its set."""

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [(len(t), _digest(t)) for t in _batch_sets(b, k)]
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], pa.binary())], names=["doc_id", "n", "digest"])

        return step

    return stash(arrow_map(thin, make, "doc_id long, n long, digest binary"), "profiles")


def _low(tokens: np.ndarray) -> np.ndarray:
    return tokens[: np.searchsorted(tokens, _LOW_BOUND)]


def _twice_seen(rows: DataFrame, make, slices: int):
    """Broadcast of the twice-seen filter over the hashes that ``make()`` takes from a batch."""

    def sending():
        hashes_of = make()
        return lambda b: partials(hashes_of(b), slices)

    return rows.sparkSession.sparkContext.broadcast(collect_twice(arrow_map(rows, sending, PARTIAL_SCHEMA), slices))


def _set_keys(ids: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """Hash of each row's id and set."""
    return kernels.mix(np.frombuffer(b"".join(digests), np.uint64)[::2] ^ kernels.mix(ids.astype(np.int64).view(np.uint64)))


def _members(keys: DataFrame, count: int, max_bytes: int):
    """Broadcast of a filter that has all of ``keys`` (a column of hashes), and few others while it is not full."""
    slices = slices_for(count, bits_per_key=10, max_bytes=max_bytes)
    return _twice_seen(keys, lambda: lambda b: np.repeat(b.column(0).to_numpy().astype(np.int64).view(np.uint64), 2), slices)


def _chosen(b: pa.RecordBatch, k: int, wanted: TwiceSeen | None, seen: set[bytes]):
    """(id, key, digest, tokens) of the rows of a batch whose keys are wanted, one of equal sets in a task."""
    ids, at = b.column("doc_id").to_numpy(), 0
    for part in kernels.portions(*kernels.text_buffer(b.column("text"))):
        sets = list(kernels.shingle_sets(kernels.hash_words(*part), k))
        digests = [_digest(t) for t in sets]
        keys = _set_keys(ids[at : at + len(sets)], digests)
        passed = wanted.suspects(keys) if wanted else np.ones(len(sets), bool)
        for i in np.flatnonzero(passed).tolist():
            if len(sets[i]) and digests[i] not in seen:
                seen.add(digests[i])
                yield int(ids[at + i]), int(keys[i : i + 1].view(np.int64)[0]), digests[i], sets[i]
        at += len(sets)


_SETS = "doc_id long, n long, unique long, digest binary, repeated array<long>, tokens binary" + "".join(f", {c} long" for c in _SKETCH)
_SETS_NAMES = ["doc_id", "n", "unique", "digest", "repeated", "tokens", *_SKETCH]


def _sift(twice, num: int, den: int, rows) -> pa.RecordBatch | None:
    """Of (doc_id, digest, tokens) those that may link."""
    out: list[list] = [[] for _ in _SETS_NAMES[:6]]
    sketches = []
    for doc, digest, tokens in rows:
        n, low = len(tokens), _low(tokens)
        again = twice.suspects(low)
        unique = len(low) - int(again.sum())
        if unique > missing_allowed(n, num, den):
            continue
        for column, value in zip(out, (doc, n, unique, digest, low[again].view(np.int64), tokens.tobytes()), strict=True):
            column.append(value)
        sketches.append(odd_sketch(tokens))
    if not sketches:
        return None
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
    bits = np.ascontiguousarray(np.stack(sketches).T)
    return pa.RecordBatch.from_arrays([*(pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)), *map(pa.array, bits)], names=_SETS_NAMES)


def _suspect_sets(thin: DataFrame, firsts: DataFrame, k: int, num: int, den: int, filter_bytes: int) -> DataFrame:
    """Sets that may link, one of equal ones: (doc_id, n, unique, digest, repeated low tokens, tokens, sketch).

    ``firsts`` has each distinct set: digest, its smallest id ``b``, its largest ``other``, and its size.
    """
    about = firsts.agg(F.count("*"), F.sum("n"), F.count_if(F.expr("other > b"))).first()
    sets, tokens, copied = about[0], about[1] or 0, about[2]

    def keyed():
        return lambda b: pa.RecordBatch.from_arrays([pa.array(_set_keys(b.column("b").to_numpy(), b.column("digest").to_pylist()).view(np.int64))], names=["key"])

    keepers = _members(arrow_map(firsts.select("digest", "b"), keyed, "key long"), sets, filter_bytes // 2) if copied else None

    def sending():
        sender, seen, wanted = Sender(tokens), set(), keepers and keepers.value

        def step(b: pa.RecordBatch) -> pa.Table | None:
            keys, sizes, counted = [], [], []
            for _, key, _, own in _chosen(b, k, wanted, seen):
                keys.append(key)
                sizes.append(len(own))
                counted.append(own[: np.searchsorted(own, _COUNTED_BOUND)].copy())
            return sender.rows(keys, sizes, counted)

        return step

    lone = lone_counts(arrow_map(thin, sending, SENT))
    left = stash(lone.where(f"lone <= n - ({num} * n + {den - 1}) div {den}").select("key", "n"), "left")
    collect_shuffles(thin.sparkSession)
    sets, tokens = left.agg(F.count("*"), F.sum("n")).first()
    staying = _members(left.select("key"), sets, filter_bytes // 2)

    def of_texts():
        wanted, seen = staying.value, set()

        def low_of(b: pa.RecordBatch) -> np.ndarray:
            low = [_low(own).copy() for *_, own in _chosen(b, k, wanted, seen)]
            return np.concatenate(low) if low else np.zeros(0, np.uint64)

        return low_of

    again = _twice_seen(thin, of_texts, slices_for(int((tokens or 0) * LOW_SHARE), bits_per_key=10, max_bytes=filter_bytes))

    def sifting():
        twice, wanted, seen = again.value, staying.value, set()
        return lambda b: _sift(twice, num, den, ((doc, digest, own) for doc, _, digest, own in _chosen(b, k, wanted, seen)))

    suspects = stash(arrow_map(thin, sifting, _SETS), "suspects")
    drop(left)
    for shared in (keepers, staying, again):
        if shared:
            shared.unpersist()
    return suspects


def _hinted(df: DataFrame, max_rows: int = 1 << 20) -> DataFrame:
    """A stashed table of narrow rows, broadcast if it has at most ``max_rows``."""
    return F.broadcast(df) if df.count() <= max_rows else df


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column of hashes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64).view(np.uint64)
    return values, offsets - offsets[0]


def _frequent_tokens(suspects: DataFrame, frequent: int, max_frequent: int) -> np.ndarray:
    """Low tokens in more than ``frequent`` sets, at most ``max_frequent`` of them, sorted."""
    counts = suspects.select(F.explode("repeated").alias("token")).groupBy("token").count().where(F.col("count") > frequent)
    counts = stash(counts, "frequent")
    by_size = sorted(((r[0], r[1]) for r in counts.groupBy(F.floor(F.log2("count")).alias("e")).count().collect()), reverse=True)
    total, least = 0, frequent
    for e, n in by_size:
        if total + n > max_frequent:
            least = 1 << (int(e) + 1)
            break
        total += n
    kept = counts.where(F.col("count") > least if least == frequent else F.col("count") >= least).select("token").toArrow()
    drop(counts)
    return np.sort(kept.column("token").to_numpy().astype(np.int64).view(np.uint64))


#: Combinations of the index and, for each, the tokens that may be missing in a group.
WIDTHS = {2: 2, 3: 2}


def _grouping(own: int, k: int, num: int, den: int) -> tuple[int, int]:
    """Tokens to a combination and hash groups of the band of sizes from ``2 ** own``; fewer than ``k`` where the sets are too small."""
    least = 1 << own
    lacking = missing_allowed(least, num, den)
    for size in range(k, 1, -1):
        groups = max(1, lacking // WIDTHS[max(w for w in WIDTHS if w <= size)])
        if lacking + 1 + groups * (size - 1) <= least:
            return size, groups
    return 1, 1


def index_keys(n: int, unique: int, rare: np.ndarray, often: np.ndarray, high: np.ndarray, num: int, den: int, k: int = 2) -> np.ndarray:
    """Distinct index keys of one set; its tokens come by class, each class sorted by hash.

    With combinations of two the tokens over the bound enter singly, as last
    resort; with longer ones they are combined like frequent tokens.
    """
    need = missing_allowed(n, num, den) + 1 - unique
    if need <= 0:
        return np.zeros(0, np.uint64)
    if len(rare) >= need:
        return rare[:need]
    need -= len(rare)
    keys, most_high = [rare], 0
    common = often if k == 2 else np.concatenate([often, high])
    band = n.bit_length() - 1
    bands = {band} | ({band - 1} if -(-num * n // den) < 1 << band else set())
    for own in bands if len(common) else {band}:
        size, groups = _grouping(own, k, num, den)
        rest, members = need, {}
        for token in common.tolist():
            if rest <= 0:
                break
            mine = members.setdefault((token >> 7) % groups, [])
            mine.append(token)
            rest -= len(mine) >= size
        for group in members.values():
            if len(group) >= size:
                chosen = np.array(list(combinations(group, size)), np.uint64)
                made = np.full(len(chosen), np.uint64(own + 64 * size))
                for column in chosen.T:
                    made = kernels.mix(made * np.uint64(3) + column)
                keys.append(made)
        most_high = max(most_high, rest)
    if k == 2:
        keys.append(high[:most_high])
    return np.unique(np.concatenate(keys))


def _index(suspects: DataFrame, often: np.ndarray, num: int, den: int, k: int) -> DataFrame:
    """(doc_id, keys) of every set."""
    shared = suspects.sparkSession.sparkContext.broadcast(often)

    def make():
        frequent = shared.value

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            repeated, at = _flat(b.column("repeated"))
            where = np.minimum(np.searchsorted(frequent, repeated), max(0, len(frequent) - 1))
            common = frequent[where] == repeated if len(frequent) else np.zeros(len(repeated), bool)
            keys = []
            for i, (n, unique, raw) in enumerate(zip(b.column("n").to_pylist(), b.column("unique").to_pylist(), b.column("tokens"), strict=True)):
                own, mark = repeated[at[i] : at[i + 1]], common[at[i] : at[i + 1]]
                tokens = np.frombuffer(raw.as_buffer(), np.uint64)
                keys.append(index_keys(n, unique, own[~mark], own[mark], tokens[np.searchsorted(tokens, _LOW_BOUND) :], num, den, k))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([b.column("doc_id"), kernels.arrow_lists(flat.view(np.int64), np.array([len(x) for x in keys]), pa.int64())], names=["doc_id", "keys"])

        return step

    return stash(arrow_map(suspects, make, "doc_id long, keys array<long>"), "index")


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs whose whole sets link."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("right"))

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for u, v in zip(b.column("left"), b.column("right"), strict=True):
                x, y = np.frombuffer(u.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            return pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

        return step

    return arrow_map(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right"), make, "a long, b long").distinct()


def _near(num: int, den: int) -> str:
    """Whether sizes, unique tokens and sketches of two sets leave room for a link."""
    apart = f"n + other_n - 2 * (({num} * (n + other_n) + {num + den - 1}) div {num + den})"
    differing = " + ".join(f"bit_count({c} ^ other_{c})" for c in _SKETCH)
    return f"{den} * least(n, other_n) >= {num} * greatest(n, other_n) and unique + other_unique <= {apart} and {differing} <= {apart}"


def _other(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else f"other_{c}") for c in df.columns])


def link_components(
    docs: DataFrame,
    k: int = 4,
    num: int = 85,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent: int = 64,
    max_frequent: int = 1 << 20,
    filter_bytes: int = 64 << 20,
    bound: int = 2048,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``; the component is its smallest doc_id."""
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    table = profiles(thin, k)
    known = table.where("doc_id is not null and n > 0")
    firsts = stash(known.groupBy("digest").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("other"), F.first("n").alias("n")), "firsts")
    copies = firsts.where("other > b").select("digest", "b")
    links = known.join(copies, "digest").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    suspects = _suspect_sets(thin.where("doc_id is not null"), firsts, k, num, den, filter_bytes)
    often = _frequent_tokens(suspects, frequent, max_frequent)
    about = suspects.select("doc_id", "n", "unique", *_SKETCH)
    near = _near(num, den)
    pair = [F.least("doc_id", "other_doc_id").alias("a"), F.greatest("doc_id", "other_doc_id").alias("b")]

    def joined(links: DataFrame) -> DataFrame:
        """(node, component) of the linked sets, written down."""
        return stash(connected_components(links), "components")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stash(pairs, "pairs")
        wanted = stash(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
        sets = stash(suspects.join(_hinted(wanted), "doc_id", "left_semi").select("doc_id", "tokens"), "sets")
        found = stash(verify(pairs, sets, num, den), "links")
        drop(pairs, wanted, sets)
        return found

    longer = [size for size in WIDTHS if size > 2]
    index = _index(suspects, often, num, den, 2)
    rows = index.select("doc_id", F.explode("keys").alias("key"))
    pivots = rows.groupBy("key").agg(F.min("doc_id").alias("other_doc_id"), F.max("doc_id").alias("most")).where("other_doc_id < most").select("key", "other_doc_id")
    met = rows.join(pivots, "key").where("doc_id <> other_doc_id").select("doc_id", "other_doc_id").distinct()
    pairs = met.join(_hinted(about, 1 << 17), "doc_id").join(_hinted(_other(about), 1 << 17), "other_doc_id").where(near).select(*pair).distinct()
    found = verified(pairs)
    stars = joined(found)
    while True:
        of = index.join(_hinted(stars, 1 << 17).withColumnRenamed("node", "doc_id"), "doc_id", "left")
        rows = of.select("doc_id", F.coalesce("component", "doc_id").alias("component"), F.explode("keys").alias("key"))
        sizes = rows.groupBy("key", "component").agg(F.count("*").alias("rows"))
        largest = F.max(F.struct("rows", "component"))
        keys = sizes.groupBy("key").agg(largest.alias("top"), F.sum("rows").alias("rows"), F.count("*").alias("parts")).where("parts > 1")
        keys = keys.select("key", F.col("top.component").alias("top"), (F.col("rows") - F.col("top.rows") > bound).alias("large"))
        opened = stash(rows.join(keys, "key").select("key", "doc_id", "component", (F.col("component") != F.col("top")).alias("straggler"), "large"), "open")
        # a pair is left to the first key of both that this step finishes
        first = opened.where("not large").groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, 4).alias("firsts"))
        described = stash(about.join(first, "doc_id", "left"), "described")
        order = Window.partitionBy("key").orderBy(F.xxhash64("doc_id"), "doc_id")
        pivots = stash(opened.where("straggler").withColumn("at", F.row_number().over(order)).where(F.col("at") <= bound).select("key", "doc_id", "component"), "pivots")
        told = _hinted(described, 1 << 17)
        wide = opened.select("key", "doc_id", "component").join(told, "doc_id")
        chosen = _other(pivots.join(told, "doc_id"), keep=("key",))
        met = wide.join(chosen, "key").where("component <> other_component").where(near).where("coalesce(array_min(array_intersect(firsts, other_firsts)) >= key, true)")
        more, old = verified(met.select(*pair).distinct()), (index, described)
        found = found.unionByName(more)
        large = opened.where("large")
        if large.isEmpty():
            drop(*old, opened, pivots, stars)
            break
        if not more.isEmpty():
            old, stars = (*old, stars), joined(found)
        if longer:
            stuck = stash(large.select("doc_id").distinct(), "stuck")
            index = _index(suspects.join(_hinted(stuck), "doc_id", "left_semi"), often, num, den, longer.pop(0))
            drop(stuck)
        else:
            left = large.join(pivots, ["key", "doc_id"], "left_anti")
            index = stash(left.groupBy("doc_id").agg(F.collect_list("key").alias("keys")), "index")
        drop(*old, opened, pivots)
    stars = joined(links.unionByName(found))
    drop(suspects, firsts)
    of = stars.withColumnRenamed("node", "doc_id")
    whole = table.select("doc_id", F.col("n").alias("n_shingles")).join(of, "doc_id", "left")
    return whole.select("doc_id", "n_shingles", F.coalesce("component", F.when(F.col("n_shingles") >= 0, F.col("doc_id"))).alias("component_id"))
