"""Near-duplicate detection by a signature-coordinate inverted join.

1. Every text becomes its set of word shingles; equal sets form a class, represented by its smallest doc_id.
2. A representative's MinHash signature has K coordinates. Two sets at the threshold agree on about 0.8 K of
   them; a pair has to agree on at least M. All coordinate-value pairs have one order, in which those that more
   than CELL documents hold come after the others, and those that far more hold come last. Whatever that order is,
   two documents that agree on M pairs have one in common among the first K - M + 1 of each, so a document is
   posted only under that prefix: a passage that many unlinked documents share takes part only where it is most of them.
3. Collisions are counted on one bit of every coordinate, packed into a long that travels with the posting:
   pairs below the match threshold never leave their list.
4. Merging skips what is settled. First each list only proposes its members with its smallest member; those
   links are confirmed on the full sets and joined into components. Then only lists that still hold more than
   one component are looked into, and only across components. So a list of g copies costs about g rows, not its
   square, and no link between components is lost.
5. A list of more than CELL members is split by bands of set size, since linked sets differ by a quarter at most,
   and what is still longer is dealt into blocks; a block is one row, and each two blocks are one cell. Members of a cell with
   a close partner of another component are compared on full sets, in groups of at most GROUP_DOCS documents
   and about GROUP_SHINGLES shingles, each of which returns fewer links than it has documents.

Defined results: a text with fewer words than a shingle has one shingle, its whole word sequence; null, empty
and blank texts have an empty set, are linked with nothing and kept. Rows with a null doc_id are passed through
unlinked (component_id null, kept true). Repeated rows share their class. An empty table gives an empty result;
other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .common import BITMAP_MAX_BITS, drop_written, maybe_in, text_chunks, written
from .graph import components

K, M = 64, 35
PREFIX = K - M + 1
#: Coordinate-value pairs held by more than so many times CELL documents come later in the order, by level.
LEVELS = (1, 64)
#: Of the 64 packed bits of a pair at similarity 0.8, 57.6 agree on average (deviation 2.4).
MIN_EQUAL_BITS = 47
#: Members of a list that are looked at together.
CELL = 2048
#: Least percentage that the bounds above are made for.
MIN_PERCENT = 80
#: Bounds of what is compared on full sets in one place; a set above the second bound is half a group of its own.
GROUP_DOCS, GROUP_SHINGLES = 512, 1 << 19
TILE = 256

_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, K, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = np.random.default_rng(12).integers(1, 1 << 63, K, np.uint64)


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and where each text's begin."""
    w = V.find_words(buf, off, V.FOLDED)
    at, value = V.windows(w, size)
    text = w.text[at]
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            for h in w.hash[w.first[d] : w.first[d + 1]]:
                whole[i : i + 1] = V.mix((whole[i : i + 1] ^ h) * V._SEEDS[15])
        text, value = np.concatenate([text, short]), np.concatenate([value, whole])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, value = text[new], value[new]
    return value, np.searchsorted(text, np.arange(len(off)))


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """K minima for each non-empty set, as a matrix."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.empty((len(full), K), np.uint64)
    if len(full):
        for k in range(K):
            out[:, k] = np.minimum.reduceat(value * _MULTIPLIERS[k] + _OFFSETS[k], first[full])
    return out


def _profiles(docs: DataFrame, size: int) -> DataFrame:
    schema = "doc_id long, n_shingles long, fp1 long, fp2 long, bits long, keys array<long>"

    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in text_chunks(batch):
                value, first = shingle_sets(buf, off, size)
                n = np.diff(first)
                fp1 = _wrapped_sums(V.mix(value), first)
                fp2 = _wrapped_sums(V.mix(value ^ _OFFSETS[0]), first)
                mins = V.mix(signatures(value, first) + np.arange(K, dtype=np.uint64) * V._BASE)
                packed = ((mins & np.uint64(1)) << np.arange(K, dtype=np.uint64)).sum(1, dtype=np.uint64)
                bits = np.zeros(hi - lo, np.uint64)
                bits[n > 0] = packed
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, K, 0))]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(mins.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), *[pa.array(x.view(np.int64)) for x in (fp1, fp2, bits)], keys], names=["doc_id", "n_shingles", "fp1", "fp2", "bits", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _frequent(profiles: DataFrame) -> list[np.ndarray]:
    """For each level a bitmap over the low bits of keys, of at most 16 MB: set for the keys that go to it or beyond.

    A key that shares its bit with a frequent one is taken for frequent too, everywhere alike, so the order stays an order.
    """
    counts = written(profiles.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LEVELS[0] * CELL), "frequent")
    out = []
    for level in LEVELS:
        keys = counts.where(F.col("n") > level * CELL)
        bits, n = 1 << 20, keys.count()
        while bits < 64 * n and bits < BITMAP_MAX_BITS:
            bits *= 2
        spot = F.col("key").bitwiseAND(F.lit(bits - 1)) + 1
        slices = keys.groupBy(F.bitmap_bucket_number(spot).alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")).toArrow()
        found = np.zeros((bits >> 15, 1 << 12), np.uint8)
        for k, part in zip(slices.column("slice").to_pylist(), slices.column("bits").to_pylist()):
            found[k - 1] = np.frombuffer(part, np.uint8)
        out.append(found.reshape(-1))
    drop_written(counts)
    return out


def _chosen(first: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, size, bits, posted: coordinates of the prefix as bits, keys: theirs) of representatives; keys are counted over all rows."""
    shared = first.sparkSession.sparkContext.broadcast(_frequent(profiles))

    def run(batches):
        for batch in batches:
            keys = batch.column(3).flatten().to_numpy().reshape(-1, K)
            level = np.zeros(keys.shape, np.int64)
            for bits in shared.value:
                spot = keys & np.int64(8 * len(bits) - 1)
                level += (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1
            take = np.sort(np.argsort(level * K + np.arange(K), axis=1)[:, :PREFIX], axis=1)
            posted = (np.uint64(1) << take.astype(np.uint64)).sum(1, dtype=np.uint64)
            heads = pa.ListArray.from_arrays(pa.array(np.arange(0, PREFIX * len(keys) + 1, PREFIX, dtype=np.int32)), pa.array(np.take_along_axis(keys, take, 1).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(posted.view(np.int64)), heads], names=["doc_id", "size", "bits", "posted", "keys"])

    plain = first.select("doc_id", F.col("n_shingles").alias("size"), "bits", "keys")
    found = written(plain.mapInArrow(run, "doc_id long, size long, bits long, posted long, keys array<long>"), "chosen")
    shared.destroy()
    return found


def _wrapped_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _close(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= K - MIN_EQUAL_BITS


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles: sorted 64-bit hashes) of at least the documents among ids."""
    wanted = maybe_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", ids, "__maybe").where("__maybe").select("doc_id", "text")

    def sets(batches):
        for batch in batches:
            for lo, hi, buf, off in text_chunks(batch):
                value, first = shingle_sets(buf, off, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([value[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], names=["doc_id", "shingles"])

    return wanted.mapInArrow(sets, "doc_id long, shingles binary").dropDuplicates(["doc_id"])


def confirm(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    known = full_sets(docs, ids, size)

    def check(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum()) if len(x) else 0
                good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    joined = pairs.join(known.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(known.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    links = written(joined.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"), "links")
    drop_written(pairs)
    return links


def _cells(lists: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(key, lo, hi, members: one or two blocks): what is looked at together, of at most about 2 * CELL members; written tables to drop.

    lists: (key, n, doc_id, size, bits, posted, component, heads), each with more than one component. In a list split by
    bands a member stands in its own band and as a guest in the next one; two guests are not compared there.
    """
    member = F.struct("doc_id", "size", "bits", "component", "heads", "guest", "posted")
    short = lists.where(F.col("n") <= CELL).withColumn("guest", F.lit(False))
    short = short.groupBy("key").agg(F.collect_list(member).alias("block")).select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.array("block").alias("members"))
    # a little more than the ratio of sizes at the threshold, so that linked sets are in one band or in neighbouring ones
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(101 / percent))).cast("int")
    homes = F.array(F.struct(band.alias("band"), F.lit(False).alias("guest")), F.struct((band + 1).alias("band"), F.lit(True).alias("guest")))
    banded = written(lists.where(F.col("n") > CELL).withColumn("home", F.explode(homes)).select("*", "home.band", "home.guest"), "banded")
    sizes = written(banded.groupBy("key", "band").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"), F.bool_or(~F.col("guest")).alias("owned")).where("low <> high and owned").select("key", "band", F.ceil(F.col("m") / CELL).cast("int").alias("blocks")), "bands")
    dealt = banded.join(sizes, ["key", "band"]).withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    packed = dealt.groupBy("key", "band", "mine").agg(F.first("blocks").alias("blocks"), F.collect_list(member).alias("block"))
    paired = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    long_ = paired.groupBy("key", "band", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")).agg(F.collect_list("block").alias("members"))
    # bands of a list get numbers of cells of their own
    shift = F.col("band").cast("long") * F.lit(1 << 32)
    cells = short.select("key", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "members").unionByName(long_.select("key", (shift + F.col("lo")).alias("lo"), (shift + F.col("hi")).alias("hi"), "members"))
    return cells, [banded, sizes]


def _suspects(cells: DataFrame, percent: int) -> DataFrame:
    """(key, lo, hi, group, doc_id, component): members of a cell with a close partner of another component in it.

    A pair is looked at in the list of the first coordinate that it shares and skipped in later ones; lists are told apart by 32 bits
    of their keys here. Suspects of a cell are dealt into groups that can be compared in one place.
    """

    def look(batches):
        for batch in batches:
            out = []
            for key, lo, hi, blocks in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                found = _close_members(key, blocks, percent)
                if found is not None:
                    out.append(((key, lo, hi), *found))
            if out:
                sizes = [len(o[1]) for o in out]
                head = [np.repeat(np.array([o[0][k] for o in out], np.int64), sizes) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*head, *(np.concatenate([o[k] for o in out]) for k in (1, 2, 3)))], names=["key", "lo", "hi", "group", "doc_id", "component"])

    return cells.mapInArrow(look, "key long, lo long, hi long, group long, doc_id long, component long")


def _close_members(key: int, blocks: pa.ListScalar, percent: int):
    """(group, doc_id, component) of a cell's members that have a close partner, or None."""
    members = blocks.values.flatten()
    ids, size, bits, comp, guest = (members.field(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 5))
    if comp.min() == comp.max():
        return None
    posted = ((members.field(6).to_numpy().view(np.uint64)[:, None] >> np.arange(K, dtype=np.uint64)) & np.uint64(1)).astype(bool)
    heads = np.zeros(posted.shape, np.int32)
    heads[posted] = members.field(4).flatten().to_numpy()
    before = int(np.argmax(posted[0] & (heads[0] == int(np.fmod(np.int64(key), np.int64(1 << 31))))))
    first = len(blocks.values[0])  # in a cell of two blocks, pairs within a block belong to other cells
    other = np.arange(len(ids)) if len(blocks.values) == 1 else np.arange(first, len(ids))
    hit = np.zeros(len(ids), bool)
    for lo in range(0, first, TILE):
        rows = slice(lo, min(lo + TILE, first))
        close = np.bitwise_count(bits[rows, None] ^ bits[None, other]) <= K - MIN_EQUAL_BITS
        close &= comp[rows, None] != comp[None, other]
        close &= ~(guest[rows, None] & guest[None, other])
        i, j = np.nonzero(close)
        i, j = i + lo, other[j]
        fit = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
        i, j = i[fit], j[fit]
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            new = ~((heads[x, :before] == heads[y, :before]) & posted[x, :before] & posted[y, :before]).any(1)
            hit[x[new]], hit[y[new]] = True, True
    found = np.flatnonzero(hit)
    if not len(found):
        return None
    full = np.maximum(np.arange(len(found)) // GROUP_DOCS, np.cumsum(size[found]) // GROUP_SHINGLES)
    part = np.unique(full, return_inverse=True)[1]
    parts = int(part[-1]) + 1
    if parts == 1:
        return part, ids[found], comp[found]
    # a group is two parts: every part meets every other one
    pairs = [(a, b) for a in range(parts) for b in range(a + 1, parts)]
    which = [found[(part == a) | (part == b)] for a, b in pairs]
    return np.repeat(np.arange(len(pairs)), list(map(len, which))), ids[np.concatenate(which)], comp[np.concatenate(which)]


def _forest(ids: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between components among some documents, on full sets: enough of them to join what belongs together."""
    n, size = len(ids), np.array([len(s) for s in sets])
    value, back, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    shared = np.cumsum(often > 1) - 1
    use = often[back] > 1
    owner, back = owner[use], shared[back[use]]
    order = np.argsort(back, kind="stable")
    owner, back = owner[order], back[order]
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(shared[-1]) + 1 if len(shared) else 0, 2048):
        a, b = np.searchsorted(back, [lo, lo + 2048])
        part = np.zeros((n, 2048), np.float32)
        part[owner[a:b], back[a:b] - lo] = 1
        both += part @ part.T
    root = {c: c for c in comp.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i in range(n):
        common = both[i, i + 1 :].astype(np.int64)
        linked = (100 * common >= percent * (size[i] + size[i + 1 :] - common)) & (comp[i + 1 :] != comp[i])
        for j in (np.flatnonzero(linked) + i + 1).tolist():
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((max(int(ids[i]), int(ids[j])), min(int(ids[i]), int(ids[j]))))
    return out


def _links_across(docs: DataFrame, lists: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components that the lists allow: suspects are compared in full, in groups of bounded size."""
    cells, used = _cells(lists, percent)
    near = written(_suspects(cells, percent), "suspects")
    for table in used:
        drop_written(table)

    def compare(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        found = _forest(table.column("doc_id").to_numpy(), table.column("component").to_numpy(), sets, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    groups = near.join(full_sets(docs, near.select("doc_id").distinct(), size), "doc_id")
    links = written(groups.groupBy("key", "lo", "hi", "group").applyInArrow(compare, "a long, b long"), "links")
    drop_written(near)
    return links


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id (smallest doc_id with an equal set)."""
    if percent < MIN_PERCENT:
        raise ValueError(f"the match threshold is made for {MIN_PERCENT} percent or more")
    profiles = written(_profiles(docs, size), "profiles")
    real = profiles.where("n_shingles > 0 and doc_id is not null")
    # tables that joins read are written first, so that a join reads two plain shuffles and Spark can split a hot key
    classes = written(real.groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("class_id")), "classes")
    first = real.join(classes.select("class_id"), F.col("doc_id") == F.col("class_id"), "left_semi").dropDuplicates(["doc_id"])
    chosen = _chosen(first, real)
    posted = written(chosen.select("doc_id", "bits", F.explode("keys").alias("key")), "posted")
    leads = written(posted.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "bits")).alias("lead")).where("n > 1"), "leads")
    lists = written(posted.join(leads, "key").select("key", "n", "doc_id", "bits", F.col("lead.doc_id").alias("lead_id"), F.col("lead.bits").alias("lead_bits")), "lists")
    stars = lists.where("doc_id <> lead_id").where(_close("bits", "lead_bits")).select(F.col("doc_id").alias("a"), F.col("lead_id").alias("b"))
    links = confirm(docs, stars, size, percent)
    joined = stars_joined = components(links)
    labelled = written(lists.select("key", "n", "doc_id").join(joined, F.col("doc_id") == F.col("node"), "left").select("key", "n", "doc_id", F.coalesce("component", "doc_id").alias("component")), "labelled")
    mixed = written(labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"), "mixed")
    wide = chosen.select("doc_id", "size", "bits", "posted", F.transform("keys", lambda k: (k % F.lit(1 << 31)).cast("int")).alias("heads"))
    more = _links_across(docs, labelled.join(mixed, "key", "left_semi").join(wide, "doc_id"), size, percent)
    joined = components(links.union(more))
    for table in (chosen, posted, leads, lists, labelled, mixed, links, more, stars_joined):
        drop_written(table)
    out = profiles.select("doc_id", "n_shingles", "fp1", "fp2").join(classes, ["n_shingles", "fp1", "fp2"], "left")
    out = out.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
    out = out.join(joined, F.col("class_id") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "class_id"))
    out = out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"), "class_id")
    found = written(out, "near")
    for table in (profiles, classes, joined):
        drop_written(table)
    return found
