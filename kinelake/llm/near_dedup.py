"""MinHash near-dedup with an LSH forest.

Every distinct set of word shingles has a MinHash signature. The forest is
several orders of the signatures, each starting at another place of them,
range-partitioned and sorted; a set's candidates are the neighbours with the
longest common prefix. How deep a prefix must be adapts to the region:

* Where few sets share one or two values, all of them are neighbours, and
  candidates if the low bits of their signatures agree.
* Sets that share three values always are.
* Regions of many sets are cut at deeper prefixes, into pieces of a bounded
  size, first. What the cuts part meets again: all against all in pieces up to
  MOST_BLOCKED sets, beyond that by prefix filtering on the full sets: of two
  sets at 0.85, the rarest shingles of the one (15 % and one more) and of the
  other have one in common, in any order of all shingles. Sets that are linked
  already, by a piece or to a hub, are compared no further among each other.

Candidates are compared on full sets, exactly, and only a spanning set of links
leaves the comparison, so neither copies nor near copies are ever written out
as pairs.

Chance: two sets at 0.85 agree in three values with 0.61, so that all sixteen
orders miss them has a chance below 1 in 4 million; that they agree in fewer
than LEAST_EQUAL values in all is less likely still. The size of a region
changes neither.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import arrow_schema, discard, join_counted, materialise, table
from .text import column, mix, shingle_sets, token_batches

SHINGLE, PERCENT = 5, 85
VALUES, ORDERS, DEPTH = 48, 16, 3
#: Values of a sort key: the deepest prefix.
KEY = 6
#: The most sets, and shingles of them, that are compared in one piece.
MOST_SETS, MOST_SHINGLES = 1024, 2_000_000
#: Larger regions than this are compared by their rarest shingles, not all against all.
MOST_BLOCKED = 8192
#: Where at most so many sets share a prefix shorter than DEPTH, it makes candidates, if so many of the values' low bits agree.
SPARSE, LEAST_BITS = 32, 38
#: Rows of a sorted order that are looked at in one go.
CHUNK_ROWS = 100_000
#: Slots in which shingles of larger regions are counted, by their hash.
SLOTS = 1 << 21
#: Pairs that agree in fewer values aren't compared: at 0.85, six standard deviations below the mean.
LEAST_EQUAL = 26
#: Up to so many ids (a few MB) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000
_MASKS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix(np.arange(1001, VALUES + 1001, dtype=np.uint64)) | np.uint64(1)

SKETCH = "doc_id long, n_shingles long, node binary, sig array<int>"
ORDERED = "order byte, key binary, node binary, n_shingles long, bits long"
REGIONS = "bucket long, node binary, n_shingles long, n long, s long, piece long"
GROUP = "gid long, node binary"
SETS = "node binary, shingles binary"
LINKS = "a binary, b binary"
TOKENS = "token long, node binary, n_shingles long"


def set_nodes(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 128-bit id for each set, in two columns: two hashes of all its shingles. 0 for an empty set."""
    n, out = np.diff(bounds), np.zeros((len(bounds) - 1, 2), np.uint64)
    for k, salt in enumerate((0x6A09E667F3BCC909, 0xBB67AE8584CAA73B)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        out[:, k] = np.where(n > 0, mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64)), np.uint64(0))
    return out


def as_ids(nodes: np.ndarray) -> pa.Array:
    """Two columns of integers as 16-byte ids."""
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(nodes), [None, pa.py_buffer(np.ascontiguousarray(nodes).tobytes())])
    return fixed.cast(pa.binary())


def _fixed(array: pa.Array, kind, width: int) -> np.ndarray:
    """Equally long binary values as a matrix of ``width`` columns."""
    size = width * np.dtype(kind).itemsize
    array = array.cast(pa.binary(size))
    return np.frombuffer(array.buffers()[1], kind, width * len(array), size * array.offset).reshape(-1, width) if len(array) else np.zeros((0, width), kind)


def of_ids(array: pa.Array) -> np.ndarray:
    return _fixed(array, np.uint64, 2)


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bounds) - 1, VALUES), np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        for k in range(VALUES):
            out[full, k] = np.minimum.reduceat((h ^ _MASKS[k]) * _FACTORS[k], bounds[:-1][full])
    # The low bits of a product depend on few bits of a shingle; the value is told by all.
    return (mix(out) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (the set's id) and signature of each row."""
    schema = arrow_schema(docs.sparkSession.createDataFrame([], SKETCH).schema)

    def run(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("doc_id"))
            for words in token_batches(column(b, "text"), lower=True):
                h, bounds = shingle_sets(words, SHINGLE)
                n, sig = np.diff(bounds), signatures(h, bounds)
                sig = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * VALUES), pa.array(sig.ravel()))
                own = ids.slice(words.rows.start, len(n))
                yield pa.RecordBatch.from_arrays([own, pa.array(n), as_ids(set_nodes(h, bounds)), sig.cast(schema.field("sig").type)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SKETCH)


def _key(*cols: Column) -> Column:
    return F.xxhash64(*cols).alias("bucket")


def _blocked(rows: DataFrame) -> DataFrame:
    """(bucket, node): every pair of a bucket's sets meets in a piece of at most about MOST_SETS.

    Sets are dealt into chunks of half a piece, and each goes to the pieces of
    its chunk with every other one.
    """
    chunks = F.greatest(F.ceil(2 * F.col("n") / MOST_SETS), F.ceil(2 * F.col("s") / MOST_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    each = rows.select("bucket", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    return each.select(_key(F.col("bucket"), F.least("own", "other"), F.greatest("own", "other")), "node")


def _hubs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(order, bucket, hub) of (order, bucket, node) rows.

    The hub is the set nearest to the commonest value at each place of the
    signatures: the text that the others were made from, or like it. Values
    are counted before any shuffle to one place.
    """
    key = ["order", "bucket"]
    values = rows.join(sets.select("node", "sig"), "node").select(*key, "node", F.posexplode("sig").alias("i", "v"))
    common = values.groupBy(*key, "i", "v").agg(F.count(F.lit(1)).alias("c")).groupBy(*key, "i").agg(F.max(F.struct("c", "v")).alias("m"))
    agree = values.join(common.select(*key, "i", F.col("m.v").alias("v")), [*key, "i", "v"]).groupBy(*key, "node").agg(F.count(F.lit(1)).alias("c"))
    return agree.groupBy(*key).agg(F.max(F.struct("c", "node"))["node"].alias("hub"))


def _linked_to_hub(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The (node, hub) pairs that are linked, as (a, b); a hub's pairs are dealt into pieces."""
    schema = arrow_schema(pairs.sparkSession.createDataFrame([], LINKS).schema)

    def run(batches):
        for b in batches:
            sets = [[np.frombuffer(s.as_buffer(), np.uint64) for s in b.column(i)] for i in (2, 3)]
            own = pa.array([bool(linked([x, y])[0, 1]) for x, y in zip(*sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=schema).filter(own)

    pieces = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / MOST_SETS).cast("int").alias("pieces"))
    near = pairs.join(pieces, "hub").withColumn("piece", F.pmod(F.xxhash64("node"), "pieces").cast("int")).drop("pieces").join(full, "node")
    core = pieces.select("hub", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).join(full.toDF("hub", "core"), "hub")
    return near.join(core, ["hub", "piece"]).select("node", "hub", "shingles", "core").mapInArrow(run, LINKS)


def _around_hubs(rows: DataFrame, sets: DataFrame, full: DataFrame) -> DataFrame:
    """(a, b): links of sets to a hub of their region.

    What is not linked goes around again, with a hub of its own, as long as a
    round links a tenth of its sets. The rounds save comparisons only: what
    they leave apart is compared by its rarest shingles.
    """
    key, links = ["order", "bucket"], None
    rows = rows.select(*key, "node")
    while True:
        hubs = materialise(_hubs(rows, sets), "hubs")
        pairs = materialise(rows.join(hubs, key).filter("node <> hub").select("node", "hub").distinct(), "around-hubs")
        found = materialise(_linked_to_hub(pairs, full), "hub-links")
        links = found if links is None else links.unionByName(found)
        done = found.select("a").distinct()
        if 10 * done.count() < rows.select("node").distinct().count():
            return links
        rest = rows.join(done.toDF("node").unionByName(hubs.select(F.col("hub").alias("node"))).distinct(), "node", "left_anti")
        many = rest.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_SETS).select(*key)
        rows = materialise(rest.join(many, key), "apart")
        if rows.isEmpty():
            return links


def _batch_sets(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a batch of (node, shingles), and the bounds of its sets."""
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in b.column(1)]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.cumsum([0, *map(len, sets)])


def _slot(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(SLOTS)).astype(np.int64)


def _rarest(full: DataFrame) -> DataFrame:
    """(token, node, n_shingles): the rarest shingles of each set, so many that two linked sets have one in common.

    A set of n shingles shares at least ceil(0.85 n) with any that it is
    linked to, so n - ceil(0.85 n) + 1 of its shingles do, the first of one
    order of all shingles. The order is by counts of slots, then by hash: counts
    that are too large for some shingles make longer lists, never lost pairs.
    """
    spark = full.sparkSession

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            total += np.bincount(_slot(_batch_sets(b)[0]), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    counts = full.select("node", "shingles").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    often, schema = spark.sparkContext.broadcast(often), arrow_schema(spark.createDataFrame([], TOKENS).schema)

    def run(batches):
        for b in batches:
            h, bounds = _batch_sets(b)
            n = np.diff(bounds)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, often.value[_slot(h)], row))
            first = np.arange(len(h)) - bounds[row] < (n - -(-PERCENT * n // 100) + 1)[row]
            h, row = h[order][first], row[first]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).take(pa.array(row)), pa.array(n[row])], schema=schema)

    return full.select("node", "shingles").mapInArrow(run, TOKENS).distinct()


def _across(rows: DataFrame) -> DataFrame:
    """(bucket, node) of (token, node, n_shingles, class): every two sets of a token that are not of one class meet.

    Tokens of up to MOST_SETS sets are one piece. The sets of larger ones are
    dealt into chunks of half a piece, those of the commonest class apart;
    two chunks meet unless both are of that class.
    """
    classes = rows.groupBy("token", "class").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("cs"))
    sizes = classes.groupBy("token").agg(F.sum("c").alias("n"), F.sum("cs").alias("s"), F.max(F.struct("c", "class", "cs")).alias("big")).filter("n > big.c")
    sizes = materialise(sizes, "tokens")
    fits = (F.col("n") <= MOST_SETS) & (F.col("s") <= MOST_SHINGLES)
    out = rows.join(sizes.filter(fits), "token").select(_key(F.lit(-1), F.col("token")), "node")
    if sizes.filter(~fits).isEmpty():
        return out
    chunks = lambda n, s: F.greatest(F.ceil(2 * n / MOST_SETS), F.ceil(2 * s / MOST_SHINGLES)).cast("int")
    large = sizes.filter(~fits).select(
        "token", F.col("big.class").alias("most"), chunks(F.col("big.c"), F.col("big.cs")).alias("alike"),
        chunks(F.col("n") - F.col("big.c"), F.col("s") - F.col("big.cs")).alias("others"),
    )
    rows = rows.join(large, "token")
    of_most = F.col("class") == F.col("most")
    own = F.when(of_most, F.col("others") + F.pmod(F.xxhash64("node"), "alike")).otherwise(F.pmod(F.xxhash64("node"), "others")).cast("int")
    last = F.when(of_most, F.col("others")).otherwise(F.col("others") + F.col("alike")) - 1
    each = rows.select("token", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return out.unionByName(each.select(_key(F.lit(-1), F.col("token"), F.least("own", "other"), F.greatest("own", "other")), "node"))


def _large_regions(docs: DataFrame, sets: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) within pieces and to hubs, and buckets (bucket, node) in which all other linked sets of large regions meet."""
    wanted = sets.select("doc_id", "node").join(rows.select("node").distinct(), "node")
    full = materialise(_full_sets(docs, wanted), "region-sets")
    pieces = _groups(rows.select(F.col("piece").alias("bucket"), "node").distinct(), sets)
    links = materialise(_links(pieces, full), "piece-links").unionByName(_around_hubs(rows, sets, full))
    classes = components(links)
    tokens = _rarest(full).join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    return links, _across(materialise(tokens.drop("component"), "rarest"))


def _orders(batches, schema: pa.Schema):
    """A row for each set and order: the order's key, and the low bits of all values."""
    for b in batches:
        if b.num_rows:
            sig = b.column(2).flatten().to_numpy().reshape(-1, VALUES)
            padded = np.zeros((len(sig), 64), np.uint8)
            padded[:, :VALUES] = sig & 1
            bits = pa.array(np.packbits(padded, axis=1).view(np.int64).ravel())
            for order in range(ORDERS):
                key = np.roll(sig, -order * (VALUES // ORDERS), axis=1)[:, :KEY].astype(">i4")
                own = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * KEY), len(key), [None, pa.py_buffer(key.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), order, np.int8)), own.cast(pa.binary()), b.column(0), b.column(1), bits], schema=schema)


def _chunks(batches, rows: int):
    """Consecutive rows of a task in tables of about ``rows``."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _too_large(n, s):
    return (n > MOST_SETS) | (s > MOST_SHINGLES)


def _cut(t: pa.Table, schema: pa.Schema):
    """Regions of consecutive rows of a sorted order.

    A region of DEPTH equal values lies inside the chunk, then it comes with
    its size, or touches an end of it, then it has none yet: its other rows are
    in the next chunk, under the same bucket. A region inside has the hash of
    its members as its bucket, so that equal regions of several orders are one.
    """
    get = lambda name: t.column(name).combine_chunks() if t.column(name).num_chunks != 1 else t.column(name).chunk(0)
    order, key, nodes, size = t.column("order").to_numpy(), _fixed(get("key"), np.uint32, KEY), of_ids(get("node")), t.column("n_shingles").to_numpy()
    bits, ids, n = t.column("bits").to_numpy().view(np.uint64), get("node"), len(order)
    equal = np.cumprod(key[1:] == key[:-1], axis=1).sum(1) * (order[1:] == order[:-1])
    common = np.concatenate([[0], equal]).astype(np.int8)  # values shared with the row before

    def runs(depth):
        run = np.cumsum(common < depth) - 1
        run -= run[0]
        return run, np.bincount(run), np.bincount(run, size)

    member = mix(nodes[:, 0] ^ np.uint64(0x3C6EF372FE94F82B))
    run, count, weight = runs(DEPTH)
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    at_end = (run == 0) | (run == run[-1])
    whole = ~_too_large(count, weight)[run]
    content = mix(np.add.reduceat(member, first) + count.astype(np.uint64))[run]
    prefix = order.astype(np.uint64)
    for k in range(DEPTH):
        prefix = mix(prefix * np.uint64(0xA54FF53A5F1D36F1) + key[:, k])
    bucket = np.where(whole & ~at_end, content, prefix)
    # Depth rises in large regions: the shallowest cut that is small enough; what even the deepest leaves too large is cut by position.
    piece, open_ = np.where(whole, run, -1), ~whole
    for depth in range(DEPTH + 1, KEY + 1):
        deep, deep_count, deep_weight = runs(depth)
        fits = open_ & ~_too_large(deep_count, deep_weight)[deep]
        piece[fits] = (depth << 32) + deep[fits]
        open_ &= ~fits
    place = np.cumsum(size) // MOST_SHINGLES * (1 << 20) + np.arange(n) // MOST_SETS
    piece[open_] = (1 << 48) + place[open_]
    piece = mix(piece.astype(np.uint64) * np.uint64(0x510E527FADE682D1) ^ member[0])
    # Depth falls in sparse regions: neighbours are linked by any common prefix, if their low bits agree.
    shallow = [runs(d)[1][runs(d)[0]] <= SPARSE for d in range(1, DEPTH)]
    sparse = np.logical_or.reduce(shallow)
    longest, pairs = common, [np.stack([i := np.flatnonzero((common >= DEPTH) & sparse), i - 1], 1)]
    for k in range(1, SPARSE):
        longest = np.minimum(longest[:-1], common[k:]) if k > 1 else common[1:]
        i = np.flatnonzero((longest > 0) & (longest < DEPTH))
        near = np.zeros(len(i), bool)
        for d in range(1, DEPTH):
            near |= (longest[i] >= d) & shallow[d - 1][i]
        i = i[near]
        pairs.append(np.stack([i, i + k], 1)[np.bitwise_count(bits[i] ^ bits[i + k]) <= VALUES - LEAST_BITS])
        if not (longest > 0).any():
            break
    label = _smallest(n, np.concatenate(pairs))
    _, group, group_n = np.unique(label, return_inverse=True, return_counts=True)
    group_s = np.bincount(group, size).astype(np.int64)
    sums = np.zeros(len(group_n), np.uint64)
    np.add.at(sums, group, member)
    group_id = mix(sums + group_n.astype(np.uint64))

    def rows(pick, bucket, n_sets, total, known, piece):
        column = lambda x: pa.array(x, pa.int64(), mask=~known)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket.view(np.int64)), ids.take(pa.array(pick)), pa.array(size[pick]), column(n_sets), column(total), pa.array(piece.view(np.int64))], schema=schema
        )

    pick = np.flatnonzero(((count[run] > 1) & ~sparse) | at_end)
    if len(pick):
        yield rows(pick, bucket[pick], count[run][pick], weight[run][pick].astype(np.int64), ~at_end[pick], piece[pick])
    pick = np.flatnonzero(sparse & (group_n[group] > 1))
    if len(pick):
        own = group[pick]
        yield rows(pick, group_id[own], group_n[own], group_s[own], np.ones(len(pick), bool), group_id[own])


def _smallest(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows is linked to by pairs."""
    label = np.arange(n)
    while len(pairs):
        least = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], least)
        np.minimum.at(new, pairs[:, 1], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _forest(sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(bucket, node) of candidates; and (order, bucket, node, piece) of regions over MOST_BLOCKED, if any."""
    spark = sets.sparkSession
    ordered, regions = (arrow_schema(spark.createDataFrame([], x).schema) for x in (ORDERED, REGIONS))
    keyed = sets.select("node", "n_shingles", "sig").mapInArrow(lambda batches: _orders(batches, ordered), ORDERED)
    keyed = keyed.repartitionByRange("order", "key", "node").sortWithinPartitions("order", "key", "node")
    rows = materialise(keyed.mapInArrow(lambda batches: (r for t in _chunks(batches, CHUNK_ROWS) for r in _cut(t, regions)), REGIONS), "regions")
    # Regions that touch an end of a chunk: their sizes come from all their rows.
    at_end = rows.filter("n IS NULL").drop("n", "s")
    sizes = at_end.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s")).filter("n > 1")
    sizes = materialise(sizes, "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    rows = rows.filter("n IS NOT NULL").unionByName(join_counted(at_end, sizes, ["bucket"], total))
    fits = (F.col("n") <= MOST_SETS) & (F.col("s") <= MOST_SHINGLES)
    blocks = ~fits & (F.col("n") <= MOST_BLOCKED) & (F.col("s") <= MOST_SHINGLES * (MOST_BLOCKED // MOST_SETS))
    out = rows.filter(fits).select("bucket", "node").distinct()
    larger = materialise(rows.filter(~fits), "larger")
    if larger.isEmpty():
        return out, None
    out = out.unionByName(_blocked(larger.filter(blocks)))
    large = larger.filter(~blocks)
    if large.isEmpty():
        return out, None
    return out, large.select(F.lit(0).alias("order"), "bucket", "node", "piece")


def _spread(links: np.ndarray) -> np.ndarray:
    """The smallest linked index for each row of a symmetric boolean matrix with a true diagonal."""
    label = np.arange(len(links))
    while True:
        new = np.where(links, label, len(label)).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _candidates(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """Split buckets by agreement of whole signatures; a group's id is a hash of its members, so that equal groups of several orders are one."""
    gid, node = [], []
    for members in batch.column(0):
        values = members.values
        ids = values.field("node")
        nodes = of_ids(ids)
        sig = values.field("sig").values.to_numpy()
        offset = values.field("sig").offsets.to_numpy()[0]
        sig = sig[offset : offset + len(nodes) * VALUES].reshape(-1, VALUES)
        equal = np.zeros((len(nodes), len(nodes)), np.uint8)
        for k in range(VALUES):
            equal += sig[:, k][:, None] == sig[:, k]
        label = _spread(equal >= LEAST_EQUAL)
        for one in np.flatnonzero(np.bincount(label, minlength=len(nodes)) > 1):
            own = np.flatnonzero(label == one)
            key = mix(np.array([mix(nodes[own]).sum(dtype=np.uint64) + np.uint64(len(own))]))
            gid.append(np.repeat(key.view(np.int64), len(own))), node.append(ids.take(pa.array(own)))
    if not gid:
        return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(gid)), pa.concat_arrays(node)], schema=schema)


def _groups(meet: DataFrame, sets: DataFrame) -> DataFrame:
    """(gid, node) of the candidates in each bucket of (bucket, node) rows."""
    members = meet.join(sets.select("node", "sig"), "node")
    buckets = members.groupBy("bucket").agg(F.collect_list(F.struct("node", "sig")).alias("members")).select("members")
    schema = arrow_schema(meet.sparkSession.createDataFrame([], GROUP).schema)
    groups = buckets.mapInArrow(lambda batches: (_candidates(b, schema) for b in batches if b.num_rows), GROUP)
    return materialise(groups.distinct(), "groups")


def _links(groups: DataFrame, full: DataFrame) -> DataFrame:
    """(a, b): links within each group, from full sets."""
    spark = groups.sparkSession
    schema = arrow_schema(spark.createDataFrame([], LINKS).schema)
    rows = groups.join(full, "node").select("gid", "node", "shingles")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "gid").sortWithinPartitions("gid", "node")
    return rows.mapInArrow(lambda batches: _verify(batches, schema), LINKS)


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sorted sets have 100 * intersection >= 85 * union: intersections by products of incidence matrices."""
    n = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        both = np.array([[n[0], 0], [0, n[1]]])
        both[0, 1] = both[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        row = np.repeat(np.arange(len(sets)), n)
        _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        new = np.cumsum(count > 1) - 1
        keep = count[col] > 1
        row, col = row[keep], new[col[keep]]
        order = np.argsort(col, kind="stable")
        row, col, both = row[order], col[order], np.zeros((len(sets), len(sets)))
        width = 4096
        for a in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            lo, hi = np.searchsorted(col, [a, a + width])
            x = np.zeros((len(sets), width), np.float32)
            x[row[lo:hi], col[lo:hi] - a] = 1
            both += x @ x.T
    union = n[:, None] + n - both
    out = 100 * both >= PERCENT * union
    out[np.diag_indices(len(n))] = True
    return out


def _verify(batches, schema: pa.Schema):
    """Links of each group of (gid, node, shingles) rows, which come sorted by gid: one from each linked set to its smallest."""
    gid, nodes, sets = None, [], []

    def close():
        label = _spread(linked(sets))
        at = np.flatnonzero(label != np.arange(len(label)))
        ids = pa.array(nodes, pa.binary())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), ids.take(pa.array(label[at]))], schema=schema)

    for b in batches:
        for g, node, s in zip(*(b.column(i) for i in range(3))):
            if g.as_py() != gid:
                if len(nodes) > 1:
                    yield close()
                gid, nodes, sets = g.as_py(), [], []
            if nodes and nodes[-1] == node.as_py():
                continue  # the set of a row that repeats
            nodes.append(node.as_py()), sets.append(np.frombuffer(s.as_buffer(), np.uint64))
    if len(nodes) > 1:
        yield close()


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) for the (doc_id, node) rows wanted, from whole texts; a row that repeats, once for each."""
    spark = docs.sparkSession
    schema = arrow_schema(spark.createDataFrame([], SETS).schema)

    def run(batches):
        for b in batches:
            asked = of_ids(b.column(b.schema.get_field_index("node")))
            for words in token_batches(column(b, "text"), lower=True):
                h, bounds = shingle_sets(words, SHINGLE)
                nodes = set_nodes(h, bounds)
                # Rows may share a doc_id without sharing a text.
                own = np.flatnonzero((nodes == asked[words.rows]).all(1))
                found = [h[bounds[i] : bounds[i + 1]].tobytes() for i in own]
                yield pa.RecordBatch.from_arrays([as_ids(nodes[own]), pa.array(found, pa.binary())], schema=schema)

    wanted = materialise(wanted.select("doc_id", "node"), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")
    return found.select("node", "text").mapInArrow(run, SETS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) runs of bytes other than ASCII white space; a
    text of one to four words is one shingle; a null or empty one has none and
    is linked to nothing. Equal sets are one node, with the smallest id of its
    rows, so copies cost a group-by and one join back, in which a set that a
    large share of all rows has is no task of its own. Rows are judged by
    their own text: rows that repeat an id with several texts may lie in
    several components. A row without an id is kept never, and has the
    component of the rows with an id that have its set, if there are any.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    sketches = materialise(sketch(docs), "sketches")
    nodes = sketches.filter("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n")
    )
    every = materialise(nodes, "nodes")
    nodes = every.filter("doc_id IS NOT NULL")
    meet, large = _forest(nodes)
    if large is not None:
        found_before, more = _large_regions(docs, nodes, large)
        meet = meet.unionByName(more)
    groups = _groups(meet, nodes)
    wanted = nodes.select("doc_id", "node").join(groups.select("node").distinct(), "node")
    found = _links(groups, _full_sets(docs, wanted))
    found = materialise(found if large is None else found.unionByName(found_before), "links")
    first = nodes.select("node", "doc_id")
    links = found.join(first.toDF("a", "u"), "a").join(first.toDF("b", "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    grouped = components(links).toDF("doc_id", "component")
    known = every.select("node", "doc_id", "n").join(grouped, "doc_id", "left").select("node", F.coalesce("component", "doc_id").alias("component"), "n")
    known = materialise(known, "components")
    discard(found, groups, every)
    rows = sketches.select("doc_id", "n_shingles", "node")
    out = join_counted(rows.filter("n_shingles > 0"), known, ["node"], known.agg(F.sum("n")).first()[0] or 0)
    out = out.select("doc_id", "n_shingles", "component").unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
