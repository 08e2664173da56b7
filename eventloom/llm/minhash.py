"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, exact confirmation.

**Signature.** ``SYMBOLS`` minima of a document's distinct shingles under as many hash functions,
16 bits of each. Two documents of similarity s differ in each symbol with probability 1 - s, so
``radius`` symbols are allowed to differ, so many that a pair at the threshold exceeds it with a
probability below ``MISSED``.

**Multi-index join.** A signature is cut into chunks. With fewer than radius + 1 = sum(e_i + 1)
errors over chunks allowed e_i errors each, some chunk has no more than its allowance (pigeonhole).
Here every chunk is allowed one error: it gives one key for each symbol left out, and any two
chunks that differ in at most one symbol share a key. So every pair within the radius meets in
a key; nothing else decides who meets.

**Confirmation.** Candidates are compared on their full shingle sets, in counts. Documents with
equal sets are one class, and only one member of a class is compared. Components are wanted, not
all pairs: twice, each class is confirmed with the nearest hub it meets, a hub being the member
of a key that most others are close to; this joins nearly all that belongs together. Then, within
the keys that still hold classes of several components, all pairs across components are
confirmed that are within the radius, of the signature and of one of ``LONG`` symbols that only
candidates have, inside the task that holds the key's members, which gives a spanning forest of them. Pairs of one
component are skipped; no other pair is. Large keys are dealt out in pairs of blocks.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Null and wordless texts have no shingles,
link with nothing and are kept. Rows with the same or no id are told apart by their sets; a null
id is never the least of a component unless there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.components import components
from eventloom.llm.text import Words, mix, not_spaces, rolling, small_batches, spans
from eventloom.session import materialize

SYMBOLS = 64
#: Symbols of the longer signature that candidates are compared by before they are confirmed.
LONG = 512
MISSED = 1e-6
PIECE_BYTES = 2 << 20
#: Members of a key compared in one task at once, twice over.
BLOCK = 2000
#: Bytes of full sets that a task keeps while it confirms pairs.
SET_BYTES = 32 << 20
#: Bits of the map that says which rows' texts are wanted for confirmation.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30

MEASURED = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("signature", T.BinaryType())]
)
U64 = np.uint64


@cache
def radius(threshold: int, symbols: int = SYMBOLS) -> int:
    """The least number of differing symbols that pairs of this similarity (in percent) rarely exceed."""
    p, left, r = 1 - threshold / 100, 1.0, -1
    while left > MISSED:
        r += 1
        left -= comb(symbols, r) * p**r * (1 - p) ** (symbols - r)
    return r


@cache
def chunks(threshold: int, symbols: int = SYMBOLS) -> list[list[int]]:
    """The symbols of each chunk: (radius + 1) / 2 chunks, as each is allowed one error."""
    n = (radius(threshold, symbols) + 2) // 2
    return [list(map(int, part)) for part in np.array_split(np.arange(symbols), n)]


@cache
def _factors(symbols: int) -> np.ndarray:
    return mix(np.arange(101, 101 + symbols, dtype=U64)) | U64(1)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order; fewer than k words are one shingle."""
    words = Words(texts, not_spaces(), lower=True)
    grams = rolling(words.hashes, range(k), salt=k)
    sets = []
    for low, high in zip(words.first[:-1], words.first[1:]):
        if high - low >= k:
            sets.append(np.unique(grams[low : high - k + 1]))
        else:
            sets.append(rolling(words.hashes[low:high], range(high - low), salt=high - low) if high > low else np.empty(0, U64))
    return sets


def _set_hash(hashes: np.ndarray, salt: int) -> np.int64:
    return mix(hashes ^ U64(salt)).sum(dtype=U64).view(np.int64)


def _measure(texts: pa.Array, k: int, with_signature: bool = True) -> pa.Array:
    n, h1, h2, signatures = [], [], [], []
    for low, high in spans(texts, PIECE_BYTES):
        sets = shingle_sets(texts.slice(low, high - low), k)
        n += [len(s) for s in sets]
        h1 += [int(_set_hash(s, 1)) for s in sets]
        h2 += [int(_set_hash(s, 0x5851F42D4C957F2D)) for s in sets]
        if with_signature:
            signatures += _signatures(sets)
    columns = [pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())]
    if with_signature:
        columns.append(pa.array(signatures, pa.binary()))
    return pa.StructArray.from_arrays(columns, MEASURED.names[: len(columns)])


def _signatures(sets: list[np.ndarray], symbols: int = SYMBOLS) -> list[bytes | None]:
    full = [s for s in sets if len(s)]
    if not full:
        return [None] * len(sets)
    joined, starts = np.concatenate(full), np.cumsum([0, *map(len, full[:-1])])
    table = np.empty((len(full), symbols), "<u2")
    product = np.empty_like(joined)
    for i, factor in enumerate(_factors(symbols)):
        np.multiply(joined, factor, out=product)
        table[:, i] = mix(np.minimum.reduceat(product, starts)) & U64(0xFFFF)
    rows = iter(table)
    return [next(rows).tobytes() if len(s) else None for s in sets]


def measure(documents: DataFrame, k: int, text: str = "text") -> DataFrame:
    """(row, doc_id, n, h1, h2, signature) of every document, stored."""

    @F.arrow_udf(MEASURED)
    def measured(texts: pa.Array) -> pa.Array:
        return _measure(texts, k)

    columns = small_batches(documents).select("doc_id", measured(F.col(text)).alias("m")).select("doc_id", "m.*")
    return materialize(columns.withColumn("row", F.monotonically_increasing_id()), "signatures")


def with_keys(classes: DataFrame, threshold: int) -> DataFrame:
    """(node, slot, key): a key for each chunk and symbol left out of it; slot is that symbol."""
    parts = chunks(threshold)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def keys_of(signatures: pa.Array) -> pa.Array:
        table = np.frombuffer(b"".join(signatures.to_pylist()), "<u2").reshape(-1, SYMBOLS).astype(U64)
        keys = []
        for c, chunk in enumerate(parts):
            terms = mix(table[:, chunk] + U64(1) + (np.array(chunk, U64) << U64(20)))
            whole = terms.sum(axis=1, dtype=U64) if len(chunk) > 1 else np.zeros(len(table), U64)
            keys += [mix(whole - (terms[:, i] if len(chunk) > 1 else U64(0)) + U64(c * SYMBOLS + i)) for i in range(len(chunk))]
        flat = np.stack(keys, axis=1).view(np.int64)
        return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), pa.array(flat.ravel()))

    # A signature becomes many keys: small partitions before, or tasks after are large.
    partitions = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = classes.select("node", "signature").repartition(partitions, "node")
    return dealt.select("node", F.posexplode(keys_of("signature")).alias("slot", "key"))


def _wanted_texts(documents: DataFrame, wanted: DataFrame, n_wanted: int, k: int, text: str) -> DataFrame:
    """(node, packed, long): the compressed text and the longer signature of a member of each wanted class.

    wanted: (node, doc_id, h1, h2). Rows are picked where they are read, by a bit map of bounded
    size; what passes it by chance falls out of the join.
    """
    bits = LEAST_BITS
    while bits < min(32 * n_wanted, MOST_BITS):
        bits *= 2
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(bits))
    words = wanted.select(place.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    table = np.zeros(bits >> 6, U64)
    for batch in words.select("at", "word").toArrow().to_batches():
        table[batch.column("at").to_numpy()] = batch.column("word").to_numpy().view(U64)
    shared = documents.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf(T.BooleanType())
    def may_be_wanted(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array((shared.value[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1)

    kind = [*MEASURED.fields[:3], T.StructField("packed", T.BinaryType()), T.StructField("long", T.BinaryType())]

    @F.arrow_udf(T.StructType(kind))
    def measured(texts: pa.Array) -> pa.Array:
        sets, press = _measure(texts, k, with_signature=False), zstandard.ZstdCompressor(level=3)
        packed = pa.array([press.compress(t.as_py().encode()) for t in texts], pa.binary())
        signatures = [s for a, b in spans(texts, PIECE_BYTES) for s in _signatures(shingle_sets(texts.slice(a, b - a), k), LONG)]
        return pa.StructArray.from_arrays([*sets.flatten(), packed, pa.array(signatures, pa.binary())], [f.name for f in kind])

    rows = documents.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).filter(may_be_wanted(place))
    rows = rows.select("doc_id", measured("text").alias("m")).select("doc_id", "m.h1", "m.h2", "m.packed", "m.long")
    same = F.col("w.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("w.h1") == F.col("r.h1")) & (F.col("w.h2") == F.col("r.h2"))
    picked = rows.alias("r").join(wanted.alias("w"), same).select("w.node", "r.packed", "r.long")
    return materialize(picked.dropDuplicates(["node"]), "candidate-texts")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= threshold * union, by their full sets."""

    @F.arrow_udf(T.BooleanType())
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        out, press = [], zstandard.ZstdDecompressor()
        for low in range(0, len(left), 256):
            part = [pa.array([press.decompress(x.as_py()).decode() for x in side.slice(low, 256)], pa.string()) for side in (left, right)]
            for a, b in zip(*(shingle_sets(texts, k) for texts in part)):
                common = len(np.intersect1d(a, b, assume_unique=True))
                out.append(100 * common >= threshold * (len(a) + len(b) - common))
        return pa.array(out, pa.bool_())

    of_a = texts.select(F.col("node").alias("a"), F.col("packed").alias("left"))
    of_b = texts.select(F.col("node").alias("b"), F.col("packed").alias("right"))
    return pairs.join(of_a, "a").join(of_b, "b").filter(linked("left", "right")).select("a", "b")


def _nearest(members: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of different components: each node a with the nearest b of the hubs it meets."""
    short = nodes.withColumn("long", F.lit(b""))  # hubs are chosen by the shorter signature
    by_key = _compared(members, short, threshold, _hub_pairs, "node long, hub long, distance long")
    best = by_key.groupBy("node").agg(F.min_by("hub", F.struct("distance", "hub")).alias("hub"))
    return best.select(F.col("node").alias("a"), F.col("hub").alias("b"))


def _across(members: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links (a, b) that join all that is linked across components: a spanning forest of each group.

    First, each group's members that have a partner within the radius are found; only they come again with
    their texts, to the task that confirms pairs on full sets. A pair that earlier links of the group join
    is skipped, so no pair becomes a row and a group gives fewer links than it has members.
    """
    with_partner = _compared(members, nodes, threshold, _partners, ", ".join(f"{c} long" for c in _Members.COLUMNS))
    partners = materialize(with_partner, "partners")
    rows = partners.join(nodes.select("node", "signature", "long"), "node").join(texts.select("node", "packed"), "node")

    def forest(rows: _Members, threshold: int) -> pa.RecordBatch:
        return _forest(rows, k, threshold)

    return _grouped(rows, threshold, forest, "a long, b long", [*_Members.COLUMNS, "signature", "long", "packed"])


def _compared(members: DataFrame, nodes: DataFrame, threshold: int, compare, schema: str) -> DataFrame:
    """Runs ``compare`` over the members of all keys that have several components.

    members: (key, slot, node, component); nodes: (node, n, signature, long). Members of large
    keys are dealt into blocks, of which each pair (i, j), i <= j, is a group of its own.
    """
    mixed = members.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    mixed = materialize(mixed.select("key", "size"), "mixed-keys")
    rows = members.join(mixed, "key").join(nodes, "node")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return _grouped(rows, threshold, compare, schema, [*_Members.COLUMNS, "signature", "long"])


def _grouped(rows: DataFrame, threshold: int, compare, schema: str, columns: list[str]) -> DataFrame:
    """Runs ``compare`` over the groups (key, i, j) of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups follow each other; the rows of the last one wait for the next batch."""
        held = None
        for batch in chain(batches, [None]):
            parts = [t for t in (held, None if batch is None else pa.Table.from_batches([batch])) if t is not None]
            rows = pa.concat_tables(parts).combine_chunks() if parts else None
            if rows is None or not rows.num_rows:
                continue
            key, i, j = (rows.column(c).to_numpy() for c in columns[:3])
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            stop = rows.num_rows if batch is None else int(np.flatnonzero(new)[-1])
            held = rows.slice(stop) if stop < rows.num_rows else None
            if stop:
                yield compare(_Members(rows.slice(0, stop), np.cumsum(new[:stop])), threshold)

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    binary = columns[len(_Members.COLUMNS) :]
    typed = rows.select(*(F.col(c).cast("long").alias(c) for c in _Members.COLUMNS), *binary)
    ordered = typed.repartition(partitions, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return ordered.mapInArrow(run, schema)


class _Members:
    """Members of keys, as columns; ``group`` numbers the (key, i, j) they are in, in order."""

    COLUMNS = ["key", "i", "j", "slot", "node", "component", "n", "block"]

    def __init__(self, rows: pa.Table, group: np.ndarray):
        self.group = group
        for c in self.COLUMNS:
            setattr(self, c, rows.column(c).to_numpy())
        self.packed = rows.column("packed") if "packed" in rows.column_names else None
        self.signatures = np.frombuffer(b"".join(rows.column("signature").to_pylist()), "<u2").reshape(-1, SYMBOLS)
        long = b"".join(rows.column("long").to_pylist())
        self.long = np.frombuffer(long, "<u2").reshape(-1, LONG) if long else None

    def steps(self, threshold: int) -> Iterator[tuple[np.ndarray, int]]:
        """(x, step): rows x and x + step of a group that are of different components and sizes that can be linked.

        Row x is paired with row x + 1 in all groups at once, then with x + 2, up to the largest group.
        """
        for step in range(1, int(np.bincount(self.group).max())):
            x, y = slice(None, -step), slice(step, None)
            pair = (self.group[x] == self.group[y]) & (self.component[x] != self.component[y])
            pair &= (self.i[x] == self.j[x]) | (self.block[x] != self.block[y])
            pair &= 100 * np.minimum(self.n[x], self.n[y]) >= threshold * np.maximum(self.n[x], self.n[y])
            yield np.flatnonzero(pair), step


def _near_pairs(rows: _Members, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, distance): rows within the radius of both signatures, in the first key that the two share."""
    parts = chunks(threshold)
    starts = np.array([p[0] for p in parts])
    for x, step in rows.steps(threshold):
        differ = rows.signatures[x] != rows.signatures[x + step]
        keep = differ.sum(axis=1) <= radius(threshold)
        x, differ = x[keep], differ[keep]
        errors = np.add.reduceat(differ, starts, axis=1, dtype=np.int64)
        chunk = np.argmax(errors <= 1, axis=1)
        # In that chunk, the first key leaves out the one error, or the first symbol.
        of_chunk = np.arange(SYMBOLS)[None, :] >= starts[chunk][:, None]
        wrong = differ & of_chunk & (errors[np.arange(len(x)), chunk] == 1)[:, None]
        slot = np.where(wrong.any(axis=1), np.argmax(wrong, axis=1), starts[chunk])
        x = x[slot == rows.slot[x]]
        distance = (rows.long[x] != rows.long[x + step]).sum(axis=1)
        keep = distance <= radius(threshold, LONG)
        yield x[keep], x[keep] + step, distance[keep]


def _partners(rows: _Members, threshold: int) -> pa.RecordBatch:
    """The rows that are near another of their group."""
    found = np.zeros(len(rows.group), bool)
    for x, y, _ in _near_pairs(rows, threshold):
        found[x] = found[y] = True
    return pa.record_batch({c: pa.array(getattr(rows, c)[found]) for c in rows.COLUMNS})


def _forest(rows: _Members, k: int, threshold: int) -> pa.RecordBatch:
    """Links of a spanning forest of each group's linked rows.

    The pairs of one step are held at a time; those that earlier links join are skipped.
    """
    # Rows of a group and component are one set to begin with.
    part = np.unique(np.stack([rows.group, rows.component], axis=1), axis=0, return_inverse=True)[1].ravel()
    press, sets, held, links = zstandard.ZstdDecompressor(), {}, 0, []

    def set_of(row: int) -> np.ndarray:
        nonlocal held
        node = int(rows.node[row])
        if node not in sets:
            if held > SET_BYTES:
                sets.clear()
                held = 0
            text = press.decompress(rows.packed[row].as_py()).decode()
            sets[node] = shingle_sets(pa.array([text], pa.string()), k)[0]
            held += sets[node].nbytes
        return sets[node]

    for x, y, distance in _near_pairs(rows, threshold):
        apart = part[x] != part[y]
        order = np.argsort(distance[apart], kind="stable")
        for a, b in zip(x[apart][order].tolist(), y[apart][order].tolist()):
            if part[a] != part[b]:
                first, second = set_of(a), set_of(b)
                common = len(np.intersect1d(first, second, assume_unique=True))
                if 100 * common >= threshold * (len(first) + len(second) - common):
                    part[part == part[b]] = part[a]
                    links.append((int(rows.node[a]), int(rows.node[b])))
    return pa.record_batch({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _hub_pairs(rows: _Members, threshold: int) -> pa.RecordBatch:
    """Each member with its group's hub, the one that most others are close to."""
    close = np.zeros(len(rows.group), np.int64)
    most = int(SYMBOLS * (1 - threshold / 100))
    for x, step in rows.steps(threshold):
        x = x[(rows.signatures[x] != rows.signatures[x + step]).sum(axis=1) <= most]
        close[x] += 1
        close[x + step] += 1
    order = np.lexsort((rows.node, -close, rows.group))
    first = np.concatenate([[True], np.diff(rows.group[order]) > 0])
    hub = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    x = order[(rows.component[order] != rows.component[hub])]
    hub = hub[(rows.component[order] != rows.component[hub])]
    distance = (rows.signatures[x] != rows.signatures[hub]).sum(axis=1)
    x, hub, distance = (v[distance <= radius(threshold)] for v in (x, hub, distance))
    return pa.record_batch({"node": pa.array(rows.node[x]), "hub": pa.array(rows.node[hub]), "distance": pa.array(distance, pa.int64())})


def _labelled(rows: DataFrame, labels: DataFrame, by: str = "node") -> DataFrame:
    """Rows with the ``component`` that labels, of a row per ``by``, give them; their own or their node where none does."""
    if by == "component":
        return rows.join(labels, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    kept = [c for c in rows.columns if c != "component"]
    return rows.select(*kept).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _between(links: DataFrame, labels: DataFrame, only_b: bool = False) -> DataFrame:
    """Links (a, b) between the labels of their ends, or of b alone, that have different ones."""
    of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
    of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
    joined = links.join(of_b, "b", "left").withColumn("b", F.coalesce("of_b", "b")).drop("of_b")
    if not only_b:
        joined = joined.join(of_a, "a", "left").withColumn("a", F.coalesce("of_a", "a")).drop("of_a")
    return joined.filter("a != b").select("a", "b")


def duplicate_groups(documents: DataFrame, k: int, threshold: int, text: str = "text") -> DataFrame:
    """(doc_id, n, h1, h2, component) of every row: the least doc_id that it is linked with."""
    rows = measure(documents, k, text)
    classes = rows.filter("n > 0").groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = materialize(classes, "classes")
    keys = with_keys(classes, threshold)
    shared_keys = materialize(keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").drop("size"), "shared-keys")
    members = materialize(keys.join(shared_keys, "key"), "key-members")
    candidates = members.select("node").distinct()
    wanted = classes.select("node", "doc_id", "h1", "h2").join(candidates, "node")
    texts = _wanted_texts(documents, wanted, candidates.count(), k, text)
    nodes = materialize(classes.select("node", "n", "signature").join(texts.select("node", "long"), "node"), "candidates")

    # First, nodes confirmed with a hub are labelled with it, then labels with the least one they are
    # linked to: parts of components, found without iteration. Only what is still apart is compared.
    alone = members.withColumn("component", F.col("node"))
    first = materialize(_nearest(alone, nodes, threshold), "hub-pairs")
    stars = materialize(confirmed(first, texts, k, threshold).select(F.col("a").alias("node"), F.col("b").alias("component")), "hub-links")
    second = materialize(_nearest(materialize(_labelled(members, stars), "stars"), nodes, threshold), "hub-pairs")
    links = _between(confirmed(second, texts, k, threshold), stars)
    # A hub may have a hub of its own.
    hubs = _between(stars.select(F.col("component").alias("a"), F.col("component").alias("b")).distinct(), stars, only_b=True)
    edges = materialize(links.union(hubs).distinct(), "label-links")
    least = materialize(edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "least-labels")
    named = _labelled(stars, least.withColumnRenamed("component", "least").withColumnRenamed("node", "component"), "component")
    own = least.join(stars.select("node"), "node", "left_anti")  # labels that are nodes without a star
    labels = materialize(named.union(own.select("node", "component")), "labels")
    new = materialize(_across(materialize(_labelled(members, labels), "apart"), nodes, texts, k, threshold), "links")
    contracted = _between(edges, least).union(_between(new, labels)).distinct()
    found = materialize(components(contracted), "components")
    of_label = found.select(F.col("node").alias("label"), F.col("component").alias("root"))
    of_node = labels.select("node", F.col("component").alias("label")).join(of_label, "label", "left").select("node", F.coalesce("root", "label").alias("component"))
    found = materialize(of_node.union(found.join(labels, "node", "left_anti")), "components")

    of_class = classes.select("h1", "h2", "node", F.col("doc_id").alias("least_id")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_class = materialize(of_class, "class-components")
    least = materialize(of_class.groupBy("component").agg(F.min("least_id").alias("component_id")), "component-ids")
    of_set = materialize(of_class.join(least, "component").select("h1", "h2", "component_id"), "set-components")
    return rows.select("doc_id", "n", "h1", "h2").join(of_set, ["h1", "h2"], "left").select("doc_id", "n", "h1", "h2", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(documents: DataFrame, k: int = 3, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and whether the row is the one its group keeps."""
    grouped = duplicate_groups(documents, k, threshold)
    return grouped.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(documents: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``documents`` without near duplicates: one row of each group stays.

    Of rows with the least id of a group, one stays. Rows without words all stay; so does one row
    of each set in a group in which no row has an id.
    """
    grouped = materialize(duplicate_groups(documents, k, threshold).filter("n > 0"), "duplicate-groups")
    kept = grouped.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("s"))
    # Groups with ids differ in them; a null id is a group's only if none of its rows has one.
    no_id = grouped.filter(F.col("component_id").isNull()).select("doc_id", F.struct("h1", "h2").alias("s")).distinct()
    chosen = materialize(kept.filter(F.col("doc_id").isNotNull()).union(no_id).select("doc_id", "s.*"), "chosen")

    @F.arrow_udf(T.StructType(MEASURED.fields[:3]))
    def set_of(texts: pa.Array) -> pa.Array:
        return _measure(texts, k, with_signature=False)

    packed = documents.select(F.struct("*").alias("doc"), set_of("text").alias("m")).select("doc", F.col("doc.doc_id").alias("id"), "m.n", "m.h1", "m.h2")
    same = F.col("p.id").eqNullSafe(F.col("c.doc_id")) & (F.col("p.h1") == F.col("c.h1")) & (F.col("p.h2") == F.col("c.h2"))
    stay = packed.filter("n > 0").alias("p").join(chosen.alias("c"), same, "left_semi").dropDuplicates(["id", "h1", "h2"])
    return stay.select("doc.*").union(packed.filter("n = 0").select("doc.*"))
