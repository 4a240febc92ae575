"""N-gram Jaccard join: prefix filters under several global token orders.

A document's set is the 64-bit hashes of its distinct word shingles.  Equal
sets are one class (a 64-bit key of the set; hashes are taken as identity), so
copies are never paired.  For a threshold t, sets with Jaccard >= t share a
token among the first ``n - ceil(t n) + 1`` tokens of each, under *any* global
order.  The orders used here put rare tokens first: a fixed-size table of
counts, summed over the whole corpus, gives each token a frequency class (an
estimate is enough, any order is valid), and inside a class each order has its
own hash permutation.

1. One pass over the texts: class key and size of each document, counts.
2. One pass: prefix tokens under order 0 with their places in it, to blocks of
   classes by token; blocks of one class are dropped.
3. Star rounds, which need not find everything: every class is compared with
   one leader of its blocks, the most central one - its prefix tokens stand in the
   largest blocks, as those of a text do that others are copies of; a copy's own
   changes put tokens of their own, and so rare ones, first.  Links give components.
4. Closing round, which has to: all pairs of one block *in different
   components* that pass the place filter: sets that first meet in a token at
   places i and j share at most ``min(n_a - i, n_b - j)`` tokens, and similar sets
   pass it with that token.  The condition is part of the block join, large blocks
   are dealt to several tasks by salt.

A candidate pair (in 3 and 4) must also meet under every further order, with the
same place filter: only the short prefixes are moved for that.  The pairs left
are verified exactly on the whole sets, a leader's followers in salted groups.
Sets and further prefixes are read again from the texts, in one pass a round,
for classes in pairs that were in none before: one text of each, known by a
64-bit key (a bit table says which may be).  They are laid down in buckets by
class, so that pairs are moved to sets; what is moved of sets to judge a pair
are prefixes and sketches (a bit for each token), and whole sets only for pairs
that pass.

Edge cases: NULL or empty text: n_shingles 0, linked with nothing (its
component is its own doc_id).  With fewer words than a shingle the whole
sequence is the one shingle.  Rows with NULL doc_id take part; they are
returned with the component of their class's smallest doc_id, NULL if no
doc_id is reachable.  Repeated rows are rows of one class; a doc_id on several
texts is several nodes of that name.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucketed, new_table, pack, slices, texts, unpack, written
from .components import components

ORDERS = 3
COUNTERS = 1 << 23
MOST_BITS = 1 << 30
SLICES = 32
FOLLOWERS = 64
STAR_ROUNDS = 4
MOST_PAIRS = 16
BLOCK_ROWS = 2048
EARLIER = 2
LONG = 64
MOST_SKETCH = 1 << 20


def word_hashes(data, start, size):
    """64-bit hashes of the words ``data[start:start + size]``: eight bytes at a
    time, longer words than LONG on their own."""
    import numpy as np
    import xxhash
    data = np.concatenate([data, np.zeros(8, dtype="uint8")])
    eight = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    below = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype="uint64")
    out = mixed(size.astype("uint64"))
    at = np.arange(len(size))
    for lane in range(0, LONG, 8):
        at = at[size[at] > lane]
        if not len(at):
            return out
        x = eight[start[at] + lane] & below[np.minimum(size[at] - lane, 8)]
        out[at] = mixed(out[at] * np.uint64(0x9E3779B97F4A7C15) + x)
    for i in at[size[at] > LONG].tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i]:start[i] + size[i]])
    return out


def shingled(texts: pa.Array, words: int):
    """The sets of texts (no NULLs), one after the other: sorted 64-bit hashes
    of distinct shingles, and where each text's begin and end."""
    import numpy as np
    import pyarrow.compute as pc
    low = pc.ascii_lower(texts)
    edge = np.asarray(pc.fill_null(pc.binary_length(low), 0), dtype="int64")
    wide = low.type == pa.large_string()
    offset = np.frombuffer(low.buffers()[1], dtype="int64" if wide else "int32")[low.offset:low.offset + len(low) + 1]
    edge = np.concatenate([[0], np.cumsum(edge)])
    data = low.buffers()[2]
    data = np.frombuffer(data, dtype="uint8")[offset[0]:offset[0] + edge[-1]] if data is not None else np.zeros(0, "uint8")
    # words: runs of bytes that are not white space, inside one text
    inside = (data != 32) & ((data < 9) | (data > 13))
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    filled = edge[1:] > edge[:-1]
    head, tail = edge[:-1][filled], edge[1:][filled] - 1
    opens[head], closes[tail] = inside[head], inside[tail]
    start = np.flatnonzero(opens)
    h = word_hashes(data, start, np.flatnonzero(closes) + 1 - start)
    begin = np.searchsorted(start, edge)                     # each text's words
    n = np.diff(begin)
    # a shingle at every word that has enough words after it in its text
    out = h.copy()
    for i in range(1, words):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out[:max(0, len(h) - i)] += h[i:]
    size = np.where(n < words, np.minimum(n, 1), n - words + 1)
    place = np.arange(len(h)) - np.repeat(begin[:-1], n)
    for i in np.flatnonzero((n > 0) & (n < words)).tolist():
        key = int(n[i])                                      # the whole sequence
        for x in h[begin[i]:begin[i + 1]].tolist():
            key = (key * 0x9E3779B97F4A7C15 + x) % (1 << 64)
        out[begin[i]] = key
    out = mixed(out[place < np.repeat(size, n)])
    ends = np.concatenate([[0], np.cumsum(size)])
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
        out[lo:hi].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    new[ends[:-1][size > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[ends]


def mixed(x):
    """A bijective scramble of 64-bit integers."""
    import numpy as np
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def set_key(tokens) -> int:
    """The class of a set: a signed 64-bit hash of its sorted tokens."""
    import xxhash
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)


def order_keys(tokens, kinds, order: int):
    """Sort keys of tokens under one global order: frequency class (6 bits),
    then this order's permutation."""
    import numpy as np
    kind = kinds[(tokens >> np.uint64(40)).astype("int64") % COUNTERS].astype("uint64")
    turned = mixed(tokens + np.uint64(order * 0x632BE59BD9B4E019 % (1 << 64)))
    return kind << np.uint64(58) | turned >> np.uint64(6)


def prefix(tokens, kinds, order: int, percent: int):
    """The prefix under one order, in that order."""
    return tokens[prefixes(tokens, [0, len(tokens)], kinds, order, percent)[0]]


def prefixes(tokens, ends, kinds, order: int, percent: int) -> list:
    """Of each set that is not empty, the places of its prefix under one order,
    in that order."""
    keys, out = order_keys(tokens, kinds, order), []
    for lo, hi in zip(ends[:-1], ends[1:]):
        if hi > lo:
            own, n = keys[lo:hi], int(hi - lo)
            first = own.argpartition(n - -(-percent * n // 100))[:n - -(-percent * n // 100) + 1]
            out.append(lo + first[own[first].argsort()])
    return out


def sketch(tokens) -> bytes:
    """A bit for each token, in a table of a power of two of bits."""
    import numpy as np
    size = min(MOST_SKETCH, max(64, 1 << (4 * len(tokens) - 1).bit_length()))
    table = np.zeros(size, dtype="uint8")
    table[tokens & np.uint64(size - 1)] = 1
    return np.packbits(table).tobytes()


def may_share(x: bytes, y: bytes, na: int, nb: int, percent: int) -> bool:
    """Can sets with these sketches reach the threshold?  A bit of one that the
    other lacks is a token that the other lacks."""
    import numpy as np
    x, y = np.frombuffer(x, dtype="uint8"), np.frombuffer(y, dtype="uint8")
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(t.reshape(-1, size), axis=0).view("uint64") for t in (x, y))
    most = min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))
    return (100 + percent) * most >= percent * (na + nb)


def kinds_of(parts: DataFrame, counters: int) -> "np.ndarray":  # noqa: F821
    """Frequency classes (half powers of two) from tasks' count tables, given in
    slices (slice, counts), added up slice by slice; the result's size is fixed."""
    import numpy as np

    def total(pdf):
        import numpy as np
        out = np.zeros(counters // SLICES, dtype="uint64")
        for x in pdf["counts"]:
            out += unpack(x)
        return np.minimum(out, (1 << 32) - 1)

    def add(pdf):
        import pandas as pd
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "counts": [pack(total(pdf))]})

    def classed(pdf):
        import numpy as np
        import pandas as pd
        kinds = np.minimum(np.log2(total(pdf) + 1.0) * 2, 63).astype("uint8")
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "counts": [pack(kinds)]})

    # tasks' tables are merged a few at a time before their last merge
    few = parts.groupBy("slice", "task").applyInPandas(add, "slice int, counts binary")
    rows = few.groupBy("slice").applyInPandas(classed, "slice int, counts binary").collect()   # SLICES rows
    out = np.zeros(counters, dtype="uint8")
    each = counters // SLICES
    for r in rows:
        out[r["slice"] * each:(r["slice"] + 1) * each] = unpack(r["counts"])
    return out


def table_rows(table, names, types, task: int, encode) -> pa.RecordBatch:
    """A task's count table as SLICES rows of columns (..., slice, task, counts)."""
    each = len(table) // SLICES
    cols = [pa.nulls(SLICES, t) for t in types]
    return pa.RecordBatch.from_arrays(
        cols + [pa.array(range(SLICES), pa.int32()), pa.array([task % 16] * SLICES, pa.int32()),
                pa.array([encode(table[i * each:(i + 1) * each]) for i in range(SLICES)], pa.binary())],
        names=[*names, "slice", "task", "counts"])


def sets_pass(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, n, node, slice, task, counts): a row per document, and each
    task's token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext
        table = np.zeros(COUNTERS, dtype="uint32")
        for b in slices(batches, "text"):
            every, ends = shingled(b.column(2), words)
            np.add.at(table, (every >> np.uint64(40)).astype("int64") % COUNTERS, 1)
            k = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(ends).astype("int64")),
                 pa.array([set_key(every[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:])], pa.int64()),
                 pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                names=["doc_id", "key", "n", "node", "slice", "task", "counts"])
        yield table_rows(table, ["doc_id", "key", "n", "node"], [pa.int64()] * 4, TaskContext.get().partitionId(), pack)

    return docs.select("doc_id", "key", "text").mapInArrow(
        run, "doc_id long, key long, n long, node long, slice int, task int, counts binary")


def prefix_pass(docs: DataFrame, words: int, percent: int, kinds) -> DataFrame:
    """(token, node, n, place): the prefix under order 0 of each class, once per
    task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        seen = set()
        for b in slices(batches, "text"):
            every, ends = shingled(b.column(0), words)
            n = np.diff(ends)
            n = n[n > 0]
            node = [set_key(every[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:]) if hi > lo]
            own = prefixes(every, ends, kinds.value, 0, percent)
            take = []
            for i, x in enumerate(node):
                if x not in seen:
                    take.append(i)
                    if len(seen) < 1_000_000:          # only saves repeats
                        seen.add(x)
            if take:
                k = [len(own[i]) for i in take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every[np.concatenate([own[i] for i in take])].view("int64")),
                     pa.array(np.repeat(np.array([node[i] for i in take], dtype="int64"), k)),
                     pa.array(np.repeat(n[take].astype("int32"), k)),
                     pa.array(np.concatenate([np.arange(x, dtype="int32") for x in k]))],
                    names=["token", "node", "n", "place"])

    return docs.select("text").mapInArrow(run, "token long, node long, n int, place int")


def marked(nodes: DataFrame, bits: int) -> bytes:
    """A bit table with a bit set for each node: at most ``MOST_BITS``."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext
        table = np.zeros(bits // 8, dtype="uint8")
        for b in batches:
            at = np.asarray(b.column(0)).view("uint64") % np.uint64(bits)
            np.bitwise_or.at(table, at >> np.uint64(3), (np.uint64(128) >> (at & np.uint64(7))).astype("uint8"))
        yield table_rows(table, [], [], TaskContext.get().partitionId(), lambda x: x.tobytes())

    def either(pdf):
        import numpy as np
        import pandas as pd
        out = np.bitwise_or.reduce([np.frombuffer(x, dtype="uint8") for x in pdf["counts"]])
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "counts": [out.tobytes()]})

    few = nodes.coalesce(16).mapInArrow(mark, "slice int, task int, counts binary")
    rows = few.groupBy("slice").applyInPandas(either, "slice int, counts binary").orderBy("slice").collect()
    return b"".join(bytes(r["counts"]) for r in rows)


def bits_for(values: DataFrame, each: int) -> int:
    bits, wanted = 1 << 20, min(MOST_BITS, each * values.count())
    while bits < wanted:
        bits *= 2
    return bits


def among(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose ``column`` is in ``values`` (one long column): a bit table
    drops most others where they are read, a join the rest."""
    bits = bits_for(values, 16)
    table = rows.sparkSession.sparkContext.broadcast(marked(values, bits))
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        flags = np.frombuffer(table.value, dtype="uint8")
        for b in batches:
            if len(flags):
                x = np.asarray(b.column(at)).view("uint64") % np.uint64(bits)
                yield b.filter(pa.array(flags[x >> np.uint64(3)] >> (7 - (x & np.uint64(7))) & 1 == 1))

    return rows.mapInArrow(run, rows.schema).join(values, column, "left_semi")


def wanted_sets(docs: DataFrame, words: int, percent: int, kinds, nodes: DataFrame, to: tuple) -> DataFrame:
    """(node, n, tokens, heads, sketch) of the given classes (node, key: a text's
    hash), by one more pass over the texts; ``heads`` are the prefixes under the
    further orders, one after the other, as 32-bit tokens.  A bit table of the
    keys (64 bits for each, up to a bound) tells which texts are cut into shingles
    at all.  The sets are moved once, to the table ``to`` bucketed by node,
    which is returned with what it had before."""
    bits = bits_for(nodes, 64)
    table = docs.sparkSession.sparkContext.broadcast(marked(nodes.select("key"), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        seen, flags = set(), np.frombuffer(table.value, dtype="uint8")
        for b in slices(batches, "text"):
            x = np.asarray(b.column(0)).view("uint64") % np.uint64(bits)
            at, take = np.flatnonzero(flags[x >> np.uint64(3)] >> (7 - (x & np.uint64(7))) & 1), []
            for i, key in zip(at.tolist(), b.column(0).take(pa.array(at)).to_pylist()):
                if key not in seen:
                    take.append(i)
                    if len(seen) < 1_000_000:
                        seen.add(key)
            if not take:
                continue
            every, ends = shingled(b.column(1).take(pa.array(take)), words)
            full = np.flatnonzero(np.diff(ends))
            heads = [prefixes(every, ends, kinds.value, k, percent) for k in range(1, ORDERS)]
            sets = [every[ends[i]:ends[i + 1]] for i in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([s.tobytes() for s in sets], pa.binary()),
                 pa.array([every[np.concatenate(h)].astype("uint32").tobytes() for h in zip(*heads)], pa.binary()),
                 pa.array([sketch(s) for s in sets], pa.binary())], names=["node", "n", "tokens", "heads", "sketch"])

    rows = docs.select("key", "text").mapInArrow(run, "node long, n int, tokens binary, heads binary, sketch binary")
    # copies of a set from several tasks meet by node: one stays
    found = rows.repartition("node").join(nodes.select("node").hint("shuffle_merge"), "node", "left_semi")
    return bucketed(found.dropDuplicates(["node"]), to, "node")


def with_sets_of(pairs: DataFrame, sets: DataFrame | None, rows: DataFrame, docs: DataFrame, words: int, percent: int,
                 kinds, to: tuple) -> DataFrame:
    """``sets`` with those of all classes in the pairs."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    if sets is not None:
        nodes = nodes.join(sets.select("node"), "node", "left_anti")
    nodes = written(rows.where("n > 0").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")),
                    "ngram-nodes")
    if sets is not None and not nodes.limit(1).count():
        return sets
    return wanted_sets(docs, words, percent, kinds, nodes, to)


def beside(rows: DataFrame, end: str, sets: DataFrame, *columns) -> DataFrame:
    """``rows`` with columns of the sets of one end: the sets stay in their
    buckets, the rows are moved to them."""
    return rows.join(sets.select(F.col("node").alias(end), *columns), end)


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after new links (a, b): only the components they
    connect are walked, each pair of them once."""
    of = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    between = links.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select(
        F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    merged = components(between).select(F.col("node").alias("component"), F.col("component").alias("root"))
    return comp.join(merged, "component", "left").select("node", F.coalesce("root", "component").alias("component"))


def meeting(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that meet under every further order, place filter
    included, and whose sketches allow it.  Only prefixes and sketches are moved."""
    of = lambda c: [F.col(x).alias(f"{x}_{c}") for x in ("n", "heads", "sketch")]
    both = beside(beside(pairs, "a", sets, *of("a")), "b", sets, *of("b")).select(
        "a", "b", "n_a", "n_b", "heads_a", "heads_b", "sketch_a", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        for b in batches:
            keep = []
            for na, nb, ha, hb, sa, sb in zip(*[b.column(i).to_pylist() for i in range(2, 8)]):
                x = np.frombuffer(ha, dtype="uint32").reshape(ORDERS - 1, -1)
                y = np.frombuffer(hb, dtype="uint32").reshape(ORDERS - 1, -1)
                keep.append(may_share(sa, sb, na, nb, percent)
                            and all(may_meet(p, q, na, nb, percent) for p, q in zip(x, y)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def may_meet(p, q, na: int, nb: int, percent: int) -> bool:
    """Do two prefixes, each in order, first meet early enough?  (Tokens cut
    to 32 bits may meet without being equal: the filter only lets more pass.)"""
    import numpy as np
    _, i, j = np.intersect1d(p, q, return_indices=True)
    if not len(i):
        return False
    most = np.minimum(na - i, nb - j).max()
    return bool((100 + percent) * most >= percent * (na + nb))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold.  The pairs of one ``a``
    are dealt into groups of about FOLLOWERS, each with a copy of its set."""
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).alias("groups"))
    dealt = pairs.join(size, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("groups"))).drop("groups")
    dealt = written(dealt, "ngram-dealt")
    follow = beside(dealt, "b", sets, "tokens").select("a", "salt", F.lit(1).alias("role"), "b", "tokens")
    lead = beside(dealt.select("a", "salt").distinct(), "a", sets, "tokens").select(
        "a", "salt", F.lit(0).alias("role"), F.lit(None).cast("long").alias("b"), "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        head, a = None, None
        for b in batches:
            found = []
            for r in range(b.num_rows):
                s = np.frombuffer(b.column(4)[r].as_buffer(), dtype="uint64")
                if b.column(2)[r].as_py() == 0:
                    head, a = s.copy(), b.column(0)[r].as_py()
                    continue
                both = len(np.intersect1d(head, s, assume_unique=True))
                if 100 * both >= percent * (len(head) + len(s) - both):
                    found.append((a, b.column(3)[r].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()),
                                              pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    both = follow.unionByName(lead).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return both.mapInArrow(run, "a long, b long")


def join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id per row: documents with
    ``100 * |A & B| >= percent * |A | B|`` are linked."""
    spark = docs.sparkSession
    own = texts(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    first = written(sets_pass(own, words), "ngram-sets")
    rows = first.where("slice IS NULL").select("doc_id", "key", "n", "node")
    kinds = spark.sparkContext.broadcast(kinds_of(first.where("slice IS NOT NULL").select(
        "slice", "task", "counts"), COUNTERS))
    postings = written(prefix_pass(own, words, percent, kinds), "ngram-postings")
    # a block of two rows is judged by the place filter at once (copies of one
    # class from several tasks count as rows here and go right after)
    shared = (postings.groupBy("token").agg(
        F.count("*").alias("k"), F.min(F.col("n") - F.col("place")).alias("rest"), F.sum("n").alias("both"))
        .where("k > 1").where((F.col("k") > 2) | (F.col("rest") * (100 + percent) >= F.col("both") * percent))
        .select("token"))
    shared = written(shared, "ngram-shared")
    blocks = written(among(postings, "token", shared).dropDuplicates(["token", "node"]), "ngram-blocks")
    comp = written(blocks.select("node", F.col("node").alias("component")).distinct(), "ngram-components")
    sets, to = None, new_table(spark, "ngram-wanted")
    for star in range(STAR_ROUNDS + 1):
        # blocks that still hold several components (in the first round every class is one)
        at = with_earlier(blocks.join(comp, "node")) if star else blocks.withColumn("component", F.col("node"))
        still = (at.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                         F.count("*").alias("size")).where("low <> high").select("token", "size"))
        at = written(at.join(still, "token"), "ngram-open")
        blocks = at.select("token", "node", "n", "place")      # a closed block stays closed
        open_nodes = at.select("node").distinct().count()
        if not open_nodes:
            break
        # after a star, close - unless that means pairs out of proportion
        closing = star > 0
        pairs = written(closing_pairs(at, percent) if closing else star_pairs(at, percent), "ngram-pairs")
        if closing and star < STAR_ROUNDS and linked and pairs.count() > MOST_PAIRS * open_nodes:
            closing, pairs = False, written(star_pairs(at, percent), "ngram-pairs")
        sets = with_sets_of(pairs, sets, rows, own, words, percent, kinds, to)
        met = written(meeting(pairs, sets, percent), "ngram-met")
        new = written(verified(met, sets, percent), "ngram-links")
        linked = new.count()
        if linked:
            comp = written(joined(comp, new), "ngram-components")
        if closing:
            break
    kinds.destroy()
    # the smallest doc_id of a class, then of its component
    named = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("smallest"))
    named = named.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = named.select("node", "component").join(smallest, "component").select("node", "component_id")
    named = named.withColumnRenamed("node", "key")
    # copies of one set are a hot key of this join: AQE splits them
    return (rows.drop("key").join(named, (rows.node == named.key) & (rows.n > 0), "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def similar(na: str, i: str, nb: str, j: str, percent: int):
    """Sets that first meet at places i and j may reach the threshold."""
    most = F.least(F.col(na) - F.col(i), F.col(nb) - F.col(j))
    return most * (100 + percent) >= (F.col(na) + F.col(nb)) * percent


def star_pairs(at: DataFrame, percent: int) -> DataFrame:
    """One pair per class: with the leader of most of its blocks, if that is of
    another component.  A block is led by its most central class; who misses
    its leader here is left to the closing round."""
    weight = F.round(F.log2("size") * 1000).cast("long")
    central = at.groupBy("node").agg(F.sum(weight).alias("central"))
    lead = at.join(central, "node").groupBy("token").agg(
        F.max(F.struct("central", "node", "component", "n", "place")).alias("lead"))
    met = at.join(lead, "token").select("node", "n", "place", "component", *[
        F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("node", "component", "n", "place")])
    met = met.where((F.col("component") != F.col("lead_component")) & similar("n", "place", "lead_n", "lead_place", percent))
    met = met.groupBy("node", "lead_node").agg(F.count("*").alias("k"))
    best = met.groupBy("node").agg(F.max(F.struct("k", "lead_node")).alias("best"))
    return best.select(F.col("best.lead_node").alias("a"), F.col("node").alias("b"))


def with_earlier(at: DataFrame) -> DataFrame:
    """Each row with the EARLIER tokens before it in its class's prefix that
    are blocks too (NULL: there is none)."""
    by_place = Window.partitionBy("node").orderBy("place")
    return at.select("*", *[F.lag("token", i).over(by_place).alias(f"earlier{i}") for i in range(1, EARLIER + 1)])


def closing_pairs(at: DataFrame, percent: int) -> DataFrame:
    return meetings(at, percent).distinct()


def meetings(at: DataFrame, percent: int) -> DataFrame:
    """All pairs of one block and different components that pass the place
    filter, unless they share one of their last tokens before it: then they met
    in an earlier block already, where the filter is wider.  A block of many
    rows is dealt into salted parts: each row of one side to one part, of the
    other side to all."""
    past = [f"earlier{i}" for i in range(1, EARLIER + 1)]
    parts = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "place", "component", *past)]
    a = at.select("token", F.pmod(F.xxhash64("node"), parts).cast("int").alias("salt"), *side("a"))
    b = at.select("token", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), *side("b"))
    on = ((a.token == b.token) & (a.salt == b.salt) & (F.col("component_a") < F.col("component_b"))
          & similar("n_a", "place_a", "n_b", "place_b", percent))
    for p, q in product(past, past):
        on &= F.coalesce(F.col(f"{p}_a") != F.col(f"{q}_b"), F.lit(True))
    return a.join(b, on).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
