"""Language-model scoring with a weighted backoff automaton.

Training counts cover every whole training text.  The unigram model is the
smoothed one of the contract, ``(c + 0.1) / (N + 0.1 (V + 1))``, which leaves
mass for unknown words.  Above it stand all n-grams seen at least ``min_count``
times (by default once: nothing is pruned; ``arc_share`` can ask for a share of
the training tokens as well), with absolute discounting: an n-gram arc has
probability ``(c - d) / C(history) + weight(history) * p(word | shorter)``,
where ``weight`` is the mass left over, so every state is a distribution.

States are the root and all histories with arcs; each has arcs for its
continuations and one failure arc, with the weight above, to its longest proper
suffix.  A text is scored by one walk from left to right that carries the state.

The model grows with the corpus, so no process holds it.  Documents are cut
into blocks of about ``BLOCK`` bytes.  First the words: a block names its own to
the buckets that own them (by a hash), with its training counts; owners add up,
number the words, the most frequent first, and answer.  Then, in the same way,
n-grams of the higher orders, as lists of word numbers, owned by a hash of the
history: each list is answered with the counts of its n-grams and histories, in
the order they were named.  From these a block lays out the part of the
automaton that its texts touch and walks them.  Lists travel sorted, as byte
planes under zstd; blocks stay where they were written (a table bucketed by
block) and only the answers are moved to them.

A history that holds a bucket's share of the corpus is dealt out by its
continuations instead; its totals are put together from all owners.  At most
``2 / word_share`` and ``2 / held_share`` of them exist (one word, longer), which
bounds what is sent to every task.  The shares and the bucket's size decide only
where a number is looked up, never what it is.

64-bit hashes of words and, at an owner, of n-grams are taken as identity.

Edge cases: NULL text is empty: one token, the end.  Rows with NULL doc_id are
scored and never learnt from.  Repeated doc_ids are scored row by row.
Without any training row (also: empty table) N and V are 0 and the unigram
probability of any token is 1.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, new_table, pack, slices, unpack, written

END = b" "                   # cannot be a word: the end of every document
ADD = 0.1
DISCOUNT = 0.5
BLOCK = 4 << 20              # bytes of text in a block (a longer text is a block of its own)
BUCKET = 1 << 20             # n-grams of one order that a bucket owns, about
PIECE = 512                  # tokens of a piece; the pieces of a block are walked side by side


def words_of(text: str) -> list[bytes]:
    """Words of the text with A-Z lower-cased (bytes.split separates at
    exactly \x20 and \x09-\x0D).  With ``Numbers`` the plain form, against
    which tests hold the tokens of blocks."""
    return text.encode("utf-8").lower().split()


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def keys_of(self):
        return keys_of(self, len(self))


def keys_of(words, count: int):
    """64-bit keys of words."""
    import numpy as np
    from xxhash import xxh3_64_intdigest
    return np.fromiter(map(xxh3_64_intdigest, words), dtype="uint64", count=count)


def cut(texts: pa.Array):
    """The words of all texts one after another, as ``words_of`` finds them, and
    how many each text has."""
    import numpy as np
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    parts = split.flatten()
    real = np.asarray(pc.binary_length(parts)) > 0            # leading and trailing blanks leave empty parts
    ends = np.cumsum(np.asarray(pc.list_value_length(split)), dtype="int64")
    before = np.concatenate([[0], np.cumsum(real)])
    return parts.filter(pa.array(real)), np.diff(before[ends], prepend=0)


def tokens_of(words: pa.Array, size):
    """Keys of the different tokens and, by their places among them, the tokens
    of all texts, with an end before and after each.  Only the different words
    become Python values."""
    import numpy as np
    found = words.dictionary_encode()
    different = found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    stop = np.cumsum(size + 2)
    inner = np.ones(int(stop[-1]), dtype=bool)
    inner[stop - 1] = inner[stop - size - 2] = False
    ids = np.zeros(len(inner), dtype="int32")
    ids[inner] = np.asarray(found.indices) + 1
    return keys_of([END, *different], len(different) + 1), ids


def longer(a, b):
    """Keys of n-grams from the keys of their prefixes and last words."""
    import numpy as np
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def in_order(key):
    """The keys sorted, and where each stood, equal ones in their order: a
    plain sort of numbers that carry the places in their low bits."""
    import numpy as np
    key = key.view("uint64")
    bits = np.uint64(max(1, len(key).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    fits = not len(key) or int(key.max()) >> int(64 - bits) == 0
    found = key << bits if fits else key & ~low
    found |= np.arange(len(key), dtype="uint64")
    found.sort()
    turn = (found & low).view("int64")
    if fits:
        found >>= bits
        return found, turn
    found = key[turn]
    if (found[1:] < found[:-1]).any():                        # keys that differ in the low bits only
        turn = np.argsort(key, kind="stable")
        found = key[turn]
    return found, turn


def grouped(key):
    """The different keys, ascending, the first place of each, and which of
    them stands at every place."""
    import numpy as np
    found, turn = in_order(key)
    new = np.ones(len(found), dtype=bool)
    new[1:] = found[1:] != found[:-1]
    of = np.empty(len(found), dtype="int32")
    of[turn] = np.cumsum(new, dtype="int32") - np.int32(1)
    return found[new], turn[new], of


def used(ids, size: int):
    """Which of the numbers below ``size`` occur, and each one's place among them."""
    import numpy as np
    seen = np.zeros(size, dtype=bool)
    seen[ids] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype="int32") - np.int32(1))[ids]


def among(key, few):
    """Which keys are in the sorted few: most are ruled out by 16 of their bits."""
    import numpy as np
    some, found = np.zeros(1 << 16, dtype=bool), np.zeros(len(key), dtype=bool)
    some[few & np.uint64(0xFFFF)] = True
    maybe = np.flatnonzero(some[key & np.uint64(0xFFFF)])
    if len(maybe):
        found[maybe] = few[np.minimum(np.searchsorted(few, key[maybe]), len(few) - 1)] == key[maybe]
    return found


def buckets_of(key, buckets: int):
    import numpy as np
    return (longer(key, np.uint64(0x5BD1)) % np.uint64(buckets)).astype("uint16" if buckets <= 1 << 16 else "int64")


def history_key(words: list):
    """Keys of histories from the numbers of their words."""
    key = words[0].astype("uint64")
    for w in words[1:]:
        key = longer(key, w.astype("uint64"))
    return key


def blocks_of(own: DataFrame) -> DataFrame:
    """(block, doc_id, held_out, train, size, words, ids): blocks of documents;
    ``words`` are keys, the most frequent first, and ``ids`` places among them,
    one end before each document and one after it (``size`` counts the latter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext
        held, size, made = [], 0, 0

        def block():
            docs = pa.Table.from_batches([h[0] for h in held])
            key, ids = tokens_of(pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            order = np.argsort(-np.bincount(ids, minlength=len(key)), kind="stable")
            rank = np.empty(len(order), dtype="int64")
            rank[order] = np.arange(len(order))
            one = lambda x, t: pa.array([x.to_pylist()], pa.list_(t))
            return pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() << 32 | made], pa.int64()),
                 one(docs.column("doc_id"), pa.int64()), one(docs.column("held_out"), pa.bool_()),
                 one(docs.column("train"), pa.bool_()), one(docs.column("size"), pa.int64()),
                 pa.array([key[order].tobytes()], pa.binary()), pa.array([pack(rank[ids])], pa.binary())],
                names=["block", "doc_id", "held_out", "train", "size", "words", "ids"])

        for b in slices(batches, "text", BLOCK):
            for lo in range(0, b.num_rows, 256):
                few = b.slice(lo, 256)
                found, many = cut(few.column(few.schema.get_field_index("text")))
                more = len(found) + 2 * len(many)
                if held and size + more > BLOCK // 6:
                    yield block()
                    held, size, made = [], 0, made + 1
                info = few.drop_columns(["text"]).append_column("size", pa.array(many + 1, pa.int64()))
                held.append((info, found, many))
                size += more
        if held:
            yield block()

    return own.select("doc_id", "held_out", "train", "text").mapInArrow(
        run, "block long, doc_id array<long>, held_out array<boolean>, train array<boolean>, size array<long>, "
             "words binary, ids binary")


def lists(key, buckets: int):
    """The bucket of each key, the order by bucket and key, and where each
    bucket's keys begin and end in it."""
    import numpy as np
    bucket, turn = buckets_of(key, buckets), in_order(key)[1]
    turn = turn[np.argsort(bucket[turn], kind="stable")]
    return bucket, turn, runs_of(bucket[turn])


def runs_of(values) -> list:
    """Where runs of equal values begin and end."""
    import numpy as np
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *cuts], [*cuts, len(values)])) if len(values) else []


class Block:
    """The tokens of a block; ``words`` are keys.  ``first`` marks the ends
    that open documents, ``closing`` those that close them, ``place`` counts
    tokens from the former."""

    def __init__(self, row: dict):
        import numpy as np
        self.words, self.ids = np.frombuffer(row["words"], dtype="uint64"), unpack(row["ids"]).astype("int32")
        self.size = np.asarray(row["size"], dtype="int64")
        self.starts = np.cumsum(self.size + 1) - self.size - 1
        self.first = np.zeros(len(self.ids), dtype=bool)
        self.first[self.starts] = True
        self.closing = np.zeros(len(self.ids), dtype=bool)
        self.closing[self.starts + self.size] = True
        self.train = np.repeat(np.asarray(row["train"], dtype=bool), self.size + 1)
        self.place = (np.arange(len(self.ids)) - np.repeat(self.starts, self.size + 1)).astype("int32")

    def numbered(self, answered: list[dict], buckets: int) -> "Block":
        """With the numbers and training counts of its words; words stand in
        the order of their numbers from here."""
        import numpy as np
        _, turn, runs = lists(self.words, buckets)
        number, n = np.zeros(len(turn), dtype="int64"), np.zeros(len(turn), dtype="int64")
        for (lo, hi), r in zip(runs, sorted(answered, key=lambda r: r["bucket"]), strict=True):
            number[turn[lo:hi]], n[turn[lo:hi]] = unpack(r["total"]), unpack(r["n"])
        order = in_order(number)[1]
        rank = np.empty(len(order), dtype="int32")
        rank[order] = np.arange(len(order), dtype="int32")
        self.words, self.number, self.n, self.ids = self.words[order], number[order], n[order], rank[self.ids]
        return self

    def histories(self, k: int, common):
        """Keys of the histories of order k, all of whose words are common,
        before every n-gram that has one."""
        import numpy as np
        usual = common[self.ids]
        at = np.flatnonzero(usual & (self.place >= k - 2))     # where the history ends: not at a closing end
        at = at[(self.place[at] == 0) | (at + 1 < len(self.ids)) & (self.place[np.minimum(at + 1, len(self.ids) - 1)] > 0)]
        for back in range(1, k - 1):
            at = at[usual[at - back]]
        key = self.words[self.ids[at - (k - 2)]]
        for back in range(k - 3, -1, -1):
            key = longer(key, self.words[self.ids[at - back]])
        return key

    def grams(self, order: int, hot: list, buckets: int) -> Iterator["Grams"]:
        """Of each order from 2."""
        below = None
        for k in range(2, order + 1):
            below = Grams(self, k, below, hot[k - 2], buckets)
            yield below


class Grams:
    """The different n-grams of one order in a block, in the order in which
    they are named: by bucket, history and word.  ``ends`` are the positions
    where one ends, ``gram`` and ``place`` which one and after which history;
    ``of[t]`` is the n-gram that ends at position t, ``at`` one position of each."""

    def __init__(self, block: Block, k: int, below: "Grams | None", hot, buckets: int):
        import numpy as np
        self.block, self.ends = block, np.flatnonzero(block.place >= k - 1).astype("int32")
        if below is None:                             # a history of one word, which may be the opening end
            seen, self.place = used(block.ids[self.ends - 1], len(block.words))
            self.past, self.key = [seen], block.words[seen]
        else:
            seen, self.place = used(below.gram[~block.closing[below.ends]], len(below.turn))
            own, word = below.own[seen], below.last[seen]
            self.past, self.key = [*(c[own] for c in below.past), word], longer(below.key[own], block.words[word])
        self.hot, self.size = among(self.key, hot), len(seen)
        bits = len(block.words).bit_length()
        one, first, self.gram = grouped(self.place.astype("int64") << bits | block.ids[self.ends])
        one = one.view("int64")
        self.own, self.last, self.first = (x.astype("int32") for x in (one >> bits, one & (1 << bits) - 1, first))
        del one, first
        bucket, dealt = buckets_of(self.key, buckets)[self.own], np.flatnonzero(self.hot[self.own])
        bucket[dealt] = buckets_of(longer(self.key[self.own[dealt]], block.words[self.last[dealt]]), buckets)
        self.turn = np.argsort(bucket, kind="stable").astype("int32")     # histories and words stay in order inside
        self.bucket, self.history, self.word = bucket[self.turn], self.own[self.turn], self.last[self.turn]
        self.runs = runs_of(self.bucket)

    @property
    def n(self):
        """How often each stands in training texts."""
        import numpy as np
        return np.bincount(self.gram[self.block.train[self.ends]], minlength=len(self.turn))[self.turn]

    @property
    def at(self):
        return self.ends[self.first[self.turn]]

    @property
    def of(self):
        import numpy as np
        back, of = np.empty(len(self.turn), dtype="int32"), np.full(len(self.block.ids), -1, dtype="int32")
        back[self.turn] = np.arange(len(back), dtype="int32")
        of[self.ends] = back[self.gram]
        return of

    def named(self, lo: int, hi: int):
        """Histories of one bucket, and how many n-grams each has there."""
        import numpy as np
        own = self.history[lo:hi]
        new = np.flatnonzero(np.diff(own, prepend=-1))
        return own[new], np.diff(np.append(new, len(own)))

    def packed(self, block: Block, n, lo: int, hi: int) -> tuple:
        """What is sent to one bucket: the words of histories, how many
        n-grams each has, their last words, counts, and which are dealt out."""
        import numpy as np
        own, many = self.named(lo, hi)
        past = [block.number[c[own]] for c in self.past]
        return ([pack(np.diff(c, prepend=0) if not i else c) for i, c in enumerate(past)], pack(many),
                pack(block.number[self.word[lo:hi]]), pack(n[lo:hi]), pack(self.hot[own]))


def named_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, words, n, every): the words of every block."""

    def run(batches):
        import numpy as np
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                bucket, turn, runs = lists(block.words, buckets)
                every = np.bincount(block.ids[~block.first], minlength=len(turn))
                n = np.bincount(block.ids, weights=block.train & ~block.first, minlength=len(turn)).astype("int64")
                for i in range(0, len(runs), 64):
                    rows = [(int(bucket[turn[lo]]), row["block"], pack(np.diff(block.words[turn[lo:hi]], prepend=np.uint64(0))),
                             pack(n[turn[lo:hi]]), pack(every[turn[lo:hi]])) for lo, hi in runs[i:i + 64]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), *[pa.binary()] * 3])],
                        names=["bucket", "block", "words", "n", "every"])

    return blocks.mapInArrow(run, "bucket long, block long, words binary, n binary, every binary")


def numbered_words(named: DataFrame, buckets: int) -> DataFrame:
    """For each list of words: their training counts and numbers; one row
    (block -1) with how many of the bucket's words training has."""

    def own(t: pa.Table) -> pa.Table:
        import numpy as np
        rows = t.to_pylist()
        words = [np.cumsum(unpack(r["words"]), dtype="uint64") for r in rows]
        one, _, at = grouped(np.concatenate(words))
        n, every = (np.bincount(at, weights=np.concatenate([unpack(r[c]) for r in rows]), minlength=len(one)).astype("int64")
                    for c in ("n", "every"))
        number = np.empty(len(one), dtype="int64")
        number[np.argsort(-every, kind="stable")] = np.arange(len(one))
        number, bucket = number * buckets + rows[0]["bucket"], rows[0]["bucket"]
        ends = np.cumsum([len(w) for w in words])
        out = [(r["block"], 1, bucket, pack(n[at[hi - len(w):hi]]), pack(number[at[hi - len(w):hi]]), None, None, None, None, None, None)
               for r, w, hi in zip(rows, words, ends)]
        return answer_rows([*out, (-1, 1, bucket, None, None, None, None, 0, 0, 0, int((n > 0).sum()))])

    return named.groupBy("bucket").applyInArrow(own, ANSWER)


def hot_histories(blocks: DataFrame, order: int, n: int, least: list[float]) -> list:
    """For each order from 2, sorted keys of the histories that stand before at
    least ``least`` of the n tokens (at most 2 n / least)."""
    import numpy as np

    def run(batches):
        import numpy as np
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                total = len(block.ids) - len(block.size)
                times = np.bincount(block.ids, minlength=len(block.words))
                for k in range(2, order + 1):
                    # a history is at most as frequent as its words
                    bar = least[k - 2] / 2 / n * total
                    key, c = np.unique(block.histories(k, times >= bar), return_counts=True)
                    key, c = key[c >= bar], c[c >= bar]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), k, "int32")), pa.array(key.view("int64")), pa.array(c.astype("int64"))],
                        names=["level", "key", "c"])

    # what blocks leave out of a history's count is below half of ``least``
    bar = F.element_at(F.array(F.lit(0.0), *[F.lit(float(x) / 2) for x in least]), F.col("level"))
    rows = blocks.mapInArrow(run, "level int, key long, c long").groupBy("level", "key").agg(
        F.sum("c").alias("c")).where(F.col("c") >= bar).toArrow()
    level, key = np.asarray(rows.column("level")), np.asarray(rows.column("key")).view("uint64")
    return [np.sort(key[level == k]) for k in range(2, order + 1)]


ANSWER = ("block long, level int, bucket long, n binary, total binary, kept binary, types binary, "
          "key long, sum_total long, sum_kept long, sum_types long")


def answer_rows(rows: list[tuple]) -> pa.Table:
    types = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4, *[pa.int64()] * 4]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in ANSWER.split(", ")])


def named_grams(blocks: DataFrame, words: DataFrame, order: int, hot, buckets: int) -> DataFrame:
    """(bucket, level, block, ...): the n-grams of every block."""
    names = ["bucket", "level", "block", "past", "many", "word", "n", "hot"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary()), *[pa.binary()] * 4]

    def run(mine: pa.Table, given: pa.Table) -> pa.Table:
        block, rows = Block(info := mine.to_pylist()[0]).numbered(given.to_pylist(), buckets), []
        for k, grams in enumerate(block.grams(order, hot.value, buckets), 2):
            n = grams.n
            rows += [(int(grams.bucket[lo]), k, info["block"], *grams.packed(block, n, lo, hi)) for lo, hi in grams.runs]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], names=names)

    return blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(
        run, "bucket long, level int, block long, past array<binary>, many binary, word binary, n binary, hot binary")


def answers(named: DataFrame, least: float) -> DataFrame:
    """For each list that a block named: the training counts of its n-grams
    and, of its histories, the counts, what of them is not kept, and the number
    of different kept continuations.  For a history dealt out to many buckets,
    one row (block -1) with this bucket's part of its sums."""

    def own(t: pa.Table) -> pa.Table:
        import numpy as np
        rows, key = t.to_pylist(), []
        many = [unpack(r["many"]).astype("int64") for r in rows]
        hot = [unpack(r["hot"]) > 0 for r in rows]
        for r in rows:
            past = [unpack(c) for c in r["past"]]
            key.append(history_key([np.cumsum(past[0], dtype="uint64"), *past[1:]]))
        states, _, own = grouped(np.concatenate(key))
        of, word = np.repeat(own, np.concatenate(many)), np.concatenate([unpack(r["word"]) for r in rows])
        one, first, gram = grouped(longer(states[of], word))
        times = np.concatenate([unpack(r["n"]) for r in rows])
        n = np.bincount(gram, weights=times, minlength=len(one)).astype("int64")
        keep = n >= least
        state = of[first[keep]]
        total, kept, types = (np.bincount(at, weights=w, minlength=len(states)).astype("int64")
                              for at, w in ((of, times), (state, n[keep]), (state, None)))
        mine, out, lo, here = n[gram], [], 0, 0
        for r, k, m in zip(rows, key, many):
            at, size = own[here:here + len(k)], int(m.sum())
            out.append((r["block"], r["level"], r["bucket"], pack(mine[lo:lo + size]), pack(total[at]),
                        pack(total[at] - kept[at]), pack(types[at]), None, None, None, None))
            lo, here = lo + size, here + len(k)
        split = np.unique(np.concatenate([k[h] for k, h in zip(key, hot)]))
        at = np.searchsorted(states, split)
        level, bucket = rows[0]["level"], rows[0]["bucket"]
        out += [(-1, level, bucket, None, None, None, None, *x) for x in zip(
            split.view("int64").tolist(), total[at].tolist(), kept[at].tolist(), types[at].tolist())]
        return answer_rows(out)

    return named.groupBy("bucket", "level").applyInArrow(own, ANSWER)


class Automaton:
    """States with arcs (state, word) -> (log10 p, next state), one failure arc
    and its log10 weight each; state 0 is the root, which has an arc for every
    word.  Arcs stand in one sorted array under ``state * words + word``."""

    def __init__(self, words: int, key, log, after, fail, weight):
        self.words, self.fail, self.weight = words, fail, weight
        key, turn = in_order(key)
        self.key, self.log, self.after = key.view("int64"), log[turn], after[turn]

    def arc(self, state, word):
        """Which arc leaves each state under its word, -1 without one."""
        import numpy as np
        key = state.astype("int64") * self.words + word
        at = np.searchsorted(self.key, key)
        return np.where(self.key[np.minimum(at, len(self.key) - 1)] == key, at, -1)

    def step(self, state, word):
        """log10 p of each word in its state, and the states after them."""
        import numpy as np
        state, total, at = state.copy(), np.zeros(len(state)), self.arc(state, word)
        open_ = np.flatnonzero(at < 0)
        while len(open_):
            total[open_] += self.weight[state[open_]]
            state[open_] = self.fail[state[open_]]
            at[open_] = found = self.arc(state[open_], word[open_])
            open_ = open_[found < 0]
        return total + self.log[at], self.after[at]

    def traverse(self, ids, start, size, state):
        """log10 of the probability of each piece ``ids[start:start + size]``,
        read from left to right from its state.  Pieces are walked side by side."""
        import numpy as np
        turn = np.argsort(-size, kind="stable")
        start, size, state, total = start[turn], size[turn], state[turn], np.zeros(len(turn))
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))
            log, state[:live] = self.step(state[:live], ids[start[:live] + t])
            total[:live] += log
        out = np.empty(len(turn))
        out[turn] = total
        return out


def laid_out(block: Block, levels: list[Grams], counts: list[dict], scale: float, least: float):
    """The part of the automaton that the block's texts touch, the state of
    every position (before its word), and log10 p of its words in the root."""
    import numpy as np
    size = len(block.words)
    p = (block.n + ADD) / scale if scale else np.ones(size)
    root = np.log10(p)
    here = np.zeros(len(block.ids), dtype="int32")           # the state before a position's word
    made, shorter = 1, block.ids
    one = np.zeros(size, dtype="int32")
    one[block.ids] = np.arange(len(block.ids), dtype="int32")
    key, log, after, at = [np.arange(size)], [root], [], one  # arcs, and a position where each ends
    fail, weight = [np.zeros(1, dtype="int64")], [np.zeros(1)]

    def behind(at):
        """The states after arcs; after an end the walk stops."""
        nxt = np.minimum(at + 1, len(block.ids) - 1)
        return np.where(block.place[nxt] > 0, here[nxt], 0)

    for g, c in zip(levels, counts):
        alive = c["types"] > 0                               # histories with arcs are states
        number = np.where(alive, made + np.cumsum(alive) - 1, -1)
        left = np.where(alive, 1 - (c["kept"] - DISCOUNT * c["types"]) / np.maximum(c["total"], 1), 1.0)
        ends = g.at
        one = np.full(g.size, -1, dtype="int32")              # a position before which the history stands
        one[g.history] = ends
        fail.append(here[one[alive]])
        weight.append(np.log10(left[alive]))
        made += int(alive.sum())
        keep = c["n"] >= least
        p = np.where(keep, (c["n"] - DISCOUNT) / np.maximum(c["total"][g.history], 1), 0.0) + left[g.history] * p[shorter[ends]]
        own = number[g.place]
        here, shorter = here.copy(), g.of if g is not levels[-1] else None
        here[g.ends[own >= 0]] = own[own >= 0]
        after.append(behind(at))
        key.append(number[g.history[keep]] * size + g.word[keep])
        log.append(np.log10(p[keep]))
        at = ends[keep]
    after.append(behind(at))
    return (Automaton(size, *map(np.concatenate, (key, log, after, fail, weight))), here, root)


def walked(block: Block, levels: list[Grams], counts: list[dict], scale: float, least: float):
    """(n_known, base, score) of each document of the block."""
    import numpy as np
    automaton, state, root = laid_out(block, levels, counts, scale, least)
    # a state is known from the words before it: long texts are walked in pieces
    pieces = -(-block.size // PIECE)
    doc = np.repeat(np.arange(len(pieces)), pieces)
    place = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
    start = block.starts[doc] + 1 + place
    size = np.minimum(PIECE, block.size[doc] - place)
    score = np.bincount(doc, weights=automaton.traverse(block.ids, start, size, state[start]), minlength=len(pieces))
    owner = np.repeat(np.arange(len(pieces)), block.size + 1)[~block.first]
    word = block.ids[~block.first]
    add = lambda w: np.bincount(owner, weights=w, minlength=len(pieces))
    return add(block.n[word] > 0), add(root[word]), score


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3,
          word_share: float = 4e-6, arc_share: float = 0.0, folds: int = 10, held_out_fold: int = 0,
          min_count: int = 1, held_share: float = 5e-6, bucket: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    for every row."""
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
    held_out = F.coalesce(fold == held_out_fold, F.lit(False))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"),
                      (F.col(id_col).isNotNull() & ~held_out).alias("train"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = bucketed(blocks_of(own), new_table(spark, "lm-blocks"), "block")
    sums = blocks.select(F.explode(F.arrays_zip("train", "size")).alias("d")).agg(
        F.sum("d.size").alias("every"), F.sum(F.when(F.col("d.train"), F.col("d.size"))).alias("n")).first()
    every, n = sums.every or 0, sums.n or 0
    buckets = max(1, -(-every // bucket))
    least = max(min_count, arc_share * n, 1)
    # fewer than a quarter of a bucket's n-grams are no load
    bars = [max((word_share if k == 2 else held_share) * every, bucket / 4, 1) for k in range(2, order + 1)]
    words = written(numbered_words(named_words(blocks, buckets), buckets), "lm-words")
    v = words.where("block = -1").agg(F.sum("sum_types")).first()[0] or 0
    scale = n + ADD * (v + 1)
    mine = words.where("block <> -1").select("block", "level", "bucket", "n", "total", "kept", "types")
    rows, answered = [], mine
    hot = spark.sparkContext.broadcast(hot_histories(blocks, order, max(1, every), bars) if order > 1 else [])
    if order > 1:
        found = written(answers(named_grams(blocks, mine.select("block", "bucket", "n", "total"), order, hot, buckets), least),
                        "lm-answers")
        rows = found.where("block = -1").groupBy("level", "key").agg(
            F.sum("sum_total").alias("total"), F.sum("sum_kept").alias("kept"), F.sum("sum_types").alias("types")).collect()
        answered = mine.unionByName(found.where("block <> -1").select(mine.columns))
    dealt = spark.sparkContext.broadcast({(r.level, r.key % (1 << 64)): r for r in rows})      # one row of each hot history

    def walk(mine: pa.Table, given: pa.Table) -> pa.Table:
        import numpy as np
        info, levels, counts = mine.to_pylist()[0], [], []
        given = sorted(given.to_pylist(), key=lambda r: (r["level"], r["bucket"]))
        block = Block(info).numbered([r for r in given if r["level"] == 1], buckets)
        for k, grams in enumerate(block.grams(order, hot.value, buckets), 2):
            c = {x: np.zeros(grams.size, dtype="int64") for x in ("total", "kept", "types")}
            lists = [r for r in given if r["level"] == k]
            for (lo, hi), r in zip(grams.runs, lists, strict=True):
                places = grams.named(lo, hi)[0]
                c["total"][places] = unpack(r["total"])
                c["kept"][places] = c["total"][places] - unpack(r["kept"]).astype("int64")
                c["types"][places] = unpack(r["types"])
            split = np.flatnonzero(grams.hot)
            for i, key in zip(split, history_key([block.number[w[split]] for w in grams.past]).tolist()):
                c["total"][i], c["kept"][i], c["types"][i] = (dealt.value[k, key][x] for x in ("total", "kept", "types"))
            c["n"] = np.concatenate([unpack(r["n"]).astype("int64") for r in lists]) if lists else np.zeros(0, "int64")
            levels.append(grams)
            counts.append(c)
        known, base, total = walked(block, levels, counts, scale if n else 0.0, least)
        return pa.table({"doc_id": pa.array(info["doc_id"], pa.int64()), "held_out": pa.array(info["held_out"], pa.bool_()),
                         "n_tokens": pa.array(block.size), "n_known": pa.array(known.astype("int64")),
                         "train_tokens": pa.array(np.full(len(block.size), n, "int64")), "base_score": pa.array(base),
                         "score": pa.array(total)})

    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
