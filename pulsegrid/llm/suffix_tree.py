"""Language-model scoring with a probabilistic suffix tree over words.

A state of the tree is a context of up to ``DEPTH`` words, of which the first may be
the beginning of the text.  A context is kept where its next-word distribution
diverges from that of its longest kept suffix.  Next-word distributions are smoothed
by absolute discounting towards that suffix, down to the additively smoothed word
frequencies at the root.  A token is scored in the state of the longest kept suffix
of the words before it.

How the work is spread: all (context, next word) pairs that occur ``LEAST_EDGE``
times, at any size of corpus, are kept in written tables keyed by the hash of the
run of words, a gram.  A gram's key is made from the keys of the two grams one word
shorter.  Tables are packed: a row holds the columns of up to ``PIECE`` entries of one
bucket.  The number of buckets follows the size of the texts, so a bucket holds a
bounded number of distinct entries, and each task counts what it has read before it
hands it on.  A level of the tree takes three shuffles: pairs are counted by their own
key, meet the probability after the suffix by the key of the shorter gram, and meet
the other pairs of their context, and its count, by the key of the context.

The log-probability of a token is a sum over the grams that end at it and before
it.  Texts send the keys they need to the buckets of the values and get their sums.
Only to save work, words and grams above a share of all tokens are broadcast, and so
is a bit field of at most ``FILTER_BITS`` that holds every other gram of a table: a
gram that is not in it need not be counted or looked up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.storage import discard, freed, saved
from pulsegrid.llm.words import Words, mix, word_slices

DEPTH = 3
#: Share of all tokens from which a word or gram is broadcast (at most 1 / share of each length); all others are looked up.
HEAD_SHARE = 2e-6
#: Least divergence in nats a token, and in all, from the longest kept suffix.
LEAST_DIVERGENCE, LEAST_GAIN = 0.01, 10.0
DISCOUNT, LEAST_EDGE, ADDED = 0.75, 2, 0.1
#: The end of a text as a word; no word's bytes hash to a chosen value.
END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: The beginning of a text as a context.
START = np.uint64(0x51A7751A7751A775)
#: Most bits of a filter, and bits for each of its keys below that.
FILTER_BITS, KEY_BITS = 1 << 28, 16
#: Pairs counted in a task before they are handed on, the most in one packed row, and the bytes of text for each bucket.
HELD, PIECE, BUCKET_BYTES = 1_000_000, 512, 8 << 20
#: Rounds in which the texts are scored.
ROUNDS = 3
#: Makes the key under which a word's own count is looked up, apart from its key as a context.
_AS_WORD = np.uint64(0x3C6EF372FE94F82B)
_SLOT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Index:
    """Positions of distinct 64-bit keys, looked up for whole arrays at once: a table of slots, and a smaller one for what collides."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        self.tables: list[tuple[int, np.ndarray]] = []
        rest = np.arange(len(keys), dtype=np.int32)
        while len(rest):
            bits = max(4, int(np.ceil(np.log2(len(rest) * 4))))
            slot = self._slot(self.keys[rest], len(self.tables), bits)
            table = np.full(1 << bits, -1, dtype=np.int32)
            table[slot] = rest
            self.tables.append((bits, table))
            rest = rest[table[slot] != rest]

    @staticmethod
    def _slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        odd = _SLOT[level % 4] + np.uint64(2 * (level // 4))
        return ((keys * odd) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 for others."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo, sought = None, keys
        for level, (bits, table) in enumerate(self.tables):
            at = table[self._slot(sought, level, bits)]
            held = np.flatnonzero(at >= 0)
            at = at[held]
            hit = self.keys[at] == sought[held]
            found, missed = held[hit], held[~hit]
            if todo is None:
                out[found], todo = at[hit], missed
            else:
                out[todo[found]], todo = at[hit], todo[missed]
            if not len(todo):
                break
            sought = keys[todo]
        return out


class Filter:
    """A bit field of keys: what is not in it is no key, what is in it may be one."""

    def __init__(self, table: DataFrame):
        count = table.agg(F.coalesce(F.sum(F.octet_length("a") / 8), F.lit(0.0))).first()[0]
        self.bits = int(np.clip(np.ceil(np.log2(max(count, 1) * KEY_BITS)), 10, np.log2(FILTER_BITS)))
        self.field = np.zeros(1 << (self.bits - 6), dtype=np.uint64)
        bits = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(1 << (bits - 6), dtype=np.uint64)
            for b in batches:
                at = np.sort(Filter.places(unpacked(b.column(0), np.uint64), bits).ravel())
                word = at >> np.uint64(6)
                first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
                if len(first):
                    own[word[first]] |= np.bitwise_or.reduceat(np.left_shift(np.uint64(1), at & np.uint64(63)), first)
            at = np.flatnonzero(own)
            for i in range(0, len(at), 100_000):
                part = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(own[part].view(np.int64))], ["at", "part"])

        with freed(table.sparkSession):
            got = table.select("a").mapInArrow(run, "at int, part long").groupBy("at").agg(F.bit_or("part").alias("part")).toArrow()
        self.field[got.column("at").to_numpy()] = got.column("part").to_numpy().view(np.uint64)

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> np.ndarray:
        return np.stack([(keys * odd) >> np.uint64(64 - bits) for odd in _SLOT[:2]])

    def has(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), dtype=bool)
        for at in self.places(keys, self.bits):
            ok &= (self.field[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return ok


@dataclass
class Model:
    """The broadcast part of the tree: frequent words and grams, and a filter of all grams."""

    tokens: int
    distinct: int
    words: Index
    counts: np.ndarray
    grams: Index | None = None
    values: np.ndarray | None = None
    all_grams: Filter | None = None

    def root(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADDED) / (self.tokens + ADDED * (self.distinct + 1))


@dataclass
class Tokens:
    """Words and ends of the texts of a slice."""

    hashes: np.ndarray
    docs: np.ndarray
    first: np.ndarray  # whether a token is the first of its text
    rows: int

    @classmethod
    def of(cls, w: Words) -> Tokens:
        n = len(w.bounds) - 1
        sizes = np.diff(w.bounds) + 1
        ends = np.cumsum(sizes)
        hashes = np.empty(int(ends[-1]) if n else 0, dtype=np.uint64)
        last = np.zeros(len(hashes), dtype=bool)
        last[ends - 1] = True
        hashes[last], hashes[~last] = END, w.hashes
        first = np.zeros(len(hashes), dtype=bool)
        first[ends - sizes] = True
        return cls(hashes, np.repeat(np.arange(n), sizes), first, n)


def grams(t: Tokens, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length of the context from 1: (positions, key, context, shorter) of the tokens that have such a context;
    ``shorter`` is the key of the gram without its first word, ``context`` of that without its last."""
    full, at, out = t.hashes, np.arange(len(t.hashes)), []
    for d in range(1, depth + 1):
        # what ended before a token is its context; before the first token that is the beginning
        if d == 1:
            context = np.roll(full, 1)
            context[t.first] = START
            shorter = full
        else:
            has = np.zeros(len(full), dtype=bool)
            has[at] = True
            at = np.flatnonzero(~t.first & np.roll(has, 1))
            context, shorter = full[at - 1], full[at]
        key = joined(context, shorter)
        full = np.zeros(len(t.hashes), dtype=np.uint64)
        full[at] = key
        out.append((at, key, context, shorter))
    return out


def joined(context: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """The key of a gram from those without its last and without its first word."""
    return mix(mix(context) * _SLOT[0] + shorter)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


#: A packed table: keys a and b, counts n, values v; s is for a whole row.  Kinds order the rows of a bucket.
PACKED = "bucket int, kind int, a binary, b binary, n binary, v binary, s long"
TABLE, WORDS, NEEDS, VALUES, HEAD = range(5)


def packed(kind: int, by: np.ndarray, buckets: int, s: int | None = None, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows of at most ``PIECE`` entries for the buckets of the keys ``by``."""
    bucket = ((by >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    if (bucket[1:] < bucket[:-1]).any():
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
    else:  # buckets ascend with keys
        order = slice(None)
    at = np.arange(len(bucket))
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else at
    since = at - np.repeat(begin, np.diff(np.concatenate((begin, [len(bucket)]))))
    begin = np.flatnonzero(since % PIECE == 0)
    bounds = np.concatenate((begin, [len(bucket)])).astype(np.int32)
    out = [pa.array(bucket[begin]), pa.array(np.full(len(begin), kind, np.int32))]
    for c in "abnv":
        if c in columns:
            x = columns[c]
            sizes = pa.py_buffer((bounds * x.itemsize).astype(np.int32))
            out.append(pa.Array.from_buffers(pa.binary(), len(begin), [None, sizes, pa.py_buffer(np.ascontiguousarray(x[order]))]))
        else:
            out.append(pa.nulls(len(begin), pa.binary()))
    out.append(pa.array([s] * len(begin), pa.int64()))
    return pa.RecordBatch.from_arrays(out, ["bucket", "kind", "a", "b", "n", "v", "s"])


def unpacked(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """All entries of a column of packed rows; rows without that column have none."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(b"".join(c.drop_null().to_pylist()), dtype=kind) for c in chunks)])


def summed(key: np.ndarray, n: np.ndarray, *parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, with the sum of ``n`` and its parts."""
    key, first, back = np.unique(key, return_index=True, return_inverse=True)
    return key, np.bincount(back, n, len(key)).astype(np.int64), *(x[first] for x in parts)


def _counted(texts: DataFrame, buckets: int, parts_of, least: int) -> DataFrame:
    """Sums over all texts of what ``parts_of`` gives for the tokens of a slice, packed: words (a, n) by
    their key; or pairs (a shorter, b context, n) of at least ``least`` by the shorter gram's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def handed() -> pa.RecordBatch:
            key, n, *parts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return packed(TABLE, key, buckets, a=parts[0] if parts else key, n=n.astype(np.uint32), **({"b": parts[1]} if parts else {}))

        for b in batches:
            for w in word_slices(b.column(0), lower=True):
                key, *parts = parts_of(Tokens.of(w))
                key, first, n = np.unique(key, return_index=True, return_counts=True)
                held.append((key, n, *(x[first] for x in parts)))
                size += len(key)
                if size > HELD:
                    yield handed()
                    held, size = [], 0
        if held:
            yield handed()

    def words(t: pa.Table) -> pa.Table:
        key, n = summed(unpacked(t["a"], np.uint64), unpacked(t["n"], np.uint32))
        return pa.Table.from_batches([packed(TABLE, key, buckets, a=key, n=n)])

    def pairs(t: pa.Table) -> pa.Table:
        shorter, context = unpacked(t["a"], np.uint64), unpacked(t["b"], np.uint64)
        _, n, shorter, context = summed(joined(context, shorter), unpacked(t["n"], np.uint32), shorter, context)
        ok = n >= least
        return pa.Table.from_batches([packed(NEEDS, shorter[ok], buckets, a=shorter[ok], b=context[ok], n=n[ok])])

    return texts.mapInArrow(run, PACKED).groupBy("bucket").applyInArrow(words if parts_of is _words else pairs, PACKED)


def _words(t: Tokens) -> tuple[np.ndarray]:
    return (t.hashes,)


def _pairs(texts: DataFrame, buckets: int, d: int, below: Filter) -> DataFrame:
    """The pairs of a context of ``d`` words and its next word that occur at least ``LEAST_EDGE`` times, packed;
    both the context and the pair without its first word are in ``below``."""
    shared = texts.sparkSession.sparkContext.broadcast(below)

    def parts(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, key, context, shorter = grams(t, d)[-1]
        at = np.flatnonzero(shared.value.has(context))
        at = at[shared.value.has(shorter[at])]
        return key[at], shorter[at], context[at]

    return _counted(texts, buckets, parts, LEAST_EDGE)


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Index, np.ndarray, np.ndarray, int, pa.RecordBatch]]:
    """(keys, values, whether of a word, kind, rows): the rows of a bucket that look up, with what the bucket's tables hold.

    The rows come by bucket, tables first; tables are held, in which a key is once, the others stream past.
    """
    now, held, table = None, [], None
    for b in batches:
        bucket, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
            if i == j:
                continue
            part = b.slice(i, j - i)
            if bucket[i] != now:
                now, held, table = bucket[i], [], None
            if kind[i] < NEEDS:
                key = unpacked(part.column(2), np.uint64)
                held.append((key, unpacked(part.column(5), np.float64), np.full(len(key), kind[i] == WORDS)))
                continue
            if table is None:
                none = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool))
                keys, values, words = (np.concatenate(x) for x in zip(none, *held, strict=True))
                order = np.argsort(keys)
                table, held = (Index(keys[order]), values[order], words[order]), []
            yield (*table, int(kind[i]), part)


def _meeting(rows: DataFrame, tables: DataFrame) -> DataFrame:
    return rows.unionByName(tables).repartition("bucket").sortWithinPartitions("bucket", "kind")


def _with_suffix(pairs: DataFrame, below: DataFrame, buckets: int) -> DataFrame:
    """(a shorter, b context, n, v) packed by context: ``pairs`` with the probability of the word after the longest kept suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values, _, _, part in _passing(batches):
            shorter, context = unpacked(part.column(2), np.uint64), unpacked(part.column(3), np.uint64)
            yield packed(NEEDS, context, buckets, a=shorter, b=context, n=unpacked(part.column(4), np.int64), v=values[keys.find(shorter)])

    return _meeting(pairs, below).mapInArrow(run, PACKED)


def _tested(pairs: DataFrame, below: DataFrame, buckets: int) -> DataFrame:
    """The grams of ``pairs`` after the divergence test of their contexts, packed by key.

    ``below`` holds the counts of the contexts.  Rows of kind TABLE hold counts n and
    in v the probability of the word in the context where it is kept, else after its
    suffix; rows of kind VALUES those of kept contexts and of their pairs.
    """

    def test(t: pa.Table) -> pa.Table:
        of_pairs = pc.equal(t["kind"], NEEDS)
        counts, rows = t.filter(pc.invert(of_pairs)), t.filter(of_pairs)
        key = unpacked(counts["a"], np.uint64)
        order = np.argsort(key)
        index, totals = Index(key[order]), unpacked(counts["n"], np.int64)[order]
        context = unpacked(rows["b"], np.uint64)
        order = np.argsort(context)
        context, shorter = context[order], unpacked(rows["a"], np.uint64)[order]
        n, above = unpacked(rows["n"], np.int64)[order], unpacked(rows["v"], np.float64)[order]
        if not len(context):
            return pa.Table.from_batches([packed(TABLE, context, buckets, a=context, n=n, v=above)])
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        of = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(context)]))))
        each = lambda x: np.add.reduceat(x, first)
        total = totals[index.find(context[first])].astype(np.float64)
        share = np.maximum(n - DISCOUNT, 0.0) / total[of]
        rest = np.clip(1 - each(share), 1e-6, 1.0)
        others = np.maximum(1 - each(above), 1e-9)
        own = share + rest[of] * above
        # divergence: the explicit words, and all others as one event
        divergence = each(own * np.log(own / above)) + rest * others * np.log(rest)
        kept = (divergence >= LEAST_DIVERGENCE) & (divergence * total >= LEAST_GAIN)
        key, ok = joined(context, shorter), kept[of]
        value = np.log10(own / above) - np.log10(rest)[of]
        return pa.Table.from_batches(
            [
                packed(TABLE, key, buckets, a=key, n=n, v=np.where(ok, own, above)),
                packed(VALUES, key[ok], buckets, a=key[ok], n=n[ok], v=value[ok]),
                packed(VALUES, context[first][kept], buckets, a=context[first][kept], n=total[kept].astype(np.int64), v=np.log10(rest)[kept]),
            ]
        )

    return pairs.unionByName(below).groupBy("bucket").applyInArrow(test, PACKED)


def _collected(rows: DataFrame, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The keys a in order, and the column of packed rows of one kind: of the head only."""
    got = rows.toArrow()
    key, value = unpacked(got.column(0), np.uint64), unpacked(got.column(1), kind)
    order = np.argsort(key)
    return key[order], value[order]


def fit(texts: DataFrame, depth: int = DEPTH) -> tuple[Model, list[DataFrame], int]:
    """The model, the packed tables of what it does not hold (values of rare words over unknown ones, and of
    grams of kept contexts), and the number of buckets, from the rows of ``texts`` (text).

    In a kept context a word has the ``rest`` of the probability it has after the
    suffix, or ``p`` where the pair is listed.  A context's value is log10 of its
    rest, a pair's value log10 of what ``p`` is over that; the log-probability of a
    token over the root's is the sum of those of its contexts and pairs.
    """
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = 1 + size // BUCKET_BYTES
    counts = saved(_counted(texts, buckets, _words, 1), "suffix-tree-words")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = unpacked(b.column(0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([len(n)])], ["tokens", "distinct"])

    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    tokens, distinct = counts.select("n").mapInArrow(totals, "tokens long, distinct long").agg(zero("tokens"), zero("distinct")).first()
    least, norm = max(1.0, HEAD_SHARE * tokens), tokens + ADDED * (distinct + 1)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n = unpacked(b.column(2), np.uint64), unpacked(b.column(4), np.int64)
            head, twice = n >= least, n >= LEAST_EDGE
            own = key ^ _AS_WORD
            yield packed(HEAD, key[head], buckets, a=key[head], n=n[head])
            yield packed(WORDS, own[~head], buckets, a=own[~head], v=np.log10(n[~head] + ADDED) - np.log10(ADDED))
            p = (n + ADDED) / norm
            if (at := np.flatnonzero(key == END)).size:  # a text begins as often as it ends
                key, n, p, twice = np.append(key, START), np.append(n, n[at]), np.append(p, 0.0), np.append(twice, True)
            yield packed(TABLE, key[twice], buckets, a=key[twice], n=n[twice], v=p[twice])

    rows = saved(counts.mapInArrow(split, PACKED), "suffix-tree-level")
    discard(counts)
    kind = lambda df, k: df.where(F.col("kind") == k)
    words, n = _collected(kind(rows, HEAD).select("a", "n"), np.int64)
    model = Model(tokens, distinct, Index(words), n.astype(np.float64))
    rare = kind(rows, WORDS)
    if tokens == 0:
        return model, [rare], buckets
    levels = [rows]
    for d in range(1, depth + 1):
        below = kind(levels[-1], TABLE)
        pairs = saved(_pairs(texts, buckets, d, Filter(below)), "suffix-tree-pairs")
        met = saved(_with_suffix(pairs, below, buckets), "suffix-tree-pairs")
        discard(pairs)
        levels.append(saved(_tested(met, below, buckets), "suffix-tree-level"))
        discard(met)

    def whole(t: pa.Table) -> pa.Table:
        key, n, v = unpacked(t["a"], np.uint64), unpacked(t["n"], np.int64), unpacked(t["v"], np.float64)
        key, back = np.unique(key, return_inverse=True)
        most = np.zeros(len(key), np.int64)
        np.maximum.at(most, back, n)
        v, head = np.bincount(back, v, len(key)), most >= least
        return pa.Table.from_batches([packed(HEAD, key[head], buckets, a=key[head], v=v[head]), packed(TABLE, key[~head], buckets, a=key[~head], v=v[~head])])

    values = reduce(DataFrame.unionByName, [kind(x, VALUES) for x in levels[1:]])
    values = saved(values.groupBy("bucket").applyInArrow(whole, PACKED), "suffix-tree-values")
    discard(*levels[1:])
    keys, model.values = _collected(kind(values, HEAD).select("a", "v"), np.float64)
    model.grams, model.all_grams = Index(keys), Filter(values)
    return model, [rare, kind(values, TABLE)], buckets


#: What adds to the texts of slice s: sums for the texts i, or of the whole slice the hash of each row and what the scan knows.
PARTS = "s long, i binary, known binary, base binary, gain binary, rows binary, facts binary"


def _sums(needs: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """PARTS rows: what the values of the keys in ``needs`` add to each text, and what is known of the texts."""
    names = [f.split()[0] for f in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[np.ndarray, ...]] = []
        size = 0

        def handed() -> pa.RecordBatch:
            s, i, *sums = (np.concatenate(x) for x in zip(*done, strict=True))
            order = np.lexsort((i, s))
            s, i = s[order], i[order]
            first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (i[1:] != i[:-1]))))
            columns = [i[first], *(np.add.reduceat(x[order], first) for x in sums)]
            s = s[first]
            begin = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            bounds = np.concatenate((begin, [len(s)]))
            made = [pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((bounds * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for x in columns]
            return pa.RecordBatch.from_arrays([pa.array(s[begin]), *made, pa.nulls(len(begin), pa.binary()), pa.nulls(len(begin), pa.binary())], names)

        for keys, values, words, kind, part in _passing(batches):
            if kind == HEAD:
                none = [pa.nulls(part.num_rows, pa.binary())] * 4
                yield pa.RecordBatch.from_arrays([part.column(6), *none, part.column(2), part.column(5)], names)
                continue
            at = keys.find(unpacked(part.column(2), np.uint64))
            sizes = pc.binary_length(part.column(3)).to_numpy() // 4
            s, i = np.repeat(part.column(6).to_numpy(), sizes), unpacked(part.column(3), np.uint32)
            s, i, at = s[at >= 0], i[at >= 0], at[at >= 0]
            if len(s):
                # entries of one text follow each other
                first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (i[1:] != i[:-1]))))
                value, word = values[at], words[at]
                done.append((s[first], i[first], *(np.add.reduceat(x, first) for x in (word.astype(np.float64), value * word, value * ~word))))
                size += len(first)
            if size > HELD:
                yield handed()
                done, size = [], 0
        if done:
            yield handed()

    return _meeting(needs, reduce(DataFrame.unionByName, tables)).mapInArrow(run, PARTS)


def _totals(parts: DataFrame) -> DataFrame:
    """(row, n_tokens, n_known, base, gain) of the texts of all slices."""

    def total(t: pa.Table) -> pa.Table:
        whole = t.filter(pc.is_valid(t["rows"]))
        copies = whole.num_rows  # slices of the same rows have one name
        rows = np.frombuffer(whole["rows"][0].as_py(), dtype=np.int64)
        tokens, known, base, gain = np.frombuffer(whole["facts"][0].as_py(), dtype=np.float64).reshape(-1, 4).T.copy()
        i = unpacked(t["i"], np.uint32)
        for x, name in ((known, "known"), (base, "base"), (gain, "gain")):
            x += np.bincount(i, unpacked(t[name], np.float64), len(rows)) / copies
        return pa.table({"row": rows, "n_tokens": tokens.astype(np.int64), "n_known": np.rint(known).astype(np.int64), "base": base, "gain": gain})

    return parts.groupBy("s").applyInArrow(total, "row long, n_tokens long, n_known long, base double, gain double")


def scored(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    * a null or empty text is its end alone; a null doc_id is never held out;
    * rows that repeat a doc_id are scored, and where not held out counted, apart;
      rows equal in doc_id and text have equal results;
    * without training rows every word is unknown and both scores are equal;
    * an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string").alias("text")
    model, tables, buckets = fit(docs.where(~held_out(F.col("doc_id"))).select(text), depth)
    shared = spark.sparkContext.broadcast(model)
    norm = float(np.log10(model.tokens + ADDED * (model.distinct + 1)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        logs = np.log10(m.counts + ADDED) - norm
        for b in batches:
            rows = b.column(0).to_numpy()
            for w in word_slices(b.column(1), lower=True):
                t = Tokens.of(w)
                words = m.words.find(t.hashes)
                known = words >= 0
                base = np.full(len(words), np.log10(ADDED) - norm)
                base[known] = logs[words[known]]
                gain, owners, sought = np.zeros(t.rows), [t.docs[~known]], [t.hashes[~known] ^ _AS_WORD]
                if m.grams is not None:
                    # all grams, contexts among them
                    for owner, keys in [(t.docs[t.first], np.full(t.rows, START)), (t.docs, t.hashes), *((t.docs[at], key) for at, key, _, _ in grams(t, depth))]:
                        may = np.flatnonzero(m.all_grams.has(keys))
                        owner, keys = owner[may], keys[may]
                        found = m.grams.find(keys)
                        hit = found >= 0
                        gain += np.bincount(owner[hit], m.values[found[hit]], t.rows)
                        owners.append(owner[~hit])
                        sought.append(keys[~hit])
                owner, key = np.concatenate(owners), np.concatenate(sought)
                order = np.argsort(owner, kind="stable")
                own = rows[w.first : w.first + t.rows]
                s = int(np.bitwise_xor.reduce(mix(own.view(np.uint64) + np.arange(t.rows, dtype=np.uint64) * _AS_WORD)).view(np.int64))
                yield packed(NEEDS, key[order], buckets, s=s, a=key[order], b=owner[order].astype(np.uint32))
                # what is known of each text already: one row that meets no table
                numbers = np.column_stack((np.bincount(t.docs, minlength=t.rows), np.bincount(t.docs, known, t.rows), np.bincount(t.docs, base, t.rows), gain))
                facts = [pa.array([((s % 2**64 >> 32) * buckets) >> 32], pa.int32()), pa.array([HEAD], pa.int32()), pa.array([own.tobytes()]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([numbers.tobytes()]), pa.array([s])]
                yield pa.RecordBatch.from_arrays(facts, ["bucket", "kind", "a", "b", "n", "v", "s"])

    row = F.xxhash64("doc_id", F.col("doc_id").isNull(), F.coalesce(text, F.lit(""))).alias("row")
    # a share of the texts at a time, so that only their keys are on disk at once
    rounds = []
    for k in range(ROUNDS):
        some = docs.select(row, text).where(F.pmod("row", F.lit(ROUNDS)) == k)
        found = _totals(_sums(some.mapInArrow(scan, PACKED), tables))
        rounds.append(saved(found.groupBy("row").agg(*[F.max(c).alias(c) for c in ("n_tokens", "n_known", "base", "gain")]), "suffix-tree-sums"))
    found = reduce(DataFrame.unionByName, rounds)
    rows = docs.select(row, "doc_id", held_out(F.col("doc_id")).alias("held_out")).join(found, "row", "left")
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("base") + F.col("gain")).alias("score"),
    )
