"""A hierarchical Pitman-Yor language model over words, seated by Gibbs sampling.

**Model.** Every word is a context with a restaurant of its own; its customers are the tokens that
follow it. All context restaurants share one parent, the root, whose customers are the tables of
the contexts. The root's parent is uniform over the V known tokens and one more. Words with at
least 1 / ``CONTEXTS`` of all training tokens count as frequent: there are at most ``CONTEXTS`` of
them whatever the corpus, so what is summed over them is broadcast. What is summed over any other
context stays with the groups and is exchanged between them after each sweep.

**Gibbs sampling.** A sweep seats all customers of all restaurants anew: one after the other
takes a new table with the probability of the Chinese restaurant process, given the seating so
far and what the last sweep left of the parent and of the totals (those of a sweep are summed and
handed to the next one, as is usual for distributed sampling). Beyond ``SINGLY`` customers of a
dish, they are seated in growing blocks with one probability each. Random numbers depend on
(sweep, group) alone, and groups on the corpus alone: a recomputed task seats as the lost one
did, a later sweep redoes earlier ones instead of storing them, and no setting of the session
changes a score.

**Layout.** Tokens go to groups: a rare word, with all its contexts, by its hash; a frequent word by
(word, context) after a frequent word, and by the context's hash after a rare one. Pairs with at
least 1 / ``CONTEXTS`` of all tokens are broadcast and scored where they are read, so no word and
no pair is a hot key. Per piece of text a group gets one list of distinct pairs and postings, and
returns one list of sums.

**Exchange.** A rare context's customers may sit in any group. Its hash says who owns it: once,
every group tells each owner which of its contexts it has, with their customers; after a sweep it
tells their tables, and is told the sums in the same order. Where an unlearnt text has a rare word
after a context that the word's group does not have, that group returns the root's probability,
the context's own group the context's weight, and the piece multiplies them.

**Score.** log10 of the mean over the last ``KEPT`` sweeps of the predictive probability of each
token, summed over the text's words and its end. The base score is add-one smoothing of words.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A null text is empty: its end is its one
token. Rows with a null doc_id are scored, not learnt from and not held out; repeated ids are
rows like others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.text import Words, fold_of, mix, not_spaces, pieces, small_batches
from eventloom.session import materialize

CONTEXTS = 1 << 16
#: Tokens of a group and of an owner of contexts, about: their numbers follow from the corpus alone.
GROUP, OWNED = 1_500_000, 8_000_000
PIECE_BYTES = 16 << 20
SWEEPS, KEPT = 4, 2
SINGLY = 64
#: Discount and strength of the root and of the contexts.
ROOT, CONTEXT = (0.6, 10.0), (0.8, 5.0)
FOLDS, HELD_OUT = 7, 2
U64 = np.uint64
END = mix(np.array([0x454E44], U64))[0]
#: Bits for a frequent word's number in keys, and for a rare context's place in its group.
_SHIFT, _WIDE = 18, 32
_MASK, _PLACE = (1 << _SHIFT) - 1, (1 << _WIDE) - 1
#: Rows that groups send each other: g receives, other sends; sweep tells what is sent.
MESSAGE = "g long, other long, sweep int, b binary"
RESTAURANT, ASKED, SUMS = -1, -2, -3


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, bytes of equal weight together."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(f"{a.dtype.str},{len(a)};".encode() + a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.compress(len(arrays).to_bytes(2, "little") + b"".join(parts), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    data, out = zstandard.decompress(blob), []
    at = 2
    for _ in range(int.from_bytes(data[:2], "little")):
        stop = data.index(b";", at)
        kind, n = data[at:stop].decode().split(",")
        kind, n, at = np.dtype(kind), int(n), stop + 1
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(kind.itemsize, n).T).view(kind).ravel())
        at += size
    return out


def steps(sorted_numbers: np.ndarray) -> np.ndarray:
    return np.diff(sorted_numbers, prepend=sorted_numbers.dtype.type(0))


def seat(customers: np.ndarray, new_table: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after the customers of each dish came one by one.

    With i customers at t tables, the next one opens a table with weight ``new_table``, and joins
    one with weight i - discount * t.
    """
    tables = np.minimum(customers, 1)
    active = np.flatnonzero(customers > 1)
    for i in range(1, SINGLY):
        if not len(active):
            return tables
        weight = new_table[active]
        tables[active] += rng.random(len(active)) < weight / (weight + i - discount * tables[active])
        active = active[customers[active] > i + 1]
    i = SINGLY
    while len(active):
        block = np.minimum(i, customers[active] - i)
        weight = new_table[active]
        p = weight / (weight + np.maximum(i + block / 2 - discount * tables[active], 1e-9))
        tables[active] += rng.binomial(block, p)
        i *= 2
        active = active[customers[active] > i]
    return tables


@dataclass
class Totals:
    """What a sweep left, of bounded size: tables by context; customers and tables of frequent words at the root."""

    tables_of: np.ndarray
    frequent_customers: np.ndarray
    frequent_tables: np.ndarray
    root_customers: float
    root_tables: float

    def root(self, customers: np.ndarray, tables: np.ndarray, known: int) -> np.ndarray:
        """The root's predictive probability of dishes with so many customers and tables."""
        d, s = ROOT
        uniform = (s + d * self.root_tables) / (known + 1)
        return (np.maximum(customers - d * tables, 0) + uniform) / (s + self.root_customers)


@dataclass
class Model:
    """The bounded part of a model, which every task has.

    words: hashes of the frequent words, in order; counts: theirs, and that of text starts.
    """

    words: np.ndarray
    counts: np.ndarray
    tokens: int
    known: int
    groups: int
    totals: list[Totals]
    hot_keys: np.ndarray | None = None
    hot_probability: np.ndarray | None = None

    @property
    def start(self) -> int:
        return len(self.words)

    @property
    def rare(self) -> int:
        """The number that stands for all rare contexts, which have a hash and no number."""
        return len(self.words) + 1

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each frequent word, -1 for others."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def group_of_words(self, hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes + U64(7)) % U64(self.groups)).astype(np.int64)

    def owner(self, contexts: np.ndarray) -> np.ndarray:
        """The task that sums a rare context over the groups: as many as the tokens need, whatever the groups."""
        return (mix(contexts + U64(11)) % U64(max(1, math.ceil(self.tokens / OWNED)))).astype(np.int64)

    def group_of_pairs(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        return (mix((words.astype(U64) << U64(_SHIFT)) + contexts.astype(U64) + U64(1)) % U64(self.groups)).astype(np.int64)

    def back_off(self, totals: Totals) -> np.ndarray:
        """The weight of the parent in each numbered context; 1 where there is no restaurant."""
        d, s = CONTEXT
        return np.append((s + d * totals.tables_of) / (s + self.counts), 1.0)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens, each text's end after its words, and the number of each one's text."""
    words = Words(texts, not_spaces(), lower=True)
    n, owner = len(words), words.owner()
    tokens = np.full(len(owner) + n, END)
    tokens[np.arange(len(owner)) + owner] = words.hashes
    return tokens, np.repeat(np.arange(n), np.diff(words.first) + 1)


def _with_contexts(model: Model, texts: pa.Array):
    """(hash, number or -1, context, hash of the token before) of all tokens, and each one's text."""
    tokens, text = _tokens(texts)
    number = model.number(tokens)
    context = np.empty(len(tokens), np.int64)
    context[1:] = np.where(number[:-1] < 0, model.rare, number[:-1])
    first = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
    context[first] = model.start
    return tokens, number, context, np.roll(tokens, 1), text


def _slices(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, rows) with the rows of each group in order."""
    order = np.argsort(group, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(part):
            yield int(group[part[0]]), part


def _to_groups(*kinds) -> list[tuple[int, bytes]]:
    """(group, arrays) of entries of several kinds: the group of each entry, and what is sent of some of them."""
    by_group: dict[int, dict[int, list[np.ndarray]]] = {}
    for kind, (group, take) in enumerate(kinds):
        for g, at in _slices(group):
            by_group.setdefault(g, {})[kind] = take(at)
    nothing = [take(np.empty(0, np.int64)) for _, take in kinds]
    return [(g, pack(*(a for kind, none in enumerate(nothing) for a in parts.get(kind, none)))) for g, parts in by_group.items()]


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted places, and how often each stands there."""
    own, each = np.unique(places, return_counts=True)
    return own, each.astype("<u4")


def _count_words(training: DataFrame, groups: int) -> DataFrame:
    """(tokens, known, b) of each group: its totals, and the words that may be frequent, as one list."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, PIECE_BYTES):
            words, counts = np.unique(_tokens(piece.column("text"))[0], return_counts=True)
            group = (mix(words + U64(7)) % U64(groups)).astype(np.int64)
            rows = [(g, pack(words[at], counts[at].astype("<u4"))) for g, at in _slices(group)]
            yield pa.record_batch({"g": pa.array([g for g, _ in rows], pa.int64()), "b": pa.array([b for _, b in rows], pa.binary())})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        words, counts = (np.concatenate(c) for c in zip(*map(unpack, rows["b"])))
        words, place = np.unique(words, return_inverse=True)
        counts = np.bincount(place, counts, len(words)).astype(np.int64)
        # Frequent among all tokens implies frequent among the group's.
        often = counts * CONTEXTS >= counts.sum()
        return pd.DataFrame({"tokens": [int(counts.sum())], "known": [len(words)], "b": [pack(words[often], counts[often])]})

    sent = training.mapInArrow(send, "g long, b binary")
    return materialize(sent.groupBy("g").applyInPandas(add, "tokens long, known long, b binary"), "word-counts")


def _first_model(training: DataFrame) -> Model:
    spark = training.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = _count_words(training, partitions)
    sums = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("known"), F.lit(0)).alias("known")).first()
    tokens = int(sums.tokens)

    def keep_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("b"):
                words, counts = unpack(blob.as_py())
                often = counts * CONTEXTS >= tokens
                yield pa.record_batch({"word": pa.array(words[often].view(np.int64)), "n": pa.array(counts[often])})

    frequent = counted.select("b").mapInArrow(keep_frequent, "word long, n long").toArrow()  # at most CONTEXTS rows
    words, counts = frequent.column("word").to_numpy().view(U64), frequent.column("n").to_numpy()
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    texts = counts[words == END].sum() if (words == END).any() else training.count()
    return Model(words, np.append(counts, texts).astype(float), tokens, int(sums.known), max(1, math.ceil(tokens / GROUP)), [])


def _pair_lists(model: Model, texts: pa.Array) -> list[tuple[int, bytes]]:
    """(group, distinct pairs with counts) of a piece's tokens."""
    tokens, number, context, before, _ = _with_contexts(model, texts)
    rare, apart = number < 0, context == model.rare
    here = rare & ~apart
    words, place = np.unique(tokens[here], return_inverse=True)
    keys, counts = np.unique((place << _SHIFT) | context[here], return_counts=True)

    def rare_words(at):
        own, each = _runs(keys[at] >> _SHIFT)
        return [words[own], each, (keys[at] & _MASK).astype("<u4"), counts[at].astype("<u4")]

    here = ~rare & ~apart
    f_keys, f_counts = np.unique((number[here] << _SHIFT) | context[here], return_counts=True)

    def frequent_pairs(at):
        return [steps(f_keys[at]), f_counts[at].astype("<u4")]

    here = rare & apart
    r_words, place = np.unique(tokens[here], return_inverse=True)
    r_contexts, r_place = np.unique(before[here], return_inverse=True)
    r_keys, r_counts = np.unique((place << _WIDE) | r_place, return_counts=True)

    def rare_pairs(at):
        own, each = _runs(r_keys[at] >> _WIDE)
        return [r_words[own], each, r_contexts[r_keys[at] & _PLACE], r_counts[at].astype("<u4")]

    here = ~rare & apart
    a_contexts, place = np.unique(before[here], return_inverse=True)
    a_keys, a_counts = np.unique((place << _SHIFT) | number[here], return_counts=True)

    def after_rare(at):
        own, each = _runs(a_keys[at] >> _SHIFT)
        return [a_contexts[own], each, (a_keys[at] & _MASK).astype("<u4"), a_counts[at].astype("<u4")]

    del tokens, number, context, before, rare, apart, here, place, r_place
    return _to_groups(
        (model.group_of_words(words)[keys >> _SHIFT], rare_words),
        (model.group_of_pairs(f_keys >> _SHIFT, f_keys & _MASK), frequent_pairs),
        (model.group_of_words(r_words)[r_keys >> _WIDE], rare_pairs),
        (model.group_of_words(a_contexts)[a_keys >> _SHIFT], after_rare),
    )


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)


@dataclass
class Restaurants:
    """The customers of one group, as sorted keys with counts.

    keys: rare words (places in ``words``, hashes in order) after frequent contexts; frequent_keys:
    pairs of frequent words; rare_keys: rare words after rare contexts (places in ``contexts``);
    after_keys: frequent words after rare contexts. contexts: hashes of these and of all ``words``,
    in order. customers_of and tables_of: sums over all groups for each of them, by sweep.
    """

    words: np.ndarray
    contexts: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    frequent_keys: np.ndarray
    frequent_counts: np.ndarray
    rare_keys: np.ndarray
    rare_counts: np.ndarray
    after_keys: np.ndarray
    after_counts: np.ndarray
    customers_of: np.ndarray
    tables_of: list[np.ndarray]

    @staticmethod
    def merged(lists: list[bytes]) -> Restaurants:
        p = [np.concatenate(arrays) for arrays in zip(*([*a[:4], np.cumsum(a[4]), *a[5:]] for a in map(unpack, lists)))]
        words, place = np.unique(np.concatenate([p[0], p[6]]), return_inverse=True)
        contexts = np.unique(np.concatenate([words, p[8], p[10]]))
        keys = (np.repeat(place[: len(p[0])], p[1]) << _SHIFT) | p[2].astype(np.int64)
        rare_keys = (np.repeat(place[len(p[0]) :], p[7]) << _WIDE) | np.searchsorted(contexts, p[8])
        after_keys = (p[12].astype(np.int64) << _WIDE) | np.repeat(np.searchsorted(contexts, p[10]), p[11])
        pairs = (*_added(keys, p[3]), *_added(p[4], p[5]), *_added(rare_keys, p[9]), *_added(after_keys, p[13]))
        return Restaurants(words, contexts, *pairs, np.empty(0, np.int64), [])

    def packed(self) -> bytes:
        keys = [self.keys, self.frequent_keys, self.rare_keys, self.after_keys]
        counts = [self.counts, self.frequent_counts, self.rare_counts, self.after_counts]
        is_word = np.zeros(len(self.contexts), bool)
        is_word[np.searchsorted(self.contexts, self.words)] = True
        return pack(self.contexts, is_word, *map(steps, keys), *counts, self.customers_of, *self.tables_of)

    @staticmethod
    def unpacked(blob: bytes | None) -> Restaurants:
        if blob is None:
            empty = np.empty(0, np.int64)
            return Restaurants(np.empty(0, U64), np.empty(0, U64), *[empty] * 9, [empty] * (SWEEPS + 1))
        contexts, is_word, *rest = unpack(blob)
        pairs = [a for keys, counts in zip(rest[:4], rest[4:8]) for a in (np.cumsum(keys), counts)]
        return Restaurants(contexts[is_word], contexts, *pairs, rest[8], rest[9:])

    def of_contexts(self, rare: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Sums over the pairs of this group for each of ``contexts``."""
        n = len(self.contexts)
        return (np.bincount(self.rare_keys & _PLACE, rare, n) + np.bincount(self.after_keys & _PLACE, after, n)).astype(np.int64)

    def asked(self, model: Model) -> list[tuple[int, np.ndarray]]:
        """(owner, places) of the contexts, in the order of all messages about them."""
        return list(_slices(model.owner(self.contexts)))

    def back_off(self, tables_of: np.ndarray) -> np.ndarray:
        """The weight of the root in each of ``contexts``."""
        d, s = CONTEXT
        return (s + d * tables_of) / (s + self.customers_of)

    def sweeps(self, model: Model, group: int, last: int) -> Iterator[Seating]:
        """The seating of this group after sweeps 0 to ``last``; sweep 0 has one table per pair."""
        word, context = self.keys >> _SHIFT, self.keys & _MASK
        f_word, f_context = self.frequent_keys >> _SHIFT, self.frequent_keys & _MASK
        r_word, r_context = self.rare_keys >> _WIDE, self.rare_keys & _PLACE
        a_word, a_context = self.after_keys >> _WIDE, self.after_keys & _PLACE

        def root(tables: np.ndarray, r_tables: np.ndarray) -> np.ndarray:
            """Customers of the rare words at the root: the tables of all contexts."""
            n = len(self.words)
            return (np.bincount(word, tables, n) + np.bincount(r_word, r_tables, n)).astype(np.int64)

        tables, f_tables, r_tables, a_tables = (np.minimum(c, 1) for c in (self.counts, self.frequent_counts, self.rare_counts, self.after_counts))
        customers = root(tables, r_tables)
        root_tables = np.minimum(customers, 1)
        yield Seating(0, tables, f_tables, r_tables, a_tables, customers, root_tables)
        d, s = CONTEXT
        for sweep in range(1, last + 1):
            before, rng = model.totals[sweep - 1], np.random.Generator(np.random.Philox(key=[sweep, group]))
            opening, r_opening = s + d * before.tables_of, s + d * self.tables_of[sweep - 1]
            parent = before.root(customers, root_tables, model.known)
            tables = seat(self.counts, opening[context] * parent[word], d, rng)
            f_parent = before.root(before.frequent_customers, before.frequent_tables, model.known)
            f_tables = seat(self.frequent_counts, opening[f_context] * f_parent[f_word], d, rng)
            r_tables = seat(self.rare_counts, r_opening[r_context] * parent[r_word], d, rng)
            a_tables = seat(self.after_counts, r_opening[a_context] * f_parent[a_word], d, rng)
            customers = root(tables, r_tables)
            d0, s0 = ROOT
            weight = (s0 + d0 * before.root_tables) / (model.known + 1)
            root_tables = seat(customers, np.full(len(customers), weight), d0, rng)
            yield Seating(sweep, tables, f_tables, r_tables, a_tables, customers, root_tables)


@dataclass
class Seating:
    sweep: int
    tables: np.ndarray
    frequent_tables: np.ndarray
    rare_tables: np.ndarray
    after_tables: np.ndarray
    customers: np.ndarray
    root_tables: np.ndarray


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame({"g": np.array([r[0] for r in rows], np.int64), "other": np.array([r[1] for r in rows], np.int64), "sweep": np.array([r[2] for r in rows], np.int32), "b": [r[3] for r in rows]})


def _restaurants(training: DataFrame, model: Model) -> DataFrame:
    """The restaurants of every group, and what it tells the owners of its contexts, stored as messages."""
    shared = training.sparkSession.sparkContext.broadcast(model)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, PIECE_BYTES):
            rows = _pair_lists(shared.value, piece.column("text"))
            yield pa.record_batch({"g": pa.array([g for g, _ in rows], pa.int64()), "b": pa.array([b for _, b in rows], pa.binary())})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        g, own = int(rows["g"].iloc[0]), Restaurants.merged(list(rows["b"]))
        customers, tables = own.of_contexts(own.rare_counts, own.after_counts), own.of_contexts(np.minimum(own.rare_counts, 1), np.minimum(own.after_counts, 1))
        told = [(owner, g, ASKED, pack(own.contexts[at], customers[at], tables[at])) for owner, at in own.asked(shared.value)]
        return _messages([(g, g, RESTAURANT, own.packed()), *told])

    return materialize(training.mapInArrow(send, "g long, b binary").groupBy("g").applyInPandas(merge, MESSAGE), "restaurants")


def _first_sums(told: DataFrame) -> DataFrame:
    """Customers and first tables of the contexts each group has told of, and the places of these with their owner."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        owner, lists = int(rows["g"].iloc[0]), [unpack(b) for b in rows["b"]]
        contexts, place = np.unique(np.concatenate([a[0] for a in lists]), return_inverse=True)
        customers, tables = (np.bincount(place, np.concatenate([a[k] for a in lists]), len(contexts)).astype(np.int64) for k in (1, 2))
        out = []
        for group, own in zip(rows["other"], np.split(place, np.cumsum([len(a[0]) for a in lists])[:-1])):
            out += [(group, owner, 0, pack(customers[own], tables[own])), (owner, group, ASKED, pack(steps(own)))]
        return _messages(out)

    return materialize(told.groupBy("g").applyInPandas(add, MESSAGE), "contexts")


def _next_sums(asked: DataFrame, told: DataFrame, sweep: int) -> DataFrame:
    """Tables of the contexts each group has, summed by their owners after a sweep."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        owner, is_list = int(rows["g"].iloc[0]), rows["sweep"] == ASKED
        places = {o: np.cumsum(unpack(b)[0]) for o, b in zip(rows["other"][is_list], rows["b"][is_list])}
        sums = np.zeros(max(int(p[-1]) for p in places.values()) + 1, np.int64)
        for o, b in zip(rows["other"][~is_list], rows["b"][~is_list]):
            sums[places[o]] += unpack(b)[0]
        return _messages([(o, owner, sweep, pack(sums[p])) for o, p in places.items()])

    return materialize(asked.union(told).groupBy("g").applyInPandas(add, MESSAGE), "context-tables")


def _with_sums(model: Model, rows: pd.DataFrame) -> Restaurants:
    """A group's restaurants with the sums that owners have sent."""
    own = Restaurants.unpacked(next(iter(rows["b"][rows["sweep"] == RESTAURANT])))
    sent = {(o, k): unpack(b) for o, k, b in zip(rows["other"], rows["sweep"], rows["b"]) if k >= 0}
    own.customers_of = np.zeros(len(own.contexts), np.int64)
    own.tables_of = [np.zeros(len(own.contexts), np.int64) for _ in model.totals]  # of every sweep so far
    for owner, at in own.asked(model):
        for sweep, tables in enumerate(own.tables_of):
            own.customers_of[at] = sent[owner, 0][0]
            tables[at] = sent[owner, sweep][-1]
    return own


def _sweep(messages: DataFrame, model: Model, sweep: int) -> tuple[Totals, DataFrame]:
    """Seats all groups. Sums what they leave, at most 2 * CONTEXTS + 3 numbers, and what they tell owners."""
    shared = messages.sparkSession.sparkContext.broadcast(model)
    size = model.rare + 1 + len(model.words) + 2

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        model, g = shared.value, int(rows["g"].iloc[0])
        own = _with_sums(model, rows)
        *_, seating = own.sweeps(model, g, sweep)
        of = np.bincount(own.keys & _MASK, seating.tables, model.rare + 1) + np.bincount(own.frequent_keys & _MASK, seating.frequent_tables, model.rare + 1)
        n = len(model.words)
        frequent = np.bincount(own.frequent_keys >> _SHIFT, seating.frequent_tables, n) + np.bincount(own.after_keys >> _WIDE, seating.after_tables, n)
        sums = np.concatenate([of, frequent, [seating.customers.sum(), seating.root_tables.sum()]])
        at = np.flatnonzero(sums)
        out = [(g, g, SUMS, pack(at.astype("<i4"), sums[at].astype(np.int64)))]
        if sweep:  # the sums of sweep 0 are there already
            tables = own.of_contexts(seating.rare_tables, seating.after_tables)
            out += [(owner, g, sweep, pack(tables[at])) for owner, at in own.asked(model)]
        return _messages(out)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = np.zeros(size, np.int64)  # of all groups of the task
        for batch in batches:
            for blob in batch.column("b"):
                at, n = unpack(blob.as_py())
                added[at] += n
        at = np.flatnonzero(added)
        yield pa.record_batch({"at": pa.array(at, pa.int32()), "n": pa.array(added[at])})

    seated = materialize(messages.groupBy("g").applyInPandas(run, MESSAGE), "seated")
    added = seated.filter(F.col("sweep") == SUMS).select("b").mapInArrow(numbers, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(size)
    sums[added.column("at").to_numpy()] = added.column("n").to_numpy()
    tables_of, rest = sums[: model.rare], sums[model.rare + 1 :]
    frequent, (customers, tables) = rest[: len(model.words)].astype(np.int64), rest[len(model.words) :]
    if sweep:
        d, s = ROOT
        weight = (s + d * model.totals[-1].root_tables) / (model.known + 1)
        own_tables = seat(frequent, np.full(len(frequent), weight), d, np.random.Generator(np.random.Philox(key=[sweep, 2**63])))
    else:
        own_tables = np.minimum(frequent, 1)
    return Totals(tables_of, frequent, own_tables, customers + frequent.sum(), tables + own_tables.sum()), seated.filter(F.col("sweep") == sweep)


def _predict(model: Model, totals: Totals, counts, tables, context, parent) -> np.ndarray:
    """Predictive probability of dishes in contexts, given the parent's."""
    d, s = CONTEXT
    of = np.append(s + model.counts, 1.0)[context]
    seated = np.where(context == model.rare, 0.0, np.maximum(counts - d * tables, 0)) / of
    return seated + model.back_off(totals)[context] * parent


def _kept(model: Model, own: Restaurants, group: int) -> list[tuple[Totals, Seating]]:
    seatings = own.sweeps(model, group, SWEEPS)
    return list(zip(model.totals, seatings))[-KEPT:]


def _hot_pairs(restaurants: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Keys and probabilities of the pairs with 1 / CONTEXTS of all tokens or more: at most CONTEXTS."""
    shared = restaurants.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for g, blob in zip(batch.column("g").to_pylist(), batch.column("b")):
                own = Restaurants.unpacked(blob.as_py())
                hot = np.flatnonzero(own.frequent_counts * CONTEXTS >= model.tokens)
                if not len(hot):
                    continue
                keys, total = own.frequent_keys[hot], 0.0
                for totals, seating in _kept(model, own, g):
                    parent = totals.root(totals.frequent_customers, totals.frequent_tables, model.known)[keys >> _SHIFT]
                    total += _predict(model, totals, own.frequent_counts[hot], seating.frequent_tables[hot], keys & _MASK, parent)
                yield pa.record_batch({"k": pa.array(keys), "p": pa.array(total / KEPT)})

    found = restaurants.mapInArrow(run, "k long, p double").toArrow()
    keys, p = found.column("k").to_numpy(), found.column("p").to_numpy()
    order = np.argsort(keys)
    return keys[order], p[order]


def fit(training: DataFrame) -> tuple[Model, DataFrame]:
    """The bounded part of the model and the stored restaurants. training: column text."""
    model = _first_model(training)
    stored = _restaurants(training, model)
    own = stored.filter(F.col("sweep") == RESTAURANT)
    first = _first_sums(stored.filter(F.col("sweep") == ASKED))
    asked, messages = first.filter(F.col("sweep") == ASKED), own
    for sweep in range(SWEEPS + 1):
        totals, told = _sweep(messages, model, sweep)
        model.totals.append(totals)
        messages = messages.union(_next_sums(asked, told, sweep) if sweep else first.filter(F.col("sweep") == 0))
    shared = training.sparkSession.sparkContext.broadcast(model)

    def complete(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [rows["g"].iloc[0]], "b": [_with_sums(shared.value, rows).packed()]})

    restaurants = materialize(messages.groupBy("g").applyInPandas(complete, "g long, b binary"), "restaurants")
    model.hot_keys, model.hot_probability = _hot_pairs(restaurants, model)
    return model, restaurants


def _post(model: Model, piece: pa.RecordBatch, number: int) -> list[tuple[int, int, bytes]]:
    """(group, piece, blob): postings for groups, and the row of the piece itself with what is scored here.

    Postings of rare words: hashes, tokens of each, (context, text) of each token, after frequent
    and after rare contexts; of pairs of frequent words: (key, text); of frequent words after rare
    contexts: hashes of these, tokens of each, (word, text); rare contexts that are asked for.
    """
    tokens, word, context, before, text = _with_contexts(model, piece.column("text"))
    n = piece.num_rows
    rare, apart = word < 0, context == model.rare
    base = np.bincount(text[~rare], np.log10(model.counts[word[~rare]] + 1), n).astype(float)
    known = np.bincount(text[~rare], minlength=n)
    # Hot pairs have a stored probability.
    p, hot = np.zeros(len(tokens)), np.zeros(len(tokens), bool)
    if len(model.hot_keys):
        keys = (word << _SHIFT) | context
        at = np.minimum(np.searchsorted(model.hot_keys, keys), len(model.hot_keys) - 1)
        hot = ~rare & ~apart & (model.hot_keys[at] == keys)
        p[hot] = model.hot_probability[at[hot]]
        del keys, at
    score = np.bincount(text[hot], np.log10(p[hot]), n).astype(float)  # whole numbers if there is nothing to add
    ids = piece.column("doc_id")
    no_id, held_out = ids.is_null().to_numpy(zero_copy_only=False), piece.column("held_out").to_numpy(zero_copy_only=False)
    whole = pack(ids.fill_null(0).to_numpy(), no_id, held_out, np.bincount(text, minlength=n).astype("<u4"), known.astype("<u4"), base, score)
    rows = [(number % model.groups, number, b"W" + whole)]
    bits = max(1, int(n).bit_length())
    low = (1 << bits) - 1

    def postings(at: np.ndarray, head: np.ndarray, tail: np.ndarray, kind: str):
        """The group of each posting by its head; heads, how often each comes, and (tail, text) of each."""
        heads, place = np.unique(head[at], return_inverse=True)
        tails, of = np.unique(tail[at], return_inverse=True)
        wide = bits + max(1, len(tails).bit_length())
        keys = np.sort((place << wide) | (of << bits) | text[at])

        def take(at):
            own, each = _runs(keys[at] >> wide)
            return [heads[own], each, tails[(keys[at] & ((1 << wide) - 1)) >> bits].astype(kind), (keys[at] & low).astype("<u4")]

        return model.group_of_words(heads)[keys >> wide], take

    there = ~rare & ~apart & ~hot
    f_keys = np.sort((word[there] << (_SHIFT + bits)) | (context[there] << bits) | text[there])
    unlearnt = np.unique(before[rare & apart & (no_id | held_out)[text]])
    del p
    kinds = [
        postings(rare & ~apart, tokens, context, "<u4"),
        (model.group_of_pairs(f_keys >> (_SHIFT + bits), (f_keys >> bits) & _MASK), lambda at: [steps(f_keys[at] >> bits), (f_keys[at] & low).astype("<u4")]),
        postings(rare & apart, tokens, before, "<u8"),
        postings(~rare & apart, before, word, "<u4"),
        (model.group_of_words(unlearnt), lambda at: [unlearnt[at]]),
    ]
    del tokens, word, context, before, text, rare, apart, there, hot  # large, and not needed while lists are packed
    return rows + [(g, number, b"P" + b) for g, b in _to_groups(*kinds)]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is among the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _score_postings(model: Model, own: Restaurants, kept, blob: bytes) -> bytes:
    """(text, known, base, score) sums of a list of postings; (text, context, the root's probabilities)
    of rare words whose context is not here; (context, weights of the root) of the contexts asked for."""
    words, each, context, text, f_keys, f_text, r_words, r_each, r_before, r_text, a_before, a_each, a_word, a_text, asked = unpack(blob)
    f_keys, context, a_word = np.cumsum(f_keys), context.astype(np.int64), a_word.astype(np.int64)
    # Rare words: their counts are all in this group.
    count_of = np.bincount(own.keys >> _SHIFT, own.counts, max(1, len(own.words))) + np.bincount(own.rare_keys >> _WIDE, own.rare_counts, max(1, len(own.words)))

    def counted(words, each):
        place, there = _found(own.words, words)
        return np.repeat(place, each), np.repeat(there, each), np.repeat(np.where(there, count_of[place], 0), each)

    (word, is_known, counts), (r_word, r_known, r_counts) = counted(words, each), counted(r_words, r_each)
    at, paired = _found(own.keys, np.where(is_known, (word << _SHIFT) | context, -1))
    f_at, f_paired = _found(own.frequent_keys, f_keys)
    r_context, r_here = _found(own.contexts, r_before)
    r_at, r_paired = _found(own.rare_keys, np.where(r_known & r_here, (r_word << _WIDE) | r_context, -1))
    a_context, a_here = (np.repeat(x, a_each) for x in _found(own.contexts, a_before))
    a_at, a_paired = _found(own.after_keys, np.where(a_here, (a_word << _WIDE) | a_context, -1))
    asked_at, asked_here = _found(own.contexts, asked)
    take = lambda values, at, there, other=0: np.where(there, values[at], other) if len(values) else np.full(len(at), float(other))
    p, f_p, r_p, a_p = (np.zeros(len(t)) for t in (text, f_text, r_text, a_text))
    roots, weights = [], []
    d, s = CONTEXT
    for totals, seating in kept:
        parent = totals.root(take(seating.customers, word, is_known), take(seating.root_tables, word, is_known), model.known)
        p += _predict(model, totals, take(own.counts, at, paired), take(seating.tables, at, paired), context, parent)
        frequent = totals.root(totals.frequent_customers, totals.frequent_tables, model.known)
        if len(f_keys):
            f_p += _predict(model, totals, take(own.frequent_counts, f_at, f_paired), take(seating.frequent_tables, f_at, f_paired), f_keys & _MASK, frequent[f_keys >> _SHIFT])
        # After rare contexts; the root's weight is 1 where a context was never learnt.
        back_off, of = own.back_off(own.tables_of[seating.sweep]), s + own.customers_of
        parent = totals.root(take(seating.customers, r_word, r_known), take(seating.root_tables, r_word, r_known), model.known)
        seated = np.maximum(take(own.rare_counts, r_at, r_paired) - d * take(seating.rare_tables, r_at, r_paired), 0) / take(of, r_context, r_here, 1)
        r_p += seated + take(back_off, r_context, r_here, 1) * parent
        seated = np.maximum(take(own.after_counts, a_at, a_paired) - d * take(seating.after_tables, a_at, a_paired), 0) / take(of, a_context, a_here, 1)
        a_p += seated + take(back_off, a_context, a_here, 1) * frequent[a_word]
        roots.append(parent[~r_here])
        weights.append(take(back_off, asked_at, asked_here, 1))
    open_text, open_before = r_text[~r_here], r_before[~r_here]
    texts = np.concatenate([text, f_text, r_text[r_here], a_text]).astype(np.int64)
    n = int(max(texts.max(initial=0), open_text.max(initial=0))) + 1
    score = np.bincount(texts, np.log10(np.concatenate([p, f_p, r_p[r_here], a_p]) / KEPT), n)
    base = np.bincount(text, np.log10(counts + 1), n) + np.bincount(r_text, np.log10(r_counts + 1), n)
    known = np.bincount(text, is_known, n) + np.bincount(r_text, r_known, n)
    touched = np.flatnonzero((np.bincount(texts, minlength=n) + np.bincount(open_text, minlength=n)) > 0)
    return pack(steps(touched).astype("<u4"), known[touched].astype("<u4"), base[touched], score[touched], open_text, open_before, *roots, asked, *weights)


def score_documents(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    fold = fold_of(F.col("doc_id"), FOLDS)
    small_batches(documents, PIECE_BYTES)  # the larger a piece, the fewer times a word is sent
    model, restaurants = fit(documents.filter(fold != HELD_OUT).select("text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for k, piece in enumerate(pieces(batches, PIECE_BYTES)):
            rows = _post(shared.value, piece, first + k)
            yield pa.record_batch({"g": pa.array([r[0] for r in rows], pa.int64()), "piece": pa.array([r[1] for r in rows], pa.int64()), "b": pa.array([r[2] for r in rows], pa.binary())})

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        model, group = shared.value, int(rows["g"].iloc[0])
        own = Restaurants.unpacked(next(iter(rows["b"][rows["piece"].isna()]), None))
        kept = _kept(model, own, group)
        out = [(int(p), b if b[:1] == b"W" else b"P" + _score_postings(model, own, kept, b[1:])) for p, b in zip(rows["piece"], rows["b"]) if not pd.isna(p)]
        return pd.DataFrame({"piece": np.array([p for p, _ in out], np.int64), "b": [b for _, b in out]})

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        whole = next(b for b in rows["b"] if b[:1] == b"W")
        ids, no_id, held_out, tokens, known, base, total = (a.copy() for a in unpack(whole[1:]))
        apart, weighed = [], []
        for blob in sorted(b for b in rows["b"] if b[:1] == b"P"):
            at, more_known, more_base, more, *rest = unpack(blob[1:])
            apart.append(rest[: 2 + KEPT])
            weighed.append(rest[2 + KEPT :])
            at = np.cumsum(at.astype(np.int64))
            known[at] += more_known
            base[at] += more_base
            total[at] += more
        if apart:  # rare words and their contexts met in no group
            text, before, *roots = (np.concatenate(a) for a in zip(*apart))
            contexts, *weights = (np.concatenate(a) for a in zip(*weighed))
            order = np.argsort(contexts)
            at = order[np.searchsorted(contexts, before, sorter=order)] if len(before) else order[:0]
            total += np.bincount(text, np.log10(sum(r * w[at] for r, w in zip(roots, weights)) / KEPT), len(total))
        base -= tokens * math.log10(shared.value.tokens + shared.value.known + 1)
        frame = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": held_out, "n_tokens": tokens.astype(np.int64), "n_known": known.astype(np.int64), "train_tokens": shared.value.tokens, "base_score": base, "score": total})
        frame.loc[no_id, "doc_id"] = pd.NA
        return frame

    rows = documents.select("doc_id", "text", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"))
    postings = rows.mapInArrow(send, "g long, piece long, b binary")
    met = postings.union(restaurants.select("g", F.lit(None).cast("long").alias("piece"), "b"))
    scored = met.groupBy("g").applyInPandas(score, "piece long, b binary")
    return scored.groupBy("piece").applyInPandas(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
