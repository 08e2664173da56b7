"""Ranked lexical search with a length-stratified index.

A document's length enters its score through a whole number only, the normaliser m, so documents
of equal m form a stratum in which a term's impact follows from its tf alone. The index keeps for
every stratum, term and tf the list of documents: an impact is computed once for a list, not once
for a document. The largest impacts of an item's terms in a stratum add up to a bound of every score
there. Strata are visited in the order of their bounds: first the best ones of each item, whose
scores give a threshold, then those whose bound reaches it, each part of a stratum with a bound of its own.

A stratum with many words is dealt out into parts of about ``PART_TOKENS`` words by a hash of the
rows, so no list grows with the corpus, however many documents have one length. Items are taken
in blocks of at most ``BLOCK_TERMS`` terms, which is the bound of what is broadcast. Postings of
a block are stored once; a part is scored in one task with numpy, and gives its best rows for an
item only if they reach the threshold, so ``k`` rows of an item and part at most.

Terms are the runs of letters and digits (all that is not ASCII is a letter); only A-Z are
lower-cased. A null or empty text has no terms: such documents are not counted and never found,
such items have no rows. Rows with equal or null ids are documents of their own; equal scores are
ordered by doc_id, null first. Items that share an id are ranked apart, under the same id.
Columns beside ids and texts are not read. Without documents or items there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.text import Words, letters_and_digits, small_batches
from eventloom.session import materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed values of the score: weight scale, impact scale, tf and length factors, share of the length.
WEIGHT, IMPACT, TF, LENGTH, SHARE = 1000, 1_000_000_000, 1000, 20, 50
PART_TOKENS = 1 << 18
#: Distinct (item, term) pairs of one block of items.
BLOCK_TERMS = 100_000
#: Postings and scores of a part that are held at once, beside those of one item.
SCORES = 1 << 21
#: Strata of an item whose scores give the first threshold.
FIRST_STRATA = 24

POSTINGS = "m long, part int, term string, tf long, rows array<long>, doc_ids array<long>"
FOUND = "item long, doc_id long, score long, row long"


@dataclass(frozen=True)
class Index:
    """Stored postings (m, part, term, tf, rows, doc_ids), and how many documents have terms."""

    postings: DataFrame
    documents: int


def _terms_of(texts: pa.Array) -> tuple[Words, pa.DictionaryArray]:
    """The lower-cased terms of texts, exactly, as codes and dictionary."""
    words = Words(texts, letters_and_digits(), lower=True, hashed=False)
    lengths = words.ends - words.starts
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    data = words.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    terms = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data.tobytes()))
    return words, terms.dictionary_encode()


def _post(table: pa.Table) -> pa.Table:
    """Postings of one part of a stratum."""
    table = table.combine_chunks()
    words, terms = _terms_of(table.column("text").combine_chunks())
    n = len(words)
    pair, tf = np.unique(terms.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + words.owner(), return_counts=True)
    order = np.lexsort((pair % n, tf, pair // n))
    term, tf, doc = (pair // n)[order], tf[order], (pair % n)[order]
    starts = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(tf) != 0))) if len(term) else np.empty(0, np.int64)
    ids = table.column("doc_id").combine_chunks().take(pa.array(doc))
    offsets = pa.array(np.append(starts, len(doc)).astype(np.int32))
    names = ["m", "part", "term", "tf", "rows", "doc_ids"]
    head = table.slice(0, 1).to_pylist()[0]
    columns = [
        pa.array(np.full(len(starts), head["m"], np.int64)),
        pa.array(np.full(len(starts), head["part"], np.int32)),
        terms.dictionary.take(pa.array(term[starts])).cast(pa.string()),
        pa.array(tf[starts].astype(np.int64)),
        pa.ListArray.from_arrays(offsets, pa.array(table.column("row").combine_chunks().to_numpy()[doc])),
        pa.ListArray.from_arrays(offsets, ids),
    ]
    return pa.table(columns, names)


def _lengths(texts: pa.Array) -> np.ndarray:
    """How many terms each text has."""
    return np.diff(Words(texts, letters_and_digits(), lower=True, hashed=False).first)


@F.arrow_udf(T.LongType())
def _length(texts: pa.Array) -> pa.Array:
    return pa.array(_lengths(texts), pa.int64())


def _normaliser(documents: int, tokens: int):
    @F.arrow_udf(T.LongType())
    def normaliser(texts: pa.Array) -> pa.Array:
        return pa.array([100 - SHARE + SHARE * n * documents // tokens if n else 0 for n in _lengths(texts).tolist()], pa.int64())

    return normaliser


def build_index(documents: DataFrame, text: str = "text", part_tokens: int = PART_TOKENS) -> Index:
    """Index of all documents that have terms."""
    texts = small_batches(documents).select("doc_id", F.col(text).alias("text"))
    lengths = materialize(texts.groupBy(_length("text").alias("n")).agg(F.count("*").alias("documents")).filter("n > 0"), "search-lengths")
    row = lengths.agg(F.sum("documents").alias("documents"), F.sum(F.col("n") * F.col("documents")).alias("tokens")).first()
    count, tokens = int(row.documents or 0), int(row.tokens or 0)
    strata = lengths.groupBy(F.expr(f"{100 - SHARE} + ({SHARE} * n * {count}L) div {max(tokens, 1)}L").cast("long").alias("m"))
    parts = strata.agg(F.ceil(F.sum(F.col("n") * F.col("documents")) / part_tokens).cast("int").alias("parts"))
    numbered = texts.select("*", _normaliser(count, max(tokens, 1))("text").alias("m"), F.monotonically_increasing_id().alias("row"))
    # Texts without terms have no stratum.
    dealt = numbered.join(F.broadcast(parts) if lengths.count() <= 1_000_000 else parts, "m")
    dealt = dealt.select("m", F.pmod(F.xxhash64("row"), "parts").cast("int").alias("part"), "row", "doc_id", "text")
    postings = dealt.groupBy("m", "part").applyInArrow(_post, POSTINGS)
    return Index(materialize(postings, "search-postings"), count)


def item_terms(items: DataFrame, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, terms): the distinct terms of every item that has some."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select(F.col(id_column).alias("item_id"), F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("terms"))
    return terms.filter(F.size("terms") > 0)


def _blocks(items: DataFrame, block_terms: int) -> Iterator[tuple[DataFrame, pa.Table]]:
    """Items in blocks of bounded size: as a table, and collected."""
    sized = materialize(items.select("*", F.monotonically_increasing_id().alias("item")), "search-items")
    total = sized.agg(F.sum(F.size("terms")).alias("n")).first().n or 0
    blocks = -(-total // block_terms)
    for block in range(blocks):
        mine = sized.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else sized
        yield mine, mine.select("item", "terms").orderBy("item").toArrow()


class Queries:
    """A block of items, ready to be scored: terms with weights, and the items that have them."""

    def __init__(self, items: np.ndarray, terms: pa.Array, weights: np.ndarray, term_of: np.ndarray, item_of: np.ndarray, threshold: np.ndarray, visits: dict[int, np.ndarray] | None):
        self.items, self.terms, self.weights, self.term_of, self.item_of = items, terms, weights, term_of, item_of
        self.threshold, self.visits = threshold, visits

    def score(self, table: pa.Table, k: int) -> pa.Table:
        """The best ``k`` rows of each item in a part of a stratum, if they reach its threshold."""
        found = {"item": [], "doc_id": [], "score": [], "row": []}
        table = table.combine_chunks()
        m = table.column("m")[0].as_py()
        rows = table.column("rows").combine_chunks()
        sizes = rows.value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        row_ids, doc = np.unique(rows.flatten().to_numpy(), return_inverse=True)
        id_at = np.empty(len(row_ids), np.int64)
        id_at[doc] = np.arange(len(doc))
        doc_ids = table.column("doc_ids").combine_chunks().flatten().take(pa.array(id_at))
        term = pc.index_in(table.column("term").combine_chunks(), value_set=self.terms).to_numpy(zero_copy_only=False).astype(np.int64)
        tf = table.column("tf").to_numpy()
        impact = self.weights[term] * ((IMPACT * tf) // (TF * tf + LENGTH * m))
        most = np.zeros(len(self.terms), np.int64)
        np.maximum.at(most, term, impact)
        bound = np.zeros(len(self.items), np.int64)
        np.add.at(bound, self.item_of, most[self.term_of])
        wanted = (bound > 0) & (bound >= self.threshold)
        if self.visits is not None:
            mine = np.zeros(len(self.items), bool)
            mine[self.visits.get(m, np.empty(0, np.int64))] = True
            wanted &= mine
        # The postings in the order of terms, so that those of a term stand together.
        by_term = np.argsort(term, kind="stable")
        lists = np.repeat(by_term, sizes[by_term])
        into = np.arange(len(lists)) - np.repeat(np.cumsum(sizes[by_term]) - sizes[by_term], sizes[by_term])
        doc, impact = doc[(ends - sizes)[lists] + into], impact[lists]
        first = np.searchsorted(term[lists], np.arange(len(self.terms) + 1))
        pairs = np.flatnonzero(wanted[self.item_of] & (np.diff(first)[self.term_of] > 0))
        item, lengths = self.item_of[pairs], np.diff(first)[self.term_of[pairs]]
        # Items are sorted; so many at once that their postings and scores stay few.
        items, cuts = np.unique(item, return_index=True)
        load = np.add.reduceat(lengths, cuts) + len(row_ids) if len(items) else lengths
        group = np.cumsum(load) // SCORES
        for part in np.unique(group):
            mine = items[group == part]
            of_part = (item >= mine[0]) & (item <= mine[-1])
            n = lengths[of_part]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[self.term_of[pairs[of_part]]], n)
            score = np.zeros((len(mine), len(row_ids)), np.int64)
            np.add.at(score.reshape(-1), np.repeat(np.searchsorted(mine, item[of_part]), n) * len(row_ids) + doc[at], impact[at])
            hit = (score > 0) & (score >= self.threshold[mine][:, None])
            for i in np.flatnonzero(hit.sum(axis=1) > k):
                hit[i] &= _top(score[i], hit[i], doc_ids, k)
            who, where = np.nonzero(hit)
            for name, values in (("item", self.items[mine][who]), ("doc_id", doc_ids.take(pa.array(where))), ("score", score[who, where]), ("row", row_ids[where])):
                found[name].append(pa.array(values, pa.int64()))
        return pa.table({name: pa.concat_arrays(parts) if parts else pa.array([], pa.int64()) for name, parts in found.items()})


def _top(score: np.ndarray, hit: np.ndarray, doc_ids: pa.Array, k: int) -> np.ndarray:
    """Which ``k`` of the hits are best; equal scores by id, null first."""
    hits = np.flatnonzero(hit)
    least = -np.partition(-score[hits], k - 1)[k - 1]
    hits = hits[score[hits] >= least]
    table = pa.table({"score": score[hits], "id": doc_ids.take(pa.array(hits)), "place": hits})
    # A stable place for null and equal ids: rows are in the order of their numbers.
    best = table.append_column("known", pc.is_valid(table.column("id"))).sort_by([("score", "descending"), ("known", "ascending"), ("id", "ascending"), ("place", "ascending")])
    top = np.zeros(len(score), bool)
    top[best.column("place").to_numpy()[:k]] = True
    return top


def _score(hits: DataFrame, queries: Queries, k: int) -> DataFrame:
    return hits.groupBy("m", "part").applyInArrow(lambda table: queries.score(table, k), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    ranks = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "row"))
    return found.withColumn("rank", ranks).filter(F.col("rank") <= k)


def _bounds(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(item, m, bound) of the strata in which an item can score."""
    most = hits.groupBy("m", "term").agg(F.max("tf").alias("tf"))
    impact = F.expr(f"w * (({IMPACT}L * tf) div ({TF}L * tf + {LENGTH}L * m))")
    return most.join(F.broadcast(pairs), "term").groupBy("item", "m").agg(F.sum(impact).alias("bound")).filter("bound > 0")


def _search_block(index: Index, block: pa.Table, spark, k: int, first_strata: int) -> DataFrame:
    lists = block.column("terms").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    terms, term_of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    item_of = np.repeat(np.arange(block.num_rows), lists.value_lengths().to_numpy())
    wanted = F.broadcast(spark.createDataFrame(pa.table({"term": terms.cast(pa.string())})))
    hits = materialize(index.postings.join(wanted, "term", "left_semi"), "search-hits")
    found = hits.groupBy("term").agg(F.sum(F.size("rows")).alias("df")).toArrow()  # at most BLOCK_TERMS rows
    df = np.zeros(len(terms), np.int64)
    at = pc.index_in(found.column("term"), value_set=terms.cast(found.schema.field("term").type)).to_numpy().astype(np.int64)
    df[at] = found.column("df").to_numpy()
    weights = np.floor(WEIGHT * np.log((2.0 * index.documents + 2.0) / (2.0 * df + 1.0))).astype(np.int64)
    items = block.column("item").to_numpy()
    queries = Queries(items, terms.cast(pa.string()), weights, term_of, item_of, np.zeros(len(items), np.int64), None)
    pairs = spark.createDataFrame(pa.table({"item": item_of, "term": terms.cast(pa.string()).take(pa.array(term_of)), "w": weights[term_of]}))
    order = W.partitionBy("item").orderBy(F.desc("bound"), "m")
    first = _bounds(hits, pairs).withColumn("visit", F.row_number().over(order)).filter(F.col("visit") <= first_strata).select("item", "m").toArrow()  # first_strata rows an item
    visits: dict[int, np.ndarray] = {}
    m, who = first.column("m").to_numpy(), first.column("item").to_numpy()
    for stratum in np.unique(m):
        visits[int(stratum)] = who[m == stratum]
    queries.visits = visits
    strata = spark.createDataFrame([(x,) for x in visits], "m long")
    best = materialize(_best(_score(hits.join(F.broadcast(strata), "m", "left_semi"), queries, k), k), "search-first")
    # The k-th best of the first strata is a score that the others must reach.
    kth = best.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).toArrow()
    rest = Queries(items, queries.terms, weights, term_of, item_of, np.zeros(len(items), np.int64), None)
    rest.threshold[np.searchsorted(items, kth.column("item").to_numpy())] = kth.column("least").to_numpy()
    return _best(_score(hits, rest, k), k)


def search(index: Index, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS, first_strata: int = FIRST_STRATA) -> DataFrame:
    """The ``k`` best documents of every item, exactly: (item_id, rank, doc_id, score)."""
    spark = items.sparkSession
    results = None
    for mine, block in _blocks(items, block_terms):
        found = _search_block(index, block, spark, k, first_strata)
        named = found.join(F.broadcast(mine.select("item", "item_id")), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        results = named if results is None else results.union(named)
    if results is None:
        return spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id long, score long")
    return results


def search_documents(documents: DataFrame, items: DataFrame, k: int = 50, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """Builds the index of ``documents`` and ranks them for every item of ``items``."""
    return search(build_index(documents, text), item_terms(items, id_column, text), k)
