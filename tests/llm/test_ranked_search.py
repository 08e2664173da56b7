import math
import re
from collections import Counter

from eventloom.llm import ranked_search as R
from tests.llm.helpers import documents, rows_of

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return WORDS.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    big_n, big_l = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for place, (i, c) in enumerate(counted):
            m = 50 + 50 * sum(c.values()) * big_n // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0, place))
        out += [(item, rank, i if known else None, -s) for rank, (s, known, i, _) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, term string, m int")


DOCS = [
    (1, "The Cat sat on the mat"), (2, "the dog"), (3, None), (4, ""), (5, "cat cat cat"), (6, "Straße ÉCLAIR éclair"), (7, "a_b-c a.b"), (None, "cat mat"), (None, "cat mat"),
    (9, "cat mat"), (8, "cat mat"), (2, "the dog"), (10, "w " * 3000 + "cat"), (11, "\x00cat mat"), (12, "..., !"),
]
ITEMS = [(1, "cat mat"), (2, "THE the dog"), (3, None), (4, ""), (5, "nowhere"), (6, "Éclair éclair straße"), (7, "w a b"), (7, "cat"), (None, "mat")]


def test_ranks_equal_brute_force(spark):
    docs = documents(spark, DOCS, extra=("m", "part", "term", "row"))
    items = items_of(spark, [(*row, "x", 1) for row in ITEMS])
    for k in (2, 50):
        got = rows_of(R.search_documents(docs, items, k), "item_id", "rank", "doc_id", "score")
        assert got == brute(DOCS, ITEMS, k)


def test_parts_blocks_and_visits_do_not_change_ranks(spark):
    docs = [(i, " ".join(f"t{(i * j) % 37}" for j in range(1, 4 + i % 9))) for i in range(300)]
    items = [(i, f"t{i} t{i + 1} t{(3 * i) % 37}") for i in range(12)]
    index = R.build_index(documents(spark, docs), part_tokens=40)
    assert index.postings.select("m", "part").distinct().count() > index.postings.select("m").distinct().count()
    wanted = R.item_terms(items_of(spark, [(*row, "x", 1) for row in items]))
    got = rows_of(R.search(index, wanted, 5, block_terms=10, first_strata=1), "item_id", "rank", "doc_id", "score")
    assert got == brute(docs, items, 5)


def test_many_copies_are_ordered_by_id(spark):
    docs = [(900 - i, "same words here") for i in range(400)] + [(2000, "same"), (2001, "other")]
    got = rows_of(R.search_documents(documents(spark, docs), items_of(spark, [(1, "same words", "x", 1)]), 50), "item_id", "rank", "doc_id", "score")
    assert got == brute(docs, [(1, "same words")], 50) and {r[2] for r in got if r[1] > 1} <= set(range(501, 552)) | {2000}


def test_empty_tables(spark):
    none, some = documents(spark, []), documents(spark, DOCS)
    items = items_of(spark, [(1, "cat", "x", 1)])
    assert R.search_documents(none, items).collect() == []
    assert R.search_documents(some, items.limit(0)).collect() == []
    assert R.search_documents(some, items_of(spark, [(1, None, "x", 1)])).collect() == []
