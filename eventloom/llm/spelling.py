"""Spelling variants of the words of all texts, grouped by exact PartEnum signatures.

A word's letters are a multiset, and a multiset is a binary vector with a dimension for the k-th
occurrence of a letter. One inserted, deleted or replaced letter changes at most ``DISTANCE`` = 2
dimensions. The dimensions are split into partitions of two levels: of ``first`` outer partitions
one has at most DISTANCE // first changes, and of its ``second`` inner ones all but so many are
untouched. A signature is the vector without a choice of that many inner partitions; the choices
are enumerated, so near words share a signature, whatever was changed. One change also leaves the
first or the second half of the shorter word as it was: a signature carries one of the halves
and the shorter length, so that few words share one that are not near. Words with equal signatures meet in
an equi-join whose condition verifies the distance; no other pair becomes a row, and Spark splits
hot signatures, as both sides are plain shuffles. All of it is DataFrame expressions.

Words are counted before they are compared: the join's size follows the distinct words, and a
frequent word is one row. Null texts have no words, a null doc_id counts as an empty one, repeated
rows count each, further columns are not read; a table without words gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LEAST, SHARE = 7, 2, 10
#: Of so many runs, one loses a letter before it is counted.
DROP_EVERY = 31
#: Changed dimensions of the letter vectors of near words; outer and inner partitions.
DISTANCE, FIRST, SECOND = 2, 1, 5


def counted_words(documents: DataFrame, shortest: int = SHORTEST, least: int = LEAST, drop_every: int = DROP_EVERY, text: str = "text") -> DataFrame:
    """(word, n) of the words with ``shortest`` letters or more that occur ``least`` times or more.

    A run whose crc32 with its document's id is divisible by ``drop_every`` loses one letter first.
    """
    # A shorter run can not become a word, as letters are only dropped.
    pattern = rf"[A-Za-zÀ-ÿ]{{{shortest},}}"
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.filter(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least)


def _projection(letters: Column, first: int, second: int, outer: int, gone: tuple[int, ...]) -> Column:
    """The letters of one outer partition without some of its inner ones."""

    def kept(letter: Column) -> Column:
        code = F.ascii(letter)
        inner = F.floor(code / first).cast("int") % second
        return (code % first == outer) & ~inner.isin(*gone) if gone else code % first == outer

    return F.array_join(F.filter(letters, kept), "")


def signatures(words: DataFrame, first: int = FIRST, second: int = SECOND, distance: int = DISTANCE) -> DataFrame:
    """(word, n, longer, signature): as one of two words of equal length, or as the longer one."""
    changes = distance // first
    if second <= changes:
        raise ValueError("an outer partition needs more inner ones than it may have changes")
    letters = words.withColumn("letters", F.array_sort(F.split("word", "")))
    choices = [(outer, gone) for outer in range(first) for gone in combinations(range(second), changes)]
    parts = F.array(*(F.xxhash64(F.lit(i), _projection(F.col("letters"), first, second, *choice)) for i, choice in enumerate(choices)))
    lengths = F.char_length("word")
    roles = letters.select("word", "n", parts.alias("parts"), F.explode(F.array(F.struct(lengths.alias("m"), F.lit(False).alias("longer")), F.struct((lengths - 1).alias("m"), F.lit(True).alias("longer")))).alias("role"))
    half = F.floor(F.col("role.m") / 2).cast("int")
    begin = F.xxhash64(F.lit(0), "role.m", F.substring("word", F.lit(1), half))
    end = F.xxhash64(F.lit(1), "role.m", F.expr("right(word, role.m - cast(floor(role.m / 2) as int))"))
    halves = roles.select("word", "n", "role.longer", "parts", F.explode(F.array(begin, end)).alias("half"))
    return halves.select("word", "n", "longer", F.explode(F.transform("parts", lambda p: F.xxhash64(p, "half"))).alias("signature"))


def near_words(words: DataFrame, first: int = FIRST, second: int = SECOND) -> DataFrame:
    """(word, n, other, other_n), both ways, of all words that differ by exactly one code point."""
    signed = signatures(words, first, second)
    a, b = signed.alias("a"), signed.alias("b")
    same = (F.col("a.signature") == F.col("b.signature")) & (F.col("a.word") < F.col("b.word")) & ~(F.col("a.longer") & F.col("b.longer"))
    pairs = a.join(b, same & (F.levenshtein("a.word", "b.word", 1) == 1)).select(F.col("a.word").alias("x"), F.col("a.n").alias("x_n"), F.col("b.word").alias("y"), F.col("b.n").alias("y_n")).distinct()
    ways = F.array(F.struct(F.col("x").alias("word"), F.col("x_n").alias("n"), F.col("y").alias("other"), F.col("y_n").alias("other_n")), F.struct(F.col("y").alias("word"), F.col("y_n").alias("n"), F.col("x").alias("other"), F.col("x_n").alias("other_n")))
    return pairs.select(F.inline(ways))


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by doubling the steps.

    A form is ``SHARE`` times as frequent as its word, so chains have no circles and a length
    logarithmic in the counts; two or three rounds end them.
    """
    steps = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if steps.join(further, "root", "left_semi").isEmpty():
            return steps
        steps = materialize(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def group_spellings(documents: DataFrame, shortest: int = SHORTEST, least: int = LEAST, share: int = SHARE, drop_every: int = DROP_EVERY, text: str = "text") -> DataFrame:
    """One row per word: (word, n, n_near, form, form_n, root).

    The form is the most frequent near word (the first of equals) that is ``share`` times as
    frequent as the word or more; the root is the last of the forms that follow one another.
    """
    words = materialize(counted_words(documents, shortest, least, drop_every, text), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus_n"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = materialize(near, "spelling-near")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best", (-F.col("best.minus_n") >= share * F.col("n")).alias("has_form"))
    formed = materialize(joined.select("word", "n", "n_near", F.when(F.col("has_form"), F.col("best.form")).alias("form"), F.when(F.col("has_form"), -F.col("best.minus_n")).alias("form_n")), "spelling-forms")
    roots = _rooted(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
