"""Personal data in texts: certain forms by pattern, further ones by a conditional random field.

The patterns find addresses, host numbers, cards and phones in their usual form. The rest (an
address spelt "name [at] host [dot] org", a phone without its country, two cards in a row, a
number with other separators) is found by a linear-chain conditional random field over the shapes of
words: digits by their number, letters by case and length, marks as they are, the gaps between, and
the words that its labelled table uses often. The table is small (``labelled_table`` makes one from
sentence forms; another can be given) and read to the driver up to ``MOST_LABELLED`` rows; the model
is fitted there by gradient steps and goes to the tasks as arrays.

Labels further than ``REACH`` code points from a digit or an at sign are nothing by definition, so
a text falls into stretches that are decoded apart: Viterbi runs over all stretches of an
Arrow batch at once, step by step. What the chain reports must still have the digits of its kind and may not
overlap a certain span. Every pattern takes time linear in the text, whatever it holds.

Spans are code points, end exclusive. A null text counts as empty; null and repeated doc_ids and
further columns of any name do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.text import small_batches

#: Kinds by pattern, then those of the model, in the order in which spans of one start are listed.
BASE_KINDS = ["email", "ip", "card", "phone"]
MODEL_KINDS = [f"likely_{kind}" for kind in BASE_KINDS]
REACH = 64
MOST_LABELLED = 5_000

AT, LOCAL = re.compile("@"), re.compile(r"[A-Za-z0-9._%+-]+$")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive parts and the look behind keep long runs of digits linear; no match could start inside one.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NO_DIGITS = re.compile("[^0-9]+")
ANCHOR = re.compile(r"[0-9@]+|[\[(<{] ?(?:at|AT) ?[\])>}]")
TOKEN = re.compile(r"[A-Za-zÀ-ɏ]+|[0-9]+|[^\sA-Za-z0-9À-ɏ]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost spans of each kind that do not overlap; a match that fails its test is dropped."""
    spans: list[Span] = []
    before = 0
    for at in AT.finditer(text):
        start = at.start()
        while start > before and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at.start() and (host := HOST.match(text, at.end())):
            spans.append(("email", start, host.end()))
            before = host.end()
        else:
            before = max(before, at.end())
    if not DIGIT.search(text):
        return spans
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() < 40 and 14 <= len(digits := NO_DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(NO_DIGITS.sub("", m[0])) <= 15]
    return spans


# Labelled sentences


def _word(rng: random.Random) -> str:
    # Syllables of filler words.
    word = "".join(rng.choice(["an", "en", "the", "tion", "er", "ou", "st", "è", "ü", "ci", "ñ", "que", "la", "sch", "re", "i", "Mo", "s"]) for _ in range(rng.randint(1, 4)))
    return word.capitalize() if rng.random() < 0.15 else word


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card_digits(rng: random.Random) -> str:
    stem = rng.choice("3456") + _digits(rng, 14)
    return next(stem + d for d in "0123456789" if luhn(stem + d))


def _personal(rng: random.Random) -> tuple[str, str]:
    """A kind and a form of it."""
    d, kind = lambda n: _digits(rng, n), rng.choice(BASE_KINDS)
    if kind == "email":
        name = rng.choice([_word(rng), f"{_word(rng)}.{_word(rng)}", f"{_word(rng)}{d(2)}", f"{_word(rng)}_{_word(rng)}", f"{_word(rng)}.{d(2)}"])
        host, end = rng.choice([_word(rng), f"mail{d(1)}.{_word(rng)}"]), rng.choice(["com", "org", "net", "de", "fr"])
        opening, closing = rng.choice(["[]", "()", "{}"])
        at = rng.choice(["@", "@", f" {opening}at{closing} ", f"{opening}at{closing}", " @ "])
        dot = "." if at == "@" else rng.choice([".", f" {opening}dot{closing} ", f"{opening}dot{closing}"])
        return kind, f"{name}{at}{host.replace('.', dot)}{dot}{end}"
    if kind == "ip":
        dot = rng.choice([".", ".", " . ", "[.]"])
        return kind, dot.join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        digits = _card_digits(rng)
        gap = rng.choice(["", "", " ", "-", ".", "  "])
        return kind, gap.join(digits[i : i + 4] for i in range(0, 16, 4))
    a, b, c = d(3), d(3), d(4)
    return kind, rng.choice([f"+{d(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d(2)} {d(2)} {c} {d(4)}", f"00{d(2)} {d(2)} {c}{b}", f"+{d(1)}.{a}.{b}.{c}", f"{a}/{b}-{c}"])


def _other(rng: random.Random) -> str:
    """Numbers and signs that are nobody's."""
    d = lambda n: _digits(rng, n)
    many = d(rng.randint(1, 9))
    return rng.choice(
        [f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(1)},{d(3)}.{d(2)}", many, many, f"{d(2)}%", f"v{d(1)}.{d(1)}", f"{d(2)} {d(2)}", f"{d(rng.randint(20, 30))}",
         f"{d(8)}-{d(4)}-{d(4)}", f"@{_word(rng)}", f"{_word(rng)}{d(3)}", f"({d(4)})", f"{d(2)}/{d(2)}/{d(4)}", f"${d(3)}.{d(2)}", f"[{d(2)}]", f"{d(1)} @ {d(2)}", f"{d(4)}-{d(4)}", f"{d(3)}-{d(2)}", f"{d(2)}.{d(2)}.{d(4)}"]
    )


def labelled_sentences(rows: int = 900, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Sentences with the spans of what is personal in them, from forms and a seed."""
    rng, out = random.Random(seed), []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(_word(rng) for _ in range(rng.randint(0, 4)))
            text += rng.choice([" ", " ", ": ", " (", ", ", " | "]) if text else ""
            if rng.random() < 0.55:
                kind, form = _personal(rng)
                if kind != "email":
                    text += rng.choice(["", "", "", {"phone": "phone: ", "card": "card ", "ip": "host "}[kind]])
                spans.append((kind, len(text), len(text) + len(form)))
                text += form
            elif rng.random() < 0.7:
                text += _other(rng)
            text += rng.choice([" ", " ", ". ", ", ", ") "])
        out.append((text, spans))
    return out


def labelled_table(spark: SparkSession, rows: int = 900, seed: int = 11) -> DataFrame:
    """(text, spans): a small labelled table of sentences."""
    return spark.createDataFrame(labelled_sentences(rows, seed), T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", SPANS)]))


# Stretches, tokens, features


def stretches(text: str, reach: int = REACH) -> Iterator[tuple[int, int]]:
    """The parts of a text within ``reach`` of a digit or an at sign."""
    start = end = -1
    for m in ANCHOR.finditer(text):
        low, high = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if low <= end:
            end = high
        else:
            if end >= 0:
                yield start, end
            start, end = low, high
    if end >= 0:
        yield start, end


def _shape(token: str) -> str:
    n = len(token)
    if token[0].isdigit() and token.isascii():
        if n <= 3:
            return f"o{n}" if int(token) <= 255 else "d3"
        if 13 <= n <= 19:
            return "luhn" if luhn(token) else "long"
        return f"d{n}" if n <= 12 else "d20"
    if token[0].isalpha():
        return f"{'A' if token[0].isupper() else 'a'}{min(n, 5)}"
    return token if token.isascii() else "mark"


def _tokens(text: str, start: int, end: int, shapes: dict[str, str]) -> list[tuple[str, str, str, int, int]]:
    """(shape, word, gap before, start, end) of each token."""
    out, before = [], start
    for m in TOKEN.finditer(text, start, end):
        token, (a, b) = m[0], m.span()
        shape = shapes.get(token)
        if shape is None:
            if len(shapes) > 100_000:
                shapes.clear()
            shape = shapes[token] = _shape(token)
        gap = "" if a == before else "_" if a == before + 1 else "="
        out.append((shape, token.lower() if shape[0] in "aA" and len(token) < 8 else "", gap, a, b))
        before = b
    return out


_EDGE = ("^", "", "^", 0, 0)


def _contexts(tokens: Sequence[tuple]) -> list[tuple]:
    """What the features of each token are made of."""
    t = [_EDGE, _EDGE, _EDGE, *tokens, _EDGE, _EDGE, _EDGE]
    return [
        (t[i - 3][0], t[i - 2][0], t[i - 1][0], t[i][0], t[i + 1][0], t[i + 2][0], t[i + 3][0], t[i - 1][2], t[i][2], t[i + 1][2], t[i + 2][2], t[i - 1][1], t[i][1], t[i + 1][1])
        for i in range(3, len(t) - 3)
    ]


def _features(c: tuple) -> list[str]:
    s3, s2, s1, s, n1, n2, n3, h1, g, g1, g2, w1, w, v1 = c
    return [
        "1", f"s{s}", f"g{g}{s}", f"p{s1}{g}{s}", f"n{s}{g1}{n1}", f"P{s2}{h1}{s1}{g}{s}", f"N{s}{g1}{n1}{g2}{n2}", f"m{s1}{g}{s}{g1}{n1}",
        f"Q{s3}|{s2}|{s1}|{s}", f"R{s}|{n1}|{n2}|{n3}", f"M{s2}|{s1}|{s}|{n1}|{n2}", f"w{w}", f"W{w1}", f"V{v1}",
    ]


# The chain


class Chain:
    """A fitted linear chain: tags are 0 for nothing, 2k + 1 where kind k begins, 2k + 2 inside."""

    def __init__(self, ids: dict[str, int], weights: np.ndarray, moves: np.ndarray, first: np.ndarray):
        self.ids, self.weights, self.moves, self.first = ids, weights, moves, first
        self._seen: dict[tuple, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}}

    def emissions(self, contexts: Sequence[tuple]) -> np.ndarray:
        """Score of each tag for each token."""
        out = np.empty((len(contexts), self.weights.shape[1]))
        for i, context in enumerate(contexts):
            row = self._seen.get(context)
            if row is None:
                if len(self._seen) > 50_000:
                    self._seen.clear()
                found = [self.ids[f] for f in _features(context) if f in self.ids]
                row = self._seen[context] = self.weights[found].sum(axis=0)
            out[i] = row
        return out

    def decode(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tags of stretches that stand one after another (Viterbi)."""
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        back = np.zeros(emissions.shape, np.int8)
        last = np.zeros(emissions.shape)
        active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0] if len(lengths) else 0), "right")
        for t, n in enumerate(active):
            at = starts[:n] + t
            if t == 0:
                last[at] = self.first + emissions[at]
                continue
            score = last[at - 1][:, :, None] + self.moves
            back[at] = score.argmax(axis=1)
            last[at] = score.max(axis=1) + emissions[at]
        tags = np.zeros(len(emissions), np.int8)
        ends = starts + lengths - 1
        tags[ends] = last[ends].argmax(axis=1)
        for t in range(len(active) - 1, 0, -1):
            at = starts[: active[t]] + t
            tags[at - 1] = back[at, tags[at]]
        return tags


def _tags(tokens: Sequence[tuple], spans: Sequence[Span]) -> list[int]:
    tags = []
    for _, _, _, start, end in tokens:
        tag = 0
        for kind, low, high in spans:
            if low <= start and end <= high:
                tag = 2 * BASE_KINDS.index(kind) + (1 if start == low else 2)
        tags.append(tag)
    return tags


def _allowed(tags: int) -> np.ndarray:
    """Inside a kind comes only after its begin or inside."""
    before, after = np.arange(tags)[:, None], np.arange(tags)[None, :]
    inside = (after > 0) & (after % 2 == 0)
    return ~inside | (before == after) | (before == after - 1)


def fit_chain(labelled: DataFrame, steps: int = 100, rate: float = 0.15, penalty: float = 1e-4) -> Chain:
    """Most likely weights on a labelled table (text, spans) of at most ``MOST_LABELLED`` rows."""
    rows = labelled.orderBy("text").limit(MOST_LABELLED).collect()
    return _fit([(r.text or "", [tuple(s) for s in r.spans or []]) for r in rows], steps, rate, penalty)


def _fit(sentences: Sequence[tuple[str, list[Span]]], steps: int, rate: float, penalty: float) -> Chain:
    tokens = [_tokens(text, 0, len(text), {}) for text, _ in sentences]
    gold = [_tags(t, spans) for t, (_, spans) in zip(tokens, sentences)]
    kept = sorted((i for i, t in enumerate(tokens) if t), key=lambda i: -len(tokens[i]))
    contexts = [_contexts(tokens[i]) for i in kept]
    ids: dict[str, int] = {}
    features = [[[ids.setdefault(f, len(ids)) for f in _features(c)] for c in cs] for cs in contexts]
    longest, n, tags = max(map(len, features)), len(features), 2 * len(BASE_KINDS) + 1
    width, lengths = len(features[0][0]), np.array([len(f) for f in features])
    x = np.full((longest, n, width), len(ids))
    y = np.zeros((longest, n), np.int64)
    real = np.zeros((longest, n), bool)
    for i, (sentence, k) in enumerate(zip(features, kept)):
        x[: len(sentence), i], y[: len(sentence), i], real[: len(sentence), i] = sentence, gold[k], True
    weights, moves, first = np.zeros((len(ids) + 1, tags)), np.zeros((tags, tags)), np.zeros(tags)
    barred, barred_first = np.where(_allowed(tags), 0, -1e4), np.where((np.arange(tags) > 0) & (np.arange(tags) % 2 == 0), -1e4, 0)
    flat, total = x[real].reshape(-1), real.sum()
    columns = list(x[real].T)
    order = np.argsort(flat, kind="stable")
    used, cuts = np.unique(flat[order], return_index=True)
    token_of = (np.arange(len(flat)) // width)[order]
    one_hot = np.eye(tags)
    pairs = np.zeros((tags, tags))
    both = real[1:] & real[:-1]
    active = real.sum(axis=1)  # sentences stand from the longest to the shortest
    np.add.at(pairs, (y[:-1][both], y[1:][both]), 1)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, moves, first)]
    for step in range(1, steps + 1):
        emit = np.zeros((longest, n, tags))
        emit[real] = sum(weights[column] for column in columns)
        log_moves = moves + barred
        alpha, beta = emit.copy(), np.zeros_like(emit)
        alpha[0] += first + barred_first
        for t in range(1, longest):
            alpha[t, : active[t]] += _log_sum(alpha[t - 1, : active[t], :, None] + log_moves, 1)
        log_z = _log_sum(alpha[lengths - 1, np.arange(n)], 1)
        g_moves = -pairs.copy()
        for t in range(longest - 1, 0, -1):
            a = active[t]
            after = log_moves + (emit[t, :a] + beta[t, :a])[:, None, :]
            beta[t - 1, :a] = _log_sum(after, 2)
            g_moves += np.exp(alpha[t - 1, :a, :, None] + after - log_z[:a, None, None]).sum(axis=0)
        own = np.exp(alpha + beta - log_z[:, None])
        off = (own - one_hot[y])[real]
        g_weights = np.zeros_like(weights)
        g_weights[used] = np.add.reduceat(off[token_of], cuts)
        g_first = (own[0] - one_hot[y[0]]).sum(axis=0)
        for (mean, square), p, g in zip(state, (weights, moves, first), (g_weights, g_moves, g_first)):
            g = g / total + penalty * p
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            p -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights[-1] = 0
    return Chain(ids, weights, moves + barred, first + barred_first)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


# Texts


def _plausible(kind: str, found: str) -> bool:
    """Whether what the chain found has the digits of its kind."""
    digits = NO_DIGITS.sub("", found)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "ip":
        parts = NO_DIGITS.split(found)
        return len(parts) == 4 and all(0 < len(p) <= 3 and int(p) <= 255 for p in parts)
    return bool(re.search(r"[A-Za-z0-9]\W*(?:@|[\[({<] ?at ?[\])}>])\W*[A-Za-z0-9]", found, re.I)) and bool(re.search(r"[A-Za-z]{2}$", found))


def find_spans(texts: Sequence[str], chain: Chain) -> list[tuple[list[Span], list[Span]]]:
    """Certain and likely spans of each text of a batch; likely ones overlap no certain one."""
    base = [sorted(base_spans(text), key=lambda s: (s[1], BASE_KINDS.index(s[0]), s[2])) for text in texts]
    shapes: dict[str, str] = {}
    cut, contexts, owners = [], [], []
    for i, text in enumerate(texts):
        for start, end in stretches(text):
            if tokens := _tokens(text, start, end, shapes):
                cut.append(tokens)
                owners.append(i)
                contexts += _contexts(tokens)
    likely: list[list[Span]] = [[] for _ in texts]
    if cut:
        tags = chain.decode(chain.emissions(contexts), np.array([len(t) for t in cut]))
        at = 0
        for i, tokens in zip(owners, cut):
            own = tags[at : at + len(tokens)]
            at += len(tokens)
            for begin in np.flatnonzero(own % 2 == 1):
                end = begin
                while end + 1 < len(tokens) and own[end + 1] == own[begin] + 1:
                    end += 1
                span = (BASE_KINDS[own[begin] // 2], tokens[begin][3], tokens[end][4])
                if _plausible(span[0], texts[i][span[1] : span[2]]):
                    likely[i].append((f"likely_{span[0]}", *span[1:]))
    return [(b, _apart(found, b)) for b, found in zip(base, likely)]


def _apart(found: list[Span], taken: list[Span]) -> list[Span]:
    """The found spans, in order, that overlap none of the taken ones, which are sorted by start."""
    kept, at, reach = [], 0, -1
    for span in found:
        while at < len(taken) and taken[at][1] <= span[1]:
            reach, at = max(reach, taken[at][2]), at + 1
        if reach <= span[1] and (at == len(taken) or taken[at][1] >= span[2]):
            kept.append(span)
    return kept


def _spans_of(chain: Chain):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    both = T.StructType([T.StructField("base", SPANS), T.StructField("likely", SPANS)])

    @F.arrow_udf(both)
    def spans_of(texts: pa.Array) -> pa.Array:
        found = find_spans([t or "" for t in texts.to_pylist()], chain)
        columns = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans[k]] for spans in found], kind) for k in (0, 1)]
        return pa.StructArray.from_arrays(columns, ["base", "likely"])

    return spans_of


def find_personal_data(documents: DataFrame, chain: Chain | None = None, text: str = "text") -> DataFrame:
    """One row per document: doc_id, base (certain spans) and found (those and likely ones)."""
    chain = chain or fit_chain(labelled_table(documents.sparkSession))
    found = small_batches(documents).select("doc_id", _spans_of(chain)(F.col(text)).alias("spans"))
    return found.select("doc_id", "spans.base", F.concat("spans.base", "spans.likely").alias("found"))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda p: p["kind"] == kind)).cast("long")


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in [*BASE_KINDS, *MODEL_KINDS]))
    ordered = F.array_sort(F.transform(spans, lambda p: F.struct(p["start"].alias("start"), F.array_position(kinds, p["kind"]).alias("n"), p["end"].alias("end"), p["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def digests(documents: DataFrame, chain: Chain | None = None) -> DataFrame:
    """Counts and digests of the spans of every document."""
    found = find_personal_data(documents, chain)
    counts = [_count("base", kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))
