"""Secrets in texts: certain ones by pattern, weak ones when complementary parts stand together.

A credential of several parts (an identifier, a secret, an endpoint) has parts that alone mean
little: a word of capitals and digits, a random-looking string, an address. Such weak parts are
found everywhere, but reported only if a part of another role is within ``scope`` code points of
the same text. That is an interval join of a text's parts with themselves; as only the existence
of a partner matters, it is a sweep in order of start: the furthest end before a part and the
nearest start after it tell whether a partner reaches into its scope. No pairs are made, so a
text with a million parts costs a sort.

Spans are code points, end exclusive. A null text counts as empty; null, repeated doc_ids and
further columns of any name do no harm: rows are told apart by a number of their own.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.text import small_batches
from eventloom.session import materialize

SCOPE = 300
#: Kinds of certain spans, then of weak ones, in the order in which spans of one start are listed.
BASE_KINDS = ["assign", "access", "hex"]
WEAK_KINDS = ["id", "key", "endpoint"]
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "id": "identifier", "key": "secret", "endpoint": "endpoint"}
#: The roles of which one must be near for a weak part to be reported.
COMPLEMENTS = {"id": ["secret"], "key": ["identifier", "endpoint"], "endpoint": ["secret"]}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is a whole run: what precedes it is no hex digit
WEAK_ID = re.compile(r"(?<![A-Za-z0-9])[A-Z][A-Z0-9]{11,}(?![A-Za-z0-9])")
WEAK_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|(?<![@\w.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}(?![0-9])""")

PART = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _random_looking(found: str) -> bool:
    """Letters of both cases and digits, at 3.5 bits a character or more."""
    if not (any(c.isdigit() for c in found) and any(c.isupper() for c in found) and any(c.islower() for c in found)):
        return False
    return -sum(n / len(found) * math.log2(n / len(found)) for n in Counter(found).values()) >= 3.5


def find_parts(text: str) -> list[tuple[str, int, int]]:
    """Certain spans and weak parts of one text; weak parts never overlap certain ones."""
    parts = []
    if "=" in text or ":" in text:
        parts += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        parts += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    parts += [("hex", *m.span()) for m in HEX.finditer(text)]
    weak = [("id", *m.span()) for m in WEAK_ID.finditer(text) if sum(c.isdigit() for c in m[0]) >= 2]
    weak += [("key", *m.span()) for m in WEAK_KEY.finditer(text) if _random_looking(m[0])]
    if ":" in text:
        weak += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    if weak and parts:
        weak = _apart(weak, sorted((s, e) for _, s, e in parts))
    return parts + weak


def _apart(weak: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    kept, at, reach = [], 0, -1
    for kind, start, end in sorted(weak, key=lambda p: p[1:]):
        while at < len(taken) and taken[at][0] <= start:
            reach, at = max(reach, taken[at][1]), at + 1
        if reach <= start and (at == len(taken) or taken[at][0] >= end):
            kept.append((kind, start, end))
    return kept


@F.arrow_udf(PART)
def parts_of(texts: pa.Array) -> pa.Array:
    found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_parts(t.as_py() or "")] for t in texts]
    return pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))


def _near(role: str, scope: int) -> Column:
    """Whether another part of the role reaches within ``scope`` of this one, in a sweep by start."""
    of_text = W.partitionBy("row").orderBy("start", "end", "kind")
    is_role = F.col("role") == role
    end_before = F.max(F.when(is_role, F.col("end"))).over(of_text.rowsBetween(W.unboundedPreceding, -1))
    start_after = F.min(F.when(is_role, F.col("start"))).over(of_text.rowsBetween(1, W.unboundedFollowing))
    return F.coalesce(F.col("start") - end_before <= scope, F.lit(False)) | F.coalesce(start_after - F.col("end") <= scope, F.lit(False))


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts (row, kind, start, end) that have a part of a complementary role in scope."""
    role = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    near = parts.withColumn("role", role[F.col("kind")])
    near = near.withColumns({f"near_{r}": _near(r, scope) for r in ("identifier", "secret", "endpoint")})
    wanted = F.lit(False)
    for kind, roles in COMPLEMENTS.items():
        for r in roles:
            wanted = wanted | ((F.col("kind") == kind) & F.col(f"near_{r}"))
    return near.filter(wanted).select("row", "kind", "start", "end")


def _count(parts: str, kind: str) -> Column:
    return F.size(F.filter(parts, lambda p: p["kind"] == kind)).cast("long")


def _listed(parts: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in [*BASE_KINDS, *WEAK_KINDS]))
    ordered = F.array_sort(F.transform(parts, lambda p: F.struct(p["start"].alias("start"), F.array_position(kinds, p["kind"]).alias("n"), p["end"].alias("end"), p["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def find_secrets(documents: DataFrame, scope: int = SCOPE, text: str = "text") -> DataFrame:
    """One row per document: doc_id, base (certain spans) and found (those and linked weak parts)."""
    extracted = small_batches(documents).select("doc_id", parts_of(F.col(text)).alias("parts"))
    stored = materialize(extracted.withColumn("row", F.monotonically_increasing_id()), "secret-parts")
    base = F.filter("parts", lambda p: p["kind"].isin(BASE_KINDS))
    # A weak part alone in its text has no partner.
    several = stored.filter((F.size("parts") > F.size(base)) & (F.size("parts") > 1))
    linked = linked_parts(several.select("row", F.inline("parts")), scope)
    extra = linked.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))
    joined = stored.withColumn("base", base).join(extra, "row", "left")
    return joined.select("doc_id", "base", F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.concat("base", "extra")).alias("found"))


def digests(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Counts and digests of the spans of every document."""
    found = find_secrets(documents, scope)
    counts = [_count("base", kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def redact(documents: DataFrame, scope: int = SCOPE, mask: str = "[REDACTED]") -> DataFrame:
    """The same rows with every found span of ``text`` replaced by ``mask`` and n_chars counted anew.

    Rows are matched by content, so this does not depend on the order in which files are read.
    """

    @F.arrow_udf(T.StringType())
    def masked(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for text, s, e in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist()):
            pieces, at, text = [], 0, text or ""
            for start, end in sorted(zip(s, e)):
                if start >= at:
                    pieces += [text[at:start], mask]
                at = max(at, end)
            out.append("".join([*pieces, text[at:]]))
        return pa.array(out, pa.string())

    scanned = small_batches(documents).select(F.md5("text").alias("key"), parts_of("text").alias("parts")).filter(F.size("parts") > 0)
    stored = materialize(scanned.dropDuplicates(["key"]).withColumn("row", F.monotonically_increasing_id()), "secret-parts")
    linked = linked_parts(stored.select("row", F.inline("parts")), scope)
    extra = linked.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))
    base = F.filter("parts", lambda p: p["kind"].isin(BASE_KINDS))
    none = F.array().cast(PART)
    found = stored.join(extra, "row", "left").select("key", F.concat(base, F.coalesce("extra", none)).alias("found"))
    joined = documents.select(F.md5("text").alias("key"), F.struct("*").alias("doc")).join(found.filter(F.size("found") > 0), "key", "left")
    text = F.when(F.col("found").isNull(), F.col("doc.text")).otherwise(masked("doc.text", F.coalesce("found.start", F.array().cast("array<bigint>")), F.coalesce("found.end", F.array().cast("array<bigint>"))))
    replaced = joined.select("doc", text.alias("text"))
    renewed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return replaced.select(*(renewed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in documents.columns))
