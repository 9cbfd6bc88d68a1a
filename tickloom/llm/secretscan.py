"""Secret scans with multipart credential linking.

Three kinds are strong enough to be reported on their own: assignments of secrets, access key identifiers and long
hexadecimal runs. Three more kinds are weak: identifiers (``user = ...``), opaque values (long tokens that mix cases and
digits) and endpoints (addresses of services). A weak candidate is reported only when a part that complements it
stands in the same scope: an identifier needs a secret, an opaque value or an access key; an opaque value needs an
identifier, an access key or an endpoint; an endpoint needs a secret, an access key or an opaque value.

A scope is a distance of ``SCOPE`` characters between the two parts. Parts meet in an interval join: every part is
known in the cell of its start, and a weak candidate looks into the cells around its own. Cells are ``SCOPE`` wide, so
a cell holds a bounded number of parts (they do not overlap within a kind) however long the document is, and one
document full of secrets is many cells. The join only asks whether there is a partner; it makes no pairs.

Rows: a null text is empty; texts are read whole; positions are code points, ends exclusive; overlapping spans of different kinds
are all reported; rows that repeat an identifier are kept apart by a row number inside the join. Empty tables give empty results.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import checkpointed

SCOPE = 240
BASE = ("assign", "access", "hex")
WEAK = ("ident", "opaque", "endpoint")
KINDS = [*BASE, *WEAK]

_SECRET = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENT = re.compile(r"""(?:user(?:_?name)?|login|account|client_?id|access_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""",
                    re.I | re.A)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])", re.A)
_MIXED = [re.compile(p) for p in ("[0-9]", "[a-z]", "[A-Z]")]
_ENDPOINT = re.compile(r"""(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh)://[^\s"'<>]+"""
                       r"""|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::\d+)?""", re.I | re.A)
#: Words without which no weak pattern can match; looking for them is cheap.
_HINT = re.compile(r"://|[:=]|[A-Za-z0-9+/_-]{20}", re.A)

PART = "row long, doc_id long, kind int, start long, end long"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strong kinds."""
    out = []
    if ":" in text or "=" in text:
        out += [(0, m.start(), m.end()) for m in _SECRET.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def weak_spans(text: str) -> list[tuple[int, int, int]]:
    if not _HINT.search(text):
        return []
    found = [(3, _IDENT), (4, _OPAQUE), (5, _ENDPOINT)]
    return [(k, m.start(), m.end()) for k, p in found for m in p.finditer(text)
            if k != 4 or all(c.search(text, m.start(), m.end()) for c in _MIXED)]


def parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All parts of all documents, and one row of kind -1 per document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row += 1
                out.append((row, doc, -1, 0, 0))
                if text:
                    out += [(row, doc, *s) for s in base_spans(text)]
                    out += [(row, doc, *s) for s in weak_spans(text)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)],
                names=["row", "doc_id", "kind", "start", "end"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, PART)


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates of ``found`` that have a complement within ``scope`` characters."""
    roles = F.when(F.col("kind") == 0, "secret").when(F.col("kind") == 1, "key").when(F.col("kind") == 2, "secret").when(
        F.col("kind") == 3, "ident").when(F.col("kind") == 4, "opaque").otherwise("endpoint")
    spans = found.where("kind >= 0").withColumn("role", roles)
    known = spans.select(F.col("row").alias("row2"), F.col("start").alias("start2"), F.col("end").alias("end2"),
                         F.col("role").alias("role2"), F.floor(F.col("start") / scope).alias("cell2"))
    # a partner starts at most a scope and its own length before; long parts are known in every cell they touch
    known = known.withColumn("cell2", F.explode(F.sequence("cell2", F.floor((F.col("end2") - 1) / scope))))
    weak = spans.where("kind >= 3").withColumn("cell", F.explode(F.sequence(
        F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))))
    completes = (((F.col("role") == "ident") & F.col("role2").isin("secret", "opaque", "key"))
                 | ((F.col("role") == "opaque") & F.col("role2").isin("ident", "key", "endpoint"))
                 | ((F.col("role") == "endpoint") & F.col("role2").isin("secret", "key", "opaque")))
    near = (F.col("start2") < F.col("end") + scope) & (F.col("end2") > F.col("start") - scope)
    apart = (F.col("start2") >= F.col("end")) | (F.col("end2") <= F.col("start"))  # one string is not two parts
    hits = weak.join(known, (F.col("row") == F.col("row2")) & (F.col("cell") == F.col("cell2")) & completes & near & apart,
                     "left_semi")
    return hits.select("row", "doc_id", "kind", "start", "end").distinct()


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``row``, ``doc_id``, ``kind`` (its name), ``start`` and ``end`` of everything reported, and a row of null kind
    for every document."""
    found = checkpointed(parts(docs, id_col, text_col))
    out = found.where("kind < 3").unionByName(linked(found, scope))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.when(F.col("kind") >= 0, F.col("kind") + 1).otherwise(1))
    return out.withColumn("name", F.when(F.col("kind") >= 0, name))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: counts of the strong kinds, a digest of their spans, and all spans."""
    spans = secret_spans(docs, id_col, text_col, scope)
    item = F.when(F.col("kind") >= 0, F.struct("start", "kind", F.concat_ws(":", "name", "start", "end").alias("s")))
    rows = spans.groupBy("row", "doc_id").agg(
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{n}") for k, n in enumerate(BASE)],
        F.sort_array(F.collect_list(item)).alias("all"))
    base = F.array_join(F.transform(F.filter("all", lambda x: x["kind"] < 3), lambda x: x["s"]), ",")
    return rows.select("doc_id", *[f"n_{n}" for n in BASE], F.sha2(base, 256).alias("base_sha256"),
                       F.array_join(F.transform("all", lambda x: x["s"]), ",").alias("spans"))


def brute_force(text: str | None, scope: int = SCOPE) -> tuple[int, int, int, str, str]:
    """The report of one text by comparing all parts with each other (for tests)."""
    t = text or ""
    base, weak = base_spans(t), weak_spans(t)
    role = {0: "secret", 1: "key", 2: "secret", 3: "ident", 4: "opaque", 5: "endpoint"}
    needs = {"ident": {"secret", "opaque", "key"}, "opaque": {"ident", "key", "endpoint"},
             "endpoint": {"secret", "key", "opaque"}}
    kept = [w for w in weak if any(
        role[p[0]] in needs[role[w[0]]] and p[1] < w[2] + scope and p[2] > w[1] - scope and (p[1] >= w[2] or p[2] <= w[1])
        for p in base + weak)]

    def spelled(spans) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])))
    return (*[sum(s[0] == k for s in base) for k in range(3)], hashlib.sha256(spelled(base).encode()).hexdigest(),
            spelled(base + kept))
