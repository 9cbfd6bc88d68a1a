"""Language identification with bit-sliced n-gram filters.

Counting: every task counts hashed letter n-grams per language over all its training texts; the counts
are added up by Spark. An n-gram belongs to a language when it makes up at least ``share`` of that
language's n-grams, so a language has at most ``1 / share`` of them whatever the size of the corpus.
The filters of all languages lie side by side: one table of rows, in each row one bit per language.
Looking up an n-gram reads a few rows, and their common bits are all languages that contain it.

Deciding: per language, the n-grams of a text that hit are counted and corrected for false positives
(with fill rate ``p`` and ``k`` probes, a miss hits with ``p ** k``). The language with the most wins, ties by
name; the score is the corrected share of the text's n-grams found in it, times its lead over the runner-up
kept above one half, so that it falls for texts that fit two languages or none.

Rows: a text that is null or has no letter is ``und`` with score 0 (every word gives an n-gram, be it of one
letter, so there are n-grams exactly where there are letters); a table without labelled rows makes every text ``und``. Texts of any length are read whole, in pieces. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.arrays import mix, slices

CELL_BITS = 21   # an n-gram is known by a hash of so many bits
ROW_BITS = 19    # rows of the filter table
PROBES = 3
SIZES = (3, 4)   # lengths of n-grams; a word border counts as one place
SHARE = 2e-5
TOGETHER = 1 << 17  # characters of short texts whose n-grams are taken at once
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For every code point below 65536: its place among letters, or 0."""
    codes = np.zeros(65536, np.uint32)
    for c in range(65536):
        if chr(c).isalpha():
            codes[c] = c
    return codes


_CODES: list[np.ndarray] = []


def cells_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram cells of all texts, in order of texts, and the index of each one's text."""
    if not _CODES:
        _CODES.append(_letters())
    raw = [(" " + t.lower() + " ").encode("utf-32-le", "surrogatepass") if t else b"" for t in texts]
    points = np.frombuffer(b"".join(raw), "<u4")
    code = np.where(points < 65536, _CODES[0][np.minimum(points, 65535)], points)
    rare = np.flatnonzero(points >= 65536)
    if len(rare):
        known, at = np.unique(points[rare], return_inverse=True)
        code[rare] = np.array([c if chr(c).isalpha() else 0 for c in known.tolist()], np.uint32)[at]
    lengths = np.array([len(r) // 4 for r in raw], np.int64)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)  # runs of other characters are one border
    keep[(np.cumsum(lengths) - lengths)[lengths > 0]] = True  # and every text has its own
    doc = np.repeat(np.arange(len(texts)), lengths)[keep]
    code = code[keep].astype(np.uint64)
    cells, docs = [], []
    for n in SIZES:
        if len(code) < n:
            continue
        h = np.zeros(len(code) - n + 1, np.uint64)
        ok = doc[: len(h)] == doc[n - 1:]
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + code[k: k + len(h)] + np.uint64(1)
            if 0 < k < n - 1:
                ok &= code[k: k + len(h)] != 0  # a border only at the ends
        if n > 3:  # of three places, a border at both ends is a word of one letter
            ok &= (code[: len(h)] != 0) | (code[n - 1:] != 0)
        cells.append((mix(h[ok] + np.uint64(n)) >> np.uint64(64 - CELL_BITS)).astype(np.int64))
        docs.append(doc[: len(h)][ok])
    if not cells:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(cells), np.concatenate(docs)


def probe_rows(cells: np.ndarray) -> list[np.ndarray]:
    h = cells.astype(np.uint64)
    return [(mix(h + np.uint64((i + 1) * 0x632BE59BD9B4E019 % 2 ** 64)) >> np.uint64(64 - ROW_BITS)).astype(np.int64)
            for i in range(PROBES)]


def pieces(texts, limit: int = 1 << 20) -> Iterator[list[tuple[int, str]]]:
    """(row, piece) lists; a long text is cut at white space where there is some, else at ``limit``."""
    def cut():
        for i, t in enumerate(texts):
            if not t or len(t) <= limit:
                yield i, t
                continue
            at = 0
            while at < len(t):
                end = min(len(t), at + limit)
                if end < len(t):
                    space = t.rfind(" ", at + 1, end)
                    end = space if space > at else end
                yield i, t[at:end]
                at = end
    yield from slices(cut(), lambda x: len(x[1]) if x[1] else 0, min(limit, TOGETHER))


def count_cells(labelled: DataFrame) -> DataFrame:
    """``lang``, ``cell`` and ``n`` of all rows of (lang, text); each task adds up its own first."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            names = b["lang"].to_numpy()
            for part in pieces(b["text"].tolist()):
                cells, doc = cells_of([t for _, t in part])
                owner = names[[i for i, _ in part]]
                for lang in set(owner):
                    if lang not in totals:
                        totals[lang] = np.zeros(1 << CELL_BITS, np.int64)
                    np.add.at(totals[lang], cells[(owner == lang)[doc]], 1)
            if len(totals) > 8:  # bounded state: hand over what is there
                yield from hand_over(totals)
                totals = {}
        yield from hand_over(totals)

    def hand_over(totals: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for lang, n in totals.items():
            found = np.flatnonzero(n)
            for k in range(0, len(found), 1 << 16):  # batches of a few MB
                cell = found[k:k + (1 << 16)]
                yield pd.DataFrame({"lang": lang, "cell": cell, "n": n[cell]})

    return (labelled.mapInPandas(count, "lang string, cell long, n long")
            .groupBy("lang", "cell").agg(F.sum("n").alias("n")))


class Masks:
    """The filter table: ``table[row]`` has bit ``i`` set if some n-gram of ``langs[i]`` falls there."""

    def __init__(self, langs: list[str], cells: list[np.ndarray]):
        self.langs = langs
        words = max(1, -(-len(langs) // 64))
        self.table = np.zeros((words, 1 << ROW_BITS), np.uint8 if len(langs) <= 8 else np.uint64)
        for i, c in enumerate(cells):
            for rows in probe_rows(c):
                self.table[i // 64, rows] |= self.table.dtype.type(1 << (i % 64))
        fill = np.array([self.bit(self.table[i // 64], i).mean() for i in range(len(langs))])
        self.false_rate = fill ** PROBES

    @staticmethod
    def bit(mask: np.ndarray, i: int) -> np.ndarray:
        return (mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1)

    def hits(self, cells: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """How many n-grams of each text every language contains."""
        rows = probe_rows(cells)
        out = np.zeros((n, len(self.langs)))
        for w in range(len(self.table)):
            mask = self.table[w][rows[0]]
            for r in rows[1:]:
                mask &= self.table[w][r]
            for i in range(w * 64, min(len(self.langs), w * 64 + 64)):
                out[:, i] = np.bincount(doc, weights=self.bit(mask, i), minlength=n)
        return out

    def decide(self, hits: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = np.clip((hits - self.false_rate * total[:, None]) / np.maximum(1 - self.false_rate, 1e-9), 0, None)
        if not len(self.langs):
            return np.full(len(total), UNKNOWN, object), np.zeros(len(total))
        best = known.argmax(1)
        top = known[np.arange(len(total)), best]
        second = np.sort(known, 1)[:, -2] if len(self.langs) > 1 else np.zeros(len(total))
        lead = (top + 1e-9) / (top + second + 1e-9)
        score = np.where(total > 0, np.minimum(1, top / np.maximum(total, 1)) * lead, 0)
        names = np.array(self.langs, object)[best]
        return np.where(total > 0, names, UNKNOWN), np.clip(score, 0, 1)


def learn(labelled: DataFrame, share: float = SHARE) -> Masks:
    """Filters from all rows of (lang, text); rows without either are left out.

    What comes to the driver is bounded by ``1 / share`` n-grams a language.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = count_cells(labelled.select(F.col("lang").cast("string").alias("lang"), "text"))
    whole = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rows = (counts.join(whole, "lang").where(F.col("n") >= share * F.col("total"))
            .select("lang", "cell").toPandas())
    by = {lang: g["cell"].to_numpy(np.int64) for lang, g in rows.groupby("lang")}
    langs = sorted(by)
    return Masks(langs, [by[x] for x in langs])


def identify(docs: DataFrame, masks: Masks, text_col: str = "text",
             keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` (as they are), ``lang_pred`` and ``score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(masks)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            n = b.num_rows
            hits, total = np.zeros((n, len(m.langs))), np.zeros(n)
            for part in pieces(b.column(at).to_pylist()):
                cells, doc = cells_of([t for _, t in part])
                own = np.array([i for i, _ in part], np.int64)
                np.add.at(hits, own, m.hits(cells, doc, len(part)))
                np.add.at(total, own, np.bincount(doc, minlength=len(part)))
            lang, score = m.decide(hits, total)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], pa.array(lang.tolist(), pa.string()), pa.array(score)],
                names=[*keep, "lang_pred", "score"])

    kept = docs.select(*[F.col(c) for c in keep])
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    if dict(docs.dtypes)[text_col] == "string" and text_col in keep:  # the text passes once
        at = list(keep).index(text_col)
        return kept.mapInArrow(predict, schema)
    at = len(keep)
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(predict, schema)
