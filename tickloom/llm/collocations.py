"""Collocations by weighted acyclic automata over the words of all texts.

Every word begins a window: itself and up to four words after it in its piece. A phrase occurs as often as windows begin
with it, so one automaton of windows holds the counts of all its prefixes. It is kept level by level: the arcs of one
depth in sorted order, each with its word, its source and the windows that pass.

* A task gathers a shard of texts, sorts its windows and builds a count automaton in one pass over the sorted rows, cut
  into ranges of prefixes. A shard's automata move, not its windows.
* Ranges are cut on a code of the first three words, word by word, so windows with a common prefix are neighbours. The
  cuts are quantiles of a sample and only balance the work: a frequent prefix spreads over several ranges, and the counts
  of the few prefixes that cross a cut are added up afterwards.
* The task of a range unites the automata of all shards, adding weights, and hands over prefixes that are frequent.
* Parts are looked up by composition: the parts of all candidates, sorted, run through the count automaton of their
  bucket. Candidates and parts are dealt by the part and a salt, as some words are parts of very many candidates.

A candidate lies inside a longer one that occurs as often exactly if it lies inside one that is one word longer and occurs
as often (every phrase between them does), so only neighbours are compared. Words are told apart by their bytes, counts are
whole numbers, and the score is computed in decimals of 38 digits.

Rows: a null text is empty, a null language is ``und``; texts of any length are read whole, in parts that overlap by the
length of a window where no piece ends; repeated rows count again; tables without rows give no rows. Only the named
columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.sizes import small_side
from tickloom.session import checkpointed

LONGEST = 5               # words of a phrase
LEAST = 100               # occurrences of a candidate
TOP = 2000
SHARD = 8_000_000         # bytes of text that a task counts at once
RANGE = 12_000_000        # bytes of text behind one range of prefixes, on average
HELD = 1_000_000          # windows that a range gathers before it unites them
SAMPLE = 500              # sampled windows for each range, about
STRIDE = 101              # every so many windows of a sampled text
SALTS = 8
BUCKET = 400_000          # frequent phrases in the automaton of one bucket
BITS = 21                 # of a word's number, three to a sort key

_CLEAN = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def parts_of(text: bytes, limit: int = SHARD) -> Iterator[tuple[bytes, bool]]:
    """A cleaned text in parts of about ``limit`` bytes; True where the last words belong to the next part only."""
    at = 0
    while len(text) - at > limit:
        end = text.rfind(b"\n", at + 1, at + limit)
        if end > at:
            yield text[at:end], False
            at = end
            continue
        end = text.find(b" ", at + limit)
        stop = text.find(b"\n", at + limit)
        if end < 0 or 0 <= stop < end:
            end = stop if stop >= 0 else len(text)
            yield text[at:end], False
            at = end
            continue
        back, words = end, 0  # the next part begins with the last words of this one
        while words < LONGEST - 1 and back > at:
            back = text.rfind(b" ", at, back)
            if back < 0:
                break
            words += text[back + 1:back + 2] != b" "
        if back <= at:
            end = stop if stop >= 0 else len(text)
            yield text[at:end], False
            at = end
            continue
        yield text[at:end], True
        at = back
    yield text[at:], False


def windows_of(text: bytes, overlaps: bool = False) -> tuple[list[bytes], np.ndarray]:
    """The sorted distinct words of a cleaned text and all windows, as rows of word numbers from 1 (0: the piece ended)."""
    tokens = text.replace(b"\n", b" \n ").split(b" ")
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, tokens, counter()), np.int64, len(tokens))
    words = sorted(w for w in first if w and w != b"\n")
    number = np.full(len(tokens), -1, np.int32)
    number[first.get(b"\n", 0)] = 0 if b"\n" in first else -1
    number[[first[w] for w in words]] = np.arange(1, len(words) + 1)
    ids = number[ids]
    ids = ids[ids >= 0]
    if overlaps:
        starts = np.flatnonzero(ids)[:-(LONGEST - 1)]
    else:
        starts = np.flatnonzero(ids)
    ids = np.concatenate((ids, np.zeros(LONGEST, np.int32)))
    out = np.empty((len(starts), LONGEST), np.int32)
    for k in range(LONGEST):
        out[:, k] = ids[starts + k]
        if k:
            out[out[:, k - 1] == 0, k] = 0
    return words, out


def _key(windows: np.ndarray, columns: tuple[int, ...]) -> np.ndarray:
    key = np.zeros(len(windows), np.int64)
    for c in columns:
        key <<= BITS
        key |= windows[:, c]
    return key


def collapsed(windows: np.ndarray, weight: np.ndarray | None, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct windows with their weights added up."""
    if not len(windows):
        return windows, np.empty(0, np.int64)
    if n_words < 1 << BITS:
        keys = (_key(windows, (3, 4)), _key(windows, (0, 1, 2)))
    else:
        keys = tuple(windows.T[::-1])
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(new)
    if weight is None:
        return windows[order[at]], np.diff(np.r_[at, len(order)])
    return windows[order[at]], np.add.reduceat(weight[order], at)


def word_codes(words: list[bytes]) -> np.ndarray:
    """A hash of each word, at place 0 that of none."""
    return np.fromiter((0, *map(zlib.crc32, words)), np.int64, len(words) + 1)


def prefix_codes(windows: np.ndarray, code: np.ndarray) -> np.ndarray:
    """23, 20 and 20 bits of the first three words: equal prefixes have codes next to each other."""
    return ((code[windows[:, 0]] >> 9) << 40) | ((code[windows[:, 1]] & 0xFFFFF) << 20) | (code[windows[:, 2]] & 0xFFFFF)


def _small(a: np.ndarray) -> np.ndarray:
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


class Automaton:
    """Count automaton of word sequences: ``label``, ``source`` and ``weight`` of the arcs of every depth, sorted."""

    def __init__(self, words: list[bytes], label: list[np.ndarray], source: list[np.ndarray], weight: list[np.ndarray]):
        self.words, self.label, self.source, self.weight = words, label, source, weight

    @classmethod
    def build(cls, words: list[bytes], rows: np.ndarray, count: np.ndarray, passing: bool = True) -> Automaton:
        """From sorted distinct rows of word numbers; a row's arcs are new from where it leaves the row before.

        A weight is what passes an arc, or only what ends there.
        """
        label, source, weight = [], [], []
        state = np.zeros(len(rows), np.int64)  # the state that each row has reached
        new = np.zeros(len(rows), bool)
        if len(rows):
            new[0] = True
        live = np.arange(len(rows))
        for d in range(rows.shape[1]):
            change = new.copy()
            change[1:] |= rows[1:, d] != rows[:-1, d]
            new = change
            live = live[rows[live, d] > 0]
            if not len(live):
                break
            first = np.flatnonzero(new[live] | np.r_[True, state[live][1:] != state[live][:-1]])
            label.append(rows[live[first], d])
            source.append(state[live[first]])
            here = count[live]
            if not passing and d + 1 < rows.shape[1]:
                here = np.where(rows[live, d + 1] == 0, here, 0)
            weight.append(np.add.reduceat(here, first))
            state[live] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(live)]))
        return cls(words, label, source, weight)

    def to_bytes(self) -> bytes:
        """The arcs of a state are neighbours, so a state stores their number; weights only what ends there."""
        out = [b" ".join(self.words)]
        states = 1
        for d in range(len(self.label)):
            passing = np.zeros(len(self.label[d]), np.int64)
            if d + 1 < len(self.label):
                np.add.at(passing, self.source[d + 1], self.weight[d + 1])
            for a in (np.bincount(self.source[d], minlength=states), self.label[d], self.weight[d] - passing):
                a = _small(a)
                out += [struct.pack("<BI", a.itemsize, len(a)), a.tobytes()]
            states = len(self.label[d])
        return struct.pack("<II", len(out[0]), len(self.label)) + b"".join(out)

    @staticmethod
    def paths(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words, rows and counts that ``to_bytes`` had."""
        size, depths = struct.unpack_from("<II", data)
        at = 8 + size
        words = data[8:at].split(b" ")

        def array() -> np.ndarray:
            nonlocal at
            width, n = struct.unpack_from("<BI", data, at)
            out = np.frombuffer(data, f"<u{width}", n, at + 5).astype(np.int64)
            at += 5 + n * width
            return out

        path = np.zeros((1, LONGEST), np.int32)
        rows, counts = [], []
        for d in range(depths):
            fan, label, ends = array(), array(), array()
            path = np.repeat(path, fan, axis=0)
            path[:, d] = label
            rows.append(path[ends > 0])
            counts.append(ends[ends > 0])
        return words, np.concatenate(rows), np.concatenate(counts)

    def compose(self, rows: np.ndarray) -> np.ndarray:
        """The weights of paths given as rows of word numbers (0 after the end, -1 for an unknown word); 0 if absent."""
        state = np.zeros(len(rows), np.int64)
        out = np.zeros(len(rows), np.int64)
        alive = np.arange(len(rows))
        width = len(self.words) + 1
        for d in range(rows.shape[1]):
            alive = alive[rows[alive, d] != 0]
            if not len(alive):
                break
            out[alive] = 0
            if d >= len(self.label):
                break
            arcs = self.source[d] * width + self.label[d]
            want = state[alive] * width + rows[alive, d]
            at = np.minimum(np.searchsorted(arcs, want), len(arcs) - 1)
            met = (arcs[at] == want) & (rows[alive, d] > 0)
            alive, at = alive[met], at[met]
            state[alive], out[alive] = at, self.weight[d][at]
        return out


def _texts(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[tuple[str, bytes, bool]]:
    """Cleaned texts of one language at a time, joined to shards."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not text:
                continue
            for part, overlaps in parts_of(text.encode("utf-8", "surrogatepass").translate(_CLEAN), shard):
                if overlaps:
                    yield lang, part, True
                    continue
                held.setdefault(lang, []).append(part)
                size += len(part)
            if size >= shard:
                for x, parts in held.items():
                    yield x, b"\n".join(parts), False
                held, size = {}, 0
    for x, parts in held.items():
        yield x, b"\n".join(parts), False


def cuts_of(texts: DataFrame, bytes_all: int) -> np.ndarray:
    """Where the code of prefixes is cut into ranges of about equal work; from a sample of texts."""
    ranges = max(1, -(-bytes_all // RANGE))
    if ranges == 1:
        return np.empty(0, np.int64)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text, overlaps in _texts(batches, 1 << 20):
            words, windows = windows_of(text, overlaps)
            yield pa.RecordBatch.from_arrays([pa.array(prefix_codes(windows, word_codes(words))[::STRIDE])], names=["code"])

    share = min(1.0, SAMPLE * STRIDE * 6 * ranges / bytes_all)
    shares = [i / ranges for i in range(1, ranges)]
    found = texts.sample(share, seed=11).mapInArrow(codes, "code long").agg(
        F.percentile_approx("code", shares, 20 * ranges)).first()[0]
    return np.unique(np.array(found or [], np.int64))


def shard_automata(texts: DataFrame, cuts: np.ndarray, shard: int) -> DataFrame:
    """(range, lang, automaton) of every shard of texts."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text, overlaps in _texts(batches, shard):
            words, windows = windows_of(text, overlaps)
            rows, count = collapsed(windows, None, len(words))
            place = np.searchsorted(cuts, prefix_codes(rows, word_codes(words)), side="right")
            order = np.argsort(place, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(place[order]) != 0]) if len(order) else []
            for lo, hi in zip(at, np.r_[at[1:], len(order)].astype(int) if len(order) else []):
                mine = order[lo:hi]
                used = np.unique(rows[mine])
                used = used[used > 0]
                local = np.searchsorted(used, rows[mine]) + 1
                local[rows[mine] == 0] = 0
                one = Automaton.build([words[i - 1] for i in used], local, count[mine])
                yield pa.RecordBatch.from_arrays([pa.array([int(place[mine[0]])], pa.int32()), pa.array([lang]),
                                                  pa.array([one.to_bytes()])], names=["range", "lang", "automaton"])

    return texts.mapInArrow(build, "range int, lang string, automaton binary")


class Union:
    """Automata of one range and language, united as they come."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.rows, self.count, self.held = [], [], 0

    def add(self, data: bytes) -> None:
        words, rows, count = Automaton.paths(data)
        numbers = np.fromiter((0, *(self.number.setdefault(w, len(self.number) + 1) for w in words)), np.int32)
        self.rows.append(numbers[rows])
        self.count.append(count)
        self.held += len(rows)
        if self.held > HELD:
            self.unite()

    def unite(self) -> tuple[np.ndarray, np.ndarray]:
        rows, count = collapsed(np.concatenate(self.rows), np.concatenate(self.count), len(self.number))
        self.rows, self.count, self.held = [rows], [count], 0
        return rows, count

    def frequent(self, least: int, edges: list[int]) -> Iterator[tuple[list[str], int, np.ndarray]]:
        """(phrases, words of each, counts) of prefixes with ``least`` occurrences, or cut by an edge of the range."""
        rows, count = self.unite()
        yield [""], 0, np.array([int(count.sum())])
        words = list(self.number)
        text = [w.decode("utf-8", "surrogatepass") for w in words]
        code = word_codes(words)
        for d in range(LONGEST):
            live = np.flatnonzero(rows[:, d])
            if not len(live):
                return
            rows, count = rows[live], count[live]
            new = np.zeros(len(rows), bool)
            new[0] = True
            for k in range(d + 1):
                new[1:] |= rows[1:, k] != rows[:-1, k]
            at = np.flatnonzero(new)
            n = np.add.reduceat(count, at)
            keep = n >= least
            if d < 2:
                shift = 40 if d == 0 else 20
                prefix = np.zeros((len(at), 3), np.int32)
                prefix[:, :d + 1] = rows[at, :d + 1]
                keep |= np.isin(prefix_codes(prefix, code) >> shift, [e >> shift for e in edges])
            yield [" ".join([text[i - 1] for i in p]) for p in rows[at[keep], :d + 1].tolist()], d + 1, n[keep]
            inside = np.repeat(keep, np.diff(np.r_[at, len(rows)]))  # a longer phrase is no more frequent
            rows, count = rows[inside], count[inside]


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                  shard: int = SHARD) -> DataFrame:
    """``lang``, ``phrase``, ``words`` and ``n`` of all phrases with ``least`` occurrences, and per language the number of
    all words, as a phrase of none."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cuts = cuts_of(texts, size)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, union = None, None
        for b in batches:
            for place, lang, data in zip(*(c.to_pylist() for c in b.columns)):
                if key != (place, lang):
                    if union:
                        yield from handed(key, union)
                    key, union = (place, lang), Union()
                union.add(data)
        if union:
            yield from handed(key, union)

    def handed(key, union) -> Iterator[pa.RecordBatch]:
        place, lang = key
        for phrases, words, n in union.frequent(least, [int(c) for c in cuts[max(0, place - 1):place + 1]]):
            for i in range(0, len(phrases), 50_000):
                some = phrases[i:i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.string()),
                     pa.array([words] * len(some), pa.int32()), pa.array(n[i:i + 50_000], pa.int64())],
                    names=["lang", "phrase", "words", "n"])

    dealt = (shard_automata(texts, cuts, shard).repartition(len(cuts) + 1, "range").sortWithinPartitions("range", "lang"))
    counted = dealt.mapInArrow(unite, "lang string, phrase string, words int, n long")
    return (counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
            .where((F.col("n") >= least) | (F.col("words") == 0)))


def looked_up(requests: DataFrame, frequent: DataFrame, buckets: int) -> DataFrame:
    """``requests`` (lang, part, ...) with the ``weight`` of each part, by composition with the automaton of its bucket."""
    columns = [c for c in requests.columns if c not in ("lang", "part")]
    bucket = F.pmod(F.hash("part"), F.lit(buckets)).alias("bucket")
    have = frequent.select("lang", F.col("phrase").alias("part"), "n").select(
        bucket, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "lang", F.lit(0).alias("kind"), "part", "n",
        *[F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in columns])
    want = requests.select(bucket, F.pmod(F.hash(*columns), F.lit(SALTS)).alias("salt"), "lang", F.lit(1).alias("kind"),
                           "part", F.lit(0).cast("long").alias("n"), *columns)
    dealt = have.unionByName(want).repartition(buckets * SALTS, "bucket", "salt").sortWithinPartitions(
        "bucket", "salt", "lang", "kind", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, automaton = None, [], None
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(4))))
            lo = 0
            while lo < len(keys):
                hi = lo
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                piece = b.slice(lo, hi - lo)
                if key != keys[lo][:3]:
                    key, held, automaton = keys[lo][:3], [], None
                if keys[lo][3] == 0:
                    held.append((piece.column(4).to_pylist(), piece.column(5).to_numpy()))
                else:
                    if automaton is None:
                        automaton, held = counted(held), []
                    yield answered(automaton, piece)
                lo = hi

    def counted(held) -> tuple[Automaton, dict[str, int]]:
        phrases = [p.split(" ") for some, _ in held for p in some]
        number = {w: i for i, w in enumerate(sorted({w for p in phrases for w in p}), 1)}
        rows = numbered(phrases, number)
        n = np.concatenate([x for _, x in held]) if held else np.empty(0, np.int64)
        order = np.lexsort(rows.T[::-1])
        return Automaton.build(list(number), rows[order], n[order], passing=False), number

    def numbered(phrases: list[list[str]], number: dict[str, int]) -> np.ndarray:
        rows = np.zeros((len(phrases), LONGEST), np.int64)
        for i, p in enumerate(phrases):
            rows[i, :len(p)] = [number.get(w, -1) for w in p]
        return rows

    def answered(found, piece: pa.RecordBatch) -> pa.RecordBatch:
        automaton, number = found
        parts = piece.column(4).to_pylist()
        distinct = list(dict.fromkeys(parts))
        weight = automaton.compose(numbered([p.split(" ") for p in distinct], number))
        at = {p: i for i, p in enumerate(distinct)}
        return pa.RecordBatch.from_arrays(
            [piece.column(2), piece.column(4), *piece.columns[6:], pa.array(weight[[at[p] for p in parts]], pa.int64())],
            names=["lang", "part", *columns, "weight"])

    kinds = ", ".join(f"{c} {requests.schema[c].dataType.simpleString()}" for c in columns)
    return dealt.mapInArrow(run, f"lang string, part string, {kinds}, weight long")


def _first(rows: DataFrame, order: list[Column], keys: list[Column], top: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= top)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP,
                 shard: int = SHARD) -> DataFrame:
    """Each language's ``top`` phrases by the score of their weakest cut: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``,
    ``n`` and ``score``."""
    frequent = checkpointed(phrase_counts(docs, text_col, lang_col, least, shard))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-tasks // SALTS), -(-frequent.count() // BUCKET))
    total = frequent.where("words = 0").select("lang", F.col("n").alias("total"))
    phrases = frequent.where("words > 0")
    pieces = F.split("phrase", " ")
    cut = phrases.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), pieces.alias("w"),
                                            F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cut.select("lang", "phrase", "words", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("head"), F.array_join(F.slice("w", 1, F.col("k")), " ").alias("part")),
        F.struct(F.lit(False).alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ")
                 .alias("part")))).alias("side")).select("lang", "phrase", "words", "a", "k", "side.head", "side.part")
    met = checkpointed(looked_up(sides, phrases, buckets))

    inside = met.where((F.col("words") > 2) & (F.col("weight") == F.col("a")) & (
        F.when(F.col("head"), F.col("k")).otherwise(F.col("words") - F.col("k")) == F.col("words") - 1)).select(
        "lang", F.col("part").alias("phrase")).distinct()
    weights = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("head"), F.col("weight"))).alias("l"),
                                                          F.max(F.when(~F.col("head"), F.col("weight"))).alias("r"))
    exact = [F.col(c).cast("decimal(18,0)") for c in ("a", "total", "l", "r")]
    weights = weights.join(small_side(total), "lang").withColumn("up", exact[0] * exact[1] * F.lit(1000).cast("decimal(4,0)"))
    weights = weights.withColumn("down", exact[2] * exact[3]).withColumn("score", F.expr("up div down").cast("long"))
    scored = weights.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    left = scored.join(inside, ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = _first(left, order, [F.col("lang"), F.pmod(F.hash("phrase"), F.lit(64))], top, "place").drop("place")
    return _first(salted, order, [F.col("lang")], top, "rank").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM lists WHERE len(w) > 0),
grams AS (SELECT lang, m AS words, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM places, generate_series(1, 5) AS g(m)
  WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, words, phrase, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang),
cuts AS (SELECT lang, phrase, words, c AS a, string_split(phrase, ' ') AS w, unnest(generate_series(1, words - 1)) AS k
  FROM f WHERE words > 1),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.words, a, k, l.c AS l, r.c AS r, n,
    (1000 * CAST(a AS HUGEINT) * CAST(n AS HUGEINT)) // (CAST(l.c AS HUGEINT) * CAST(r.c AS HUGEINT)) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(w[k + 1:], ' ') JOIN total ON total.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = b.lang AND g.words > b.words
  AND 100 * g.c >= 100 * b.a AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000"""
