"""Jaccard join on word shingles with prefix filters under several global token orders.

If two sets have a Jaccard similarity of at least ``t``, then under *any* one order of all tokens their
prefixes of length ``n - ceil(t * n) + 1`` share a token. Pairs must pass this under three orders that all
begin with the rarest tokens but break ties differently; only pairs that pass every one are verified by
counting the common tokens.

How it is laid out:

1. Every task hashes the shingles of a block of documents. Tokens seen once in the block go to their hash
   shard with the place of their document; tokens seen several times go as one entry with a count, and
   their places stay with the block. A token of a third of all documents thus is one entry per block.
   Equal sets of a block post their tokens once, and each set posts itself as well, by count and a sum over its tokens.
2. A shard adds up the counts and answers each block with those of its tokens that occur elsewhere, too.
   Most tokens of a corpus occur in one document only; they are never looked at again. For equal sets of several
   blocks it says how many post, and which one of them goes on.
3. A block picks the prefixes of its documents. Tokens of one set (and its copies) only come first in every order,
   so they fill a prefix without making candidates. Documents whose shared tokens cannot reach the threshold are
   done. Equal sets become one class, by count and a 128-bit sum over the tokens.
4. Classes meet in the buckets of their prefix tokens. First each bucket's most central class is compared
   with the others and components grow along the links; then all pairs of a bucket in different components are
   compared. Pairs inside a component need no comparison to know it. Before each step, members that cannot
   reach the threshold with anyone in the bucket leave it, and so do buckets of one component; star steps go
   on while they find links and many pairs are left.

Rows: a null text is empty; a text without words has no shingles, is linked with nothing and is its own
component; with fewer words than a shingle the whole sequence is the one shingle. Rows that repeat an
identifier are rows of their own. A null identifier takes part but is never a component's name (a component of
null identifiers only has none). Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.arrays import mix, slices, windows, word_hashes
from tickloom.llm.sizes import BROADCAST_ROWS
from tickloom.session import checkpointed

ORDERS = 3
BLOCK_CHARS = 2 << 20
SHARD_TOKENS = 1 << 19
REPEATED = np.uint32(0xFFFFFFFF)
OF_SET = np.uint32(0x80000000)  # marks the entry of a whole set
_SALT = [np.uint64(x) for x in (0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]

BLOCK_ROWS = "block long, shard int, size int, payload binary"
CLASS_ROWS = ("doc_id long, key long, n long, sig1 long, sig2 long, shared long, "
              "p0 array<long>, p1 array<long>, p2 array<long>, tokens array<long>")


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text and the index of the text; texts may come in any order."""
    h, doc = word_hashes(texts)
    s, owner, _ = windows(h, doc, words)
    per = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((per > 0) & (per < words))
    if len(short):
        first = np.searchsorted(doc, short)
        value = per[short].astype(np.uint64)
        for k in range(words - 1):
            more = per[short] > k
            value[more] = mix(value[more] * np.uint64(0x9E3779B97F4A7C15) + h[first[more] + k])
        s, owner = np.concatenate((s, value)), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        s, owner = s[order], owner[order]
    order = np.argsort(s, kind="stable")
    s, owner = s[order], owner[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[keep], owner[keep]  # by hash, then by text


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal significance together, so that the zeros of small numbers compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _from_planes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length; the first one is sorted and kept as differences."""
    first = np.diff(arrays[0], prepend=arrays[0].dtype.type(0))
    return b"".join(_planes(np.ascontiguousarray(a)) for a in (first, *arrays[1:]))


def unpack(payload: bytes, n: int, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(_from_planes(payload[at: at + size], kind))
        at += size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _blocks(words: int, shards: int):
    bits = int(math.log2(shards))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 24
        rows = (r for b in batches for r in zip(b["doc_id"].tolist(), b["nameless"].tolist(), b["text"].tolist()))
        for part in slices(rows, lambda r: max(len(r[2] or ""), 100), BLOCK_CHARS):  # fewer than 2^16 rows
            at += 1
            yield block(at, part)

    def block(name: int, part: list) -> pd.DataFrame:
        s, owner = [], []
        done = 0
        for piece in slices(part, lambda r: len(r[2] or ""), 1 << 20):
            a, b = shingle_sets([t for _, _, t in piece], words)
            s.append(a)
            owner.append(b + done)
            done += len(piece)
        s, owner = np.concatenate(s), np.concatenate(owner)
        n = np.bincount(owner, minlength=len(part)).astype(np.int64)
        by_text = np.argsort(owner, kind="stable")
        sums = []
        starts = np.cumsum(n) - n
        for salt in _SALT[1:]:
            total = np.zeros(len(part), np.uint64)
            if len(s):
                sums_all = np.concatenate(([np.uint64(0)], np.cumsum(mix(s[by_text] ^ salt), dtype=np.uint64)))
                total = sums_all[starts + n] - sums_all[starts]
            sums.append(total)
        # of equal sets in a block only the first one posts its tokens
        _, first = np.unique(np.stack([n.astype(np.uint64), *sums]), axis=1, return_index=True)
        posts = np.zeros(len(part), bool)
        posts[first] = True
        mine = posts[owner]
        s, owner = s[mine], owner[mine]
        order = np.argsort(s, kind="stable")
        s, owner = s[order], owner[order].astype(np.uint32)
        run = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
        count = np.diff(np.r_[run, len(s)])
        token, place = s[run], np.where(count == 1, owner[run] if len(run) else 0, REPEATED).astype(np.uint32)
        twice = np.repeat(count > 1, count)
        ids = np.array([i for i, _, _ in part], np.int64)
        null = np.array([x for _, x, _ in part], bool)
        head = [len(part), int(twice.sum())]
        payload = b"".join([
            np.array(head, np.int64).tobytes(), ids.tobytes(), null.tobytes(), posts.tobytes(), n.tobytes(),
            sums[0].tobytes(), sums[1].tobytes(), s[twice].tobytes(), owner[twice].tobytes()])
        out = [(name, int(mix(np.uint64([name]))[0]) % shards, -1, payload)]
        whole = np.flatnonzero(posts & (n > 0))
        own = mix(sums[0][whole] + n[whole].astype(np.uint64))
        token = np.concatenate((token, own))
        place = np.concatenate((place, whole.astype(np.uint32) | OF_SET))
        count = np.concatenate((count, (sums[1][whole] >> np.uint64(32)).astype(np.int64)))
        order = np.argsort(token, kind="stable")
        token, place, count = token[order], place[order], count[order]
        shard = (token >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(token), np.int64)
        edges = np.searchsorted(shard, np.arange(shards + 1))
        for k in range(shards):
            a, b = edges[k], edges[k + 1]
            if b > a:
                out.append((name, k, b - a, pack(token[a:b], place[a:b], count[a:b].astype(np.uint32))))
        return pd.DataFrame(out, columns=["block", "shard", "size", "payload"])

    return make


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: the tokens of each block that occur in more than one document of the corpus."""
    heads = rows[rows["size"] < 0]
    rest = rows[rows["size"] >= 0]
    out = list(heads[["block", "shard", "size", "payload"]].itertuples(index=False, name=None))
    if len(rest):
        sizes = rest["size"].to_numpy()
        parts = [unpack(p, n, np.uint64, np.uint32, np.uint32) for p, n in zip(rest["payload"], sizes)]
        token, place, count = (np.concatenate([p[k] for p in parts]) for k in range(3))
        who = np.repeat(np.arange(len(rest)), sizes)
        sets = (place >= OF_SET) & (place != REPEATED)
        order = np.flatnonzero(sets)
        order = order[np.lexsort((rest["block"].to_numpy()[who[order]], count[order], token[order]))]
        t, c = token[order], count[order]
        run = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])]) if len(t) else np.empty(0, np.int64)
        size = np.diff(np.r_[run, len(t)])
        copies = np.repeat(size, size) * 2
        copies[run] += 1  # the first one goes on
        several = np.repeat(size, size) > 1
        set_part = (t[several], place[order][several], who[order][several], copies[several].astype(np.int64))
        token, place, count, who = token[~sets], place[~sets], count[~sets], who[~sets]
        order = np.argsort(token, kind="stable")
        token, place, count, who = token[order], place[order], count[order], who[order]
        run = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)
        df = np.add.reduceat(count.astype(np.int64), run) if len(run) else np.empty(0, np.int64)
        each = np.repeat(df, np.diff(np.r_[run, len(token)]))
        many = each > 1
        token, place, who, each = (np.concatenate((a[many], b)) for a, b in zip((token, place, who, each), set_part))
        order = np.lexsort((token, who))
        token, place, who, each = token[order], place[order], who[order], each[order].astype(np.int64)
        edges = np.searchsorted(who, np.arange(len(rest) + 1))
        names, shards = rest["block"].to_numpy(), rest["shard"].to_numpy()
        for k in range(len(rest)):
            a, b = edges[k], edges[k + 1]
            if b > a:
                out.append((names[k], shards[k], b - a, pack(token[a:b], place[a:b], each[a:b])))
    return pd.DataFrame(out, columns=["block", "shard", "size", "payload"])


def _prefixes(percent: int):
    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        payload = rows.loc[rows["size"] < 0, "payload"].iloc[0]
        size, repeats = np.frombuffer(payload, np.int64, 2)
        at = 16

        def take(kind, n):
            nonlocal at
            a = np.frombuffer(payload, kind, n, at)
            at += a.nbytes
            return a

        ids, null, posts, n = take(np.int64, size), take(bool, size), take(bool, size), take(np.int64, size)
        sig1, sig2 = take(np.uint64, size), take(np.uint64, size)
        own_token, own_place = take(np.uint64, repeats), take(np.uint32, repeats)
        rest = rows[rows["size"] >= 0]
        parts = [unpack(p, k, np.uint64, np.uint32, np.int64) for p, k in zip(rest["payload"], rest["size"])]
        token = np.concatenate([p[0] for p in parts] or [np.empty(0, np.uint64)])
        place = np.concatenate([p[1] for p in parts] or [np.empty(0, np.uint32)])
        df = np.concatenate([p[2] for p in parts] or [np.empty(0, np.int64)])
        of_set = (place >= OF_SET) & (place != REPEATED)
        copies, first = np.ones(size, np.int64), np.ones(size, bool)
        at_set = (place[of_set] & ~OF_SET).astype(np.int64)
        copies[at_set], first[at_set] = df[of_set] >> 1, (df[of_set] & 1) == 1
        token, place, df = token[~of_set], place[~of_set], df[~of_set]
        single = place != REPEATED
        known = np.argsort(token[~single])
        found = known[np.searchsorted(token[~single][known], own_token)] if repeats else np.empty(0, np.int64)
        token = np.concatenate((token[single], own_token))
        df = np.concatenate((df[single], df[~single][found]))
        place = np.concatenate((place[single], own_place)).astype(np.int64)
        elsewhere = df > copies[place]  # in other sets than this one
        token, df, place = token[elsewhere], df[elsewhere], place[elsewhere]
        shared = np.bincount(place, minlength=size)
        active = posts & first & (n > 0) & (100 * shared >= percent * n)
        use = active[place]
        token, df, place = token[use], df[use], place[use]
        quota = np.maximum(prefix_length(n, percent) - (n - shared), 0)
        step = np.floor(np.log2(np.maximum(df, 1)))
        chosen = []
        for k, first in enumerate((df, step, step)):
            order = np.lexsort((mix(token ^ _SALT[k]), first, place))
            p = place[order]
            rank = np.arange(len(p)) - np.searchsorted(p, p)
            got = order[rank < quota[p]]
            chosen.append(np.split(token[got].view(np.int64), np.searchsorted(place[got], np.arange(1, size))))
        order = np.argsort(place, kind="stable")
        whole = np.split(token[order].view(np.int64), np.searchsorted(place[order], np.arange(1, size)))
        block = int(rows["block"].iloc[0])
        lists = {f"p{k}": [c if a else None for c, a in zip(chosen[k], active)] for k in range(ORDERS)}
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(ids.copy(), null.copy()),
            "key": (block << 16) + np.arange(size), "n": n, "sig1": sig1.view(np.int64), "sig2": sig2.view(np.int64),
            "shared": shared, **lists, "tokens": [c if a else None for c, a in zip(whole, active)]})

    return choose


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``label`` (the least identifier reachable) of every end of a link (``a``, ``b``).

    Alternates large and small stars until every node hangs on a root; each step is a few joins and cuts its
    lineage. While there are few edges, the joins broadcast them.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    while True:
        hint = F.broadcast if edges.count() <= BROADCAST_ROWS else (lambda d: d)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (both.join(hint(least), "u").where("v > u and v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(hint(small_min), "u")
                 .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        edges = checkpointed(small)
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")),
                                              F.struct(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))).alias("e"))
        roles = ends.groupBy("e.x").agg(F.sum("e.hangs").alias("hangs"), F.max("e.holds").alias("holds"))
        if not roles.where("hangs > 1 or (hangs = 1 and holds = 1)").limit(1).count():
            break
    return (edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
            .union(edges.select(F.col("v").alias("id"), F.col("v").alias("label"))).distinct())


def _possible(na, nb, sa, sb, percent: int) -> Column:
    """Whether sets of these sizes can reach the threshold with so many tokens left to share."""
    most = F.least(sa, sb)
    return (100 + percent) * most >= percent * (na + nb)


def class_links(classes: DataFrame, percent: int, star_steps: int = 8) -> DataFrame:
    """Verified links ``a``, ``b`` of classes that connect exactly what all links would connect.

    ``classes``: ``rep``, ``n``, ``shared``, prefixes ``p0`` to ``p2`` and ``tokens``. Rows of a bucket carry ``comp``, the
    component of the class by the links found so far, and ``reach``: how many tokens the class can share with another one
    if this token is the first one they share.
    """
    rows = classes.select("rep", "n", "shared", F.posexplode("p0").alias("rank", "token")).select(
        "rep", "n", (F.col("shared") - F.col("rank")).alias("reach"), "token", F.col("rep").alias("comp"))
    links, tested = [], None

    def living(rows: DataFrame) -> DataFrame:
        """Members that could still be linked with one of another component in their bucket."""
        about = rows.groupBy("token").agg(F.min("n").alias("least"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
        rows = (rows.join(about, "token").where("c1 <> c2")
                .where(f"{100 + percent} * reach >= {percent} * (n + least)").drop("least", "c1", "c2"))
        about = rows.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"))
        return rows.join(about, "token").where("c1 <> c2").drop("c1", "c2")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs that pass the prefixes of the other orders and then the threshold itself."""
        def side(end: str) -> DataFrame:
            return classes.select(F.col("rep").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "p1", "p2", "tokens")])

        met = pairs.join(side("a"), "a").join(side("b"), "b")
        met = met.where(F.arrays_overlap("p1_a", "p1_b") & F.arrays_overlap("p2_a", "p2_b"))
        return (met.withColumn("both", F.size(F.array_intersect("tokens_a", "tokens_b")))
                .where((100 + percent) * F.col("both") >= percent * (F.col("n_a") + F.col("n_b"))).select(*pairs.columns))

    def untested(pairs: DataFrame) -> DataFrame:
        return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")

    rows = checkpointed(living(rows))
    linear = 4 * rows.count()  # so many pairs are no more work than the rows themselves
    for step in range(star_steps):
        sizes = rows.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(
            F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("same"))
        left = sizes.agg(F.sum((F.col("m") * F.col("m") - F.col("same")) / 2).alias("pairs")).first()
        if (left["pairs"] or 0) <= linear:
            break
        turn = F.xxhash64("rep", F.lit(step)) if step else F.col("n") - F.col("reach")
        centre = rows.groupBy("token").agg(
            F.min(F.struct(turn.alias("turn"), "rep", "n", "reach", "comp")).alias("c"))
        star = (rows.join(centre, "token").where("comp <> c.comp")
                .where(_possible(F.col("n"), F.col("c.n"), F.col("reach"), F.col("c.reach"), percent))
                .select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b"),
                        F.least("comp", "c.comp").alias("ca"), F.greatest("comp", "c.comp").alias("cb")).distinct())
        star = checkpointed(untested(star))
        tested = star.select("a", "b") if tested is None else tested.union(star.select("a", "b"))
        found = checkpointed(verified(star))
        if not found.take(1):
            break
        links.append(found.select("a", "b"))
        # the components known so far grow together along the new links
        moved = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnRenamed("id", "comp")
        rows = checkpointed(living(rows.join(moved, "comp", "left").withColumn("comp", F.coalesce("label", "comp")).drop("label")))
    x, y = rows.alias("x"), rows.alias("y")
    pairs = (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.rep") < F.col("y.rep"))
                    & (F.col("x.comp") != F.col("y.comp"))
                    & _possible(F.col("x.n"), F.col("y.n"), F.col("x.reach"), F.col("y.reach"), percent))
             .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())
    return reduce(DataFrame.union, links, verified(checkpointed(untested(pairs))))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                       percent: int = 85) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, for sets linked when
    ``100 * |a and b| >= percent * |a or b|``."""
    ident = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(ident, F.lit(0)).alias("doc_id"), ident.isNull().alias("nameless"),
                       F.col(text_col).cast("string").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = 1 << max(6, math.ceil(math.log2(max(chars / 6 / SHARD_TOKENS, 1))))
    found = (rows.mapInPandas(_blocks(words, shards), BLOCK_ROWS)
             .groupBy("shard").applyInPandas(_answer, BLOCK_ROWS)
             .groupBy("block").applyInPandas(_prefixes(percent), CLASS_ROWS))
    found = checkpointed(found)
    same = ["n", "sig1", "sig2"]
    reps = checkpointed(found.where("n > 0").groupBy(*same).agg(
        F.min("doc_id").alias("rep"), F.min(F.when(F.col("p0").isNotNull(), F.col("key"))).alias("key")))
    # classes are told apart by number, since identifiers may be null or repeat
    classes = found.where("p0 is not null").select(
        F.col("key").alias("rep"), "n", "shared", "p0", "p1", "p2", "tokens")
    label = components(class_links(classes, percent))
    joined = reps.join(label, reps.key == label.id, "left")
    least = joined.where("label is not null").groupBy("label").agg(F.min("rep").alias("low"))
    names = joined.join(least, "label", "left").select(*same, F.coalesce("low", "rep").alias("component"))
    out = found.select("doc_id", *same).join(names, same, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
