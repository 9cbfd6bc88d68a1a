"""Phrases, url words and hard negatives against brute force, and their edge rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import collocations as C
from tickloom.llm import hardneg as H
from tickloom.llm import urlwords as U


# --- phrases -----------------------------------------------------------------------------------

def pieces(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in ".,;:!?\n\x0b\x0c\r":
        text = text.replace(c, "\n")
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in text.split("\n")]


def phrases_brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for p in pieces(text):
            n[lang or "und"] += len(p)
            for m in range(1, 6):
                f[lang or "und"].update(tuple(p[i:i + m]) for i in range(len(p) - m + 1))
    out = []
    for lang, c in f.items():
        scored = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in c.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(n=60, seed=5):
    r = np.random.default_rng(seed)
    words = np.array(["a", "A", "of", "the", "end", "é", "ß", "\u2028", "red-hot", "x" * 40, "B", "\x00", "of"])
    gaps = np.array([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; ", "\r"])
    return ["".join(w + g for w, g in zip(r.choice(words, k), r.choice(gaps, k))) for k in r.integers(0, 80, n)]


@pytest.mark.parametrize("shard,width", [(C.SHARD, C.RANGE), (300, 400), (40, 150)])
def test_phrases_like_brute_force(spark, monkeypatch, shard, width):
    monkeypatch.setattr(C, "RANGE", width)
    monkeypatch.setattr(C, "HELD", 50)
    rows = [(("en", "de", None)[i % 3], t) for i, t in enumerate(texts())]
    rows += [("en", "one two three four five six " * 50), ("en", "never, twice"), ("en", None), (None, ""), ("fr", "! .")]
    rows += [("de", "same text twice")] * 3
    df = spark.createDataFrame([(*r, 1, "z", 0) for r in rows], "lang string, text string, n int, phrase string, rank int")
    got = sorted(map(tuple, C.collocations(df.repartition(5), least=3, top=15, shard=shard).collect()))
    assert got == phrases_brute(rows, 3, 15)


def test_phrases_of_a_text_without_an_end(spark):
    rows = [("en", "to be or not " * 3000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, C.collocations(df, shard=1000).collect())) == phrases_brute(rows, 100, 2000)


def test_no_phrases(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(df).count() == 0
    assert C.collocations(spark.createDataFrame([("en", None), (None, "a")], "lang string, text string")).count() == 0


def test_parts_cover_a_text():
    r = np.random.default_rng(1)
    for _ in range(300):
        text = bytes(r.choice(list(b"ab  \n"), r.integers(0, 120)))
        whole = Counter()
        for part, overlaps in C.parts_of(text, int(r.integers(8, 40))):
            words, rows = C.windows_of(part, overlaps)
            whole.update(tuple(words[i - 1] for i in w if i) for w in rows.tolist())
        words, rows = C.windows_of(text)
        assert whole == Counter(tuple(words[i - 1] for i in w if i) for w in rows.tolist())


def test_automata_unite_and_compose():
    r = np.random.default_rng(2)
    united, want = C.Union(), Counter()
    for _ in range(5):
        words, rows = C.windows_of(" ".join(r.choice(["a", "b", "cc", "\n"], 200)).encode())
        rows, n = C.collapsed(rows, None, len(words))
        one = C.Automaton.build(words, rows, n)
        back = C.Automaton.paths(one.to_bytes())
        assert back[0] == words and sorted(zip(map(tuple, back[1].tolist()), back[2].tolist())) == sorted(
            zip(map(tuple, rows.tolist()), n.tolist()))
        united.add(one.to_bytes())
        for w, k in zip(rows.tolist(), n.tolist()):
            path = tuple(words[i - 1] for i in w if i)
            for d in range(1, len(path) + 1):
                want[path[:d]] += k
    rows, n = united.unite()
    words = list(united.number)
    whole = C.Automaton.build(words, rows, n)
    asked = [*want, (b"a", b"zz"), (b"zz",), (b"a",) * 4]
    number = {w: i for i, w in enumerate(words, 1)}
    paths = np.zeros((len(asked), 5), np.int64)
    for i, p in enumerate(asked):
        paths[i, :len(p)] = [number.get(w, -1) for w in p]
    assert whole.compose(paths).tolist() == [want[p] for p in asked]


# --- urls --------------------------------------------------------------------------------------

def test_url_parts_and_rules(spark):
    rows = [(1, "HTTP://Www.Example.NET/en/x?y#z"), (2, None), (3, "example.net/en/"), (4, "https://net/"),
            (5, "a://example.com/de/ä?://q"), (6, "://x.org/fr/"), (7, "http://org"), (8, "http://myexample.net/en/1"),
            (9, "http://example.com?/de/"), (10, "x\ny://Ä.net:80/"), (11, ""), (12, "https://a.example.com/de")]
    df = spark.createDataFrame([(i, u, "", "h", "r") for i, u in rows], "page_id int, url string, html string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judged(df).collect()}
    assert got == {
        1: ("www.example.net", "/en/x", "example.net/en/", "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
        4: ("net", "/", "net/", "block"), 5: ("example.com", "/de/ä", "example.com/de/", "block"),
        6: ("x.org", "/fr/", "org/fr/", "allow"), 7: ("org", "", None, "allow"),
        8: ("myexample.net", "/en/1", "net/", "block"), 9: ("example.com", "", None, "allow"),
        10: ("Ä.net:80", "/", None, "allow"), 11: ("", "", None, "allow"), 12: ("a.example.com", "/de", None, "allow")}


def split_brute(name, counts, total):
    """All splits into known words and unknown runs; no two unknown runs meet."""
    price, best = math.log(max(total, 2)), (math.inf, None)

    def go(at, cost, words, unknown):
        nonlocal best
        if at == len(name):
            best = min(best, (cost, words))
        for end in range(at + 1, len(name) + 1):
            w = name[at:end]
            if w in counts:
                go(end, cost + price - math.log(counts[w]), words + [w], False)
            if not unknown:
                go(end, cost + price + U.UNKNOWN_LETTER * len(w), words + [w], True)

    go(0, 0.0, [], False)
    return best


def test_viterbi_like_brute_force(spark):
    r = np.random.default_rng(3)
    counts = {"a": 40, "ab": 30, "b": 5, "abc": 2, "ca": 9, "cc": 1}
    total = 1000
    names = {"".join(r.choice(list("abcd"), r.integers(1, 9))) for _ in range(60)}
    for name in names:
        cells = [(i, s, counts[name[i:i + s]]) for i in range(len(name)) for s in range(1, 4) if name[i:i + s] in counts]
        words = U.viterbi(name, cells, total)
        cost, _ = split_brute(name, counts, total)
        price = math.log(total)
        options = [sum(price - math.log(counts[w]) if known else price + U.UNKNOWN_LETTER * len(w)
                       for w, known in zip(words, kind)) for kind in [[w in counts for w in words]]]
        assert "".join(words) == name and min(options) == pytest.approx(cost)


def test_names_are_split_and_judged(spark):
    text = "<p>cheap things and heads of the garden, " + "garden the of and heads cheap " * 30 + "</p>"
    rows = [(i, f"http://www.cheappills{i % 3}.example.com/en/{i}", text) for i in range(9)]
    rows += [(100 + i, f"http://{h}.example.com/en/{i}", text) for i in range(40) for h in ("thegarden", "gardenheads")]
    rows += [(300, "http://cheap-garden.example.com/", None), (301, "http://www.cheap-pills-of-the-heads.example.org/", ""),
             (None, None, None), (302, "http://" + "garden" * 3000 + ".example.com/", "x" * 100_000), (302, "x://a", "<" * 1000)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    out = U.judged(df).collect()
    assert len(out) == len(rows)
    bad = {r["page_id"] for r in out if r["verdict"] == "block"}
    assert bad == {*range(9), 301}
    names = df.sparkSession.createDataFrame([("cheappills",), ("gardenheads",), ("zqgarden",)], "name string")
    words = U.page_words(df).unionByName(spark.createDataFrame([("pills", 3)], "word string, n long"))
    got = {r["name"]: r["words"] for r in U.segmented(names, words).collect()}
    assert got == {"cheappills": ["cheap", "pills"], "gardenheads": ["garden", "heads"], "zqgarden": ["zq", "garden"]}


def test_no_pages(spark):
    assert U.judged(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


def test_frequent_names_take_the_other_way(spark, monkeypatch):
    rows = [(i, f"http://{'spam' if i % 5 == 0 else 'garden'}{'abc'[i % 3]}.example.com/en/{'x' * (i % 4)}", "the garden") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    want = sorted(map(tuple, U.judged(df).collect()))
    monkeypatch.setattr(U, "FREQUENT", 4)
    assert sorted(map(tuple, U.judged(df).collect())) == want


# --- hard negatives ----------------------------------------------------------------------------

def negatives_brute(rows, every):
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
          if i is not None and lab is not None and v is not None and all(x is not None and abs(x) <= 2 ** 20 for x in v)]
    dim = max((len(v) for _, _, v in ok), default=0)
    ok = [(i, lab, np.array(v + [0] * (dim - len(v)), object)) for i, lab, v in ok]
    out = []
    for a, (name, lab, q) in enumerate(ok):
        if name % every:
            continue
        scores = sorted((-int(sum(q * v)), i, k) for k, (i, _, v) in enumerate(ok) if k != a)
        for s, pos, _ in [x for x in scores if ok[x[2]][1] == lab][:5]:
            window = [x for x in scores if ok[x[2]][1] != lab and -50 * s <= -100 * x[0] <= -95 * s]
            out += [(name, pos, rank, neg, -s, -t) for rank, (t, neg, _) in enumerate(window[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,scale", [(512, 1.0), (7, 1.0), (16, 300.0)])
def test_negatives_like_brute_force(spark, monkeypatch, least, scale):
    monkeypatch.setattr(H, "LEAST_BLOCK", least)
    monkeypatch.setattr(H, "FIRST_DEPTH", 2)
    r = np.random.default_rng(4)
    centre = r.normal(size=(3, 6))
    rows = [(i, int(r.integers(0, 4)), (scale * (centre[i % 3] + 0.4 * r.normal(size=6))).round(2).tolist()) for i in range(200)]
    rows += [(500 + i, 2, [0.5, 0.25, 0.0, 0.0, 0.5, 0.5]) for i in range(12)] + [(600 + i, 1, [0.5, 0.25, 0.0, 0.0, 0.5, 0.5]) for i in range(5)]
    rows += [(40, 2, rows[40][2]), (None, 1, [1.0] * 6), (701, None, [1.0] * 6), (702, 1, None), (703, 1, [None] * 6),
             (704, 1, [math.nan] * 6), (705, 1, [math.inf] * 6), (700, 1, [1e30] * 6), (710, 1, [0.0] * 6), (720, 3, []), (730, 0, [1.0, 2.0])]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], "vec_id long, label int, embedding array<double>, row int, score string")
    got = sorted(map(tuple, H.hard_negatives(df.repartition(3), F.col("vec_id") % 10 == 0).collect()))
    assert got == negatives_brute(rows, 10)


def test_no_negatives(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert H.hard_negatives(empty, F.col("vec_id") % 50 == 0).count() == 0


def test_search_stops_early():
    r = np.random.default_rng(6)
    q = r.integers(-5, 6, (4000, 3))
    q[:20] *= 60
    lists = H.Lists(np.arange(4000), np.arange(4000), np.zeros(4000, int), q)
    anchor = np.array([3, -2, 0])

    def enough(places, scores, threshold):
        return len(scores) >= 5 and threshold < np.sort(scores)[-5]

    places, scores = lists.search(anchor, enough)
    assert len(places) < 1000
    assert sorted(scores)[-5:] == sorted(q @ anchor)[-5:]
