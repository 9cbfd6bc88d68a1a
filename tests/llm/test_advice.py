"""Cases of the second review: each failed before its finding was settled."""

import datetime as dt
import os
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P  # noqa: E402
from test_pairs import shingles  # noqa: E402
from tickloom.llm import chat, htmllstm, langmask  # noqa: E402
from tickloom.llm.catalog import QUERIES  # noqa: E402
from tickloom.llm.more_queries import with_probe  # noqa: E402
from tickloom.streaming import live  # noqa: E402

SF = "/root/testdata/sf0.001"


# --- near copies of the pipeline ---------------------------------------------------------------

def near_kept(rows, words=5, percent=80):
    """Identifiers that are the least of their group."""
    sets = [(i, shingles(t, words)) for i, t in rows]
    by = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for members in by.values() for a in members for b in members if a < b}:
        x, y = sets[a][1], sets[b][1]
        if 100 * len(x & y) >= percent * len(x | y):
            parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted(low.values())


def test_near_stage_takes_five_words_and_four_fifths(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = near_kept(rows)
    assert len(want) == 922 and len(near_kept(rows, 4, 85)) == 925
    assert sorted(r.doc_id for r in P.near(spark, docs, "").collect()) == want


# --- chat examples -----------------------------------------------------------------------------

def whole_examples(turns):
    """(text, loss start, loss end) of every reply, each with all turns before it."""
    out, context = [], ""
    for role, text in turns:
        turn = f"<|turn|>{chat.escape_role(role)}\n{chat.escape(text)}<|end|>\n"
        if role == "assistant":
            start = len(context) + len("<|turn|>assistant\n")
            out.append((context + turn, start, start + len(chat.escape(text))))
        context += turn
    return out


def test_examples_are_written_with_their_context(spark):
    df = with_probe(spark.read.parquet(f"{SF}/conversations.parquet"))
    by = {}
    for r in df.orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    want = {c: whole_examples(t) for c, t in by.items()}
    got = {}
    for r in chat.written(df).where("loss_end < n_chars").orderBy("conv_id", "example").collect():
        got.setdefault(r.conv_id, []).append((r.text, r.loss_start, r.loss_end))
    assert got == {c: e for c, e in want.items() if e} and max(map(len, got.values())) > 2
    for r in QUERIES["op7_prefix_examples"](spark, SF).collect():
        assert (r.n_examples, r.formatted_chars) == (len(want[r.conv_id]), sum(len(t) for t, _, _ in want[r.conv_id]))


def test_written_and_stored_examples_read_alike(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"turn {i} " * (i + 1)) for i in range(60)]
    rows += [(2, 0, "user", "alone"), (3, None, "assistant", "no turn"), (3, 0, "user", "q"), (3, 1, "assistant", ""), (3, 2, "user", "last"),
             (None, 0, "user", "q"), (None, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(map(tuple, chat.read_written(chat.written(df)).collect()), key=repr)
    assert whole == sorted(map(tuple, chat.read_back(chat.prefix_examples(df)).collect()), key=repr)
    assert {r[0]: (r[1], r[6]) for r in whole} == {1: (60, 30), 2: (1, 0), 3: (4, 2), None: (2, 1)}
    examples = chat.written(df)
    with_gap = examples.withColumn("text", examples.text.substr(5, 10 ** 6))
    try:
        chat.read_written(with_gap).collect()
        raise AssertionError("a cut context passed")
    except Exception as e:
        assert "without its context" in str(e) or "outside of turns" in str(e)


# --- languages ---------------------------------------------------------------------------------

def test_words_of_one_letter_and_rare_scripts(spark):
    learn = spark.createDataFrame([("en", "I saw a thing that was a thing " * 20), ("fr", "une chose que les autres choses " * 20),
                                   ("got", "\U00010330\U00010331\U00010332 \U00010333\U00010334 " * 20)], "lang string, text string")
    masks = langmask.learn(learn)
    assert masks.langs == ["en", "fr", "got"]
    texts = ["A.", "I", "x 1 y", "\U0001F600\U0001F680 \U0001F600", "\u2022 \U0001F600\U0001F600\U0001F600\U0001F600", "\U00010333\U00010334", "7", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langmask.identify(df, masks).collect()}
    assert [got[i][0] for i in (0, 1, 5)] == ["en", "en", "got"] and got[0][1] > 0.9 and got[1][1] > 0.9
    assert got[2][0] != "und" and [got[i] for i in (3, 4, 6, 7)] == [("und", 0.0)] * 4


def test_cells_do_not_depend_on_the_text_before():
    alone = [langmask.cells_of([t])[0].tolist() for t in ("one two", "a", "b c")]
    cells, doc = langmask.cells_of(["one two", "a", None, "b c"])
    assert [sorted(cells[doc == i].tolist()) for i in (0, 1, 3)] == [sorted(a) for a in alone] and all(alone)


# --- rows of the duplicate stages --------------------------------------------------------------

COPY = "some words of a text that was loaded more than one time by some job or other"
DUPLICATES = [(4, COPY), (4, COPY), (3, COPY + " end"), (3, "quite another text under the same number as the first one"), (None, COPY),
              (None, "nobody named this one"), (None, "nobody named this one"), (9, COPY), (1, ""), (2, None)]


def stage_rows(spark, stage, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, df.repartition(3).checkpoint(), "")
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_one_row_of_equal_texts_stays(spark):
    got = stage_rows(spark, P.exact, DUPLICATES)
    assert got == sorted([(4, COPY), (3, COPY + " end"), DUPLICATES[3], DUPLICATES[5], (1, "")], key=repr)


def test_one_row_of_linked_texts_stays(spark):
    got = stage_rows(spark, P.near, DUPLICATES)
    assert got == sorted([(3, COPY + " end"), DUPLICATES[3], DUPLICATES[5], (1, ""), (2, None)], key=repr)


def test_a_table_loaded_twice_is_left_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (P.exact, P.near):
        once = sorted((r.doc_id for r in stage(spark, docs, SF).collect()))
        twice = stage(spark, docs.union(docs).checkpoint(), SF).where("text <> ''")
        assert sorted(r.doc_id for r in twice.collect()) == once


# --- page text ---------------------------------------------------------------------------------

def block_texts(page):
    return [t for _, t, _ in htmllstm.blocks(page)]


def test_silent_elements_end_where_they_end():
    article = "<article><p>All of the article.</p></article>"
    assert block_texts(f'<nav><svg class="i"/>Menu</nav>{article}') == ["Menu", "All of the article."]
    assert block_texts(f"<nav><SVG class=i />Menu</nav>{article}<svg><path d='x'/>no</svg>") == ["Menu", "All of the article."]
    assert block_texts(f"<nav><math/>Menu</nav>{article}") == ["Menu", "All of the article."]
    assert block_texts(f"<noscript><iframe src=x></iframe>no</noscript>{article}") == ["All of the article."]
    assert block_texts(f"<script>'</style>' no</script>{article}<svg><title>no</title>no</svg>") == ["All of the article."]
    assert block_texts("<title-x>yes</title-x><object-list>two</object-list><title>no</title>") == ["yes", "two"]


def test_formulas_are_text():
    page = ("<p>So <math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow>"
            "<annotation encoding='application/x-tex'>E=mc^2</annotation></semantics></math> holds.</p>")
    assert block_texts(page) == ["So E=mc2 holds."]
