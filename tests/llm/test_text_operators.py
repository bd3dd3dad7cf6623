"""Chat windows, pieces, extraction, URL filters and license scans against plain versions and edge cases."""

import hashlib
import html as entities
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import chat, html, licenses, pieces, urls

SF = "/root/testdata/sf0.001"
EMPTY = {"docs": "doc_id long, text string, lang string", "pages": "page_id long, url string, html string", "turns": "conv_id long, turn long, role string, text string"}


def empty(spark, kind):
    return spark.createDataFrame([], EMPTY[kind])


# --- chat ---------------------------------------------------------------------


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", r"<\s>[\\INST] <\\/s>", "<", "[", "a<s", "\\", "", "<s><s>[/INST]\n"])
def test_escapes_come_back(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not re.search(r"</?s>|\[/?INST\]", chat.escape(text))
    assert chat._unrole(chat._role(text + "\n\\n")) == text + "\n\\n"
    for role in ("user", "assistant", text):
        assert chat.parse(chat.render(role, text)[0]) == [(role, text)]


def test_windows_respect_the_budget_and_target_each_text_once():
    turns = [("system", "s " * 5)] + [(("user", "assistant")[i % 2], f"w{i} " * (3 + 7 * i % 11)) for i in range(40)]
    made = list(chat.windows_of(iter(turns), 40, 2))
    assert len(made) > 5
    seen, targets = [], []
    for number, (window, text, loss, repeated) in enumerate(made):
        mine = chat.parse(text)
        assert window == number and sum(chat.n_tokens(t) for _, t in mine) <= 40
        if number > 1:
            assert mine[0] == turns[0] and mine[1:repeated] == seen[-2:]
        seen += mine[repeated:]
        targets += [chat.unescape(text[s["start"]:s["end"]]) for s in loss]
    assert seen == turns and targets == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize("system", [True, False])
def test_windows_over_the_budget_are_single_turns(system):
    rng = random.Random(3)
    turns = [("system", "s " * 20)] * system + [(("user", "assistant")[i % 2], f"w{i} " * rng.choice([0, 3, 30, 60, 99, 100, 101, 300])) for i in range(200)]
    seen = []
    for number, (_, text, _, repeated) in enumerate(chat.windows_of(iter(turns), 100, 2)):
        mine = chat.parse(text)
        total = sum(chat.n_tokens(t) for _, t in mine)
        assert total <= 100 or (len(mine) == 1 and repeated == 0)
        own = mine[repeated:]
        # What is repeated: the system turn and the end of the history, and one turn more would not fit.
        history = seen[system:][-2:] if number else []
        kept = mine[1:repeated] if system and repeated else mine[:repeated]
        assert kept == history[len(history) - len(kept):]
        if len(kept) < len(history):
            left = ([turns[0]] if system else []) + history[len(history) - len(kept) - 1:]
            assert sum(chat.n_tokens(t) for _, t in [*left, own[0]]) > 100
        seen += own
    assert seen == turns


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_no_given_window_exceeds_the_budget(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    for r in chat.format_conversations(turns).collect():
        mine = chat.parse(r.text)
        assert sum(chat.n_tokens(t) for _, t in mine) <= chat.BUDGET or len(mine) == 1


def test_chat_edge_rows(spark):
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 0, "assistant", "x" * 70_000), (1, 0, "assistant", "x" * 70_000), (2, 1, "user", ""), (2, 0, "tool", "é𝄞")]
    frame = spark.createDataFrame(rows, EMPTY["turns"]).withColumn("window", F.lit(1)).withColumn("loss", F.lit("x"))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(frame, budget=3)).collect()}
    assert set(got) == {None, 1, 2} and got[1].n_turns == 3 and got[1].loss_chars == 140_000
    assert got[2].turns_sha256 == hashlib.sha256("tool\né𝄞\nuser\n\n".encode()).hexdigest()
    assert chat.digests(chat.format_conversations(empty(spark, "turns"))).count() == 0


# --- pieces -------------------------------------------------------------------

TEXTS = [None, "", " ", "   ", "a", "  The  étion\n ththé. 𝄞x", "hello" * 60, "(x)... \"foo\" 1,234.5 don't", "日本語\t\ttab", "ñ" * 300]


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary here")
def test_pieces_equal_a_plain_pass_and_come_back(spark):
    vocab = pieces.load()
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "a b"), (1, "")], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("block", F.lit(2))
    coded = pieces.encode(docs, vocab)
    rows = coded.collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.round_trip for r in rows)
    for r in rows:
        text = "a b" if r.doc_id is None else TEXTS[r.doc_id]
        assert r.ids == pieces.viterbi(pieces.normalised(text, True), vocab) and r.n_pieces == len(r.ids)
    back = {r.doc_id: r.text for r in pieces.decode(coded, vocab).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert pieces.encode(empty(spark, "docs"), vocab).count() == 0


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary here")
def test_pieces_of_a_bucket_and_what_is_shuffled(spark):
    """Best paths of many words at once are those of the plain pass, and a block's word numbers are never shuffled."""
    vocab, rng = pieces.load(), np.random.default_rng(4)
    words = ["".join(rng.choice(list("aeinrst▁\u00e9\u4e16\U0001f9ff\x02"), n)) for n in rng.integers(1, 40, 300)]
    lattice = pa.array([[end << 48 | start << 32 | hit for start in range(len(w)) for end in range(start + 1, len(w) + 1)
                         if (hit := vocab.pieces.get(w[start:end], (pieces.NO_PIECE if end == start + 1 else None,))[0]) is not None][::-1] for w in words], pa.list_(pa.int64()))
    ids, n = pieces.best_paths(words, lattice, vocab)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [pieces.viterbi(w, vocab) for w in words]
    docs = spark.createDataFrame([(i, f"some words {i} " + "long" * 60) for i in range(9)], "doc_id long, text string")
    coded = pieces.encode(docs, vocab)
    assert sorted(r.ids for r in coded.collect()) == sorted(pieces.viterbi(pieces.normalised(r.text, True), vocab) for r in docs.collect())
    exchanges = [x for x in coded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Exchange hashpartitioning" in x]
    assert 0 < len(exchanges) <= 3  # words up, once more in the plan as the same exchange, ids back


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary here")
def test_partitions_that_look_alike_keep_their_words(spark):
    vocab = pieces.load()
    one = lambda i, t: spark.createDataFrame([(i, t)], "doc_id long, text string").coalesce(1)
    texts = ["alpha beta gamma", "red green blue", "alpha beta gamma"]
    docs = one(None, texts[0]).union(one(None, texts[1])).union(one(None, texts[2])).union(one(1, "same words here")).union(one(1, "same words here"))
    got = sorted(r.ids for r in pieces.encode(docs, vocab).collect())
    assert got == sorted(pieces.viterbi(pieces.normalised(t, True), vocab) for t in [*texts, "same words here", "same words here"])


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary here")
def test_paths_are_as_good_as_the_library_finds_with_the_same_scores():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    vocab, model = pieces.load(), pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = vocab.pieces.get(p.piece, (0, p.score))[1]
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    score = lambda ids: sum(vocab.pieces[vocab.texts[i]][1] for i in ids)
    for word in "the with hest international organisation unbelievably thereandthere Python étion".split():
        assert score(pieces.viterbi(pieces.BLANK + word, vocab)) == pytest.approx(score(library.nbest_encode_as_ids(word, 1)[0]), abs=1e-3)


# --- html ---------------------------------------------------------------------


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 10))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        flags = html.shared_lines(a, b)
        rest = iter(b)
        assert sum(flags) == table[-1][-1] and all(x in rest for x, f in zip(a, flags) if f)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p>a", "a"), ("a < b", "a < b"), ("<script>x", ""),
    ('<div>x<span class="ad">junk</span>y</div><p hidden>z', "xy"),
    ("<article><header>H</header><p>T&nbsp;x &lt;  y<ul><li>1<li>2</ul><div class=comments><p>c</div></article><p>after", "T x < y\n1\n2"),
    ("<main>m<aside>q</aside><p>n</main><form>f</form>", "m\nn"),
    ("<nav>" * 300 + "x", ""),
])
def test_main_text_of_single_pages(page, text):
    assert html.main_text(html.lines(page), []) == text


def test_pages_of_the_tables(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html.extract(pages).collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1])
        want = [" ".join(entities.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)


def test_lines_of_neighbours_go_copies_stay(spark):
    body = lambda k, i: f"<body><div>Welcome to {k}</div><p>Own text {i} of site {k}</p><p>More of {i * 7}</p><div>Legal {k}</div>"
    rows = [(100 * k + i, f"http://h{k}.com/a/{i:03d}", body(k, i)) for k in range(2) for i in range(20)]
    rows += [(900, "http://h0.com/a/005", body(0, 5)), (None, None, None), (901, "http://solo.com/x", "<p>only</p>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, EMPTY["pages"]).withColumn("part", F.lit("x")).repartition(5)).collect()}
    assert len(got) == len(rows) and got[None] == "" and got[901] == "only"
    assert all(t == f"Own text {i % 100} of site {i // 100}\nMore of {i % 100 * 7}" for i, t in got.items() if i is not None and i < 900)
    assert html.extract(empty(spark, "pages")).count() == 0


def test_differencing_decides_beside_an_article():
    page = lambda i: html.lines(f"<div>Site of all</div><article><p>Story {i} with its own words</p><p>To be continued</p></article><p>Card of story {i} only</p><div>Legal</div>")
    assert html.main_text(page(1), [page(0), page(2)]) == "Story 1 with its own words\nTo be continued\nCard of story 1 only"
    assert html.main_text(page(1), [page(1)]) == html.main_text(page(1), []) == "Story 1 with its own words\nTo be continued"


# --- urls ---------------------------------------------------------------------


def test_rules_and_parts(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://Foo.Net/x?y"), (4, "http://example.net/en/"), (5, "http://xexample.net/en/1"), (6, "x://y://z/a#b"), (7, "http://org/fr/x"), (8, "http://A.NET")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(0)).withColumn("value", F.lit(0))).collect()}
    assert (got[1].host, got[1].path, got[1].verdict) == ("", "", "block") and got[2].host == ""
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("foo.net", "/x", "net/", "block")
    assert got[4].rule == "example.net/en/" and got[4].verdict == "allow" and got[5].rule == "net/"
    assert (got[6].host, got[6].path) == ("y:", "//z/a") and got[7].rule == "org/fr/" and got[8].rule is None
    assert urls.judge(empty(spark, "pages")).count() == 0


def test_models_sum_to_one_and_tell_hosts_apart(spark):
    import numpy as np

    p = np.exp(urls.log_probabilities(np.bincount(urls.grams("news.example.com/a"), minlength=urls.SYMBOLS**4).astype(float)))
    assert np.allclose(p.reshape(-1, urls.SYMBOLS).sum(axis=1), 1)
    good, bad = [f"http://garden{i}.example.org/page/{i}" for i in range(200)], [f"http://casino-win{i}.example.org/page/{i}" for i in range(60)]
    unseen = ["http://casinowinner.example.org/page/3", "http://gardening.example.org/page/3"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad + unseen)], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert [got[i].verdict for i in (0, 210, 261)] == ["allow", "block", "allow"]
    assert got[210].value < got[260].value < got[261].value  # unseen hosts fall on their side


# --- licenses -----------------------------------------------------------------


def test_every_template_is_found_and_clean_text_is_not():
    scanner = licenses.Scanner()
    for label, text in licenses.TEMPLATES:
        assert label in scanner.scan(f"foo bar {text.upper()}. baz")["labels"].split(",")
    assert scanner.scan("the software is in the public domain of any version and use")["labels"] == ""
    edited = scanner.scan("Permission is hereby granted, without charge, to any person obtaining a copy of this software and associated docs files to deal")
    assert edited["labels"] == "mit" and 0 < edited["score"] < 1


def test_matching_statistics_equal_a_plain_search():
    rng = random.Random(3)
    for _ in range(60):
        sequences = [[bytes([97 + rng.randrange(3)]) for _ in range(rng.randint(1, 9))] for _ in range(3)]
        text = [bytes([97 + rng.randrange(3)]) for _ in range(30)]
        pieces_of = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for end, length, _ in licenses.Automaton(sequences).matches(text, [(0, len(text))]):
            assert length == max((n for n in range(1, end + 1) if tuple(text[end - n:end]) in pieces_of), default=0)


def test_license_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "MIT License mit license"), (3, "MIT. \nLicense é" + " x" * 50_000), (3, "a GNU General-Public License")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("z"))).collect()
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [
        (0, None, None, ""), (0, None, None, ""), (2, 0, 2, "mit"), (1, 0, 0, "mit"), (1, 2, 2, "gpl")]
    assert licenses.scan(empty(spark, "docs")).count() == 0
