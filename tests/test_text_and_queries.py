from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.joins import contains_pairs
from marginalia.operators import queries as Q


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_tokens_keep_path_marks(spark):
    assert one(spark, T.tokenize("t"), t="The memory. Apps/Host_v2-x, ÄÖ é!") == ["the", "memory.", "apps/host_v2-x"]


def test_catalog_tokens_drop_stop_words_and_repeats(spark):
    assert one(spark, T.catalog_tokens("t"), t="Use the API for a review: api x Review") == ["api", "review"]


def test_trigrams_and_slugs(spark):
    assert one(spark, T.trigrams("t"), t="routes") == ["rou", "out", "ute", "tes"]
    assert one(spark, T.trigrams("t"), t="ab") == ["ab"]
    assert one(spark, T.slugify("t"), t="  Hello, World -- 2!  ") == "hello-world-2"
    assert one(spark, T.slugify("t", "board"), t="It's (a) Plan: now") == "its-a-plan-now"


def test_excerpt_window_and_marks(spark):
    body = "x " * 150 + "needle here " + "y " * 150
    got = one(spark, T.excerpt(F.col("t"), F.col("q")), t=body, q="the needle")
    assert got.startswith("... ") and got.endswith(" ...") and "needle" in got
    assert one(spark, T.excerpt(F.col("t"), F.col("q")), t=body, q="zz").endswith("\n...[truncated]")


def test_substantive_needs_forty_characters_of_prose(spark):
    assert one(spark, T.is_substantive("t"), t="Source: a\n\n## Goal\n\n" + "w" * 40) is True
    assert one(spark, T.is_substantive("t"), t="Source: a\n\n## A very long heading that does not count at all\n\nshort") is False


def test_contains_pairs_equals_brute_force(spark):
    hays = ["bobcat dogs run", "concatenate this", "a-b... c", "the cat dog and bird", "", "rock'n'roll", "xx cat", "cat"]
    needles = ["cat dog", "cat", "...", "dog and", "ten", "n'r", "a-b", "d b", " cat", "cat ", "zzz", "t"]
    h = spark.createDataFrame(list(enumerate(hays)), "hid int, hay string")
    n = spark.createDataFrame(list(enumerate(needles)), "nid int, needle string")
    got = {(r.hid, r.nid) for r in contains_pairs(h, n, "hid", "nid").collect()}
    assert got == {(i, j) for i, a in enumerate(hays) for j, b in enumerate(needles) if b in a}


def plan(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    return {r.query: r for r in Q.plan_queries(df).collect()}


def test_intents_and_preferred_types(spark):
    p = plan(
        spark, "What should we build for typed memory?", "recent session todo", "next task please",
        "how does the command work", "who owns routing", "archived plan", "plain words",
    )
    assert p["What should we build for typed memory?"].intent == "implementation"
    assert p["What should we build for typed memory?"].preferred_types == ["spec", "todo"]
    assert p["recent session todo"].intent == "session"
    assert p["next task please"].intent == "task"
    assert p["how does the command work"].intent == "reference" and not p["how does the command work"].use_graph
    assert p["who owns routing"].intent == "architecture"
    assert p["archived plan"].excluded_statuses == [] and p["archived plan"].allow_archived
    assert p["plain words"].intent == "general" and p["plain words"].variants == []


def test_variants_are_phrase_then_suffixes(spark):
    p = plan(spark, "Build  the Plan, build!")
    assert p["Build  the Plan, build!"].variants == [
        "build the plan", "build the plan implementation spec", "build the plan remaining tasks"]


def test_workflow_classes(spark):
    df = spark.createDataFrame([("We decided to keep it",), ("compare options",), ("hello",), ("define glossary",)], "input string")
    got = [(r.request_intent, r.expected_note_type) for r in Q.classify_inputs(df).collect()]
    assert got == [("make_decision", "architecture-record"), ("investigate", "investigation"),
                   ("answer_question", "reference"), ("answer_question", "glossary")]


def test_catalog_expansion(spark):
    df = spark.createDataFrame([("CI reviewers testing",)], "query string")
    r = Q.expand_catalog_query(df).first()
    assert r.expanded_tokens == ["ci", "continuous", "integration", "pipeline", "reviewers", "review", "reviewer", "testing", "test"]
    assert r.has_synonym and r.has_morphology
