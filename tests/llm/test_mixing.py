"""The source mix: targets, schedule and words taken against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm import mixing


def docs_of(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("size", "si", "block", "bucket", "number"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def fair(words, weights, repeats=3):
    """Targets by repeated sharing: what full sources leave goes to the open ones by weight."""
    target, full, budget = dict.fromkeys(words, 0.0), set(), float(sum(words.values()))
    while True:
        open_ = [s for s in words if s not in full]
        left = budget - sum(target[s] for s in full)
        for s in open_:
            target[s] = left * weights[s] / sum(weights[x] for x in open_)
        over = [s for s in open_ if target[s] > repeats * words[s]]
        if not over:
            return target
        for s in over:
            target[s] = float(repeats * words[s])
            full.add(s)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 90)), rng.choice(["b", "b", "b", "b", "a", "é", None])) for i in range(600)]
    rows += [(700, None, "a"), (None, "x\x0by  z", "a"), (None, "x\x0by  z", "a"), (5, "again " * 70, "b"), (5, "again " * 70, "b"), (701, "", "wordless"), (702, "huge " * 9000, "huge"),
             (703, "one two", "tiny"), (704, "\x85 \t", "tiny")]
    m = mixing.mix(docs_of(spark, rows), block=64)
    return rows, m, m.sources.toPandas(), m.schedule.toPandas()


def test_targets_share_by_weight_and_stop_at_three_times_the_size(mixed):
    rows, _, sources, _ = mixed
    order = ["a", "b", "huge", "tiny", "wordless", "é", None]
    assert [None if s != s else s for s in sources.sort_values("si").source] == order
    words = {s: sum(len((t or "").replace("\x0b", " ").replace("\t", " ").split(" ")) - (t or "").replace("\x0b", " ").replace("\t", " ").split(" ").count("") for _, t, x in rows if x == s) for s in order}
    want = fair(words, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    got = {None if r.source != r.source else r.source: r for r in sources.itertuples()}
    for s in order:
        assert got[s].words == words[s] and got[s].target == pytest.approx(want[s]) and got[s].quota == int(got[s].target)
    assert got["tiny"].target == 9 and got["wordless"].target == 0 and got["huge"].target < got["huge"].words


def test_words_taken_meet_targets_and_no_document_is_overused(mixed):
    rows, m, sources, _ = mixed
    got = mixing.taken(m, 64).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    assert sorted(zip(got.source_size, got.target)) == sorted((s.words, s.target) for r in rows for s in sources.itertuples() if (s.source == r[2] or (r[2] is None and s.source != s.source)))
    assert got.groupby("source_size").taken.sum().to_dict() == sources.groupby("words").quota.sum().to_dict()
    again = mixing.taken(mixing.mix(docs_of(m.sources.sparkSession, rows[::-1]).repartition(7), block=64), 64).toPandas()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    assert got[key].fillna(-1).sort_values(key).values.tolist() == again[key].fillna(-1).sort_values(key).values.tolist()


def test_schedule_is_balanced_everywhere_and_reads_each_block_once_a_pass(mixed):
    _, m, sources, schedule = mixed
    total = schedule["take"].sum()
    part = {s.si: s.target / sources.target.sum() for s in sources.itertuples()}
    assert schedule.position.is_unique or schedule[schedule.position < len(schedule)].position.is_unique
    for upto in (20, 100, 300):
        seen = schedule[schedule.position < upto].groupby("si").size()
        assert all(abs(seen.get(si, 0) - upto * p) <= 6 for si, p in part.items())
    for (si, _), own in schedule.groupby(["si", "epoch"]):
        assert own.block.is_unique
    assert total == sources.quota.sum()
    # Earlier ranks come earlier, and the passages read what the schedule says.
    for _, own in schedule.groupby("si"):
        assert own.sort_values("rank").position.is_monotonic_increasing
    read = mixing.passages(m, 64).toPandas()
    assert read.groupby(["position", "si"]).n_words.sum().to_dict() == schedule.set_index(["position", "si"])["take"].to_dict()
    assert (read.first_word >= 0).all()


def test_numbers_do_not_depend_on_buckets(spark, mixed, monkeypatch):
    rows, m, _, schedule = mixed
    monkeypatch.setattr(mixing, "CHUNK", 7)
    other = mixing.mix(docs_of(spark, rows), block=64)
    key = ["si", "rank", "position", "epoch", "block", "take"]
    assert sorted(map(tuple, other.schedule.toPandas()[key].values)) == sorted(map(tuple, schedule[key].values))
    place = ["si", "pos", "size", "start"]
    assert sorted(map(tuple, other.placed.toPandas()[place].values)) == sorted(map(tuple, m.placed.toPandas()[place].values))


def test_empty_and_wordless_tables(spark):
    assert mixing.taken(mixing.mix(docs_of(spark, []))).count() == 0
    assert [tuple(r) for r in mixing.taken(mixing.mix(docs_of(spark, [(1, None, None), (2, " ", "s")]))).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
