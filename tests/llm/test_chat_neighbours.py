"""Chat formatting and nearest neighbours on small tables with nulls, ties, repeats and odd values."""

import collections
import hashlib

import numpy as np
from pyspark.sql import functions as F

from staylens.llm import chat, neighbours

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string, span int"


def folded(spark, rows):
    frame = spark.createDataFrame([(*r, 1) for r in rows], EVENTS)
    return {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold_events(frame).collect()}


def test_fold(spark):
    rows = [
        (1, 0, 0, "start", "user", "he"), (1, 1, 0, "delta", None, "llo"), (1, 2, 1, "start", "assistant", None),
        (1, 3, 1, "delta", None, "bad"), (1, 4, 2, "start", "user", "gone"), (1, 5, 1, "regenerate", None, None),
        (1, 6, 1, "delta", None, "go"), (1, 7, 1, "delta", None, "od"), (1, 8, 2, "start", None, "again"),
        (1, 9, 0, "edit", None, "hi"), (2, 0, 0, "delta", None, "never started"), (3, None, 0, "start", "user", "x"),
        (None, 0, 0, "start", "user", "no id"),
    ]
    assert folded(spark, rows) == {(1, 0): ("user", "hi"), (1, 1): ("assistant", "good"), (1, 2): ("", "again"), (None, 0): ("user", "no id")}
    assert folded(spark, [rows[i] for i in (12, 9, 3, 7, 0, 5, 1, 4, 2, 8, 6, 10, 11)]) == folded(spark, rows)
    assert folded(spark, []) == {}


def test_round_trip(spark):
    texts = ["", "plain", "\\", "<|", "<|end|>\n", "\\<|user|>\n", "a\\\\<|b", "<\\|", "\n<", "é漢🙂" * 50, "x" * 50_000, None]
    roles = ["user", "assistant", "a|b", "|>\n", "\\", None]
    rows = [(c, t, roles[(c + t) % 6], texts[(c * 5 + t) % 12]) for c in range(12) for t in range(14)]
    rows += [(50, 1, "assistant", "same"), (50, 1, "assistant", "same"), (50, None, "user", "first")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, message string")
    done = chat.format_conversations(chat.event_log(frame))
    got = done.select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1] if r[1] is not None else -1)):
        want[c].append((role or "", text or ""))
    result = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss) for r in got.collect()}
    assert {c: t for c, (t, _) in result.items()} == want
    assert {c: x for c, (_, x) in result.items()} == {c: "".join(x for r, x in t if r == "assistant") for c, t in want.items()}
    assert chat.format_conversations(chat.event_log(frame.limit(0))).count() == 0


def exact(rows, k):
    """Brute force with whole vectors."""
    use = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q, qv in use:
        if q % 50:
            continue
        a = np.array(qv, float)
        found = {}
        for i, v in use:
            if i != q and len(v) == len(qv):
                b = np.array(v, float)
                s = float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
                found[i] = max(found.get(i, -9), s)
        out[q] = sorted(((-round(s, 9), i) for i, s in found.items()))[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 700)]  # one vector very often
    rows += [(1000, None), (1050, []), (1100, [0.0] * 8), (1150, [float("nan")] + [1.0] * 7), (1200, [None] + [1.0] * 7), (1250, [float("inf")] + [1.0] * 7)]
    rows += [(None, rows[5][1]), (50, rows[50][1]), (1300, [1e30] * 8), (1350, [1e-30] * 8)]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = collections.defaultdict(list)
    for r in neighbours.search(frame, frame.where("vec_id % 50 = 0")).collect():
        got[r.query_id].append((r.rank, -round(r.score, 9), r.vec_id))
    want = exact(rows, 5)
    assert set(got) == set(want)
    assert all([x[0] for x in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())
    hits = sum(len({x[2] for x in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.98 * 5 * len(want)
    assert [x[1:] for x in sorted(got[400])] == want[400]
    assert neighbours.search(frame.limit(0), frame.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(few, few).collect()] == [(0, 1, 1), (1, 1, 0)]


def test_recall_in_a_shard():
    rng = np.random.default_rng(5)
    unit = neighbours._unit(rng.normal(size=(4000, 64)))
    edges, start = neighbours.build_graph(unit)
    queries = neighbours._unit(rng.normal(size=(100, 64)))
    met, far = neighbours.beam_search(unit, edges, start, queries, neighbours.SEARCH_BEAM)
    true = np.argsort(-(queries @ unit.T), axis=1)[:, :5]
    recall = np.mean([len(set(m[:5]) & set(t)) / 5 for m, t in zip(met, true)])
    assert recall >= 0.9 and (np.diff(far, axis=1) >= 0).all()


def test_digest_of_the_check_conversation(spark):
    from staylens.llm import queries

    rows = spark.createDataFrame([(-7, 0, "user", queries.CHECK_TEXT), (-7, 1, "assistant", queries.CHECK_TEXT)], "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(chat.event_log(rows)).select(chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert hashlib.sha256(done.loss.encode()).hexdigest() == hashlib.sha256(rb"\### Assistant: </turn> ok").hexdigest()
