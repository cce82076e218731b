"""Filter audit, whitening and wavelet files against brute force, with nulls, ties, repeats and odd values."""

import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from tokenizers import Tokenizer

from staylens.llm import filter_audit, subwords, wavelet, whitening
from staylens.llm.queries import QUERIES, SQL
from staylens.llm.stored import Scratch
from tests.oracle import compare, duck

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(120))
TEXTS = [
    (0, "en", LONG), (1, "en", LONG), (1, "de", LONG), (None, "en", LONG), (2, None, ""), (3, "", None), (4, "en", "$ short"),
    (5, "en", LONG.upper()), (6, "de", "a " * 200), (7, "de", LONG + " é|ß"), (8, "en", " \n\t\x0b "), (9, "fr", "Ünï code"), (9, "fr", "Ünï code"),
    (10, "fr", "word " * 90 + LONG), (11, "xx", "x" * 300_000), (12, "en", "ABC " * 30 + "#"), (13, "en", "ABC " * 30 + "#"),
]
LABELS = [(0, 1, 0), (1, 1, 1), (1, 0, None), (5, None, 1), (13, 1, 1), (None, 1, 1), (99, 1, 1)]


def brute_audit(rows, labels):
    masks = []
    for doc_id, lang, text in rows:
        t = text or ""
        w = WORD.findall(t)
        caps = sum("A" <= c <= "Z" for c in t)
        earlier = doc_id is not None and any(d is not None and d < doc_id and (x or "") == t for d, _, x in rows)
        fails = dict(zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * caps > 10 * len(t), any(c in "#$%&*|" for c in t), earlier)))
        good = doc_id is not None and any(d == doc_id and q == 1 for d, q, _ in labels)
        toxic = doc_id is not None and any(d == doc_id and x == 1 for d, _, x in labels)
        masks.append((lang or "", fails, good, toxic))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, x in enumerate(order, 1):
                removed, kept = [m for m in left if m[1][x]], [m for m in left if not m[1][x]]
                failing = [m for m in own if m[1][x]]
                unique = sum(sum(m[1].values()) == 1 for m in failing)
                out[part, "".join(order), step] = [len(kept), len(removed), len(failing) - len(removed), unique, sum(m[2] for m in removed), sum(m[3] for m in removed)]
                share[x] += len(removed)
                left = kept
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                out[part, "".join(order), step].append(share[x])
    return out


def test_audit(spark):
    docs = spark.createDataFrame([(*r, 5, "k") for r in TEXTS], "doc_id long, lang string, text string, mask int, key string").repartition(4)
    labels = spark.createDataFrame([(*r, 1) for r in LABELS], "doc_id long, quality int, toxic int, part int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (*filter_audit.OUTCOMES, "shapley")] for r in filter_audit.audit(docs, labels).collect()}
    want = brute_audit(TEXTS, LABELS)
    assert got == want and len(got) == 600 * len({p for p, _, _ in want})
    assert not filter_audit.audit(docs.where("false"), labels).collect()
    assert len(filter_audit.audit(docs, labels.where("false")).collect()) == len(got)


def test_fields_hold_large_counts():
    total = (10**15) * filter_audit.packed(31, True, True) + (10**15 + 7) * filter_audit.packed(1, False, False)
    counts = filter_audit.unpacked(total)
    at = filter_audit.ORDERS.index("ABCDE")
    assert counts[at, 0].tolist() == [0, 2 * 10**15 + 7, 0, 10**15 + 7, 10**15, 10**15]
    assert counts[at, 1].tolist() == [0, 0, 10**15, 0, 0, 0]
    assert counts.min() >= 0 and counts.max() == 2 * 10**15 + 7


def test_more_parts_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS_AT_ONCE", 3)
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('l', id % 20) AS lang", "repeat('a ', int(id % 150)) AS text").repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    first = {r["part"]: r for r in got.where("filter_order = 'ABCDE' AND step = 1").collect()}
    assert len(first) == 20 and all(r["kept"] + r["removed"] == 20 for r in first.values())


def test_audit_as_registered(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(QUERIES["op11_filter_interaction_audit"](spark, folder), duck(folder), SQL["op11_filter_interaction_audit"]) == ""


def vectors():
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(6, 6)) * np.array([3, 2, 1.2, 0.7, 0.3, 0.1])
    rows = [(i, (rng.normal(size=6) @ mix + 1).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(100)] + [(5, rows[3][1]), (None, rows[4][1])]
    return rows


ODD = [(400, None), (401, []), (402, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (403, [float("nan")] * 6), (404, [float("inf")] + [0.0] * 5), (405, [1.0, 2.0]), (406, [3e38] * 6)]
KIND = "vec_id long, embedding array<float>, x int, n int, component string"


def brute_whitening(rows, k):
    x = np.array([[np.floor(256 * float(np.float32(c))) for c in v] for _, v in rows]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh((fit - s / n).T @ (fit - s / n) / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ axes[:, :k] / np.sqrt(values[:k]), values / values.sum()


def test_whitening(spark):
    good = vectors()
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in good + ODD], KIND).repartition(5)
    got = whitening.whiten(df).collect()
    n, deviation, white, share = brute_whitening(good, 4)
    assert len(got) == 4 * len(good)
    assert {r["n"] for r in got} == {n} and n == 300
    assert max(r["identity_error"] for r in got) < 1e-10 and len({r["identity_error"] for r in got}) == 1
    for k in range(4):
        own = [r for r in got if r["component"] == k + 1]
        assert max(abs(r["explained"] / share[k] - 1) for r in own) < 1e-10
        want = sorted(((i is None, i or 0), int(d), w) for (i, _), d, w in zip(good, deviation, white[:, k]))
        mine = sorted(((r["vec_id"] is None, r["vec_id"] or 0), int(r["deviation"]), r["whitened"]) for r in own)
        sign = 1 if abs(mine[0][2] - want[0][2]) < 1e-6 else -1
        mine = sorted((i, d, sign * w) for i, d, w in mine)
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        assert max(abs(m[2] - w[2]) for m, w in zip(mine, want)) < 1e-9


def test_whitening_of_few_dimensions(spark):
    rows = [(i, [float(i % 7), float(i % 7) * 2, 5.0]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 40 and {r["component"] for r in got} == {1}
    assert got[0]["n"] == 7 and abs(got[0]["explained"] - 1) < 1e-12 and got[0]["identity_error"] < 1e-10
    for odd in ([], ODD[:4], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert not whitening.whiten(spark.createDataFrame(odd, "vec_id long, embedding array<float>")).collect()


def test_ill_conditioned_rows(spark):
    """A condition number whose square is beyond double precision; plain Cholesky of the Gram matrix would break down."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(500, 4)) * [2.0**40, 2.0**39, 2.0**38, 4.0]).astype(np.int64)
    rows = [(i, (r / 256).tolist()) for i, r in enumerate(x)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert max(r["identity_error"] for r in got) < 1e-4 and {r["component"] for r in got} == {1, 2, 3, 4}
    s = x.astype(object).sum(axis=0)
    want = {i: sum((500 * int(v) - int(t)) ** 2 for v, t in zip(r, s)) for i, r in enumerate(x)}
    assert all(int(r["deviation"]) == want[r["vec_id"]] for r in got)


def test_whitening_as_registered(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op12_embedding_whitening"](spark, folder)
    assert dict(got.dtypes)["deviation"] == "bigint"
    given = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    n, deviation, _, _ = brute_whitening(given, 4)
    rows = got.collect()
    assert len(rows) == 4 * len(given) and {r["n"] for r in rows} == {n}
    assert {r["vec_id"]: r["deviation"] for r in rows} == {i: int(d) for (i, _), d in zip(given, deviation)}


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (1, 2), (2047, 300), (2048, 300), (2049, 2), (20_000, 49_408), (30_000, 3)])
def test_matrix(n, top):
    rng = np.random.default_rng(n + top)
    ids = (rng.integers(0, top, n) * rng.integers(0, 2, n)).astype(np.uint32)
    bounds = np.array([0, n // 3, n // 3, n])
    matrix = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, bounds).to_bytes())
    assert (matrix.ids() == ids).all() and matrix.bounds.tolist() == bounds.tolist()
    at = rng.integers(0, n, min(n, 500))
    assert (matrix.access(at) == ids[at]).all()
    for token in {0, 1, top - 1, top, 1 << 20, *ids[:5].tolist()}:
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert matrix.count(token) == (ids == token).sum() and matrix.count(token, a, b) == (ids[a:b] == token).sum()
        assert matrix.occurrences(token, a, b).tolist() == (a + np.flatnonzero(ids[a:b] == token)).tolist()
        assert len(matrix.occurrences(token)) == (ids == token).sum()
    with pytest.raises(IndexError):
        matrix.access(np.array([n]))
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_bytes(b"WVM9" + bytes(40))


def library_ids(texts):
    library = Tokenizer.from_file(subwords.default_path())
    return [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]


def test_files(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "Hello, wörld! " * int(rng.integers(0, 40)) + str(i)) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n "), (63, "<|endoftext|> x y’s 漢字"), (64, "long text " * 30_000), (7, "again"), (7, "again"), (None, "no id"), (-5, "first")]
    df = spark.createDataFrame([(*r, 1, 2, b"x") for r in rows], "doc_id long, text string, start int, apart int, ids binary").repartition(4)
    folder = f"{Scratch(spark, 'test-wavelet').root}/files"
    wavelet.write_files(df, folder, shard_tokens=700)
    files = spark.read.parquet(folder)
    assert files.count() > 10 and files.select("matrix").inputFiles().__len__() >= files.count()
    order = sorted(zip(rows, library_ids([t for _, t in rows])), key=lambda x: (x[0][0] is not None, x[0][0] or 0, len(x[1]), zlib.crc32(x[1].tobytes())))
    flat = np.concatenate([ids for _, ids in order])
    got = sorted(wavelet.read_back(spark, folder).collect(), key=lambda r: r["start"])
    starts = np.cumsum([0] + [len(ids) for _, ids in order])
    want = [(d, int(s), len(ids), zlib.crc32(ids.tobytes())) for ((d, _), ids), s in zip(order, starts)]
    assert [tuple(r) for r in got] == want
    places = [0, 1, len(flat) - 1, len(flat), -1, 5, 5, len(flat) // 2, None]
    at = wavelet.tokens_at(spark, folder, spark.createDataFrame([(p,) for p in places], "place long")).collect()
    assert sorted(map(tuple, at)) == sorted((p, int(flat[p])) for p in {0, 1, 5, len(flat) // 2, len(flat) - 1})
    tokens = [1, int(flat[0]), 49_407, 48_000]
    assert {r["token"]: r["n"] for r in wavelet.token_counts(spark, folder, tokens).collect()} == {t: int((flat == t).sum()) for t in tokens}
    where = wavelet.occurrences(spark, folder, [49_407, int(flat[3])]).collect()
    owner = np.repeat(np.arange(len(order)), np.diff(starts))
    assert sorted((r["token"], r["place"]) for r in where) == sorted((t, int(p)) for t in {49_407, int(flat[3])} for p in np.flatnonzero(flat == t))
    assert all(r["doc_id"] == order[owner[r["place"]]][0][0] for r in where)
    assert not wavelet.round_trip(df.where("false")).collect()


def test_files_as_registered(spark):
    folder = "/root/testdata/sf0.001"
    given = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    ids = library_ids([t for _, t in given])
    starts = np.cumsum([0] + [len(x) for x in ids])
    want = [(d, int(s), len(x), zlib.crc32(x.tobytes())) for (d, _), s, x in zip(given, starts, ids)]
    assert [tuple(r) for r in QUERIES["op13_token_id_output"](spark, folder).orderBy("doc_id").collect()] == want


def test_words_as_the_library_encodes_them():
    rng = np.random.default_rng(6)
    pool = ["'s", "'ve", "''s", "J̌", "İ", "้", "Σ", "ς", "ﬁ", "漢字", "é", "é", "́", "가", "가", "🙂", "\xa0", " ", "​", "x", "Y", "1", "²", "#", "***'"]
    pool += ["</w>", "Ġ", "\x7f", "\x00", "ẞ", "ǅ", "क", "ि", "ͅ", "<|endoftext|>", "<|startoftext|>"]
    words = ["".join(rng.choice(pool) for _ in range(rng.integers(1, 12))) for _ in range(3000)]
    encode, library = wavelet.encoder(subwords.default_path()), Tokenizer.from_file(subwords.default_path())
    plain = [w for w in words if "<|" not in w]
    for some in (plain, words, [""]):
        ids, bounds = encode.encode(some)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [library.encode(w, add_special_tokens=False).ids for w in some]
