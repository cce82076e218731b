"""Document operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import collections
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from staylens.llm import components, decontaminate, line_dedup, links, lm_score, ngram_join, packing, quality, scan, sharding, subwords, token_counts
from staylens.llm.stored import Scratch

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon phi chi psi omega".split()
SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.integers(0, 50)) for _ in range(n))


def corpus():
    rng = np.random.default_rng(3)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, "two words"), (6, "Ünïcode ＷＯＲＤＳ 漢字   x")]
    for i in range(10, 60):
        rows.append((i, "\n".join(prose(rng, int(rng.integers(4, 25))) for _ in range(int(rng.integers(1, 6))))))
    base = prose(rng, 200).split(" ")
    for i in range(60, 80):  # near copies of one text, a chain of edits
        base = list(base)
        base[int(rng.integers(0, 200))] = f"new{i}"
        rows.append((i, " ".join(base)))
    for i in range(80, 90):  # exact copies
        rows.append((i, rows[12][1]))
    rows.append((95, prose(rng, 9000)))
    rows.append((95, rows[-1][1]))  # a repeated row
    rows.append((None, prose(rng, 30)))
    return rows


SCHEMA = "doc_id long, text string, item long, lo string, score int, key int, length int"


@pytest.fixture(scope="module")
def docs(spark):
    """Further columns carry names that operators use themselves."""
    return spark.createDataFrame([(d, t, 1, "x", 2, 3, 4) for d, t in corpus()], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def shingle_components(rows, n, threshold):
    sets = {}
    for d, t in rows:
        w = SPACES.findall((t or "").translate(LOW))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(parent, d)) for d in sets}


@pytest.mark.parametrize("n,threshold", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_ngram_join(docs, n, threshold):
    _, members = ngram_join.ngram_join(docs, n, threshold)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()}
    assert got == shingle_components([r for r in corpus() if r[0] is not None], n, threshold)


def test_ngram_join_empty(none):
    links, members = ngram_join.ngram_join(none)
    assert members.count() == 0 and links.count() == 0


def test_one_component_is_not_verified_pair_by_pair(spark):
    scratch, asked = Scratch(spark, "links"), []
    members = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (2, 2, 3), (3, 1, 3)], "key long, lo long, item long")
    sketches = spark.createDataFrame([(i, [5, 0, 0, 0, 0]) for i in (1, 2, 3)], "item long, sketch array<long>")

    def verify(pairs):
        asked.append({(r.a, r.b) for r in pairs.collect()})
        return pairs.select("a", "b")

    _, found = links.linked_components(members, ["key"], verify, scratch, sketches, scan.jaccard_possible(Fraction(4, 5)))
    assert asked == [{(1, 2), (1, 3)}, set()]
    assert {(r.node, r.component) for r in found.collect()} == {(1, 1), (2, 1), (3, 1)}


@pytest.mark.parametrize("threshold", [Fraction(1, 3), Fraction(4, 5), Fraction(9, 10)])
def test_wide_sketches_rule_out_long_texts_and_no_link(spark, threshold):
    rng, rows = np.random.default_rng(3), []
    for size in (400, 600, 1000, 1030, 2100, 9000):
        for share in (0.0, 0.4, 0.75, 0.82, 0.88, 0.93, 0.99):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            b = np.concatenate((a[: int(size * share)], rng.integers(0, 2**63, size - int(size * share) + int(0.02 * size)).astype(np.uint64)))
            sides = []
            for x in (a, b):
                bounds = np.array([0, len(x)])
                words = np.concatenate((scan.parity_sketches(x, bounds)[0], scan.wide_sketches(x, bounds)[0]))
                sides.append([len(x), *scan.signed(words).tolist()])
            both = len(np.intersect1d(a, b))
            rows.append((size, share, *sides, both / (len(a) + len(b) - both)))
    df = spark.createDataFrame(rows, "size int, share double, a array<long>, b array<long>, j double")
    got = df.select("size", "share", "j", scan.wide_jaccard_possible(threshold)(df.a, df.b).alias("may"), scan.jaccard_possible(threshold)(df.a, df.b).alias("narrow")).collect()
    assert all(r.may and r.narrow for r in got if r.j >= threshold)
    if threshold >= Fraction(4, 5):
        assert not any(r.may for r in got if r.share == 0)
        assert any(r.narrow for r in got if r.share == 0)


def test_allocation_keeps_the_pigeonhole():
    loads = [(4, s, 10 if s else 10**7, 20) for s in range(8)]
    out, two = ngram_join.allocate(loads, {4: 8})
    assert out == {(4, 0)} and len(two) == 1 and not out & two


def test_deletions_find_what_the_left_out_segment_would(spark):
    rng = np.random.default_rng(8)
    base = prose(rng, 120).split(" ")
    other = [*base[:60], "extra", *base[60:]]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id long, text string")
    units = ngram_join.Bands(Fraction(9, 10), 200).units
    bands = ngram_join.Bands(Fraction(9, 10), 200).of(np.array([118, 119]))
    chosen = {(int(b), s) for b in {*bands, *(bands - 1)} for s in range(int(units[b]))}
    rows = ngram_join.deletions(docs, 3, Fraction(9, 10), 200, chosen).collect()
    keys = [{(r.band, r.segment, r.key) for r in rows if r.item == i} for i in (1, 2)]
    assert keys[0] & keys[1]


def test_components(spark):
    links = spark.createDataFrame([(5, 3), (3, 9), (9, 3), (1, 1), (7, 8), (None, 2), (8, 10), (10, 11), (11, 12)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 7: 7, 8: 7, 10: 7, 11: 7, 12: 7}
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    assert {r.component for r in components.components(chain).collect()} == {0}


def line_fates(rows, k=5, threshold=Fraction(4, 5)):
    items, first, occurrences = {}, {}, []
    for d, t in sorted((r for r in rows if None not in r), key=lambda r: r[0]):
        for p, line in enumerate(t.split("\n")):
            line = line.translate(LOW).strip(" \t\v\f\r")
            if line:
                items.setdefault(line, {line[i : i + k] for i in range(max(1, len(line) - k + 1))})
                occurrences.append((d, p, line))
    parent = {x: x for x in items}
    lines = list(items)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            both = len(items[a] & items[b])
            if both >= threshold * (len(items[a]) + len(items[b]) - both):
                x, y = find(parent, a), find(parent, b)
                parent[x] = y
    dropped = collections.defaultdict(set)
    for d, p, line in occurrences:
        if first.setdefault(find(parent, line), (d, p)) != (d, p):
            dropped[d].add(p)
    return dropped


def test_line_dedup(docs):
    fates = line_fates(corpus())
    rows = line_dedup.line_dedup(docs).collect()
    assert len(rows) == len(corpus())
    texts = dict(corpus())
    for r in rows:
        text = texts[r.doc_id] if r.doc_id is not None else corpus()[-1][1]
        own = fates[r.doc_id] if r.doc_id is not None else set()
        left = None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in own)
        assert (r.text, r.n_dropped, r.emptied) == (left, len(own), bool(own) and not left.strip()) and r.lo == "x"


def near_lines(pairs):
    """One line a row; two by two their similarity is from 0.80 to 0.85."""
    rng, rows = np.random.default_rng(4), []
    while len(rows) < 2 * pairs:
        a = list(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(48, 160))))
        b = list(a)
        for _ in range(int(rng.integers(1, 4))):
            b[int(rng.integers(0, len(b)))] = str(rng.integers(0, 10))
        x, y = ({"".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.85:
            rows += [(len(rows), "".join(a)), (len(rows) + 1, "".join(b))]
    return rows


def test_lines_near_the_threshold_are_found(spark):
    rows = near_lines(800)
    got = {r.doc_id for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_dropped}
    want = set(line_fates(rows))
    assert len(want) == 800 and got == want


def test_rows_that_share_a_doc_id_lose_only_their_own_lines(spark):
    x, y, z = (prose(np.random.default_rng(i), 20) for i in range(3))
    rows = [(0, x), (1, x), (1, y), (2, f"{z}\n{x}"), (2, f"{y}\n{z}"), (2, f"{y}\n{z}"), (3, None), (None, x)]
    got = line_dedup.line_dedup(spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id long, text string, row int, h1 string")).collect()
    assert len(got) == len(rows) and {r.h1 for r in got} == {"h"}
    alone = sorted((r.doc_id, r.text, r.emptied) for r in got if r.doc_id in (0, 1))
    assert alone == [(0, x, False), (1, "", True), (1, y, False)]
    twice = sorted(r.text for r in got if r.doc_id == 2)
    assert twice in (sorted([z, "", ""]), sorted(["", z, z]))
    assert [r.text for r in got if r.doc_id is None] == [x] and [r.text for r in got if r.doc_id == 3] == [None]


def test_line_dedup_empty(none):
    assert line_dedup.line_dedup(none).count() == 0


def test_long_lines_near_the_threshold_are_found(spark):
    rng, rows = np.random.default_rng(6), []
    while len(rows) < 400:
        a = list(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(190, 420))))
        b = list(a)
        for at in rng.choice(len(b), len(b) // 55, replace=False):
            b[at] = str(rng.integers(0, 10))
        x, y = ({"".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.87:
            rows += [(len(rows), "".join(a)), (len(rows) + 1, "".join(b[: len(b) - len(rows) % 7]))]
    got = {r.doc_id for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_dropped}
    want = set(line_fates(rows))
    assert len(want) > 150 and got == want


def long_keys(lines):
    flat, bounds = line_dedup.distinct_runs(*line_dedup.char_runs(line_dedup.Lines(*scan.text_bytes(pa.array(lines))), 5))
    return line_dedup.band_keys(flat, bounds, Fraction(4, 5), line_dedup.BANDS, line_dedup.ROWS)


def test_long_lines_of_one_language_share_few_keys(monkeypatch):
    rng = np.random.default_rng(3)
    parts = ["".join(rng.choice(list("abcdefgh "), 4)) for _ in range(30)]
    lines = ["".join(rng.choice(parts, 250)) for _ in range(200)]
    shared = lambda: len(np.unique(keys := long_keys(lines)[0])) / len(keys)
    few = 1 - shared()
    monkeypatch.setattr(line_dedup, "LONG", 1 << 20)
    assert few * 5 < 1 - shared()


def test_signatures_are_made_of_so_many_lines_at_once(spark, monkeypatch):
    seen, make = [], line_dedup.signatures
    monkeypatch.setattr(line_dedup, "signatures", lambda values, bounds, bins: seen.append(len(bounds) - 1) or make(values, bounds, bins))
    column = pa.array(["\n".join(f"line {i} of {j}" for i in range(3000)) for j in range(3)])
    marks = list(line_dedup._marks(column, 5, Fraction(4, 5), line_dedup.BANDS, line_dedup.ROWS))
    assert sum(seen) == 9000 and max(seen) <= line_dedup.LINES and sum(len(k) for k, _ in marks) == 9000 * line_dedup.BANDS


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 900).astype(np.uint64)
    pair = np.concatenate((values[:800], values[100:]))
    sign = line_dedup.signatures(pair, np.array([0, 800, 1600]), 400)
    assert abs((sign[0] == sign[1]).mean() - 700 / 900) < 0.08


def test_decontaminate(spark, docs):
    rng = np.random.default_rng(9)
    item = prose(rng, 30)
    edited = item.replace(" ", " - ", 3).upper()[:-1] + "!"
    wrong = " ".join(w if i % 3 else "zzz" for i, w in enumerate(item.split(" ")))
    rows = [(1, f"Before. {item} After."), (2, f"x {edited} y"), (3, wrong), (4, None), (5, ""), (6, item + " " + item), (None, item), (1, f"Before. {item} After.")]
    frame = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(10, item), (11, item), (12, "short"), (13, None), (14, "")], "item_id long, text string")
    found = sorted((r.doc_id or 0, r.item_id, r.distance, r.start, r.end) for r in decontaminate.find_items(frame, bench).collect())
    assert [f[:2] for f in found] == [(0, 10), (1, 10), (1, 10), (2, 10), (6, 10)]
    assert found[1][2:] == (0, 8, 8 + len(item)) and 0 < found[3][2] <= 0.08 * len(item)
    assert sorted(r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()) == [3, 4, 5]
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(corpus())
    assert decontaminate.find_items(docs.limit(0), bench).count() == 0


def test_short_items_stand_word_for_word(spark):
    bench = spark.createDataFrame([(1, "E = mc2"), (2, "the Cat, sat"), (3, "..."), (4, "xy"), (5, "THE cat sat")], "item_id long, text string")
    rows = [(1, "so e=MC2!"), (2, "we mc2 x"), (3, "e mc2s"), (4, "The cat sat"), (5, "the cats sat"), (6, "the cat sad"), (7, "xyz yx"), (8, "a xyz, xy"), (9, "e mc2s e mc2"), (10, "...")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (r.distance, r.start, r.end) for r in decontaminate.find_items(frame, bench).collect()}
    assert found == {(1, 1): (0, 3, 8), (4, 2): (0, 0, 11), (8, 4): (0, 7, 9), (9, 1): (0, 7, 12)}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()) == [2, 3, 5, 6, 7, 10]


def test_a_benchmark_of_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(12)
    items = [(i, prose(rng, 15)) for i in range(9)]
    frame = spark.createDataFrame([(i, f"{prose(rng, 10)} {t} {prose(rng, 10)}") for i, t in items[::2]] + [(50, prose(rng, 40))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 250)
    assert len(list(decontaminate._blocks(bench))) >= 3
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_items(frame, bench).collect()) == [(i, i) for i in range(0, 9, 2)]
    assert [r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()] == [50]


def test_quality_learns_from_long_texts(spark, monkeypatch):
    """Texts of a megabyte are learned from; one that does not fit into what is left is passed over."""
    sizes = []

    def stop(size, texts):
        sizes.append(sorted(len(t) for t in texts))
        raise quality.zstandard.ZstdError("stop")

    monkeypatch.setattr(quality.zstandard, "train_dictionary", stop)
    frame = spark.createDataFrame([(i, "x" * 1_000_000) for i in range(4)], "doc_id long, text string")
    quality.fit(frame, spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, quality int"), megabytes=3)
    assert sizes == [[1_000_000, 1_000_000]]  # every second of three that fit


def test_edit_search_misses_nothing():
    rng = np.random.default_rng(2)

    def least(p, t):
        col = list(range(len(p) + 1))
        best = len(p)
        for c in t:
            old, col = col, [0]
            for i in range(1, len(p) + 1):
                col.append(min(old[i] + 1, col[i - 1] + 1, old[i - 1] + (p[i - 1] != c)))
            best = min(best, col[-1])
        return best

    for _ in range(120):
        item = "".join(rng.choice(list("abc "), 50))
        text = list("".join(rng.choice(list("abc "), 90)))
        text[20:20] = item
        for _ in range(int(rng.integers(0, 8))):
            text[int(rng.integers(15, 75))] = str(rng.choice(list("abc")))
        text = "".join(text)
        got = decontaminate._Searcher([(1, item)], 0.1).search(text)
        want = least(item, text)
        assert (got[0][1] if got else None) == (want if want <= 5 else None)


def test_subword_ids_equal_the_library():
    encode = subwords.encoder(subwords.default_path())
    for text in ["It's 'round 12€ <|endoftext|>x", "ΑΣ ΣΑΣ ﬁ ½ à", "<|startoftext|", "don't\x7fstop", "🙂🏽 ok"]:
        words = SPACES.findall(text)
        assert encode.encode(words)[0].tolist() == encode.library.encode(text, add_special_tokens=False).ids
    whole = [t for t in encode.library.get_vocab(with_added_tokens=False)]
    assert len(whole) == encode.size - 2


def test_packing(docs, none):
    rows = packing.pack_documents(docs, capacity=512).collect()
    encode = subwords.encoder(subwords.default_path()).library
    ids = [np.array([*encode.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in corpus()]
    want = collections.Counter((d, i // 512, i, len(x[i : i + 512]), zlib.crc32(x[i : i + 512].tobytes())) for (d, _), x in zip(corpus(), ids) for i in range(0, len(x), 512))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_bin = collections.defaultdict(list)
    for r in rows:
        by_bin[r.sequence_id].append((r.offset, r.length))
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by_bin) <= packing.lower_bound(np.array([r.length for r in rows]), 512) + 1
    assert packing.pack_documents(none).count() == 0


def test_packing_exchanges_gaps(spark):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 101, 4000).tolist()
    rows = packing.pack(spark.createDataFrame([(n,) for n in lengths], "length long").repartition(4), 100, per_task=1000).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    bins = len({r.sequence_id for r in rows})
    bound = packing.lower_bound(np.array(lengths), 100)
    assert bound <= bins <= 1.01 * bound


def test_lower_bound_is_one():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = rng.integers(1, 41, 9)
        assert packing.lower_bound(lengths, 40) <= packing.best_fit(lengths, 40)[2].size
    assert packing.lower_bound(np.array([21] * 7), 40) == 7


def test_sharding(spark, docs, none):
    frame = docs.drop("key").withColumnRenamed("item", "shard")
    stored = sharding.shuffle_into_shards(frame, 4, stored=False)
    rows = stored.collect()
    assert stored.columns == ["doc_id", "text", "lo", "score", "length", "shard", "slot"]
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter(corpus())
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shuffle_into_shards(none, 4, stored=False).count() == 0


def test_communication_matrix():
    sizes = sharding.shard_sizes(1003, 5)
    mean = np.zeros((3, 5))
    for seed in range(300):
        m = sharding.communication_matrix([500, 3, 500], sizes, seed)
        assert m.sum(axis=1).tolist() == [500, 3, 500] and m.sum(axis=0).tolist() == sizes
        mean += m / 300
    assert np.abs(mean[0] - 500 * np.array(sizes) / 1003).max() < 2.5
    big = sharding.communication_matrix([3 * 10**9, 2 * 10**9], sharding.shard_sizes(5 * 10**9, 3), 1)
    assert big.sum(axis=1).tolist() == [3 * 10**9, 2 * 10**9] and abs(int(big[0, 0]) - 10**9) < 10**6


def test_quality(spark, none):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(900):
        good = i % 3 > 0
        text = prose(rng, 60) if good else " ".join(f"{rng.choice(WORDS).upper()}!!" for _ in range(60))
        rows.append((i, text, "z"))
        labels.append((i, int(good), 5))
    rows += [(5000, None, "z"), (5001, "", "z"), (None, "x", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, y int")
    model = quality.fit(docs, marks.where("doc_id % 5 > 0"))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == 903 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(900) if i % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 3 > 0) for i in held]) > 0.97
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, s in got.items() if s >= 0.3}
    flat = quality.fit(docs, marks.limit(0))
    assert {r.score for r in quality.score(docs, flat).collect()} == {0.5}
    assert quality.score(none, flat).count() == 0


def test_token_counts(spark, docs, none):
    library = subwords.encoder(subwords.default_path()).library
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = collections.Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs).collect())
    assert got == collections.Counter((d, count(t or "")) for d, t in corpus())
    edits = token_counts.edits_by_rule(docs).dropDuplicates()
    steps = collections.defaultdict(list)
    for e in sorted(edits.where("doc_id is not null").collect(), key=lambda e: e.seq):
        steps[e.doc_id].append((e.start, e.length, e.insert or ""))
    odd = [(10, 9, None, None, None), (10, 10, 10**6, -5, "tail"), (77777, 0, 0, 1, "x")]
    extra = spark.createDataFrame(odd, "doc_id long, seq int, start int, length int, insert string")
    steps[10] += [(0, 0, ""), (10**6, 0, "tail")]
    rows = token_counts.counts_after_edits(docs, edits.unionByName(extra)).collect()
    assert len(rows) == len(corpus())
    texts = dict(corpus())
    for r in rows:
        if r.doc_id is None:
            continue
        text = texts[r.doc_id] or ""
        assert r.tokens_before == count(text)
        for start, length, insert in steps[r.doc_id]:
            start = min(start, len(text))
            text = text[:start] + insert + text[start + max(length, 0) :]
        assert (r.n_tokens, r.n_chars, r.n_edits) == (count(text), len(text), len(steps[r.doc_id]))
    assert token_counts.counts_after_edits(none, edits).count() == 0


def test_lm_score(docs, none):
    rows = lm_score.lm_score(docs, docs.where("doc_id % 7 != 2")).collect()
    counts = collections.Counter()
    total = 0
    for d, t in corpus():
        if d is not None and d % 7 != 2:
            w = [*SPACES.findall((t or "").translate(LOW)), "\n"]
            counts.update(w)
            total += len(w)
    want = collections.Counter()
    for d, t in corpus():
        w = [*SPACES.findall((t or "").translate(LOW)), "\n"]
        base = sum(np.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in w)
        want[d, len(w), sum(counts[x] > 0 for x in w), total, round(float(base), 6)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm_score.lm_score(none, none).count() == 0


def pairs_of(rows, encode, model):
    """(class before, id) of all positions of shared classes, end marks included."""
    n, found = encode.size + 1, collections.Counter()
    for _, t in rows:
        ids = [*subwords_of(t, encode), n - 1]
        for a, b in zip([n, *ids[:-1]], ids):
            if model.targets[b] >= lm_score.OWN:
                found[int(model.targets[a]), int(b)] += 1
    return found


def subwords_of(text, encode):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return encode.of_words(lm_score.scan(raw, np.array([0, len(raw)])), raw)[0].tolist()


@pytest.fixture(scope="module")
def varied(spark):
    """Rows of short texts with many subword ids, and their frame."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(1, 7))))
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(0, 60))))) for i in range(60)] + [(60, None), (61, "")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_every_window_is_learned_from(varied, monkeypatch):
    rows, docs = varied
    encode, seen = subwords.encoder(subwords.default_path()), {}
    learn, score = lm_score.train, lm_score.score_rows
    monkeypatch.setattr(lm_score, "train", lambda kept, *a: seen.update(kept=kept.select("ids").toArrow().to_batches()) or learn(kept, *a))
    monkeypatch.setattr(lm_score, "score_rows", lambda docs, model, *a: seen.update(model=model) or score(docs, model, *a))
    lm_score.lm_score(docs, docs.where("doc_id % 7 != 2"))
    training = [(d, t) for d, t in rows if d % 7 != 2]
    model = seen["model"]
    want = collections.Counter(int(model.targets[i]) for _, t in training for i in [*subwords_of(t, encode), encode.size])
    got = [t for _, t in lm_score.examples(seen["kept"], model, 0)]
    assert collections.Counter(np.concatenate(got)[np.concatenate(got) >= 0].tolist()) == want
    counted = {(int(k) // len(model.of_id), int(k) % len(model.of_id)): int(n) for k, n in zip(model.pairs, model.times)}
    assert counted == pairs_of(training, encode, model) and counted


def test_rare_pairs_count_too(varied, monkeypatch):
    rows, docs = varied
    scores = lambda: {r.doc_id: r.score for r in lm_score.lm_score(docs, docs.where("doc_id % 7 != 2")).collect()}
    monkeypatch.setattr(lm_score, "train", lambda kept, model, class_share: lm_score.Net.fresh(class_share).flat)
    want = scores()
    for few in (0, 40):
        monkeypatch.setattr(lm_score, "PAIRS", few)
        got = scores()
        assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in want)


def test_model_is_a_distribution_and_causal():
    rng = np.random.default_rng(7)
    net = lm_score.Net(rng.normal(0, 0.3, lm_score.Net.SIZE).astype(np.float32))
    inputs = rng.integers(0, lm_score.INPUTS, (1, lm_score.WINDOW))
    every = np.stack([np.full(lm_score.HALF, c) for c in range(lm_score.CLASSES)])
    p = np.exp(net.log_prob(np.repeat(inputs, lm_score.CLASSES, axis=0), every))
    assert np.allclose(p.sum(axis=0), 1, atol=1e-4)
    later = inputs.copy()
    later[0, -1] = (later[0, -1] + 1) % lm_score.INPUTS
    a, b = (net.log_prob(x, every[:1])[0] for x in (inputs, later))
    assert np.allclose(a[:-1], b[:-1]) and abs(a[-1] - b[-1]) > 1e-6
    counts = rng.integers(0, 1000, 500).astype(float)
    _, of_id, share, _ = lm_score.classes_of(counts, rng.integers(0, 2, 500))
    assert np.allclose(np.bincount(of_id, 10**share, lm_score.CLASSES)[np.unique(of_id)], 1)


@pytest.mark.parametrize("large", [0.3, 4.0])
def test_gradient_is_that_of_the_mean_loss(large):
    rng = np.random.default_rng(2)
    net = lm_score.Net(rng.normal(0, large, lm_score.Net.SIZE))
    inputs = rng.integers(-1, lm_score.INPUTS + 1, (3, lm_score.WINDOW))
    inputs[:, lm_score.HALF] = lm_score.INPUTS
    targets = rng.integers(-1, lm_score.CLASSES, (3, lm_score.HALF))
    loss = lambda flat: -lm_score.Net(flat).log_prob(inputs, targets).sum() / (targets >= 0).sum()
    got = net.gradient(inputs, targets)
    for _ in range(20):
        way, at = np.zeros(net.SIZE), rng.integers(0, net.SIZE - lm_score.DIM * lm_score.INPUTS, 50) + lm_score.DIM * lm_score.INPUTS
        way[at] = rng.normal(0, 1e-6, len(at))
        way[lm_score.DIM * inputs.max() + rng.integers(0, lm_score.DIM)] = 1e-6
        assert np.isclose(loss(net.flat + way) - loss(net.flat - way), 2 * way @ got, rtol=1e-3, atol=1e-8)


def test_windows_score_each_id_once():
    ids = np.arange(100, 100 + 150)
    bounds = np.array([0, 0, 32, 33, 150])
    inputs, targets, doc = lm_score.windows(ids, bounds, 999, 998)
    for d in range(4):
        own = targets[doc == d].reshape(-1)
        assert own[own >= 0].tolist() == [*ids[bounds[d] : bounds[d + 1]], 998]
        mine = inputs[doc == d]
        assert mine[0, lm_score.HALF - 0] == 999 or mine[0, lm_score.HALF] == 999


def test_scratch_drops(spark):
    scratch = Scratch(spark, "test")
    kept = scratch.put(spark.range(3))
    assert kept.count() == 3
    scratch.drop(kept)
    with pytest.raises(Exception):
        spark.read.parquet(f"{scratch.root}/1").count()
