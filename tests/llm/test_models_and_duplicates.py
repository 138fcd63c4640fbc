import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hushmap.llm import near_embeddings, ngram_jaccard, quality_crf, toxicity
from hushmap.llm.training import held_out, labelled_sample
from tests.llm.helpers import ODD, Groups, clashing, documents, words


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_held_out_is_the_crc_of_the_text(spark):
    got = spark.range(-5, 300).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
    null = spark.createDataFrame([(None,)], "id long").select(held_out(F.col("id")).alias("h"))
    assert null.first().h is False


def test_sample_leaves_out_what_it_should(spark):
    docs = documents(spark, [(i, f"text {i}", "s") for i in range(200)] + [(7, "text 7", "s")])
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(200)] + [(1, 0), (3, None), (None, 1)],
        "doc_id long, quality int",
    )
    got = labelled_sample(docs, labels, "quality", 20, 100)
    ids = [int(t.split()[1]) for t, _ in got]
    assert len(ids) == len(set(ids)) == 40 and 1 not in ids
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert all(y == i % 2 for i, (_, y) in zip(ids, got))
    assert not labelled_sample(docs, labels.limit(0), "quality", 20, 100)


def test_forward_backward_sums_over_all_labellings():
    rng = np.random.default_rng(1)
    first = np.array([0, 3, 3, 4, 8])
    odds, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    forward, backward, _, total = quality_crf.forward_backward(odds, first, moves)
    good = np.exp(forward[:, 1] + backward[:, 1] - total)
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        weights = np.zeros(n)
        whole = 0.0
        for code in range(2**n):
            s = [(code >> i) & 1 for i in range(n)]
            w = np.exp(
                sum(odds[a + i] for i in range(n) if s[i])
                + sum(moves[s[i], s[i + 1]] for i in range(n - 1))
            )
            whole += w
            weights += w * np.array(s)
        if n:
            assert np.allclose(good[a:b], weights / whole)


def test_line_features_follow_the_lines():
    text = "Two words\n\n  \nA A A B!\r\nlast"
    data = np.frombuffer(text.encode(), np.uint8)
    base, size, first = quality_crf.line_features(data, np.array([0, 0, len(data), len(data)]))
    assert first.tolist() == [0, 0, 3, 3]
    assert np.allclose(np.expm1(base[:, 0]), [2, 4, 1])
    assert np.allclose(base[:, 8] ** 2, [0, 2 / 4, 0])
    assert size.tolist() == [10, 10, 4]
    rows = quality_crf.with_neighbours(base, first)
    n = base.shape[1]
    assert np.allclose(rows[1, n : 2 * n], base[0]) and np.allclose(rows[1, 2 * n : 3 * n], base[2])
    assert rows[:, 3 * n].tolist() == [1, 0, 0] and rows[:, 3 * n + 1].tolist() == [0, 0, 1]


JUNK = ["###$ %%% &&& ***", "WORD!! WORD!! WORD!!", "a a a a a a a a"]


def small_corpus(toxic):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(240):
        bad = i % 2
        text = "\n".join(" ".join(rng.choice(["the", "of", "house", "river", "stone"]) for _ in range(12)) for _ in range(4))
        if bad and toxic:
            place = rng.randrange(len(text.split(" ")))
            text = " ".join(text.split(" ")[:place] + [rng.choice(["idiot", "scumbag"])] + text.split(" ")[place:])
        elif bad:
            text = "\n".join(rng.choice(JUNK) * 4 for _ in range(4))
        rows.append((i, text, "s"))
        marks.append((i, int(bad) if toxic else 1 - bad))
    return rows, marks


@pytest.mark.parametrize("toxic", [False, True])
def test_classifiers_learn_and_score_every_row(spark, toxic):
    rows, marks = small_corpus(toxic)
    extra = [(1000 + i, t, s) for i, t, s in ODD] + [(1, "second text of one id", "s"), (None, "no id", "s")]
    docs = clashing(documents(spark, rows + extra))
    name = "toxic" if toxic else "quality"
    labels = spark.createDataFrame(marks, f"doc_id long, {name} int")
    use = toxicity.score_toxicity if toxic else quality_crf.score_quality
    got = use(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    truth = dict(marks)
    test = [r for r in got if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in test)
    assert right >= 0.95 * len(test)
    assert use(docs.limit(0), labels).count() == 0
    assert {r.score for r in use(docs, labels.limit(0)).collect()} == ({0.0} if toxic else {0.5})


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_held_out_accuracy_on_the_tables(spark, name):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    use = toxicity.score_toxicity if name == "toxic" else quality_crf.score_quality
    test = use(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r[name] for r in test)
    assert len(test) > 50 and right >= 0.95 * len(test)


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(2)
    values = {k: v.astype(np.float64) for k, v in toxicity._start(9, rng).items()}
    values["table"][0] = 0
    numbers = rng.integers(0, 9, (5, 4, toxicity.KINDS))
    mask = np.arange(4) < np.array([4, 2, 1, 4, 3])[:, None]
    numbers[~mask] = 0
    y, cost = np.array([1, 0, 1, 0, 0.0]), np.array([2, 1, 1, 1, 3.0])

    def loss():
        x = values["table"][numbers].sum(2)
        p = {s: x @ values[f"x{s}"] + values[f"b{s}"] for s in "fb"}
        states, _ = toxicity._run(values, lambda s, t: p[s][:, t], 4, 5, False)
        score = toxicity._pool(values, states.astype(np.float64), mask.T)[3]
        return (cost * (np.logaddexp(0, score) - y * score)).mean()

    made = toxicity._gradients(values, numbers, mask, y, cost)
    for name in values:
        flat, slope = values[name].reshape(-1), made[name].reshape(-1)
        for i in rng.choice(len(flat), min(4, len(flat)), replace=False):
            if name == "table" and i < toxicity.WIDTH:
                continue
            was = flat[i]
            flat[i] = was + 1e-3
            up = loss()
            flat[i] = was - 1e-3
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-3 - slope[i]) < 2e-3, name


def test_windows_cover_every_word():
    first = np.array([0, 0, 1, 17, 17 + 100])
    starts, owner = toxicity._windows(first)
    for i in range(4):
        own = starts[owner == i] - first[i]
        n = first[i + 1] - first[i]
        assert (len(own) == 0) == (n == 0)
        assert {w for s in own for w in range(s, s + 16)} >= set(range(n))
        assert all(s == 0 or s + 8 < n for s in own)


# -- near-duplicates -------------------------------------------------------------------------


def plain_sets(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def test_jaccard_join_follows_brute_force(spark):
    rng = random.Random(11)
    made = []
    for f in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 90))]
        made += family(rng, base, 12, rng.choice([0, 1, 1, 2, 3]))
    passage = " ".join(f"p{i}" for i in range(60))
    made += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    # A chain in which only neighbours link.
    long = [f"c{i}" for i in range(400)]
    made += [" ".join(long[i : i + 200]) for i in range(0, 200, 20)]
    rows = ODD + [(100 + i, t, "s") for i, t in enumerate(made)]
    random.Random(1).shuffle(rows)
    rows += [(100, "zz later text of one id", "s"), (None, made[0], "s")]
    sets = [plain_sets(t) for _, t, _ in rows]
    groups = Groups()
    for k, a in enumerate(sets):
        groups.find(k)
        for at in range(k + 1, len(sets)):
            n = len(a & sets[at])
            if a and sets[at] and 100 * n >= 75 * len(a | sets[at]):
                groups.join(k, at)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        c = groups.find(k)
        least[c] = min((x for x in (i, least.get(c)) if x is not None), default=None)
    want = [(i, len(sets[k]), least[groups.find(k)]) for k, (i, _, _) in enumerate(rows)]
    got = ngram_jaccard.similar_documents(clashing(documents(spark, rows))).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)
    assert ngram_jaccard.similar_documents(documents(spark, rows).limit(0)).count() == 0


def test_jaccard_join_of_large_sets_and_partly_linked_families(spark):
    rng = random.Random(5)
    made = []
    for edits in (20, 45, 60):  # near the threshold: some pairs link, others do not
        base = [f"w{rng.randrange(10**6)}" for _ in range(1_000)]
        made += family(rng, base, 14, edits)
    base = [f"w{rng.randrange(10**6)}" for _ in range(4_000)]
    made += family(rng, base, 3, 100) + [" ".join(base[:3_010]), " ".join(base)]
    rows = [(i, t, "s") for i, t in enumerate(made)]
    random.Random(2).shuffle(rows)
    groups, sets = Groups(), {i: plain_sets(t) for i, t, _ in rows}
    links = 0
    for a in sets:
        groups.find(a)
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                groups.join(a, b)
                links += 1
    assert 0 < links < 3 * 14 * 13 / 2
    # Few buckets order elements badly, which changes no result.
    for bits in (4, ngram_jaccard.ORDER_BITS):
        got = ngram_jaccard.similar_documents(documents(spark, rows), order_bits=bits).collect()
        assert {r.doc_id: r.component_id for r in got} == {i: groups.find(i) for i in sets}


@pytest.mark.parametrize("repeat", [0, 1])
def test_jaccard_join_broadcasts_no_row_for_each_document(spark, monkeypatch, repeat):
    rng = random.Random(8)
    shared = [f"s{i} " * 6 for i in range(20)]
    made = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(40)) + " " + rng.choice(shared) for _ in range(200)]
    made += [made[0] + " end", made[1] + " end"]
    rows = [(i, t, "s") for i, t in enumerate(made)] + [(0, made[0], "s")] * repeat
    sent, mark = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.count()) or mark(df))
    got = {r.doc_id: r.component_id for r in ngram_jaccard.similar_documents(documents(spark, rows)).collect()}
    assert got == {i: {200: 0, 201: 1}.get(i, i) for i in range(202)}
    assert sum(sent) < 60


def test_linked_sets_share_their_first_elements():
    rng = np.random.default_rng(3)
    ranks = rng.integers(0, 5, 1 << 8).astype(np.uint8)
    for _ in range(300):
        m = int(rng.integers(1, 400))
        n = int(rng.integers(-(-75 * m // 100), m + 1))
        # As few in common as a link allows.
        shared = next(c for c in range(n + 1) if 100 * c >= 75 * (n + m - c))
        pool = np.unique(rng.integers(0, 2**64, n + m, dtype=np.uint64))
        rng.shuffle(pool)
        small, large = np.sort(pool[:n]), np.sort(pool[n - shared : n - shared + m])
        short, _ = ngram_jaccard.prefix_sizes(n)
        met = np.isin(ngram_jaccard.prefix(small, ranks)[:short], ngram_jaccard.prefix(large, ranks))
        assert met.sum() >= ngram_jaccard.least_common(n)


def test_near_embeddings_follow_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, at = [], 0
    for label in (1, 2):
        for size in (1,) * 60 + (2, 3, 5, 40, 700 if label == 1 else 30):
            centre = rng.normal(size=24)
            for _ in range(size):
                rows.append((at, (centre + rng.normal(size=24) * 0.03).tolist(), label))
                at += 1
    # A chain whose ends do not link, copies, and copies scaled.
    for i in range(12):
        rows.append((at + i, [float(np.cos(i * 0.3)), float(np.sin(i * 0.3))] + [0.0] * 22, 2))
    at += 12
    rows += [(at, rows[0][1], 1), (at + 1, rows[0][1], 1), (at + 2, [2 * x for x in rows[0][1]], 1), (at + 3, rows[0][1], 2)]
    bad = [
        (at + 10, None, 1), (at + 11, [0.0] * 24, 1), (at + 12, [float("nan")] + [1.0] * 23, 1),
        (at + 13, [None] + [1.0] * 23, 1), (at + 14, [float("inf")] + [1.0] * 23, 1),
        (at + 15, rows[0][1], None), (at + 16, [], 1), (at + 17, [1.0, 2.0], 1),
    ]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")
    df = df.withColumn("size", F.lit("clash")).withColumn("id", F.lit("clash")).repartition(6)
    groups, links = Groups(), {}
    for i, *_ in rows + bad:
        groups.find(i)
        links[i] = 0
    x = np.array([e for _, e, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    marks = np.array([g for *_, g in rows])
    near = (x @ x.T >= 0.93) & (marks[:, None] == marks[None, :])
    np.fill_diagonal(near, False)
    for i, j in np.argwhere(near):
        groups.join(int(rows[i][0]), int(rows[j][0]))
        links[rows[i][0]] += 1
    got = near_embeddings.near_embeddings(df).collect()
    assert {r.vec_id: r.n_links for r in got} == links
    assert {r.vec_id: r.component_id for r in got} == {i: groups.find(i) for i in links}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert near_embeddings.near_embeddings(df.limit(0)).count() == 0


def test_near_pairs_are_found_beside_a_large_group(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=24)
    rows = [(i, (centre + rng.normal(size=24) * 0.03).tolist(), 1) for i in range(200)]
    for i in range(200, 260, 2):
        pair = rng.normal(size=24)
        rows += [(i + k, (pair + rng.normal(size=24) * 0.03).tolist(), 1) for k in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    units = near_embeddings._unit(near_embeddings.usable(df, "vec_id", "embedding", "label"))
    # All links of the group, none of the pairs: over 99 % of the links, half of the vectors.
    found = spark.range(200).select("id", F.lit(199).cast("long").alias("others"))
    assert near_embeddings.audit(units, found, 0.93) < 0.5
    # Orders that never meet a pair: what they leave is compared block by block.
    lists = near_embeddings.first_lists
    monkeypatch.setattr(near_embeddings, "first_lists", lambda *a: lists(*a).where("b < 200"))
    got = near_embeddings.near_embeddings(df, tries=1).collect()
    assert {r.vec_id: r.n_links for r in got} == {i: 199 if i < 200 else 1 for i, *_ in rows}
    assert {r.vec_id: r.component_id for r in got} == {i: 0 if i < 200 else i // 2 * 2 for i, *_ in rows}
    blocks = near_embeddings.block_links(units, 0.93, block=50).collect()
    groups = Groups()
    for r in blocks:
        groups.join(r.a, r.b)
    assert all(groups.find(i) == (0 if i < 200 else i // 2 * 2) for i, *_ in rows)
    assert len(blocks) < 10 * len(rows)


def test_orders_grow_with_the_label():
    for n in (1, 30_000, 300_000, 1_600_000, 10**8):
        orders, bits = near_embeddings.orders_for(n, 0.93)
        met = (1 - np.arccos(0.93) / np.pi) ** max(np.log2(n / near_embeddings.AHEAD), 0)
        assert (1 - met) ** orders <= 0.001 and 2**bits >= 16 * n
