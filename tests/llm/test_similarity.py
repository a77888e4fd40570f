"""Near duplicates, the incremental index and vector neighbours against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import incremental, mih, near_dup, words
from reviewloom.sources.tables import table

DATA = "/root/testdata"
VOCABULARY = [f"w{i}" for i in range(400)]


def similarity(a, b):
    x, y = (Counter(words.WORD.findall((t or "").lower())) for t in (a, b))
    return (x & y).total() / max(1, (x | y).total())


def size(t):
    return len(words.WORD.findall((t or "").lower()))


def true_near(texts, threshold=0.8, least=25):
    """Pairs (i, j), i < j, of near texts."""
    return {(i, j) for j in range(len(texts)) for i in range(j) if min(size(texts[i]), size(texts[j])) >= least and similarity(texts[i], texts[j]) >= threshold - 1e-12}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [[rng.choice(VOCABULARY) for _ in range(rng.randint(20, 60))] for _ in range(60)]
    out = []
    for b in base:
        out.append(" ".join(b))
        for _ in range(rng.randint(0, 3)):
            c = list(b)
            for _ in range(rng.randint(0, 9)):
                c[rng.randrange(len(c))] = rng.choice(VOCABULARY)
            rng.shuffle(c)
            out.append(" ".join(c).upper() if rng.random() < 0.3 else ", ".join(c))
    long = " ".join(rng.choice(VOCABULARY) for _ in range(9000))
    copies = " ".join(VOCABULARY[:30])
    return [*out, None, "", "   ", "few words", *[copies] * 8, long, long + " extra", " ".join(["same"] * 40), " ".join(["same"] * 45), " ".join(["same"] * 60)]


def frame(spark, texts, **more):
    rows = [(i, t, f"r{i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "seq long, cleaned_text string, review_id string")


def test_elements_are_multisets():
    a, b = "a a b c", "a b b d"
    assert words.similarity(words.elements(a), words.elements(b)) == pytest.approx(similarity(a, b))
    assert words.elements(None) is None and words.elements("", 1) is None and words.elements("x", 2) is None


def test_near_pairs_equal_brute_force(spark, texts):
    found = near_dup.NearDuplicates(frame(spark, texts), "seq", "cleaned_text")
    pairs = [tuple(r) for r in found.row_pairs().collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == true_near(texts)
    links = {r["seq"]: r for r in found.links().collect()}
    assert set(links) == {i for i, t in enumerate(texts) if size(t) >= 25}
    assert links[len(texts) - 6]["copies"] == 8
    head = {i: i for i in links}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        head[b] = a
    sizes = Counter(root(i) for i in links)
    assert {(r["seq"], r["group_id"], r["size"]) for r in found.groups().collect()} == {(i, root(i), sizes[root(i)]) for i in links}


def test_a_long_chain_is_one_group(spark):
    chain = [list(VOCABULARY[100:140])]
    for k in range(25):
        c = list(chain[-1])
        for j in range(3):
            c[(3 * k + j) % 40] = f"z{k}{j}"
        chain.append(c)
    got = near_dup.NearDuplicates(frame(spark, [" ".join(c) for c in chain]), "seq", "cleaned_text").groups().collect()
    assert {(r["group_id"], r["size"]) for r in got} == {(0, 26)} and len(got) == 26


def test_extra_columns_and_empty_tables(spark, texts):
    clashing = frame(spark, texts[:30]).select("*", F.lit(1).alias("text"), F.lit("x").alias("bag"), F.lit(2).alias("rep"))
    assert {tuple(r) for r in near_dup.NearDuplicates(clashing, "seq", "cleaned_text").row_pairs().collect()} == true_near(texts[:30])
    empty = frame(spark, []).limit(0)
    assert near_dup.NearDuplicates(empty, "seq", "cleaned_text").row_pairs().count() == 0
    assert near_dup.NearDuplicates(frame(spark, [None, ""]), "seq", "cleaned_text").links().count() == 0


def test_thresholds_of_pruning():
    for n in near_dup.STEPS:
        m = near_dup.least_matches(n, 0.8, 1e-6)
        # So few matches are very unlikely at the threshold, and what is kept is below its expectation.
        assert 0 < m < 0.9 * n
        assert near_dup.least_matches(n, 0.8, 1e-3) >= m


def test_band_chance_at_threshold():
    assert (1 - 0.8**near_dup.WIDTH) ** near_dup.BANDS < 1e-5


def sequential(history, batch):
    """The rule itself: (key, batch, id, text) rows in order."""
    ids = {i for _, i, _ in history if i and i.strip()}
    kept = [t for _, _, t in history]
    out = []
    for key, _, rid, text in sorted(batch, key=lambda r: (r[1], r[0])):
        has = rid is not None and rid.strip() != ""
        if has and rid in ids or any(size(t) >= 25 and size(text) >= 25 and similarity(t, text) >= 0.8 - 1e-12 for t in kept):
            out.append(key)
        else:
            kept.append(text)
            if has:
                ids.add(rid)
    return set(out)


@pytest.fixture(scope="module")
def batches(texts):
    rng = random.Random(9)
    rows = [(i, rng.choice([f"r{rng.randrange(90)}", None, "", " "]), t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    half = len(rows) // 3
    new = [(i, rng.randint(1, 4), rid, t) for i, rid, t in rows[half:]]
    # A chain: each is near to the one before, not to the one before that.
    chain = [[*VOCABULARY[100:140]]]
    for k in range(8):
        c = list(chain[-1])
        for j in range(3):
            c[(3 * k + j) % 40] = f"z{k}{j}"
        chain.append(c)
    new += [(1000 + k, 2, None, " ".join(c)) for k, c in enumerate(chain)]
    return rows[:half], new


def new_frame(spark, new):
    return spark.createDataFrame(new, "seq long, batch_no int, review_id string, cleaned_text string")


def test_batches_at_once_and_one_by_one(spark, batches):
    history, new = batches
    wanted = sequential(history, new)
    h = spark.createDataFrame(history, "seq long, review_id string, cleaned_text string")
    at_once = incremental.IncrementalIndex(spark).build(h).admit(new_frame(spark, new))
    assert {r["seq"] for r in at_once.filter("duplicate").collect()} == wanted
    assert at_once.count() == len(new)
    index = incremental.IncrementalIndex(spark).build(h)
    found = set()
    for no in range(1, 5):
        index = incremental.IncrementalIndex(spark, index.path)  # what is on disk is all there is
        found |= {r["seq"] for r in index.admit(new_frame(spark, [r for r in new if r[1] == no])).filter("duplicate").collect()}
    assert found == wanted
    in_turn = incremental.IncrementalIndex(spark, bucket_rows=60).build(h).admit_batches(new_frame(spark, new), at_once=2)
    assert {r["seq"] for r in in_turn.filter("duplicate").collect()} == wanted and in_turn.count() == len(new)


def probed_bytes(index, batch):
    """Bytes of the files that a batch's tokens, ids and candidates lie in."""
    rows = index._prepared(batch, "seq", "batch_no", "review_id", "cleaned_text").filter("bag is not null").select("id", "bag", "text")
    total = 0
    for table, keys in (("postings", index._postings(rows).select("token")), ("texts", rows.select("id")), ("ids", batch.select("review_id"))):
        files = index.probed(table, keys).select("_metadata.file_path", "_metadata.file_size").distinct().collect()
        total += sum(f["file_size"] for f in files)
    return total


def test_a_batch_reads_as_much_of_a_longer_history(spark):
    rng = random.Random(2)
    words_ = [f"v{i}" for i in range(6000)]
    rows = [(i, f"r{i}", " ".join(rng.choice(words_) for _ in range(30))) for i in range(3000)]
    new = new_frame(spark, [(9000 + i, 1, f"r{i}", rows[i][2] + " more") for i in range(2)])
    read = []
    for n in (300, 3000):
        h = spark.createDataFrame(rows[:n], "seq long, review_id string, cleaned_text string")
        index = incremental.IncrementalIndex(spark, bucket_rows=50).build(h)
        read.append(probed_bytes(index, new))
        assert index.admit(new).filter("duplicate").count() == 2
    assert 0.8 <= read[1] / read[0] <= 1.2


def test_a_broken_run_leaves_the_index_as_it_was(spark, batches):
    history, new = batches
    h = spark.createDataFrame(history, "seq long, review_id string, cleaned_text string")
    index = incremental.IncrementalIndex(spark).build(h)
    other = incremental.IncrementalIndex(spark, index.path)
    index._segment(h.select("review_id"), "ids", 10)  # written, but no manifest names it
    again = incremental.IncrementalIndex(spark, index.path)
    assert again._manifest == other._manifest and again._rows("ids").count() == other._rows("ids").count()
    index.admit(new_frame(spark, new[:5]))
    with pytest.raises(RuntimeError):
        other.admit(new_frame(spark, new[5:9]))


def test_index_of_nothing(spark, batches):
    _, new = batches
    empty = spark.createDataFrame([], "seq long, review_id string, cleaned_text string")
    got = incremental.IncrementalIndex(spark).build(empty).admit(new_frame(spark, new), append=False)
    assert {r["seq"] for r in got.filter("duplicate").collect()} == sequential([], new)
    assert incremental.IncrementalIndex(spark).build(empty).admit(new_frame(spark, new).limit(0)).count() == 0


def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    rows = []
    for c in centres:
        for _ in range(rng.integers(1, 9)):
            rows.append(c + rng.normal(size=64) * rng.choice([0.05, 0.2, 0.6]))
    rows += [rng.normal(size=64) for _ in range(150)]
    rows += [rows[0]] * 9 + [rows[3] * 2.5, rows[3] * 0.5]
    out = [[float(np.float32(x)) for x in r] for r in rows]
    return [*out, None, [0.0] * 64, [1.0] * 63 + [float("nan")], [1.0, 2.0], [None] + [1.0] * 63]


def brute_pairs(rows, k=5, floor=0.9):
    ok = [i for i, r in enumerate(rows) if r is not None and len(r) == 64 and all(x is not None and x == x for x in r) and any(r)]
    x = np.array([rows[i] for i in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(np.minimum(x @ x.T, 1), 12)
    out = set()
    for a in range(len(ok)):
        order = sorted((b for b in range(len(ok)) if b != a), key=lambda b: (-s[a, b], ok[b]))[:k]
        out |= {(min(ok[a], ok[b]), max(ok[a], ok[b])) for b in order if s[a, b] >= floor}
    return out


def test_neighbours_of_all_kinds(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "seq long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("rep", F.lit(2))
    got = {tuple(r) for r in mih.MultiIndex(df).neighbour_pairs().collect()}
    wanted = brute_pairs(rows)
    assert got <= wanted and len(got) >= 0.97 * len(wanted)
    n = mih.MultiIndex(df).neighbours().collect()
    by_seq = defaultdict(list)
    for r in n:
        by_seq[r["seq"]].append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 5 for v in by_seq.values())


def test_neighbours_across_many_parts(spark, monkeypatch):
    monkeypatch.setattr(mih, "PART", 40)
    rows = vectors()
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "seq long, embedding array<float>")
    got = {tuple(r) for r in mih.MultiIndex(df).neighbour_pairs().collect()}
    assert len(got & brute_pairs(rows)) >= 0.97 * len(brute_pairs(rows)) and got <= brute_pairs(rows)


@pytest.mark.parametrize("crowded", [0, 1 << 30])
def test_blocks_meet_once_and_each_vector_goes_to_each_block(spark, monkeypatch, crowded):
    """A vector is sent once for each block, not for each part in reach of its probes, and both ways of comparing find the same pairs."""
    monkeypatch.setattr(mih, "PART", 2)
    monkeypatch.setattr(mih, "CROWDED", crowded)
    rows = vectors()
    index = mih.MultiIndex(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "seq long, embedding array<float>"))
    n, blocks = index.classes.count(), -(-index.classes.count() // 16)
    assert blocks > mih.BLOCKS and index._routed(blocks).count() == n * blocks
    found = [tuple(r) for r in index.candidates().collect()]
    assert len(found) == len(set(found)) and all(a < b for a, b in found)
    got = {tuple(r) for r in index.neighbour_pairs().collect()}
    assert got <= brute_pairs(rows) and len(got) >= 0.97 * len(brute_pairs(rows))


def brute_nearest(rows, k=5):
    ok = [i for i, r in enumerate(rows) if r is not None and len(r) == 64 and all(x is not None and x == x for x in r) and any(r)]
    x = np.array([rows[i] for i in ok], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(np.minimum(x @ x.T, 1), 12)
    return {(ok[a], ok[b], n) for a in range(len(ok)) for n, b in enumerate(sorted((b for b in range(len(ok)) if b != a), key=lambda b: (-s[a, b], ok[b]))[:k], 1)}


@pytest.mark.parametrize(("part", "every"), [(100_000, 1), (60, 3)])
def test_five_nearest_at_any_cosine(spark, monkeypatch, part, every):
    monkeypatch.setattr(mih, "PART", part)
    rows = vectors()
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "seq long, embedding array<float>")
    got = [(r["seq"], r["neighbour"], r["rank"]) for r in mih.MultiIndex(df).nearest(every=every).collect()]
    wanted = {(a, b) for a, b, _ in brute_nearest(rows) if a % every == 0}
    assert len(got) == len({(a, n) for a, _, n in got}) and {a for a, _, _ in got} <= {a for a, _ in wanted}
    assert len({(a, b) for a, b, _ in got} & wanted) >= 0.9 * len(wanted)


def test_nearest_of_few_and_of_none(spark):
    few = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.9, 0.2]), (3, [1.0, 0.1]), (4, None)], "seq long, embedding array<float>")
    got = {(r["seq"], r["neighbour"], r["rank"]) for r in mih.MultiIndex(few).nearest(every=1).collect()}
    assert got == {(1, 3, 1), (1, 2, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2)}
    assert {r["seq"] for r in mih.MultiIndex(few).nearest(every=2).collect()} == {2}
    assert mih.MultiIndex(few.filter("seq = 4")).nearest().count() == 0


def test_recall_of_the_nearest_on_the_table(spark):
    t = table(spark, f"{DATA}/sf0.01", "chunk_vectors").select("seq", "embedding").orderBy("seq").collect()
    wanted = {(t[a]["seq"], t[b]["seq"]) for a, b, _ in brute_nearest([None if r["embedding"] is None else list(r["embedding"]) for r in t]) if t[a]["seq"] % 20 == 0}
    got = {(r["seq"], r["neighbour"]) for r in mih.MultiIndex(table(spark, f"{DATA}/sf0.01", "chunk_vectors")).nearest().collect()}
    assert len(got & wanted) >= 0.9 * len(wanted)


def test_no_vectors(spark):
    empty = spark.createDataFrame([(1, None)], "seq long, embedding array<float>")
    assert mih.MultiIndex(empty).neighbour_pairs().count() == 0


def test_recall_on_the_table(spark):
    t = table(spark, f"{DATA}/sf0.01", "chunk_vectors").select("seq", "embedding").orderBy("seq").collect()
    wanted = {(t[a]["seq"], t[b]["seq"]) for a, b in brute_pairs([None if r["embedding"] is None else list(r["embedding"]) for r in t])}
    got = {tuple(r) for r in mih.MultiIndex(table(spark, f"{DATA}/sf0.01", "chunk_vectors")).neighbour_pairs().collect()}
    assert len(got & wanted) >= 0.98 * len(wanted) and got <= wanted
