"""Operators on small literal tables: expected values, nulls, ties, repeated rows, empty tables, extra columns."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reviewloom.config import EngineConfig
from reviewloom.functions import text as T
from reviewloom.operators import analytics, chunk, clean, dedup, fee, registry, report, themes, validate, vectors
from reviewloom.plans import catalog
from reviewloom.schemas import CLEAN_REVIEW, SCRAPED

TWELVE = [
    ("r1", "1", "2026-08-10", 50, "18.15.1"), ("r2", "1", "2026-08-11", 30, "18.15.1"), ("r3", "2", "2026-08-12", 10, "18.15.1"), ("r4", "5", "2026-08-13", 0, "18.15.1"),
    ("r5", "5", "2026-08-17", 1, "18.16.0"), ("r6", "4", "2026-08-18", 2, "18.16.0"), ("r7", "3", "2026-08-19", 0, "18.16.0"), ("r8", "5", "2026-08-24", 0, None),
    ("r9", "5", "2026-08-25", 0, None), ("r10", "4", "2026-08-26", 5, "18.15.1"), ("r11", "5", "2026-08-27", 0, "18.15.1"), ("r12", "5", "2026-08-28", 0, "18.15.1"),
]


def reviews(spark, rows, texts=None):
    data = [(i, r[0], f"Text {r[0]}" if texts is None else texts[i], f"text {r[0]}" if texts is None else (texts[i] or "").lower() if texts[i] is not None else None, r[1], r[2], "App User", r[3], r[4]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, CLEAN_REVIEW)


@pytest.fixture(scope="module")
def twelve(spark):
    return reviews(spark, TWELVE).withColumn("rank", F.lit(9)).withColumn("n", F.lit(9)).cache()


@pytest.fixture(scope="module")
def members(spark):
    rows = [(0, r) for r in ("r1", "r2", "r3")] + [(1, r) for r in ("r4", "r5", "r6", "r11", "r12")]
    return spark.createDataFrame([(t, r, i) for i, (t, r) in enumerate(rows)], "theme_id int, review_id string, pos long")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_ratings(spark, twelve):
    assert rows(analytics.rating_summary(twelve), "total", "average", "negative_count", "negative_pct") == [(12, 3.75, 3, 25.0)]
    assert sorted(rows(analytics.rating_distribution(twelve), "stars", "n")) == [(1, 2), (2, 1), (3, 1), (4, 2), (5, 6)]
    odd = reviews(spark, [("a", x, None, None, None) for x in ("5", "0", "9", "bad", None, "3.0", " 4 ", "-1", "99999999999")])
    assert rows(analytics.rating_summary(odd), "total", "average") == [(2, 4.5)]
    assert sorted(rows(analytics.rating_distribution(odd.limit(0)), "stars", "n", "pct")) == [(s, 0, 0.0) for s in range(1, 6)]


def test_trend(spark, twelve):
    got = {str(w): (n, a) for w, n, a in rows(analytics.weekly_trend(twelve), "week", "n", "avg_rating")}
    assert {w: n for w, (n, _) in got.items()} == {"2026-08-10": 4, "2026-08-17": 3, "2026-08-24": 5}
    odd = reviews(spark, [("a", "bad", "2026-08-10", 0, ""), ("b", "9", "2026-08-18T10:00", 0, ""), ("c", "5", "not-a-date", 0, ""), ("d", "5", "", 0, ""), ("e", "5", None, 0, ""), ("f", "5", "2026-02-31", 0, "")])
    assert sorted((str(w), n, a) for w, n, a in rows(analytics.weekly_trend(odd), "week", "n", "avg_rating")) == [("2026-08-10", 0, 0.0), ("2026-08-17", 1, 0.0)]
    assert [c for _, c in sorted(rows(analytics.weekly_change(twelve), "week", "n_change"))] == [None, -1, 2]


def test_themes(spark, twelve, members):
    got = {r["theme_id"]: r for r in analytics.theme_breakdown(members, twelve).collect()}
    assert (got[0]["n"], got[0]["thumbs_up"], got[0]["negative_pct"], got[1]["negative_pct"], got[1]["rank"]) == (3, 90, 100.0, 0.0, 1)
    ghosts = spark.createDataFrame([(4, "nope1", 0), (4, "nope2", 1), (4, None, 2)], members.schema)
    assert rows(analytics.theme_breakdown(ghosts, twelve), "n", "avg_rating", "thumbs_up") == [(3, 0.0, 0)]
    assert rows(analytics.worst_theme(members, twelve), "theme_id") == [(0,)] and rows(analytics.largest_theme(members, twelve), "theme_id") == [(1,)]
    twice = twelve.unionByName(twelve.filter("review_id = 'r1'").withColumn("rating", F.lit("5")).withColumn("seq", F.lit(99).cast("long")))
    assert {r["theme_id"]: r["avg_rating"] for r in analytics.theme_breakdown(members, twice).collect()}[0] == 2.67
    assert analytics.theme_breakdown(members.limit(0), twelve).count() == 0


def test_versions_and_quotes(spark, twelve):
    assert analytics.version_breakdown(twelve).count() == 0
    many = reviews(spark, [(f"a{i}", "4", None, 0, "1.0") for i in range(25)] + [(f"b{i}", "2", None, 0, None) for i in range(50)] + [(f"c{i}", "1", None, 0, "") for i in range(50)])
    assert rows(analytics.version_breakdown(many), "version", "n", "negative_pct", "position") == [("1.0", 25, 0.0, 1)]
    assert [r["thumbs_up"] for r in analytics.top_quotes(twelve).orderBy("seq").collect()] == [50, 30, 10]
    blank = reviews(spark, [(f"x{i}", "1", None, None if i else 7, None) for i in range(9)], ["", *["t"] * 8])
    assert [r["seq"] for r in analytics.top_quotes(blank).orderBy("seq").collect()] == [1, 2, 3, 4]


def test_funnel_and_fees(spark, twelve, members):
    raw, chunks = spark.range(20), spark.range(14)
    noise = members.unionByName(spark.createDataFrame([(-1, "r8", 8), (-1, "r9", 9)], members.schema))
    got = analytics.funnel(raw, twelve, chunks, noise).orderBy("position").collect()
    assert [r["n"] for r in got] == [20, 12, 14, 8, 2] and [r["pct_of_raw"] for r in got][:2] == [100.0, 60.0]
    assert {r["pct_of_raw"] for r in analytics.funnel(raw.limit(0), twelve, chunks, noise).collect()} == {0.0}
    texts = ["I feel great", "no words here", "hidden things", None, "COFFEE", "plain", "x", "x", "x", "x", "x", "stamp  duty"]
    fees = fee.fee_reviews(reviews(spark, TWELVE, texts), members)
    assert sorted(r["review_id"] for r in fees.collect()) == ["r1", "r3", "r5"]
    assert rows(fee.fee_reviews(reviews(spark, TWELVE, texts), members, whole_words=True), "review_id") == [("r3",)]
    assert rows(analytics.fee_stats(fees, twelve), "n", "pct_of_corpus", "avg_rating") == [(3, 25.0, 2.67)]
    assert rows(analytics.fee_stats(fees.limit(0), twelve.limit(0)), "n", "pct_of_corpus", "avg_rating") == [(0, 0.0, 0.0)]
    assert all(any(k in w for k in fee.minimal_keywords()) for w in fee.FEE_KEYWORDS)


SCRAPED_ROWS = [
    (0, "a", "u", "Great app <b>works</b> see https://x.example/y now", 5, datetime(2026, 8, 1), 1, "1"),
    (1, "a", "u", "second row of the same id", 1, datetime(2026, 8, 2), 1, "1"),
    (2, "", "u", "no id at all in this one", 1, datetime(2026, 8, 2), 1, "1"),
    (3, None, None, None, None, None, None, None),
    (4, "b", None, "an old review from before the window", 3, datetime(2026, 7, 1), None, None),
    (5, "c", "u", "a review without any time is kept", 0, None, 2, ""),
    (6, "d", "u", "short", 4, datetime(2026, 7, 16), 0, None),
    (7, "e", "u", "  \n\t ", 4, datetime(2026, 7, 16), 0, None),
    (8, "f", "u", "हिन्दी", 4, datetime(2026, 7, 16), 0, None),
    (9, "g", "u", "la aplicacion es muy buena pero no me gusta el precio", 4, datetime(2026, 7, 16), 0, None),
    (10, "h", "u", "ＡＢＣ is the very good café app", 4, datetime(2026, 7, 16), 0, None),
]


def test_fetch_and_clean(spark):
    scraped = spark.createDataFrame(SCRAPED_ROWS, SCRAPED).withColumn("extra", F.lit(1))
    got = {r["review_id"]: r for r in clean.fetch(scraped).collect()}
    assert sorted(got) == ["a", "c", "d", "e", "f", "g", "h"] and got["a"]["seq"] == 0 and got["c"]["date"] == "" and got["a"]["date"] == "2026-08-01"
    cfg = EngineConfig(enforce_week_end=True)
    assert sorted(r["review_id"] for r in clean.fetch(scraped, cfg, "2026-07-20").collect()) == ["c", "d", "e", "f", "g", "h"]
    reasons = {r["review_id"]: r["reason"] for r in clean.with_reason(clean.fetch(scraped)).collect()}
    assert reasons == {"a": None, "c": None, "d": "short", "e": "empty", "f": "empty", "g": "non_english", "h": None}
    kept = {r["review_id"]: r for r in clean.clean(clean.fetch(scraped)).collect()}
    assert kept["a"]["original_text"] == "Great app works see  now" and kept["h"]["original_text"] == "ABC is the very good caf app" and kept["h"]["cleaned_text"] == "abc is the very good caf app"
    assert {r["outcome"]: r["n"] for r in clean.discards(clean.fetch(scraped)).collect()} == {"kept": 3, "short": 1, "empty": 2, "non_english": 1}
    assert clean.clean(clean.fetch(scraped.limit(0))).count() == 0


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "wanted"),
    [("ＡＢＣ", "ABC"), ("hello\x00world\x01test", "helloworldtest"), ("café", "caf"), ("éa", "a"), (None, None), ("", ""), (" \n a \t", "a")],
)
def test_normalise(spark, value, wanted):
    assert one(spark, T.normalise_unicode, value) == wanted


@pytest.mark.parametrize(
    ("value", "wanted"),
    [
        ("call me at +91 98765 43210 please", "call me at [PHONE]please"),
        ("contact user@example.com for help", "contact [EMAIL] for help"),
        ("my order ORD123456789 is pending", "my order [ID] is pending"),
        ("ord123456789", "ord[PHONE]"),
        ("my name is John Smith and I need help", "[NAME] and I need help"),
        ("i am frustrated", "[NAME]"),
        ("this is a normal review about the app", "this is a normal review about the app"),
        (None, None),
    ],
)
def test_scrub(spark, value, wanted):
    assert one(spark, lambda c: T.scrub(c)[0], value) == wanted


def test_scrub_counts(spark):
    r = reviews(spark, [("a", "1", "", 0, "")] * 2, ["ORD123456789 a@b.co", None])
    got = clean.pii_scrub(r).orderBy("seq").collect()
    assert (got[0]["n_email"], got[0]["n_id"], got[0]["n_phone"], got[0]["n_name"]) == (1, 1, 1, 0) and got[1]["original_text"] is None
    assert clean.pii_counts(r).first().asDict() == {"n_email": 1, "n_id": 1, "n_name": 0, "n_phone": 1, "reviews_with_pii": 1}


def test_shingles(spark):
    for value, wanted in (("a b c d", ["a b c", "b c d"]), ("a b", ["a", "b"]), ("", [""]), (None, [""]), ("a b c a b c", ["a b c", "b c a", "c a b"]), ("  a  b\nc ", ["a b c"])):
        assert one(spark, T.shingles, value) == wanted


def test_near_dedup(spark):
    base = " ".join(f"w{i}" for i in range(60))
    b = base.replace("w0 ", "x0 ")
    c = b.replace(" w59", " y59").replace(" w58", " y58").replace(" w57", " y57")
    rows_ = [("late", "1", "2026-08-20", 0, ""), ("early", "1", "2026-08-01", 0, ""), ("undated", "1", "", 0, ""), ("other", "1", "2026-08-01", 0, ""), ("null", "1", None, 0, ""), ("null2", "1", None, 0, "")]
    n = dedup.ShingleNeighbours(reviews(spark, rows_, [base, base, b, "unlike the rest", None, ""]))
    assert sorted(r["seq"] for r in n.first_only().collect()) == [2, 3, 4]
    assert {r["seq"]: (r["copies"], r["links"]) for r in n.neighbour_counts().collect()} == {0: (2, 1), 1: (2, 1), 2: (1, 1), 3: (1, 0), 4: (2, 0), 5: (2, 0)}
    chain = dedup.ShingleNeighbours(reviews(spark, [("a", "1", "2026-08-01", 0, ""), ("b", "1", "2026-08-02", 0, ""), ("c", "1", "2026-08-03", 0, "")], [base, b, c]))
    assert {tuple(r) for r in chain.pairs.select("a", "b").collect()} == {(0, 1), (1, 2)}
    assert sorted(r["seq"] for r in chain.first_only().collect()) == [0] and sorted(r["seq"] for r in chain.greedy().collect()) == [0, 2]
    assert dedup.ShingleNeighbours(reviews(spark, rows_, [base] * 6).limit(0)).greedy().count() == 0


def test_exact_dedup(spark):
    r = reviews(spark, [("x", "1", "", 0, ""), ("x", "2", "", 0, ""), ("", "3", "", 0, ""), ("", "4", "", 0, ""), (None, "5", "", 0, ""), (None, "6", "", 0, "")])
    assert sorted(x["seq"] for x in clean.exact_dedup(r).collect()) == [0, 2, 4]


def test_chunks(spark):
    texts = ["short one", " ".join(["word"] * 600), " ".join(["word"] * 1025), "One here. Two there! " * 160, None, ""]
    r = reviews(spark, [(f"r{i}", "1", "", 0, "") for i in range(6)], texts)
    got = {}
    for x in chunk.chunk(r).collect():
        got.setdefault(x["seq"], []).append(x)
    assert {k: len(v) for k, v in got.items()} == {0: 1, 1: 1, 2: 3, 3: 320, 4: 1, 5: 1}
    assert got[2][0]["chunk_id"].startswith("r2_chunk_") and {x["total_chunks"] for x in got[2]} == {3}
    assert {t: n for t, n in rows(chunk.tier_counts(r), "tier", "n")} == {"whole": 3, "sentence": 2, "sliding": 1}
    assert sorted(n for s, n in rows(chunk.sliding_chunks(r), "seq", "n_tokens") if s == 1) == [216, 512]


def test_batches_and_cache(spark):
    c = spark.createDataFrame([(i, f"c{i}") for i in range(600)] + [(600, None)], "seq long, chunk_id string")
    cached = spark.createDataFrame([("c0",), ("c7",), (None,)], "chunk_id string")
    assert sorted(rows(chunk.batch_sizes(c, cached), "batch_id", "n", "first_seq")) == [(0, 256, 1), (1, 256, 258), (2, 87, 514)]
    numbered = clean.row_numbers(c.repartition(7), "seq")
    assert all(r["row_no"] == r["seq"] + 1 for r in numbered.collect())
    old, new = c.filter("seq < 2").withColumn("v", F.lit("old")), c.filter("seq = 1").withColumn("v", F.lit("new"))
    assert sorted(rows(chunk.upsert(old, new), "chunk_id", "v")) == [("c0", "old"), ("c1", "new")]


def test_vectors(spark):
    v = spark.createDataFrame([("a_chunk_0", "a", 0, [1.0, 0.0], 1), ("a_chunk_1", "a", 1, [0.0, 1.0], 2), ("b_chunk_0", "b", 0, [1.0, 1.0], 3), ("c_chunk_0", "c", 0, None, 4), ("d_chunk_0", "d", 0, [0.0, 0.0], 5)], "chunk_id string, review_id string, chunk_index int, embedding array<float>, seq long")
    m = spark.createDataFrame([(0, r, i) for i, r in enumerate("abcd")], "theme_id int, review_id string, pos long")
    r = reviews(spark, [(x, "1", "", 0, "") for x in "abcd"], ["A", "", "C", "D"])
    assert rows(vectors.representative_quotes(v, m, r), "review_id", "rank", "quote") == [("a", 2, "A")]
    votes = spark.createDataFrame([("r", "r10_chunk_0", 1), ("r", "r1_chunk_0", 2), ("q", "q0", -1), ("q", "q1", -1), ("q", "q2", 3), (None, "z", 1)], "review_id string, chunk_id string, label int")
    assert sorted(rows(vectors.majority_vote(votes), "review_id", "theme_id")) == [("q", -1), ("r", 1)]
    many = spark.createDataFrame([(t, f"{t}_{i}", i) for t in range(12) for i in range(12 - t if t < 10 else 4)], m.schema)
    got = {x["theme_id"]: x for x in vectors.cap_and_rank(many).collect()}
    assert [t for t in got if got[t]["final_id"] == -2] == [9, 10, 11] or {t for t in got if got[t]["final_id"] == -2} == {9, 10, 11}
    assert got[9]["n"] == 11 and got[9]["rank"] == 3 and got[9]["is_top_3"]  # ranks after theme 1 of the same size
    assert rows(vectors.cluster_shape(votes), "clusters") == [(3,)] and rows(vectors.cluster_shape(votes.limit(0)), "clusters", "noise_share") == [(0, 0.0)]
    meta = {x["chunk_id"]: x["review_id"] for x in vectors.chunk_meta(spark.createDataFrame([("x_chunk_1_chunk_0", 1), ("odd", 1), ("a_chunk_0", 0)], "chunk_id string, label int"), v).collect()}
    assert meta == {"x_chunk_1_chunk_0": "x_chunk_1", "odd": "odd", "a_chunk_0": "a"}
    e = {x["seq"]: x["embedding"] for x in vectors.hash_embed(reviews(spark, [("a", "", "", 0, "")] * 3, ["same words", "same words", None]), "seq", "cleaned_text").collect()}
    assert e[0] == e[1] and sum(x * x for x in e[0]) == pytest.approx(1, abs=1e-5) and set(e[2]) == {0.0}


LABELS = [
    ('"Fund withdrawal delays"', "Fund withdrawal delays"), ("**Hidden brokerage charges**", "Hidden brokerage charges"), ("Theme: KYC verification delays", "KYC verification delays"),
    ("Category - Order failures", "Order failures"), ("1. Order execution failures", "Order execution failures"), ("App crashes.", "App crashes"), ("a   b", "a b"), ("thinking\nLast line", "Last line"),
    ("Theme 1", ""), ("cluster 3", ""), ("General", ""), ("Other", ""), ("N/A", ""), ("", ""), (None, ""), (" ".join(["w"] * 20), "w w w w w w"),
]


@pytest.mark.parametrize(("raw", "wanted"), LABELS)
def test_labels(spark, raw, wanted):
    assert one(spark, themes.clean_label, raw) == wanted


def test_keywords(spark):
    s = spark.createDataFrame([(0, 0, "Charges charges deducted refund refund"), (0, 1, "deducted again"), (1, 0, "the app"), (2, 0, "zeta alpha")], "theme_id int, pos long, text string")
    got = dict(rows(themes.keyword_labels(s), "theme_id", "label"))
    assert got == {0: "Charges, deducted, refund", 2: "Zeta, alpha"}
    ranked = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "theme_id int, rank int")
    answers = spark.createDataFrame([(0, "Theme 4"), (2, "Login trouble.")], "theme_id int, raw string")
    assert dict(rows(themes.label_themes(ranked, s, answers), "theme_id", "label")) == {0: "Charges, deducted, refund", 1: "Unnamed theme 2", 2: "Login trouble"}
    assert dict(rows(themes.prompt_blocks(s), "theme_id", "block"))[0] == "1. Charges charges deducted refund refund\n2. deducted again"


GOOD = "# R\n## Summary of Top Themes\nx\n## supporting user quotes\n> crashes on login\n>> > nested\n>\n> [!NOTE]\n## Key Observation\n##  Action Ideas"


def test_validation(spark):
    reps = spark.createDataFrame([(1, GOOD), (2, "## Key Observation\n> never said by anyone at all"), (3, None)], "report_id long, markdown string")
    q = validate.blockquotes(reps)
    assert sorted(rows(q, "report_id", "quote")) == [(1, "> nested"), (1, "crashes on login"), (2, "never said by anyone at all")]
    src = reviews(spark, [("a", "", "", 0, "")] * 3, ["The app crashes on login every day", "and it was >nested too", None])
    match = validate.quote_match(q, src)
    assert {(r["report_id"], r["line_no"]): r["matched"] for r in match.collect()} == {(1, 4): True, (1, 5): True, (2, 1): False}
    lacking = validate.missing_sections(reps)
    assert sorted(rows(lacking.groupBy("report_id").count(), "report_id", "count")) == [(2, 3), (3, 4)]
    assert dict(rows(validate.decide(reps, match, lacking), "report_id", "passed")) == {1: True, 2: False, 3: False}
    t = spark.createDataFrame([(0, "Key OBSERVATION", 30), (1, "crash", 29), (2, None, 99), (3, "zzz", 31)], "theme_id int, label string, n long")
    assert sorted(rows(validate.theme_coverage(reps.limit(1), t), "theme_id", "covered")) == [(0, True), (3, False)]
    assert validate.quote_match(q.limit(0), src).count() == 0 and validate.quote_match(q, src.limit(0)).filter("matched").count() == 0


def test_partial_ratio():
    assert validate.partial_ratio("abc", "xxabcxx") == 100 and validate.partial_ratio("", "") == 100 and validate.partial_ratio("", "x") == 100
    assert validate.partial_ratio("abcd", "xxabxdxx") == pytest.approx(75) and validate.partial_ratio("abc", "xyz") == 0


def test_registry(spark):
    ev = spark.createDataFrame(
        [("a", 1, "queued", "x"), ("a", 2, "running", None), ("b", 3, "queued", None), ("a", 4, None, "y"), ("b", 5, "awaiting_approval", None), ("c", 6, "delivering", None), ("d", 7, "delivered", None)],
        "run_id string, event_seq long, status string, step string",
    )
    assert [(r["run_id"], r["status"], r["step"]) for r in registry.latest(ev).orderBy("run_id").collect()] == [("a", "running", "y"), ("b", "awaiting_approval", None), ("c", "delivering", None), ("d", "delivered", None)]
    assert [r["run_id"] for r in registry.list_runs(ev, 2).collect()] == ["d", "c"] and len(registry.list_runs(ev, 0).collect()) == 1
    assert rows(registry.active_run(ev), "run_id") == [("c",)] and sorted(rows(registry.reset_stuck(ev), "run_id", "event_seq")) == [("a", 8), ("c", 8)]
    assert rows(registry.invalid_changes(ev), "run_id", "was", "status") == [("b", "queued", "awaiting_approval")]
    assert registry.active_run(ev.limit(0)).count() == 0 and rows(registry.get_run(ev, "a"), "status") == [("running",)]
    assert one(spark, registry.slug, "My App! (v2)") == "my_app___v2" and one(spark, registry.slug, "!!") == "report" and one(spark, registry.slug, None) == "report"


def test_report():
    t = [{"label": "Login <b>", "n": 9, "share_pct": 60.0, "avg_rating": 1.5, "rank": 1}]
    text = report.markdown("App", t, [{"text": "can not\nlog in"}], {"n": 2, "pct_of_corpus": 10.0})
    assert all(f"## {s}" in text for s in validate.REQUIRED_SECTIONS) and "> can not log in" in text
    html = report.to_html(text)
    assert "<b>" not in html and "&lt;b&gt;" in html and "<blockquote>" in html
    assert report.markdown("App", [], [], {}) and report.truncate("a b c d", 4) == "a b..." and report.severity(2.0) == "high"
    assert report.report_key("a", "b", "c") == "b05ddb8b9e4e" or len(report.report_key("a", "b", "c")) == 12


def test_partitioning_does_not_matter(spark, twelve):
    for f in (analytics.weekly_trend, analytics.rating_summary, clean.exact_dedup, clean.pii_scrub, chunk.chunk):
        assert sorted(map(str, f(twelve.repartition(1)).collect())) == sorted(map(str, f(twelve.repartition(7)).collect()))


def test_all_quotes_are_matched(spark, tmp_path):
    texts = [f"review number {i} tells of a screen that froze while paying {i * 37} rupees to a shop" for i in range(60)]
    rows = [(i, f"r{i}", t, t, 40 + i) for i, t in enumerate(texts)] + [(60, "r60", texts[0], texts[0], 39)]
    spark.createDataFrame(rows, "seq long, review_id string, original_text string, cleaned_text string, thumbs_up_count int").coalesce(1).write.parquet(str(tmp_path / "clean_reviews.parquet"))
    got = {r["line_no"]: r["matched"] for r in catalog.QUERIES["quote_match"](spark, str(tmp_path)).collect()}
    quotes = [t[4:64] if i % 2 == 0 else f"zz#{t[4:64]}#zz" for i, t in enumerate(texts)]
    assert got == {i: any(validate.partial_ratio(q, t) >= 85 for t in texts) for i, q in enumerate(quotes)} and len(got) == 60


def test_kmeans_takes_the_best_of_ten_starts(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    seeds, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, *a: seeds.append(self.getSeed()) or fit(self, *a))
    df = spark.createDataFrame([(f"c{i}", f"r{i}", [float(i % 5), 1.0]) for i in range(20)], "chunk_id string, review_id string, embedding array<float>")
    assert vectors.kmeans(df).count() == 20 and seeds == list(range(42, 52))
