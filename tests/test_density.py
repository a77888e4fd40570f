"""Density clustering, delivery files, bundles and the filter of quotes."""

import json
import random
from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewloom.operators import analytics, delivery, density, fee, report, validate
from reviewloom.plans import pipeline
from reviewloom.sources.tables import table


def blobs(n=60, noise=15):
    rng = np.random.default_rng(42)
    centres = rng.normal(size=(4, 32)) * 10
    rows = [(f"c{k}_{i}", f"r{k}_{i}", (centres[k] + rng.normal(size=32) * 0.5).tolist()) for k in range(4) for i in range(n + 10 * k)]
    return rows + [(f"n{i}", f"n{i}", (rng.normal(size=32) * 10).tolist()) for i in range(noise)]


@pytest.mark.parametrize(("micro", "outliers"), [(3000, 0.6), (120, 0.4)])
def test_blobs_are_clusters_and_the_rest_noise(spark, micro, outliers):
    rows = [*blobs(), ("z", "z", [0.0] * 32), ("u", "u", None)]
    df = spark.createDataFrame(rows, "chunk_id string, review_id string, embedding array<float>")
    found = {r["chunk_id"]: r["label"] for r in density.hdbscan(df, least=30, micro=micro).collect()}
    assert "z" not in found and "u" not in found and len(found) == len(rows) - 2
    of = [{found[c] for c in found if c.startswith(f"c{k}_")} for k in range(4)]
    assert all(len(x) == 1 for x in of) and set.union(*of) == {0, 1, 2, 3} and of[3] == {0}
    noise = [found[c] for c in found if c.startswith("n")]
    # Those that a cluster reaches before it meets another belong to it: 10 of 15 are outliers, 7 by a third of the rows as micro-clusters.
    assert noise.count(-1) >= outliers * len(noise)


def test_few_vectors_are_no_cluster(spark):
    df = spark.createDataFrame([("a", "a", [1.0, 0.0]), ("b", "b", [0.0, 1.0])], "chunk_id string, review_id string, embedding array<float>")
    assert {r["label"] for r in density.hdbscan(df).collect()} == {-1}
    assert density.hdbscan(df.limit(0)).count() == 0 and density.hdbscan(df.limit(1)).first()["label"] == -1


def test_spanning_tree_and_core_distances():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert np.allclose(density.core_distances(d, np.ones(40), 5), np.sort(d, axis=1)[:, 4])
    assert np.allclose(density.core_distances(d, np.full(40, 3.0), 5), np.sort(d, axis=1)[:, 1])
    edges = density.spanning_tree(d)
    head = list(range(40))
    total = 0.0
    for length, a, b in sorted((d[i, j], i, j) for i in range(40) for j in range(i)):
        while head[a] != a:
            a = head[a]
        while head[b] != b:
            b = head[b]
        if a != b:
            head[a] = b
            total += length
    assert len(edges) == 39 and sum(e[0] for e in edges) == pytest.approx(total)


WORDS = st.text(st.sampled_from("abcd e"), min_size=1, max_size=40)


@settings(max_examples=400, deadline=None)
@given(WORDS, WORDS, st.sampled_from([70.0, 85.0, 95.0]))
def test_bigrams_lose_no_quote(a, b, threshold):
    if validate.partial_ratio(a, b) >= threshold:
        (i, n), (j, m) = validate.bigrams(a), validate.bigrams(b)
        common = sum(min(x, dict(zip(j.tolist(), m.tolist())).get(k, 0)) for k, x in zip(i.tolist(), n.tolist()))
        assert common >= validate.least_common_bigrams(np.array(min(len(a), len(b))), threshold)


def test_quotes_against_brute_force(spark):
    reviews = ["the app keeps crashing when i log in every morning", "withdrawal takes five days and nobody answers", "ok", "", None, "x" * 300 + " hidden charges everywhere in this app " + "y" * 300]
    quotes = ["app keeps crashing when i login every mornin", "withdrawal took five days and nobody answered", "hidden chargs everywhere in this ap", "something nobody ever wrote here", "ok", "q"]
    r = spark.createDataFrame([(t, None) for t in reviews], "original_text string, cleaned_text string")
    q = spark.createDataFrame([(1, i, t) for i, t in enumerate(quotes)], "report_id int, line_no int, quote string")
    got = {x["line_no"]: (x["matched"], x["score"]) for x in validate.quote_match(q, r).collect()}
    for i, t in enumerate(quotes):
        best = max(validate.partial_ratio(t, s) for s in reviews if s)
        assert got[i][0] == (best >= 85) and (best < 85 or got[i][1] >= 85)


def test_quotes_beyond_one_pass(spark, monkeypatch):
    """More quotes than one pass takes are all looked for; pieces find a quote anywhere in a text, and the rest is compared with all."""
    monkeypatch.setattr(validate, "QUOTES_AT_ONCE", 7)
    rng = random.Random(2)
    words = ["payment", "screen", "\u0928\u092e\u0938\u094d\u0924\u0947", "login", "\U0001f600", "refund", "slow", "chart", "order", "fees"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    quotes = ["fees", "nothing like any of these texts at all", "zz" * 20]
    for i, t in enumerate(texts):
        at = rng.randrange(max(1, len(t) - 50))
        part = t[at : at + 50]
        quotes += [part, f"#{part[:20]}{part[22:]}##", part[::-1]]
    r = spark.createDataFrame([(t, None) for t in texts], "original_text string, cleaned_text string")
    q = spark.createDataFrame([(1, i, t) for i, t in enumerate(quotes)], "report_id int, line_no int, quote string")
    got = {x["line_no"]: (x["matched"], x["score"]) for x in validate.quote_match(q, r).collect()}
    for i, t in enumerate(quotes):
        best = max(validate.partial_ratio(t, s) for s in texts)
        assert got[i][0] == (best >= 85) and (got[i][1] == 100 or not any(t in s for s in texts))
    looked = validate.Pieces([t for t in quotes if len(t) >= validate.PIECE])
    marks = np.zeros(len(looked.quotes), bool)
    looked.look(texts, marks, np.zeros(len(marks), np.int64), [None] * len(marks))
    assert marks.tolist() == [any(t in s for s in texts) for t in looked.quotes]


def test_reports_go_out_once(tmp_path):
    log = delivery.AuditLog(str(tmp_path / "log" / "audit.json"))
    pending = json.dumps({"product": "My App", "week_start": "2026-07-16", "week_end": "2026-09-10", "review_count": 3, "theme_count": 1, "report_markdown": "# Hi", "report_key": "k1"})
    sent = []

    class Channel:
        def send(self, subject, html, recipients):
            sent.append(subject)
            return True

    again = delivery.load_pending(delivery.save_pending(str(tmp_path), pending))
    assert again == pending
    assert pipeline.deliver(again, Channel(), ["a@b.example"], set(), log, str(tmp_path))["ok"]
    assert pipeline.deliver(again, Channel(), ["a@b.example"], set(), log) is None and len(sent) == 1
    assert (tmp_path / "report_my_app_2026-07-16.md").read_text() == "# Hi"
    assert list(log.entries()) == ["My App_2026-07-16"] and log.entries()["My App_2026-07-16"]["recipients"] == "a@b.example"
    log.path.write_text("{broken")
    assert log.entries() == {} and not log.delivered("My App", "2026-07-16", "k1")


def test_windows_and_steps():
    assert delivery.window(None, today=date(2026, 9, 10)) == (date(2026, 7, 16), date(2026, 9, 10))
    with pytest.raises(ValueError):
        delivery.window(date(2026, 7, 1), date(2026, 7, 1))
    assert delivery.step_label("pii_scrub") == "Removing personal data" and delivery.step_label("new_step") == "New step" and delivery.step_label(None) == ""
    assert delivery.raw_cache_path("/x", "My App", "a", "b") == "/x/my_app_a_b"


def test_inline_marks():
    assert report.inline("**bold** and *it* and [x](https://a.b/c)") == '<strong>bold</strong> and <em>it</em> and <a href="https://a.b/c">x</a>'
    assert report.inline("5 * 3 ** 2 [no](ftp://x) *") == "5 * 3 ** 2 [no](ftp://x) *" or "<" in report.inline("5 * 3 ** 2 [no](ftp://x) *")
    assert report.truncate("one  two three", 8) == "one two..." and report.truncate("longword", 3) == "lon..." and report.truncate("", 3) == ""


def test_insights_bundle(spark):
    d = "/root/testdata/sf0.001"
    from reviewloom.plans.insight_queries import members, reviews

    m, r = members(spark, d), reviews(spark, d)
    themes = m.select("theme_id").distinct().selectExpr("theme_id", "concat('t', theme_id) as label")
    found = analytics.insights(table(spark, d, "raw_reviews"), r, table(spark, d, "chunk_vectors"), m, themes, fee.fee_reviews(r, m))
    json.dumps(found, default=str)
    assert [x["position"] for x in found["funnel"]] == [1, 2, 3, 4, 5] and len(found["ratings"]) == 5
    assert found["largest_theme"]["rank"] == 1 and found["worst_theme"]["avg_rating"] == min(t["avg_rating"] for t in found["themes"])
