"""Tokenizer, splitting, mixing, personal values and themes."""

import random

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewloom.llm import mixing, peaks, pii, splitting, tokenizer
from reviewloom.sources.tables import table

DATA = "/root/testdata"
B = tokenizer.bpe()


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(f"{tokenizer.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def documents(sf="sf0.01"):
    return pq.read_table(f"{DATA}/{sf}/documents.parquet").to_pylist()


def test_ids_equal_public_library(public):
    texts = [d["text"] for d in documents() if d["text"]]
    assert [B.encode(t) for t in texts] == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


SIGNS = st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("  \n\t\r'stredmlv 0129éहि😀\x1c\x85 ​<|endoftext|>")))


@settings(max_examples=300, deadline=None)
@given(st.text(SIGNS, max_size=60))
def test_any_text_equals_definition_and_round_trips(text):
    ids = B.encode(text)
    assert ids == [i for w in B.words(text) for i in B.merged(w.encode())] == [i for w in B.words(text) for i in B.encode_bytes(w.encode())]
    d = tokenizer.StreamDecoder(B)
    assert d.push(ids) + d.close() == text
    assert "".join(d.push([i]) for i in ids) + d.close() == text


def test_boundaries_by_undoing_merges():
    rng = random.Random(4)
    for _ in range(20_000):
        a, b = rng.choice((rng.randrange(50_256), rng.randrange(1500))), rng.choice((rng.randrange(50_256), rng.randrange(1500)))
        x, y = B.bytes_of[a], B.bytes_of[b]
        assert B.fits(a, b) == (x + y not in B.ranks and B.merged(x + y) == [a, b])
    for c in "ab= \n-":
        for n in range(1, 40):
            assert B.run_once((c * n).encode()) == B.encode_bytes((c * n).encode()) == B.merged((c * n).encode())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50255), max_size=12))
def test_any_ids_decode_like_python(ids):
    d = tokenizer.StreamDecoder(B)
    assert d.push(ids) + d.close() == b"".join(B.bytes_of[i] for i in ids).decode("utf-8", "replace")


def test_long_run_and_small_memory(public, monkeypatch):
    rng = random.Random(5)
    run = "".join(rng.choice("abcdefghijklmnop") for _ in range(20_000))
    monkeypatch.setattr(tokenizer, "MAX_STATES", 50)
    monkeypatch.setattr(tokenizer, "MEMO_WORDS", 5)
    small = tokenizer.ByteBPE(B.ranks)
    text = run + " and then " + "हिन्दी में " * 50 + run[:500]
    assert small.encode(text) == public.encode(text, add_special_tokens=False).ids


def test_encode_columns(spark):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(0)).withColumn("k", F.lit(0))
    got = sorted((r["doc_id"], list(r["ids"])) for r in tokenizer.encode_column(df, "doc_id", "text").collect())
    assert got == [(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    assert tokenizer.encode_column(df.limit(0), "doc_id", "text").count() == 0
    assert [r["n_tokens"] for r in tokenizer.count_column(df, "doc_id", "text").orderBy("doc_id").collect()] == [0, 0, 2, 2]


def check_pieces(text, pieces, limit, overlap):
    assert pieces[0][1] == 0 and pieces[-1][2] == len(text)
    for k, (no, start, end, n, shared, _, piece) in enumerate(pieces):
        assert no == k and piece == text[start:end] and n == B.count(piece) <= limit and shared <= overlap
    for p, q in zip(pieces, pieces[1:]):
        assert p[1] < q[1] <= p[2] < q[2]


def test_pieces_of_documents():
    for d in documents():
        for limit, overlap in ((512, 64), (40, 8)):
            pieces = splitting.split_text(B, d["text"], limit, overlap)
            assert bool(pieces) == (B.count(d["text"]) > limit)
            if pieces:
                check_pieces(d["text"], pieces, limit, overlap)


@settings(max_examples=60, deadline=None)
@given(st.text(SIGNS, min_size=60, max_size=400))
def test_any_text_splits(text):
    pieces = splitting.split_text(B, text, 16, 4)
    if pieces:
        check_pieces(text, pieces, 16, 4)


def test_cuts_prefer_natural_boundaries():
    paragraph = " ".join(f"Sentence number {i} ends here." for i in range(12))
    text = "\n\n".join([paragraph] * 12)
    kinds = [p[5] for p in splitting.split_text(B, text)]
    assert set(kinds) <= {"paragraph", "sentence", "end"} and kinds[-1] == "end"
    run = "x9q" * 4000
    assert {p[5] for p in splitting.split_text(B, run)} == {"none", "end"}
    words = "word " * 3000
    assert {p[5] for p in splitting.split_text(B, words)} == {"word", "end"}


@pytest.mark.parametrize("seed", range(25))
def test_dynamic_program_is_optimal(seed):
    """Over all boundaries of all kinds, although word boundaries of short sentences aren't looked at."""
    import itertools

    import numpy as np

    rng = random.Random(seed)
    tokens = np.cumsum([0] + [rng.randint(1, 6) for _ in range(13)])
    kinds = np.array([0] + [rng.choice([0, 1, 2, 2, 2, 3]) for _ in range(12)] + [0])
    limit = 14
    _, ends = splitting.cuts(tokens, kinds, limit, 0)
    total = tokens[-1]
    even = min(limit, total / max(1, -(-total // limit)))
    penalty = splitting.penalties(14)

    def cost(inner):
        at, c = 0, 0.0
        for e in [*inner, 13]:
            size = tokens[e] - tokens[at]
            if size > limit:
                return np.inf
            c += 1 + splitting.EVENNESS * ((size - even) / limit) ** 2 + penalty[kinds[e]]
            at = e
        return c

    best = min(cost(c) for n in range(13) for c in itertools.combinations(range(1, 13), n))
    assert cost(ends[:-1]) == pytest.approx(best, abs=1e-6)


def test_runs_that_hardly_divide():
    for text in ("\U0001f9ff\U0001fae0" * 900, "=" * 90_000 + "x", "\n\n\n \n" * 2000, "a\n\n\n\n" * 900, "क्ष" * 3000):
        check_pieces(text, splitting.split_text(B, text), 512, 64)
    with pytest.raises(ValueError):
        splitting.split_text(B, "\U0001f9ff" * 9, 2, 0)


def test_split_columns(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "many words here " * 300), (4, "many words here " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit(0))
    got = splitting.split_oversized(df, "doc_id", "text")
    assert {r["doc_id"] for r in got.collect()} == {4} and got.filter("piece_no = 0").count() == 2


def mix(spark, rows, targets, total=None):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("copies", F.lit(0))
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    copies, report = mixing.mixture(docs, t, total)
    return copies.collect(), {r["source"]: r for r in report.collect()}


def test_mixture_reaches_shares(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([" A", "a", "a", "b", "B ", "c", None, "unnamed"]), "word " * rng.randint(0, 80)) for i in range(900)]
    copies, report = mix(spark, rows, [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.19, 4), ("nowhere", 0.01, 2)], 15_000)
    total = sum(r["copies"] * r["n_tokens"] for r in copies)
    assert abs(total - 15_000) < 150
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.19)):
        assert report[s]["actual_share"] == pytest.approx(share / 0.99, abs=0.005)
        assert report[s]["most_copies"] <= report[s]["max_repeats"]
    assert report["nowhere"]["tokens"] == 0 and "unnamed" not in report
    ids = [r["doc_id"] for r in copies]
    assert len(ids) == len(set(ids)) and sum(report[s]["tokens"] for s in "abc") == total


def test_rates_are_tilted_and_solve_the_dual(spark):
    """Against bisection on each source's own equation; where the shares aren't the natural ones the multipliers are not 0."""
    import numpy as np

    rng = random.Random(3)
    lengths = {s: [rng.randint(1, 900) for _ in range(200)] for s in "abc"}
    hist = spark.createDataFrame([(s, n, ns.count(n)) for s, ns in lengths.items() for n in set(ns)], "source string, n_tokens int, docs long")
    have = {s: sum(ns) for s, ns in lengths.items()}
    wanted, caps, base = {"a": 0.3 * have["a"], "b": 1.6 * have["b"], "c": 0.9 * 2 * have["c"]}, {"a": 1, "b": 4, "c": 2}, 0.8
    found = mixing.solve_rates(hist, wanted, caps, base)
    for s, ns in lengths.items():
        t = np.array(ns, float)
        lo, hi = -1.0, 1.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (t * np.minimum(base * np.exp(np.minimum(mid * t, 600)), caps[s])).sum() < wanted[s] else (lo, mid)
        assert found[s] == pytest.approx(lo, rel=1e-3) and abs(found[s]) > 1e-4
    assert found["a"] < 0 < found["b"]
    assert mixing.solve_rates(hist, {"a": base * have["a"]}, caps, base)["a"] == 0.0


def test_mixture_that_cannot_be_had(spark):
    rows = [(1, "a", "one two three"), (2, "b", "word " * 500)]
    copies, report = mix(spark, rows, [("a", 0.5, 2), ("b", 0.5, 1)], 1_000)
    assert report["a"]["tokens_feasible"] == pytest.approx(12) and report["a"]["tokens"] <= 6
    assert mix(spark, [(1, None, "x")], [("a", 1.0, 1)])[0] == []
    assert mix(spark, [], [("a", 1.0, 1)])[1]["a"]["tokens"] == 0


def test_all_of_a_source_at_its_cap(spark):
    copies, report = mix(spark, [(i, "a", "word " * (i + 1)) for i in range(30)], [("a", 1.0, 2)], 10**6)
    assert {r["copies"] for r in copies} == {2} and report["a"]["docs_used"] == 30


NAMES = {"tusav": "given", "gevand": "family", "hope": "given", "sunny": "given"}
FINDER = pii.Finder(NAMES)

CASES = [
    ("Contact me on a.b72@mail.example please.", [("email", "a.b72@mail.example")]),
    ("write to <N.X1 at mailnest dot example>.", [("email", "N.X1 at mailnest dot example")]),
    ("her mail is k_m[at]kumail[dot]test!", [("email", "k_m[at]kumail[dot]test")]),
    ("takor.k(at)webpost.example", [("email", "takor.k(at)webpost.example")]),
    ("thawal-v @ kumail.test. Next", [("email", "thawal-v @ kumail.test")]),
    ("known in the app as @zerofee and @fastpay, no mail", []),
    ("call me at +91 98765 43210 please", [("phone", "+91 98765 43210")]),
    ("ring my father (4022560752) instead", [("phone", "4022560752")]),
    ("ring (460) 555-0128 now", [("phone", "460) 555-0128")]),
    ("I gave 5 4 0 4 7 5 8 5 6 2 as my mobile", [("phone", "5 4 0 4 7 5 8 5 6 2")]),
    ("reach me on 047-4163 7888.. ok", [("phone", "047-4163 7888")]),
    ("ph: 447.265.1669", [("phone", "447.265.1669")]),
    ("my order ORD545770656 is pending", [("id", "ORD545770656")]),
    ("complaint no TKT#7407425 was closed", [("id", "TKT#7407425")]),
    ("credited to a/c 84845334575 by mistake", [("id", "84845334575")]),
    ("my national id 1835 4309 3160 does not match", [("id", "1835 4309 3160")]),
    ("folio number 3783/35/617 has no units", [("id", "3783/35/617")]),
    ("tax card XFZPR4452R was refused", [("id", "XFZPR4452R")]),
    ("client id QJ-03951 is blocked", [("id", "QJ-03951")]),
    ("error code ERR749998 on build 2026071677 since version 16.21.11", []),
    ("index went from 24500.35 to 246190.10, order value was 12518965 in paise", []),
    ("10 000 000 downloads at 09:15 on 12-08-2026, Range 1500 - 2500 - 3500", []),
    ("I live at Plot 87 Sector 2, Lople Layout, Graerford if you need it", [("address", "Plot 87 Sector 2, Lople Layout, Graerford")]),
    ("my address: H.No. 13-92, Kawen Nagar, Skeirur - 040842. I", [("address", "H.No. 13-92, Kawen Nagar, Skeirur - 040842")]),
    ("office at P.O. Box 137, Yugrirford 051977", [("address", "P.O. Box 137, Yugrirford 051977")]),
    ("card was to reach 20/8 Meston Cross, near Labiwen Temple, Vralford if", [("address", "20/8 Meston Cross, near Labiwen Temple, Vralford")]),
    ("we moved to 56 Ladiple Street, Prodar 051985 in spring", [("address", "56 Ladiple Street, Prodar 051985")]),
    ("kit went to the wrong flat, wait at the main road branch, street smart", []),
    ("my name is Kurosh Kodra and I need help", [("name", "Kurosh Kodra")]),
    ("my name is not important here", []),
    ("I am Losul and I have a problem", [("name", "Losul")]),
    ("I am Happy with version 18.75.13 and it works", []),
    ("spoke to Mr. Vutem Thopemor twice", [("name", "Vutem Thopemor")]),
    ("Regards, Tusav Bimor.", [("name", "Tusav Bimor")]),
    ("all gone. - Kedal. - Sunny Thawal!", [("name", "Kedal"), ("name", "Sunny Thawal")]),
    ("hope the team reads this, sunny promises do not help", []),
    ("Yours, Hope Gevand from the old forum", [("name", "Hope Gevand")]),
    ("mail [EMAIL] and [PHONE] and [NAME] stay", []),
]


CASES += [
    ("My name is Zoltan Kovacs and I live here", [("name", "Zoltan Kovacs")]),
    ("spoke to Zoltan Kovacs yesterday", [("name", "Zoltan Kovacs")]),
    ("Contact Mr Kovacs tomorrow", [("name", "Kovacs")]),
    ("this is Zoltan from Pune", [("name", "Zoltan")]),
    ("aadhaar 1234-5678-9012", [("id", "1234-5678-9012")]),
    ("number 2341-2341-2346 without a cue, 2341-2341-2345 is none", [("id", "2341-2341-2346")]),
    ("ssn 123-45-6789", [("id", "123-45-6789")]),
    ("paid with 4111-1111-1111-1111 again", [("id", "4111-1111-1111-1111")]),
    ("pay to DE89 3704 0044 0532 0130 00 now", [("id", "DE89 3704 0044 0532 0130 00")]),
    ("passport K1234567", [("id", "K1234567")]),
    ("I live at 45 Park Avenue", [("address", "45 Park Avenue")]),
    ("invoice 9876543210", [("id", "9876543210")]),
    ("mail " + "a" * 90 + "@b.example", [("email", "a" * 90 + "@b.example")]),
    ("I am Using this since May, this is Ridiculous. Contact Customer Care", []),
]

#: Written before they were first run, and not looked at for the rules: (text, values). What comes out is counted, not demanded.
HELD_OUT = [
    ("Kindly note my sister Anneke Vos uses the same login", ["Anneke Vos"]),
    ("your officer Bogdan Ilic promised a refund on Monday", ["Bogdan Ilic"]),
    ("Thanks, Priyamvada", ["Priyamvada"]),
    ("the account holder Oluwaseun Adeyemi passed away", ["Oluwaseun Adeyemi"]),
    ("I was talking to Dr Haverkamp about it", ["Haverkamp"]),
    ("please call Ms. Quiroga on 9811022033 before noon", ["Quiroga", "9811022033"]),
    ("you can reach me under +44 20 7946 0958 at night", ["+44 20 7946 0958"]),
    ("write to rohit.k+sip@fundmail.example if it fails", ["rohit.k+sip@fundmail.example"]),
    ("my id: sunil dot rao at postbox dot example", ["sunil dot rao at postbox dot example"]),
    ("transaction number 402913388171 never arrived", ["402913388171"]),
    ("ticket 8837261 was closed without a word", ["8837261"]),
    ("card ending unknown, full number 5500 0000 0000 0004", ["5500 0000 0000 0004"]),
    ("send it to Flat 12B, Rosewood Apartments, Nashik 422001", ["Flat 12B, Rosewood Apartments, Nashik 422001"]),
    ("my office at 221 Baker Street is closed on sundays", ["221 Baker Street"]),
    ("policy no 77120934 lapsed although I paid", ["77120934"]),
    ("Ask for Tendai, she knows the case", ["Tendai"]),
    ("This is Great and I am Very Happy with Nifty Fund", []),
    ("Contact Support Team at once, Mr Market is moody", []),
    ("sensex went to 81234567 points in my dream, version 20260716", []),
    ("ordered at 10:45 on 2026-07-16 for 1250000.50 rupees", []),
]


def test_held_out_wordings():
    found = wanted = right = 0
    for text, values in HELD_OUT:
        got = [text[s:e] for _, s, e in FINDER.find(text)]
        found, wanted, right = found + len(got), wanted + len(values), right + len(set(got) & set(values))
    print(f"held out: {right} of {wanted} found, {found - right} others")
    assert right >= 0.6 * wanted and right >= 0.7 * found


def test_names_of_a_row_are_sought_in_its_other_texts():
    a, b = FINDER.find_row(["I wrote this, Vurin Tethasund said. my agent Vurin Tethasund said no", "i wrote this, vurin tethasund said"])
    assert [k for k, *_ in a] == ["name", "name"] and b == [("name", 14, 29)]
    assert FINDER.find_row([None, ""]) == [[], []]


def test_check_digits():
    assert pii.card_holds("4111 1111 1111 1111") and not pii.card_holds("4111 1111 1111 1112")
    assert pii.identity_holds("2341 2341 2346") and not any(pii.identity_holds(f"2341 2341 234{i}") for i in range(6))
    assert pii.account_holds("GB82 WEST 1234 5698 7654 32") and not pii.account_holds("GB82 WEST 1234 5698 7654 33")


@pytest.mark.parametrize(("text", "wanted"), CASES)
def test_values(text, wanted):
    assert [(k, text[s:e]) for k, s, e in FINDER.find(text)] == wanted


def test_redaction_keeps_the_rest():
    text = "Hi 😀, call me at +91 98765 43210 or a@b.example, thanks"
    assert pii.redact(text, FINDER.find(text)) == "Hi 😀, call me at [PHONE] or [EMAIL], thanks"
    again = pii.redact(text, FINDER.find(text))
    assert FINDER.find(again) == [] and FINDER.find(None) == [] and FINDER.find("") == [] and pii.redact(None, []) is None


def test_positions_survive_odd_letters():
    text = "İİ ẞ call me at 4022560752 please"
    (kind, s, e), = FINDER.find(text)
    assert (kind, text[s:e]) == ("phone", "4022560752")


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("@@..()[]0123456789+- at dot ")),), max_size=120))
def test_any_text_is_searched(text):
    values = FINDER.find(text)
    assert all(0 <= s < e <= len(text) for _, s, e in values)
    assert all(a[2] <= b[1] for a, b in zip(values, values[1:]))


def test_find_in_columns(spark):
    names = spark.createDataFrame([("Tusav", "given"), (None, None), ("", "given"), ("Gevand", "family")], "name_part string, name_kind string")
    rows = [(1, None, "ask tusav gevand, he saw it"), (2, "x@y.example", ""), (2, "x@y.example", ""), (3, "nothing", "here " * 30_000 + "a@b.example")]
    df = spark.createDataFrame(rows, "seq long, original_text string, cleaned_text string").withColumn("kind", F.lit("?"))
    got = sorted(tuple(r) for r in pii.find_values(df, names, "seq", ["original_text", "cleaned_text"]).drop("end_pos").collect())
    assert got == [(1, "cleaned_text", "name", 4), (2, "original_text", "email", 0), (2, "original_text", "email", 0), (3, "cleaned_text", "email", 150_000)]
    red = {r["seq"]: r for r in pii.redact_columns(df, names, "seq", ["original_text", "cleaned_text"]).collect()}
    assert red[1]["cleaned_text"] == "ask [NAME], he saw it" and red[1]["original_text"] is None and red[1]["n_values"] == 1
    assert pii.find_values(df.limit(0), names.limit(0), "seq", ["original_text"]).count() == 0


def subjects(n, rng):
    letters = "abcdefghijklmnopqrstuvwxyz"
    banks = [[f"{letters[k] * 2}q{letters[i % 26]}{letters[i // 26]}" for i in range(30)] for k in range(12)]
    common = [f"zz{letters[i % 26]}{letters[i // 26]}" for i in range(60)]
    rows = []
    for i in range(n):
        k = i % 12
        rows.append((i, " ".join(rng.choice(banks[k]) if rng.random() < 0.6 else rng.choice(common) for _ in range(rng.randint(20, 40)))))
    return rows


def test_themes_of_known_subjects(spark):
    rng = random.Random(6)
    rows = subjects(1500, rng)
    extra = [(5000, None), (5001, ""), (5002, "ok"), (5003, rows[0][1]), (5003, rows[0][1])]
    df = spark.createDataFrame([*rows, *extra], "seq long, cleaned_text string").withColumn("rep", F.lit(0))
    t = peaks.Themes(df)
    of = {}
    for r in t.row_labels().collect():
        of[r["seq"]] = r["theme_id"]
    assert of[5000] == of[5001] == 0 and of[5003] == of[0] and len(of) == 1504
    from collections import Counter

    pure = sum(Counter(of[i] for i in range(k, 1500, 12)).most_common(1)[0][1] for k in range(12))
    assert pure >= 0.93 * 1500  # four words in ten are common to all subjects
    report = t.report().collect()
    assert sum({r["theme_id"]: r["size"] for r in report}.values()) == t.row_labels().count()
    pairs = spark.createDataFrame([(0, 12), (0, 1), (0, 99999)], "seq_a long, seq_b long")
    assert [tuple(r) for r in t.same_theme(pairs).collect()] == [(0, 12)]


def test_cells_against_all_pairs(spark, monkeypatch):
    """Densities are of the whole collection whatever the cells; pointers lead to denser records; labels agree."""
    rows = subjects(600, random.Random(8))
    df = spark.createDataFrame(rows, "seq long, cleaned_text string")
    whole = peaks.Themes(df)
    monkeypatch.setattr(peaks, "LEADERS_AT_ONCE", 3)
    celled = peaks.Themes(df, cell=60)
    a, b = ({r["rep"]: r for r in t.pointers.collect()} for t in (whole, celled))
    assert len(a) == 600 and set(a) == set(b)
    import numpy as np

    assert np.median([abs(a[k]["rho"] - b[k]["rho"]) / a[k]["rho"] for k in a]) < 0.1
    for t in (a, b):
        assert all(r["parent"] == k or (t[r["parent"]]["rho"], -r["parent"]) > (r["rho"], -k) for k, r in t.items())
        assert sum(r["parent"] == k for k, r in t.items()) == 1
    labels = [dict(map(tuple, t.row_labels().collect())) for t in (whole, celled)]
    pairs = [(i, j) for i in range(0, 600, 7) for j in range(i + 1, 600, 11)]
    # Ten cells of 60 records, of which a record meets three: 0.954 was measured.
    assert sum((labels[0][i] == labels[0][j]) == (labels[1][i] == labels[1][j]) for i, j in pairs) >= 0.93 * len(pairs)


def test_nearest_denser_equals_brute_force():
    import numpy as np

    rng = np.random.default_rng(5)
    z = rng.normal(size=(300, 4)).astype(np.float32)
    rho, rep = np.round(rng.random(300), 1), rng.permutation(300)
    got = {r.rep: r.cosine for r in peaks._nearest_denser(z, rep, rho, np.arange(0, 300, 2), np.arange(300)).itertuples()}
    for i in range(0, 300, 2):
        denser = [j for j in range(300) if (rho[j], -rep[j]) > (rho[i], -rep[i])]
        assert (rep[i] in got) == bool(denser) and (not denser or abs(got[rep[i]] - max(z[denser] @ z[i])) < 1e-5)


def test_crowded_cells_are_divided(spark):
    df = spark.createDataFrame(subjects(700, random.Random(4)), "seq long, cleaned_text string")
    one, many = peaks.Themes(df, cell=1000), peaks.Themes(df, cell=1000)
    assert one.row_labels().count() == many.row_labels().count() == 700
    from unittest import mock

    with mock.patch.object(peaks, "MAX_PIVOTS", 2):
        few = peaks.Themes(df, cell=25, visits=2)  # two cells of some 350, in shards of 100
    a, b = ({r["rep"]: r for r in t.pointers.collect()} for t in (one, few))
    assert all(abs(a[k]["rho"] - b[k]["rho"]) < 1e-5 for k in a)
    # Densities equal but for rounding may change places.
    assert sum(abs(a[k]["delta"] - b[k]["delta"]) < 1e-4 for k in a) >= 0.99 * len(a)


def test_themes_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "two words")], "seq long, cleaned_text string")
    assert {tuple(r) for r in peaks.Themes(df).row_labels().collect()} == {(1, 0), (2, 0)}
    assert peaks.Themes(df.limit(0)).row_labels().count() == 0


def test_width_is_that_of_all_records(spark):
    """The kernel width counts every record: it is the exact median within two hundredths, and a fifth of rare records moves it."""
    import numpy as np

    rng = np.random.default_rng(3)
    # Twelve tight subjects, and one as large as three of them that is looser.
    centre = np.repeat(rng.normal(size=(13, 6)), [400] * 12 + [1300], axis=0)
    z = centre + rng.normal(size=centre.shape) * np.repeat([0.1, 0.6], [4800, 1300])[:, None]
    z = (z / np.linalg.norm(z, axis=1, keepdims=True)).astype(np.float32)
    m = rng.integers(1, 4, len(z))
    total, reach = m.sum(), []
    for i in range(0, len(z), 500):
        d = 1 - z[i : i + 500] @ z.T
        order = d.argsort(axis=1)
        at = (m[order].cumsum(axis=1) >= 1 + int(total * peaks.NEAR_SHARE)).argmax(axis=1)
        reach += np.take_along_axis(d, order, axis=1)[np.arange(len(d)), at].tolist()
    exact = np.median(np.repeat(reach, m))
    points = spark.createDataFrame([(i, True, v, int(n)) for i, (v, n) in enumerate(zip(z.tolist(), m))], "rep long, long boolean, z array<float>, m long").repartition(3)
    assert peaks.Cells(points, len(z), 8000, 3).kernel_width(points) == pytest.approx(exact, rel=0.02)
    assert peaks.Cells(points, len(z), 300, 6).kernel_width(points) == pytest.approx(exact, rel=0.06)
    one = points.limit(1).withColumn("m", F.lit(1).cast("long"))
    assert peaks.Cells(one, 1, 300, 3).kernel_width(one) == 1e-6
