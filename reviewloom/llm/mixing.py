"""Mixing sources to target shares of a total size in tokens, by entropy balancing.

Each document gets a rate, the number of copies it should have on average. Rates stay as near as the constraints allow, in
relative entropy, to a common base rate: that at which the named sources together come to the total asked for. Each source's
tokens must come to its share of the total, and no rate exceeds ``max_repeats``. The dual of that problem is convex with one
multiplier a source; its solution is exponentially tilted: rates are base * exp(multiplier * tokens), at most max_repeats. A
source that gives less than at the base rate loses its long documents first, one that gives more repeats them first. Newton
steps for all sources at once need two sums each, taken over all documents in one aggregation an iteration, from (source,
token count, documents). Rates are rounded into copies from the longest documents down, each length making up for what
rounding the longer ones left, so that a source misses its tokens by about half of a short document where it has short ones.

Sources compare after trimming and lower-casing. Documents without tokens, with a null source, or of a source that the
targets don't name get no copies. The share of a source without documents goes to the others in proportion. If a source
has too few tokens for its share even with all repeats, the total is lowered until all shares hold; the report says so.
Repeated target rows of a source add up; null or negative shares count as 0, ``max_repeats`` below 1 or null as 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.tokenizer import TOKENIZER_DIR, VOCABULARY, count_column
from reviewloom.staging import stage

#: Documents of one source and length that are ranked together.
RANKED = 50_000
MAX_ITERATIONS, TOLERANCE = 60, 1e-7
#: The exponent is held below this; rates that large are above any cap.
LARGEST = 600.0
#: The targets are collected and their sources broadcast; a longer list than this is refused.
MAX_SOURCES = 10_000
#: How far the copies of one length may leave their rate to make up for the rounding of longer documents.
MAKE_UP = 2


def plan_totals(targets: list[dict], available: dict[str, int], total_tokens: int) -> tuple[float, dict[str, float]]:
    """The feasible total, and the tokens that each source with documents is to give."""
    usable = {t["source"]: t["share"] for t in targets if available.get(t["source"], 0) > 0 and t["share"] > 0 and t["cap"] > 0}
    named = sum(usable.values())
    if not named:
        return 0.0, {}
    cap = {t["source"]: t["cap"] for t in targets}
    shares = {s: x / named for s, x in usable.items()}
    total = min(float(total_tokens), min(cap[s] * available[s] / x for s, x in shares.items()))
    return total, {s: total * x for s, x in shares.items()}


def solve_rates(hist: DataFrame, wanted: dict[str, float], caps: dict[str, int], base: float) -> dict[str, float]:
    """The multiplier of each source by safeguarded Newton iterations on the logarithm of its tokens.

    hist: (source, n_tokens, docs). What reaches the driver is two sums a source and iteration.
    """
    spark = hist.sparkSession
    at = dict.fromkeys(wanted, 0.0)
    low, high = dict.fromkeys(wanted, -np.inf), dict.fromkeys(wanted, np.inf)
    open_ = set(wanted)
    for _ in range(MAX_ITERATIONS):
        if not open_:
            break
        params = spark.createDataFrame([(s, at[s], float(caps[s])) for s in sorted(open_)], "source string, multiplier double, cap double")
        x = F.col("n_tokens")
        tilted = F.lit(base) * F.exp(F.least(F.col("multiplier") * x, F.lit(LARGEST)))
        tokens = F.sum(F.col("docs") * x * F.least(tilted, F.col("cap")))
        # Where the cap binds the rate doesn't move with the multiplier.
        slope = F.sum(F.when(tilted < F.col("cap"), F.col("docs") * x * x * tilted).otherwise(0.0))
        for row in hist.join(F.broadcast(params), "source").groupBy("source").agg(tokens.alias("g"), slope.alias("h")).collect():
            s, g, h = row["source"], row["g"], row["h"]
            if abs(g / wanted[s] - 1) <= TOLERANCE:
                open_.discard(s)
                continue
            (low if g < wanted[s] else high)[s] = at[s]
            # Where nothing moves any more, a step of the size that changes a document of one token by its factor e.
            step = np.log(wanted[s] / max(g, 1e-300)) * g / h if h > 0 else np.sign(wanted[s] - g)
            to = at[s] + step
            if not low[s] < to < high[s]:
                to = (low[s] + high[s]) / 2 if np.isfinite(low[s]) and np.isfinite(high[s]) else at[s] + np.sign(step) * max(1.0, abs(at[s]))
            at[s] = float(to)
    return at


def round_lengths(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies given to each document length of one source. Its rows are distinct lengths, at most as many as the longest document has tokens."""
    pdf = pdf.sort_values("n_tokens", ascending=False, ignore_index=True)
    given = np.zeros(len(pdf), np.int64)
    owed = 0.0
    for i, (t, n, base, multiplier, cap) in enumerate(zip(pdf.n_tokens, pdf.docs, pdf.base, pdf.multiplier, pdf.cap)):
        mean = n * min(base * np.exp(min(multiplier * t, LARGEST)), cap)
        owed += mean * t
        k = min(max(round(owed / t), np.floor(mean) - MAKE_UP, 0), np.ceil(mean) + MAKE_UP, n * cap)
        given[i] = int(k)
        owed -= given[i] * t
    return pd.DataFrame({"source": pdf.source, "n_tokens": pdf.n_tokens, "docs": pdf.docs, "given": given, "cap": pdf.cap})


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, key: str = "doc_id", text: str = "text", source: str = "source", directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(copies, report).

    copies: ``key``, source, n_tokens, copies for each document used at least once.
    report: a row for each target with what was wanted, what there is and what came out.
    total_tokens: the size asked for; by default 80 % of the tokens of the documents that have a named source.
    The targets are collected: a list of sources, small by its nature; everything by document stays distributed.
    """
    spark = docs.sparkSession
    norm = F.lower(F.trim(F.col(source)))
    target_rows = [
        r.asDict()
        for r in targets.select(F.lower(F.trim("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("cap"))
        .filter("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap")).limit(MAX_SOURCES + 1).collect()
    ]
    if len(target_rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    named = F.broadcast(spark.createDataFrame([(t["source"],) for t in target_rows], "source string"))
    picked = docs.select(F.col(key).alias("doc"), norm.alias("source"), F.col(text).alias("t")).join(named, "source", "left_semi")
    sized = stage(count_column(picked, "doc", "t", directory=directory, name=name).drop("t").filter("n_tokens > 0"), "sized")
    hist = stage(sized.groupBy("source", "n_tokens").agg(F.count("*").alias("docs")), "lengths")
    stats = {r["source"]: (r["n"], r["tokens"]) for r in hist.groupBy("source").agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * F.col("n_tokens")).alias("tokens")).collect()}
    available = {s: tokens for s, (_, tokens) in stats.items()}
    asked = int(0.8 * sum(available.values())) if total_tokens is None else total_tokens
    total, wanted = plan_totals(target_rows, available, asked)
    caps = {t["source"]: t["cap"] for t in target_rows}
    base = total / max(1, sum(available[s] for s in wanted))
    multipliers = solve_rates(hist, wanted, caps, base)
    params = spark.createDataFrame([(s, float(base), m, float(caps[s])) for s, m in multipliers.items()], "source string, base double, multiplier double, cap double")
    steps = stage(hist.join(F.broadcast(params), "source").groupBy("source").applyInPandas(round_lengths, "source string, n_tokens int, docs long, given long, cap double"), "given")
    # The copies of one source and length go to its documents in the order of their hash, ranked in parts of bounded size.
    h = F.xxhash64("doc")
    placed = sized.join(steps.filter("given > 0").withColumn("parts", F.expr(f"1 + docs div {RANKED}")), ["source", "n_tokens"]).withColumn("part", F.pmod(h, F.col("parts")))
    sizes = placed.groupBy("source", "n_tokens", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("skipped", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = Window.partitionBy("source", "n_tokens", "part").orderBy(h, "doc")
    copies = (
        placed.join(sizes, ["source", "n_tokens", "part"]).withColumn("j", F.col("skipped") + F.row_number().over(inside))
        .withColumn("copies", F.expr("cast((j * given) div docs - ((j - 1) * given) div docs as int)"))
        .filter("copies > 0").select(F.col("doc").alias(key), "source", "n_tokens", "copies")
    )
    copies = stage(copies, "copies")
    used = copies.groupBy("source").agg(F.count("*").alias("docs_used"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    plan = spark.createDataFrame(
        [(t["source"], t["share"], int(t["cap"]), stats.get(t["source"], (0, 0))[0], available.get(t["source"], 0), int(asked), float(total), float(wanted.get(t["source"], 0.0)), multipliers.get(t["source"], 0.0)) for t in target_rows],
        "source string, target_share double, max_repeats int, docs_available long, tokens_available long, tokens_asked long, tokens_feasible double, tokens_wanted double, multiplier double",
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    report = plan.join(used, "source", "left").select(*plan.columns, zero("docs_used").alias("docs_used"), zero("most_copies").alias("most_copies"), zero("tokens").alias("tokens"))
    everything = Window.partitionBy()
    report = report.withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(everything), F.lit(0)), F.lit(0.0)))
    return copies, report
