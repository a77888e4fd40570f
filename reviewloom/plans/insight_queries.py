"""Queries over clean reviews and theme members: ratings, trend, versions, quotes, themes, fees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators import analytics, fee, themes, vectors
from reviewloom.sources.tables import table


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clean_reviews")


def members(spark: SparkSession, d: str) -> DataFrame:
    """A division of the reviews into twelve themes and outliers (-1) that SQL can state as well: by the length of the text."""
    r = reviews(spark, d).filter("review_id is not null")
    return r.select((F.length("cleaned_text") % 13 - 1).cast("int").alias("theme_id"), "review_id", F.col("seq").alias("pos"))


def _sampled(s: SparkSession, d: str) -> DataFrame:
    return themes.sample(members(s, d), reviews(s, d))


QUERIES = {
    "weekly_trend": lambda s, d: analytics.weekly_trend(reviews(s, d)),
    "weekly_change": lambda s, d: analytics.weekly_change(reviews(s, d)),
    "rating_distribution": lambda s, d: analytics.rating_distribution(reviews(s, d)),
    "rating_summary": lambda s, d: analytics.rating_summary(reviews(s, d)),
    "version_breakdown": lambda s, d: analytics.version_breakdown(reviews(s, d)),
    "top_quotes": lambda s, d: analytics.top_quotes(reviews(s, d)),
    "theme_breakdown": lambda s, d: analytics.theme_breakdown(members(s, d), reviews(s, d)),
    "worst_theme": lambda s, d: analytics.worst_theme(members(s, d), reviews(s, d)),
    "largest_theme": lambda s, d: analytics.largest_theme(members(s, d), reviews(s, d)),
    "funnel": lambda s, d: analytics.funnel(table(s, d, "raw_reviews"), reviews(s, d), table(s, d, "chunk_vectors"), members(s, d)),
    "fee_reviews": lambda s, d: fee.fee_reviews(reviews(s, d), members(s, d)).select("review_id", "seq"),
    "fee_stats": lambda s, d: analytics.fee_stats(fee.fee_reviews(reviews(s, d), members(s, d)), reviews(s, d)),
    "noise_reviews": lambda s, d: vectors.noise_reviews(members(s, d), reviews(s, d)).select("review_id", "seq"),
    "cluster_rank": lambda s, d: vectors.cap_and_rank(members(s, d)),
    "label_samples": lambda s, d: _sampled(s, d),
    "keyword_labels": lambda s, d: themes.keyword_labels(_sampled(s, d)),
    "theme_prompt_blocks": lambda s, d: themes.prompt_blocks(_sampled(s, d)),
    "clean_label": lambda s, d: reviews(s, d).select("seq", themes.clean_label(F.concat(F.lit("- Theme: \"**"), "original_text", F.lit("**\".\n"))).alias("label")),
}

# The same in SQL.

#: A whole number with an optional sign and blanks around it.
STARS = r"case when regexp_full_match(trim(rating), '[+-]?[0-9]+') then try_cast(trim(rating) as integer) end"
DAY = "try_cast(case when regexp_full_match(substr(date,1,10), '[0-9]{4}-[0-9]{2}-[0-9]{2}') then substr(date,1,10) end as date)"
REVIEWS = f"r as (select *, {STARS} as s0, {DAY} as d, case when {STARS} between 1 and 5 then {STARS} end as s from clean_reviews)"
MEMBERS = "m as (select cast(length(cleaned_text) % 13 - 1 as integer) as theme_id, review_id, seq as pos from clean_reviews where review_id is not null)"
LATEST = "l as (select * from r where review_id is not null qualify row_number() over (partition by review_id order by seq desc) = 1)"
PCT = "coalesce(round_even({0} * 100.0::double / nullif({1}, 0), 1), 0.0)"
MEAN = "coalesce(round(avg({0}), 2), 0.0)"


def pct(part: str, whole: str) -> str:
    return PCT.format(part, whole)


THEMES = f"""b as (select theme_id, count(*) as n, {MEAN.format('s')} as avg_rating, {pct('count(*) filter (s <= 2)', 'count(s)')} as negative_pct,
        cast(coalesce(sum(coalesce(thumbs_up_count, 0)), 0) as bigint) as thumbs_up from m left join l using (review_id) where theme_id >= 0 group by 1),
    t as (select *, {pct('n', 'sum(n) over ()')} as share_pct, cast(row_number() over (order by n desc, theme_id) as integer) as rank from b)"""
FEES = "f as (select * from l where review_id in (select review_id from m where theme_id >= 0) and (" + " or ".join(f"contains(lower(cleaned_text), '{k}')" for k in fee.FEE_KEYWORDS) + "))"
SAMPLE = """p as (select theme_id, pos, review_id from m where theme_id >= 0 qualify row_number() over (partition by theme_id order by pos) <= 20),
    q as (select theme_id, pos, coalesce(original_text, cleaned_text) as text from p join l using (review_id) where coalesce(original_text, cleaned_text) <> '')"""
STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in themes.STOPWORDS)

ORACLE_SQL = {
    "weekly_trend": f"with {REVIEWS} select cast(date_trunc('week', d) as date) as week, count(s0) as n, {MEAN.format('s')} as avg_rating from r where d is not null group by 1",
    "weekly_change": f"with {REVIEWS}, w as (select cast(date_trunc('week', d) as date) as week, count(s0) as n, {MEAN.format('s')} as avg_rating from r where d is not null group by 1) select *, n - lag(n) over (order by week) as n_change from w",
    "rating_distribution": f"with {REVIEWS}, c as (select cast(x as integer) as stars, (select count(*) from r where s = x) as n from range(1, 6) t(x)) select stars, n, {pct('n', 'sum(n) over ()')} as pct from c",
    "rating_summary": f"with {REVIEWS} select count(s) as total, {MEAN.format('s')} as average, count(*) filter (s <= 2) as negative_count, {pct('count(*) filter (s <= 2)', 'count(s)')} as negative_pct from r",
    "version_breakdown": f"""with {REVIEWS}, g as (select app_version as version, count(*) as n, {MEAN.format('s')} as avg_rating, {pct('count(*) filter (s <= 2)', 'count(*)')} as negative_pct, min(seq) as f
        from r where app_version <> '' and s is not null group by 1 having count(*) >= 25) select version, n, avg_rating, negative_pct, cast(row_number() over (order by n desc, f) as integer) as position from g""",
    "top_quotes": f"""with {REVIEWS}, q as (select *, coalesce(thumbs_up_count, 0) as thumbs_up from r where s <= 2 order by thumbs_up desc, seq limit 5)
        select seq, coalesce(original_text, cleaned_text) as text, s as stars, thumbs_up, date from q where coalesce(original_text, '') <> '' or coalesce(cleaned_text, '') <> ''""",
    "theme_breakdown": f"with {REVIEWS}, {MEMBERS}, {LATEST}, {THEMES} select *, rank <= 3 as is_top_3 from t",
    "worst_theme": f"with {REVIEWS}, {MEMBERS}, {LATEST}, {THEMES} select theme_id, n, avg_rating from t order by avg_rating, rank limit 1",
    "largest_theme": f"with {REVIEWS}, {MEMBERS}, {LATEST}, {THEMES} select theme_id, n, share_pct from t order by rank limit 1",
    "funnel": f"""with {MEMBERS}, c as (select (select count(*) from raw_reviews) as raw, (select count(*) from clean_reviews) as c2, (select count(*) from chunk_vectors) as c3,
        (select count(*) from m where theme_id >= 0) as c4, (select count(*) from m where theme_id < 0) as c5),
        u as (select 1 as position, '{analytics.FUNNEL_STAGES[0]}' as stage, raw as n, raw from c union all select 2, '{analytics.FUNNEL_STAGES[1]}', c2, raw from c union all select 3, '{analytics.FUNNEL_STAGES[2]}', c3, raw from c
        union all select 4, '{analytics.FUNNEL_STAGES[3]}', c4, raw from c union all select 5, '{analytics.FUNNEL_STAGES[4]}', c5, raw from c) select position, stage, n, {pct('n', 'raw')} as pct_of_raw from u""",
    "fee_reviews": f"with {REVIEWS}, {MEMBERS}, {LATEST}, {FEES} select review_id, seq from f",
    "fee_stats": f"with {REVIEWS}, {MEMBERS}, {LATEST}, {FEES} select count(*) as n, {pct('count(*)', '(select count(*) from clean_reviews)')} as pct_of_corpus, {MEAN.format('s')} as avg_rating from f",
    "noise_reviews": f"with {REVIEWS}, {MEMBERS}, {LATEST} select review_id, seq from l where review_id in (select review_id from m where theme_id = -1)",
    "cluster_rank": f"""with {MEMBERS}, z as (select theme_id, count(*) as size from m where theme_id >= 0 group by 1), o as (select *, row_number() over (order by size desc, theme_id) as place, count(*) over () as total from z),
        g as (select *, case when total > 10 and place >= 10 then -2 else theme_id end as final_id from o), j as (select final_id, cast(sum(size) as bigint) as n, min(place) as place from g group by 1),
        k as (select *, cast(row_number() over (order by n desc, place) as integer) as rank from j) select theme_id, final_id, n, rank, rank <= 3 as is_top_3 from g join k using (final_id)""",
    "label_samples": f"with {REVIEWS}, {MEMBERS}, {LATEST}, {SAMPLE} select * from q",
    "keyword_labels": f"""with {REVIEWS}, {MEMBERS}, {LATEST}, {SAMPLE}, a as (select theme_id, pos, regexp_extract_all(lower(text), '[a-z'']{{3,}}') as ws from q),
        w as (select theme_id, pos, unnest(ws) as word, generate_subscripts(ws, 1) as nth from a), c as (select theme_id, word, count(*) as n, min(pos * 1000000 + nth) as f from w where word not in ({STOP}) group by 1, 2),
        k as (select *, row_number() over (partition by theme_id order by n desc, f) as i from c qualify i <= 3), j as (select theme_id, string_agg(word, ', ' order by i) as label from k group by 1)
        select theme_id, upper(label[1]) || label[2:] as label from j""",
    "theme_prompt_blocks": f"""with {REVIEWS}, {MEMBERS}, {LATEST}, {SAMPLE}, i as (select *, row_number() over (partition by theme_id order by pos) as i from q)
        select theme_id, count(*) as n, string_agg(i::varchar || '. ' || text, chr(10) order by i) as block from i group by 1""",
}
