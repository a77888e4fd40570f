"""Queries of cleaning, scrubbing, deduplication, chunking, vectors, validation and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.config import DEFAULTS
from reviewloom.functions import text as T
from reviewloom.operators import chunk, clean, dedup, density, registry, validate, vectors
from reviewloom.plans.insight_queries import MEMBERS, members, reviews
from reviewloom.sources.tables import table


def scraped(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_reviews")


def vector_rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunk_vectors")


def labels(s: SparkSession, d: str) -> DataFrame:
    """Labels of chunks that SQL can state as well."""
    return vector_rows(s, d).select("chunk_id", "review_id", ((F.length("chunk_text") + F.col("chunk_index")) % 4 - 1).cast("int").alias("label"))


def reports(s: SparkSession, d: str) -> DataFrame:
    """Documents as reports: what stands in a mail or post is checked as Markdown; every third line becomes a quote."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit(" >> "), x)).when(i % 3 == 1, F.concat(F.lit("## key observation "), x)).otherwise(x))
    return table(s, d, "documents").select(F.col("doc_id").alias("report_id"), F.array_join(lines, "\n").alias("markdown"))


def run_events(s: SparkSession, d: str) -> DataFrame:
    """Events of a run registry: users are runs, their events in order change the status."""
    e = table(s, d, "events")
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "delivering", "awaiting_approval", "delivered", "failed", "rejected"))), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("event_seq"), F.when(F.col("event_id") % 3 != 0, status).alias("status"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("step"))


def shared_quotes(s: SparkSession, d: str) -> DataFrame:
    """Quotes to be checked: pieces of all reviews with 40 votes or more, every other one altered."""
    r = reviews(s, d).filter("thumbs_up_count >= 40 and length(original_text) >= 40")
    q = F.substring("original_text", 5, 60)
    return r.select(F.lit(1).alias("report_id"), F.col("seq").cast("int").alias("line_no"), F.when(F.col("seq") % 2 == 0, q).otherwise(F.concat(F.lit("zz#"), q, F.lit("#zz"))).alias("quote"))


def first_chunks(s: SparkSession, d: str) -> DataFrame:
    """The first chunk of every review, most of which are in chunk_vectors already."""
    return reviews(s, d).select(F.concat("review_id", F.lit("_chunk_0")).alias("chunk_id"), "seq")


QUERIES = {
    "map_review": lambda s, d: clean.map_review(scraped(s, d)),
    "window_filter": lambda s, d: clean.in_window(scraped(s, d), DEFAULTS.window_start).select("seq"),
    "fetch_reviews": lambda s, d: clean.fetch(scraped(s, d)),
    "strip_html_urls": lambda s, d: scraped(s, d).select("seq", T.strip_html_urls(F.col("content")).alias("content")),
    "normalise_unicode": lambda s, d: scraped(s, d).select("seq", T.normalise_unicode(F.col("content")).alias("content")),
    "normalise_nfc": lambda s, d: scraped(s, d).select("seq", T.normalise_unicode(F.col("content"), "NFC").alias("content")),
    "clean_reviews": lambda s, d: clean.clean(clean.fetch(scraped(s, d))),
    "clean_reviews_nfc": lambda s, d: clean.clean(clean.fetch(scraped(s, d)), form="NFC"),
    "clean_discards_nfc": lambda s, d: clean.discards(clean.fetch(scraped(s, d)), form="NFC"),
    "pii_scrub": lambda s, d: clean.pii_scrub(reviews(s, d)),
    "pii_counts": lambda s, d: clean.pii_counts(reviews(s, d)),
    "exact_dedup": lambda s, d: clean.exact_dedup(reviews(s, d)),
    "shingles": lambda s, d: dedup.shingle_rows(reviews(s, d)),
    "near_dup_links": lambda s, d: dedup.ShingleNeighbours(reviews(s, d)).neighbour_counts(),
    "near_dedup": lambda s, d: dedup.ShingleNeighbours(reviews(s, d)).first_only(),
    "near_dedup_greedy": lambda s, d: dedup.ShingleNeighbours(reviews(s, d)).greedy(),
    "chunk_tiers": lambda s, d: chunk.tiers(reviews(s, d)),
    "tier_counts": lambda s, d: chunk.tier_counts(reviews(s, d)),
    "sliding_chunks": lambda s, d: chunk.sliding_chunks(reviews(s, d)),
    "sentence_chunks": lambda s, d: chunk.sentence_chunks(reviews(s, d)),
    "chunk": lambda s, d: chunk.chunk(reviews(s, d)).select("chunk_id", "seq", "chunk_index", "total_chunks", F.length("chunk_text").alias("chars")),
    "embed_batches": lambda s, d: chunk.batch_sizes(first_chunks(s, d), vector_rows(s, d)),
    "cache_skip": lambda s, d: chunk.uncached(first_chunks(s, d), vector_rows(s, d)).select("seq"),
    "vector_upsert": lambda s, d: chunk.upsert(vector_rows(s, d).select("chunk_id", "seq"), first_chunks(s, d)),
    "centroids": lambda s, d: vectors.mean_vectors(vector_rows(s, d).select((F.length("chunk_text") % 5).cast("int").alias("label"), "embedding"), "label").select("label", "n", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid")),
    "representative_quotes": lambda s, d: vectors.representative_quotes(vector_rows(s, d), members(s, d), reviews(s, d)),
    "majority_vote": lambda s, d: vectors.majority_vote(labels(s, d)),
    "cluster_shape": lambda s, d: vectors.cluster_shape(labels(s, d)).select("clusters", F.round("noise_share", 9).alias("noise_share")),
    "chunk_meta": lambda s, d: vectors.chunk_meta(labels(s, d).drop("review_id"), vector_rows(s, d).filter("chunk_index = 0")),
    "hash_embed": lambda s, d: vectors.hash_embed(reviews(s, d), "seq", "cleaned_text"),
    "pca_reduce": lambda s, d: vectors.reduce_dimensions(vector_rows(s, d)).select("seq", "reduced"),
    "hdbscan_labels": lambda s, d: density.hdbscan(vector_rows(s, d)),
    "kmeans": lambda s, d: vectors.kmeans(vector_rows(s, d)),
    "blockquotes": lambda s, d: validate.blockquotes(reports(s, d)),
    "format_check": lambda s, d: validate.missing_sections(reports(s, d)),
    "word_count": lambda s, d: validate.word_count(reports(s, d)),
    "quote_match": lambda s, d: validate.quote_match(shared_quotes(s, d), reviews(s, d)).select("line_no", "matched"),
    "report_decision": lambda s, d: validate.decide(reports(s, d), validate.blockquotes(reports(s, d)).withColumn("matched", F.length("quote") % 2 == 0), validate.missing_sections(reports(s, d))),
    "theme_coverage": lambda s, d: validate.theme_coverage(reports(s, d), members(s, d).filter("theme_id >= 0").groupBy("theme_id").agg(F.count("*").alias("n")).withColumn("label", F.element_at(F.array(*map(F.lit, ("app", "Login", "fees", "")),), F.col("theme_id") % 4 + 1))),
    "run_latest": lambda s, d: registry.latest(run_events(s, d)),
    "list_runs": lambda s, d: registry.list_runs(run_events(s, d)),
    "active_run": lambda s, d: registry.active_run(run_events(s, d)),
    "reset_stuck": lambda s, d: registry.reset_stuck(run_events(s, d)),
    "invalid_changes": lambda s, d: registry.invalid_changes(run_events(s, d)),
    "report_key": lambda s, d: registry.report_key(reviews(s, d).select("seq", F.col("author_name").alias("product"), F.col("date").alias("week_start"), F.col("app_version").alias("week_end"))).select("seq", "report_key"),
    "file_slug": lambda s, d: scraped(s, d).select("seq", registry.slug(F.col("userName")).alias("slug")),
}

WS = r"' ' || chr(10) || chr(9)"


def _strip(x: str) -> str:
    return f"trim({x}, {WS})"


def _html(x: str) -> str:
    for p in (r"<[^>]+>", r"https?://\S+", r"www\.\S+"):
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return _strip(x)


def _nfc(x: str) -> str:
    return _strip(f"regexp_replace(nfc_normalize({x}), '[^\\x20-\\x7E\\n\\t]', '', 'g')")


def _english(x: str) -> str:
    score = {k: f"len(regexp_extract_all(lower({x}), '{T.language_pattern(k)}'))" for k in T.LANGUAGE_WORDS}
    return f"(regexp_matches({x}, '[A-Za-z]') and {score['en']} >= greatest({', '.join(v for k, v in score.items() if k != 'en')}))"


def _scrub_sql(column: str, cte: str) -> str:
    """CTEs that apply the scrubbing rules one after the other to a column, with the counts of each."""
    out, source = [], "clean_reviews"
    text = column
    for i, (kind, pattern, tag) in enumerate(T.PII_RULES):
        p = pattern.replace("'", "''")
        name = f"{cte}{i}"
        carried = "".join(f", n_{k}" for k, _, _ in T.PII_RULES[:i])
        out.append(f"{name} as (select seq, review_id{carried}, regexp_replace({text}, '{p}', '{tag}', 'g') as t, coalesce(len(regexp_extract_all({text}, '{p}')), 0) as n_{kind} from {source})")
        source, text = name, "t"
    return ", ".join(out)


FETCH = f"""w as (select * from raw_reviews where ("at" is null or "at" >= timestamp '{DEFAULTS.window_start}') and reviewId <> '' qualify row_number() over (partition by reviewId order by seq) = 1),
    f as (select seq, coalesce(reviewId, '') as review_id, coalesce(userName, '') as author_name, coalesce(content, '') as text, coalesce(score, 0) as star_rating, coalesce(strftime("at", '%Y-%m-%d'), '') as date,
    coalesce(thumbsUpCount, 0) as thumbs_up_count, coalesce(appVersion, '') as app_version from w)"""
REASON = f"""p as (select *, {_html(_nfc('text'))} as processed from f), c as (select *, case when processed = '' then 'empty' when not {_english('processed')} then 'non_english' when length(processed) < 10 then 'short' end as reason from p)"""
SCRUB = f"with {_scrub_sql('original_text', 'o')}, {_scrub_sql('cleaned_text', 'c')}, x as (select o3.seq, o3.review_id, o3.t as original_text, c3.t as cleaned_text, " + ", ".join(f"greatest(o3.n_{k}, c3.n_{k}) as n_{k}" for k, _, _ in T.PII_RULES) + " from o3 join c3 using (seq))"
SHINGLES = r"""ws as (select seq, coalesce(date, '') as date, list_filter(regexp_split_to_array(coalesce(cleaned_text, ''), '\s+'), lambda x: x <> '') as w from clean_reviews),
    sh as (select seq, date, list_distinct(case when len(w) = 0 then [''] when len(w) < 3 then w else list_transform(range(0, len(w) - 2), lambda i: w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]) end) as s from ws)"""
NEAR = SHINGLES + """, k as (select *, list_sort(s) as o from sh), cl as (select o, min(seq) as cls, count(*) as copies from k group by 1), mem as (select seq, date, cls, copies from k join cl using (o)),
    e as (select cls, len(o) as n, unnest(o) as x from cl), pr as (select a.cls as a, b.cls as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.x = b.x and a.cls <> b.cls group by 1, 2),
    np as (select a, b from pr where c * 1.0 / (na + nb - c) >= 0.9)"""
TOK = r"coalesce(regexp_extract_all(lower(cleaned_text), '[a-z0-9_]+|[^a-z0-9_\s]'), [])"
WINDOWS = f"tk as (select seq, review_id, cleaned_text, {TOK} as k from clean_reviews), wn as (select *, case when len(k) <= 512 then 1 else cast(ceil((len(k) - 512) / 384.0) as integer) + 1 end as c from tk)"
LINES = r"""ln as (select doc_id as report_id, string_split(coalesce(text, ''), chr(10)) as a from documents), mk as (select report_id,
    array_to_string(list_transform(a, lambda x, i: case when (i - 1) % 3 = 0 then ' >> ' || x when (i - 1) % 3 = 1 then '## key observation ' || x else x end), chr(10)) as markdown from ln)"""
QUOTES = LINES + r""", sp as (select report_id, regexp_split_to_array(markdown, '\r\n|\r|\n') as l from mk), un as (select report_id, cast(generate_subscripts(l, 1) - 1 as integer) as line_no, regexp_replace(unnest(l), '^[\t-\r ]+|[\t-\r ]+$', '', 'g') as t from sp),
    bq as (select report_id, line_no, regexp_replace(regexp_replace(t, '^>+', ''), '^[\t-\r ]+|[\t-\r ]+$', '', 'g') as quote from un where starts_with(t, '>')), qq as (select * from bq where quote <> '' and not starts_with(quote, '[!'))"""
SECTIONS = LINES + ", rs(section) as (values " + ", ".join(f"('{x}')" for x in validate.REQUIRED_SECTIONS) + r"), ms as (select report_id, section from mk, rs where not regexp_matches(lower(markdown), '#+\s*' || lower(section)))"
STATUS = "['queued', 'running', 'delivering', 'awaiting_approval', 'delivered', 'failed', 'rejected'][event_id % 7 + 1]"
EVENTS = f"""ev as (select user_id::varchar as run_id, event_id as event_seq, case when event_id % 3 <> 0 then {STATUS} end as status, case when event_id % 5 = 0 then event_type end as step from events),
    la as (select run_id, arg_max(status, event_seq) filter (status is not null) as status, arg_max(step, event_seq) filter (step is not null) as step, min(event_seq) as created_seq from ev group by 1)"""
COS = "list_cosine_similarity(cast(embedding as double[]), centroid)"

#: The first chunk of every review.
FIRST = "f as (select case when review_id is not null then concat(review_id, '_chunk_0') end as chunk_id, seq from clean_reviews)"

ORACLE_SQL = {
    "map_review": """select seq, coalesce(reviewId, '') as review_id, coalesce(userName, '') as author_name, coalesce(content, '') as text, coalesce(score, 0) as star_rating, coalesce(strftime("at", '%Y-%m-%d'), '') as date, coalesce(thumbsUpCount, 0) as thumbs_up_count, coalesce(appVersion, '') as app_version from raw_reviews""",
    "window_filter": f"""select seq from raw_reviews where "at" is null or "at" >= timestamp '{DEFAULTS.window_start}'""",
    "fetch_reviews": f"with {FETCH} select * from f",
    "strip_html_urls": f"select seq, {_html('content')} as content from raw_reviews",
    "normalise_nfc": f"select seq, {_nfc('content')} as content from raw_reviews",
    "clean_reviews_nfc": f"with {FETCH}, {REASON} select seq, review_id, processed as original_text, lower(processed) as cleaned_text, star_rating as rating, date, author_name, thumbs_up_count, app_version from c where reason is null",
    "clean_discards_nfc": f"with {FETCH}, {REASON} select coalesce(reason, 'kept') as outcome, count(*) as n from c group by 1",
    "pii_scrub": SCRUB + " select * from x",
    "pii_counts": SCRUB + " select " + ", ".join(f"cast(coalesce(sum(n_{k}), 0) as bigint) as n_{k}" for k, _, _ in T.PII_RULES) + ", count(*) filter (" + " + ".join(f"n_{k}" for k, _, _ in T.PII_RULES) + " > 0) as reviews_with_pii from x",
    "exact_dedup": "select * from clean_reviews qualify row_number() over (partition by review_id order by seq) = 1",
    "shingles": f"with {SHINGLES} select seq, len(s) as n_shingles, case when len(w) = 0 then '' when len(w) < 3 then w[1] else w[1] || ' ' || w[2] || ' ' || w[3] end as first_shingle from sh join ws using (seq)",
    "near_dup_links": f"with {NEAR}, li as (select a as cls, count(*) as links from np group by 1) select seq, copies, coalesce(links, 0) as links from mem left join li using (cls)",
    "near_dedup": f"with {NEAR}, fi as (select cls, min((date, seq)) as f from mem group by 1), nf as (select a as cls, min(f) as g from np join fi on fi.cls = b group by 1), le as (select cls, case when g < f then g else f end as h from fi left join nf using (cls)) select seq from mem join le using (cls) where (date, seq) = h",
    "chunk_tiers": f"with {WINDOWS} select seq, review_id, len(k) as n_tokens, case when len(k) <= 512 then 'whole' when len(k) <= 1024 then 'sentence' else 'sliding' end as tier from tk",
    "tier_counts": f"with {WINDOWS} select case when len(k) <= 512 then 'whole' when len(k) <= 1024 then 'sentence' else 'sliding' end as tier, count(*) as n, cast(sum(len(k)) as bigint) as tokens from tk group by 1",
    "sliding_chunks": f"with {WINDOWS}, u as (select seq, k, unnest(range(0, c)) as i from wn) select seq, cast(i as integer) as chunk_index, len(k[i*384+1 : i*384+512]) as n_tokens from u",
    "sentence_chunks": f"with a as (select seq, list_filter(list_transform(regexp_extract_all(coalesce(cleaned_text, ''), '[^.!?]+[.!?]*'), lambda x: {_strip('x')}), lambda x: x <> '') as s from clean_reviews) select seq, cast(generate_subscripts(s, 1) - 1 as integer) as sentence_index, unnest(s) as sentence from a",
    "chunk": f"""with {WINDOWS}, ss as (select *, list_filter(list_transform(regexp_extract_all(coalesce(cleaned_text, ''), '[^.!?]+[.!?]*'), lambda x: {_strip('x')}), lambda x: x <> '') as s from wn),
        pc as (select seq, review_id, case when len(k) <= 512 then [coalesce(cleaned_text, '')] when len(k) <= 1024 then case when len(s) > 0 then s else [coalesce(cleaned_text, '')] end
        else list_transform(range(0, c), lambda i: array_to_string(k[i*384+1 : i*384+512], ' ')) end as p from ss),
        u as (select seq, review_id, len(p) as total_chunks, cast(generate_subscripts(p, 1) - 1 as integer) as chunk_index, unnest(p) as t from pc)
        select review_id || '_chunk_' || chunk_index as chunk_id, seq, chunk_index, total_chunks, length(t) as chars from u""",
    "embed_batches": f"with {FIRST}, n as (select *, row_number() over (order by seq) as row_no from f where chunk_id is null or chunk_id not in (select chunk_id from chunk_vectors where chunk_id is not null)) select (row_no - 1) // 256 as batch_id, count(*) as n, min(seq) as first_seq, max(seq) as last_seq from n group by 1",
    "cache_skip": f"with {FIRST} select seq from f where chunk_id is null or chunk_id not in (select chunk_id from chunk_vectors where chunk_id is not null)",
    "vector_upsert": f"with {FIRST} select chunk_id, seq from chunk_vectors where chunk_id is null or chunk_id not in (select chunk_id from f where chunk_id is not null) union all select * from f",
    "centroids": "with e as (select cast(length(chunk_text) % 5 as integer) as label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from chunk_vectors where embedding is not null), a as (select label, i, avg(x::double) as m, count(*) as n from e group by 1, 2) select label, max(n) as n, list(round(m, 6) order by i) as centroid from a group by 1",
    "representative_quotes": f"""with {MEMBERS}, tm as (select distinct theme_id, review_id from m where theme_id >= 0), tv as (select theme_id, v.* from chunk_vectors v join tm using (review_id) where embedding is not null),
        e as (select theme_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from tv), av as (select theme_id, i, avg(x::double) as mm from e group by 1, 2), ce as (select theme_id, list(mm order by i) as centroid from av group by 1),
        fc as (select theme_id, review_id, arg_min(embedding, seq) as embedding from tv where chunk_index = 0 group by 1, 2), sc as (select theme_id, review_id, round({COS}, 6) as similarity from fc join ce using (theme_id) where list_max(list_transform(embedding, lambda x: abs(x))) > 0),
        rk as (select *, cast(row_number() over (partition by theme_id order by similarity desc, review_id) as integer) as rank from sc qualify rank <= 3), tx as (select review_id, arg_max(coalesce(original_text, cleaned_text), seq) as quote from clean_reviews where review_id is not null group by 1)
        select theme_id, rank, review_id, similarity, quote from rk join tx using (review_id) where quote <> ''""",
    "majority_vote": "with l as (select chunk_id, review_id, cast((length(chunk_text) + chunk_index) % 4 - 1 as integer) as label from chunk_vectors where review_id is not null), c as (select review_id, label, count(*) as votes, min(chunk_id) as f from l group by 1, 2) select review_id, label as theme_id, votes from c qualify row_number() over (partition by review_id order by votes desc, f) = 1",
    "cluster_shape": "with l as (select cast((length(chunk_text) + chunk_index) % 4 - 1 as integer) as label from chunk_vectors) select count(distinct case when label <> -1 then label end) as clusters, round(coalesce(avg(case when label = -1 then 1.0 else 0.0 end), 0), 9)::double as noise_share from l",
    "chunk_meta": """with l as (select chunk_id, cast((length(chunk_text) + chunk_index) % 4 - 1 as integer) as label from chunk_vectors), k as (select chunk_id, min(review_id) as kr, min(chunk_index) as ki from chunk_vectors where chunk_index = 0 group by 1)
        select chunk_id, label, coalesce(kr, nullif(regexp_extract(chunk_id, '^(.*)_chunk_', 1), ''), chunk_id) as review_id, coalesce(ki, 0) as chunk_index from l left join k using (chunk_id)""",
    "blockquotes": f"with {QUOTES} select * from qq",
    "format_check": f"with {SECTIONS} select * from ms",
    "word_count": f"with {LINES}, w as (select report_id, len(list_filter(regexp_split_to_array(markdown, '[\\t-\\r ]+'), lambda x: x <> '')) as words from mk) select report_id, words, words > 250 as too_long from w",
    # An altered quote has six signs more than what it quotes; at the end of a text it is compared with less than its own length.
    "quote_match": """with q as (select cast(seq as integer) as line_no, seq % 2 = 0 as literal, length(original_text) <= 64 as ends, length(substr(original_text, 5, 60)) as n from clean_reviews where thumbs_up_count >= 40 and length(original_text) >= 40)
        select line_no, literal or case when ends then 2 * n / (2 * n + 6.0) else n / (n + 6.0) end >= 0.85 as matched from q""",
    "report_decision": f"""with {QUOTES}, rs(section) as (values {", ".join(f"('{x}')" for x in validate.REQUIRED_SECTIONS)}), ms as (select report_id, section from mk, rs where not regexp_matches(lower(markdown), '#+\\s*' || lower(section))),
        a as (select report_id, count(*) as quotes, count(*) filter (length(quote) % 2 = 0) as matched from qq group by 1), b as (select report_id, count(*) as sections_missing from ms group by 1),
        j as (select report_id, coalesce(quotes, 0) as quotes, coalesce(matched, 0) as matched, coalesce(sections_missing, 0) as sections_missing from mk left join a using (report_id) left join b using (report_id))
        select *, sections_missing = 0 and (quotes = 0 or matched * 2 >= quotes) as passed from j""",
    "theme_coverage": f"with {LINES}, {MEMBERS}, z as (select theme_id, count(*) as n, ['app', 'Login', 'fees', ''][theme_id % 4 + 1] as label from m where theme_id >= 0 group by 1) select report_id, theme_id, n, contains(lower(markdown), lower(label)) as covered from mk, z where n >= 30 and label <> ''",
    "run_latest": f"with {EVENTS} select * from la",
    "list_runs": f"with {EVENTS} select * from la order by created_seq desc limit 50",
    "active_run": f"with {EVENTS} select * from la where status in ('queued', 'running', 'delivering') order by created_seq desc limit 1",
    "reset_stuck": f"with {EVENTS} select run_id, (select max(event_seq) from ev) + 1 as event_seq, status as was, 'failed' as status from la where status in ('queued', 'running', 'delivering')",
    "invalid_changes": f"""with {EVENTS}, c as (select run_id, event_seq, lag(status) over (partition by run_id order by event_seq) as was, status from ev where status is not null)
        select * from c where was is not null and was <> status and not coalesce({" or ".join(f"was = '{k}' and status in ({', '.join(repr(x) for x in v)})" for k, v in registry.TRANSITIONS.items())}, false)""",
    "report_key": "select seq, substr(sha256(concat_ws('_', author_name, date, app_version)), 1, 12) as report_key from clean_reviews",
    "file_slug": r"select seq, coalesce(nullif(trim(regexp_replace(lower(userName), '[^\p{L}\p{N}_-]', '_', 'g'), '_'), ''), 'report') as slug from raw_reviews",
}
