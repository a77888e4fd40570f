"""Schemas of the tables that pass between operators, as Spark DDL."""

SCRAPED = "seq BIGINT, reviewId STRING, userName STRING, content STRING, score INT, at TIMESTAMP, thumbsUpCount INT, appVersion STRING"
RAW_REVIEW = "seq BIGINT, review_id STRING, author_name STRING, text STRING, star_rating INT, date STRING, thumbs_up_count INT, app_version STRING"
CLEAN_REVIEW = "seq BIGINT, review_id STRING, original_text STRING, cleaned_text STRING, rating STRING, date STRING, author_name STRING, thumbs_up_count INT, app_version STRING"
CHUNK = "chunk_id STRING, review_id STRING, chunk_index INT, chunk_text STRING, total_chunks INT"
VECTOR = CHUNK + ", embedding ARRAY<FLOAT>"
THEME_MEMBER = "theme_id INT, review_id STRING, pos BIGINT"
PENDING = "product STRING, week_start STRING, week_end STRING, report_markdown STRING, fee_explainer STRING, fee_pain_point STRING, review_count BIGINT, theme_count INT, report_key STRING"
AUDIT = "product STRING, week_start STRING, week_end STRING, report_hash STRING, review_count BIGINT, theme_count INT, delivered_at STRING, channel STRING, target STRING, ok BOOLEAN"
RUN = "run_id STRING, event_seq BIGINT, product STRING, week_start STRING, week_end STRING, status STRING, step STRING, error STRING, created_at STRING, updated_at STRING, approved_at STRING, review_count BIGINT, theme_count INT, report_markdown STRING, validation_errors ARRAY<STRING>, themes ARRAY<STRING>, recipients ARRAY<STRING>"
