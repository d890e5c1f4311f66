"""Canonical table schemas and the helper that conforms a frame to one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DataType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType,
)

# Table layouts of the data model.
_DDL = {
    "reviews": """review_id string, parent_asin string, child_asin string, variation_text string,
        author_name string, rating_score double, title string, text string, review_date date,
        is_verified boolean, vine_program boolean, helpful_count int, source_file string,
        mining_status string, ingested_at timestamp""",
    "products": """asin string, parent_asin string, title string, brand string, image_url string,
        material string, main_niche string, gender string, design_type string,
        target_audience string, size_capacity string, product_line string, num_pieces string,
        pack string, variation_count int, real_average_rating double, real_total_ratings bigint,
        rating_breakdown string, specs_json string, category string, verification_status string,
        last_updated timestamp""",
    "product_parents": """parent_asin string, category string, title string, brand string,
        image_url string, niche string, verification_status string, last_updated timestamp""",
    "review_tags": """tag_id string, review_id string, parent_asin string, category string,
        aspect string, sentiment string, quote string, created_at timestamp""",
    "aspect_mapping": "raw_aspect string, standard_aspect string, category string",
    "product_stats": "asin string, last_updated timestamp, metrics_json string",
    "scrape_queue": """request_id string, asin string, status string, requested_by string,
        note string, priority int, created_at timestamp, updated_at timestamp""",
    "social_posts": """platform string, post_id string, keyword string, author string, text string,
        url string, likes bigint, shares bigint, comments_count bigint, views bigint,
        created_at timestamp, scraped_at timestamp""",
    "social_comments": """comment_id string, post_url string, platform string, author string,
        text string, likes bigint, reply_count bigint, created_at timestamp, sentiment string,
        scraped_at timestamp""",
    "social_ads": """platform string, ad_id string, keyword string, page_name string,
        ad_body string, cta_type string, media_type string, start_date date, end_date date,
        platforms string, url string""",
    "users": "user_id string, monthly_budget double, role string",
    "user_wallets": "user_id string, current_spend double, last_topup_date timestamp",
    "watchlist": """pin_id string, user_id string, asin string, is_active boolean,
        created_at timestamp""",
    "scrape_audit_logs": """log_id string, user_id string, platform string, task_type string,
        target string, item_count int, cost_usd double, timestamp timestamp""",
    "chat_history": """chat_id string, user_id string, asin_context string, user_query string,
        ai_response string, timestamp timestamp""",
    "scrape_transactions": """trans_id string, user_id string, platform string, target string,
        item_count int, estimated_cost double, actual_cost double, status string,
        created_at timestamp""",
    "social_case_studies": """case_id string, trans_id string, platform string, target string,
        raw_file_path string, ai_analysis_json string, created_by string, created_at timestamp""",
    "users_budget": """user_id string, monthly_cap double, current_spend double,
        is_locked boolean, last_reset date""",
    "user_feedback": """id bigint, user_identity string, rating int, feature_request string,
        bug_report string, other_comment string, created_at timestamp""",
}

_TYPES: dict[str, DataType] = {
    "string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType(),
    "boolean": BooleanType(), "date": DateType(),
    # wall-clock times: the session time zone never shifts them
    "timestamp": TimestampNTZType(),
}


def _schema(ddl: str) -> StructType:
    """Read without a session, so that the package can be imported before one exists."""
    pairs = [column.split() for column in ddl.split(",")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMAS: dict[str, StructType] = {name: _schema(ddl) for name, ddl in _DDL.items()}


def conform(
    df: DataFrame,
    schema: StructType | str,
    renames: dict[str, str] | None = None,
    defaults: dict[str, object] | None = None,
) -> DataFrame:
    """Project ``df`` on ``schema``: names are matched without case, casts never fail, and an
    absent column becomes a typed null or its default. ``renames``: raw name -> column."""
    target = SCHEMAS[schema] if isinstance(schema, str) else schema
    source_of = {to: raw.lower() for raw, to in (renames or {}).items()}
    present = {c.lower(): c for c in df.columns}
    defaults = defaults or {}

    def pick(field: StructField) -> Column:
        raw = present.get(source_of.get(field.name, field.name))
        if raw is None:
            value = F.lit(defaults.get(field.name)).cast(field.dataType)
        else:
            value = F.col(f"`{raw}`").try_cast(field.dataType)
            if field.name in defaults:
                value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        return value.alias(field.name)

    return df.select([pick(f) for f in target.fields])
