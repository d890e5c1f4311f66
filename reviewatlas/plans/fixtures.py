"""Driver tables mapped to the canonical tables, in Spark and (for the checks) in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewatlas.functions.frames import keep_one

_PLATFORM = "element_at(array('tiktok', 'facebook', 'instagram'), CAST(user_id % 3 + 1 AS INT))"


def asin(key: str) -> str:
    """SQL for the product id of a number."""
    return f"'A' || lpad(CAST({key} AS STRING), 9, '0')"


#: A review's columns, written from a row of lineitem.
_REVIEW_ID = "'R' || l_orderkey || '_' || l_linenumber"
_REVIEW = [
    f"{asin('l_partkey - l_partkey % 5')} AS parent_asin",
    f"{asin('l_partkey')} AS child_asin",
    "'Size ' || (l_suppkey % 5) AS variation_text",
    "'U' || l_suppkey AS author_name",
    "1.0D + l_quantity % 5 AS rating_score",
    "CAST(l_shipdate AS DATE) AS review_date",
    "l_linestatus = 'O' AS is_verified",
    "l_linenumber AS helpful_count",
    "CASE l_linenumber % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'QUEUED' ELSE 'COMPLETED' END AS mining_status",
    "CAST(date_add(CAST(l_shipdate AS DATE), 1) AS TIMESTAMP_NTZ) AS ingested_at",
    "l_returnflag AS _flag", "l_partkey AS _pk", "l_suppkey AS _sk", "l_extendedprice AS _price",
    "l_orderkey AS _ok", "l_linenumber AS _ln",
]


class Tables:
    """Lazily built canonical tables over one folder of driver parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").selectExpr(
            f"{asin('p_partkey')} AS asin",
            f"{asin('p_partkey - p_partkey % 5')} AS parent_asin",
            "p_name AS title", "p_brand AS brand", "p_type AS category",
            "CASE WHEN p_partkey % 9 <> 0 THEN 'http://img.example/' || p_partkey || '.jpg' END AS image_url",
            "split(p_name, ' ')[0] AS material", "split(p_name, ' ')[1] AS main_niche",
            "CASE p_partkey % 6 WHEN 1 THEN 'Kids' WHEN 2 THEN 'Adults' END AS target_audience",
            "CASE WHEN p_partkey % 4 <> 0 THEN 'S' || p_size END AS size_capacity",
            "'L' || (p_size % 10) AS product_line",
            "CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 4 AS INT) END AS variation_count",
            "CASE WHEN p_partkey % 11 <> 0 THEN 1.0D + (p_partkey * 7 % 41) / 10.0D END AS real_average_rating",
            "CASE WHEN p_partkey % 13 <> 0 THEN p_partkey * 37 % 1000 END AS real_total_ratings",
            """CASE WHEN p_partkey % 35 = 0 THEN NULL WHEN p_partkey % 55 = 0 THEN '{}' ELSE
                '{"5": ' || (40 + p_partkey % 20) || ', "4": 20, "3": 10, "2": ' || (5 + p_partkey % 7)
                || ', "1": ' || (1 + p_partkey % 9) || '}' END AS rating_breakdown""",
        )

    @cached_property
    def product_parents(self) -> DataFrame:
        from reviewatlas.operators.linkage import niche_rollup

        own = self.products.filter("asin = parent_asin").filter(
            F.substring("parent_asin", 2, 9).try_cast("bigint") % 85 != 0
        )
        return own.select("parent_asin", "category", "title", "brand", "image_url").join(
            niche_rollup(self.products), "parent_asin", "left"
        )

    @cached_property
    def reviews_raw(self) -> DataFrame:
        """Duplicated ids are kept; text is not attached."""
        return self.raw("lineitem").selectExpr(f"{_REVIEW_ID} AS review_id", *_REVIEW)

    @cached_property
    def _reviews(self) -> DataFrame:
        # the stored numbers cross the network; what is written from them comes after
        rows = self.raw("lineitem").withColumns({"review_id": F.expr(_REVIEW_ID), "l_shipdate": F.col("l_shipdate").cast("date")})
        order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]
        return keep_one(rows, "review_id", order).selectExpr("review_id", *_REVIEW)

    @cached_property
    def reviews(self) -> DataFrame:
        return self._reviews.drop("_flag", "_pk", "_sk", "_price", "_ok", "_ln")

    def _with_text(self, df: DataFrame, column: str, text: Column) -> DataFrame:
        """Attach a whole document to every review; a few short and missing texts are planted."""
        # merged, not broadcast: no task holds all texts, and the reviews of one document lie together
        docs = self.raw("documents").select("doc_id", text.alias("_text")).hint("merge")
        total = self.raw("documents").agg(F.count("*")).scalar()
        body = F.when((F.col("_ln") == 1) & (F.col("_ok") % 53 == 0), F.lit(None)).when((F.col("_ln") == 2) & (F.col("_ok") % 59 == 0), F.col("_flag")).otherwise(F.col("_text"))
        return df.join(docs, F.col("_ok") % total == F.col("doc_id"), "left").withColumn(column, body).drop("doc_id", "_text")

    @cached_property
    def reviews_text(self) -> DataFrame:
        df = self._with_text(self._reviews, "text", F.col("text"))
        return df.drop("_flag", "_pk", "_sk", "_price", "_ok", "_ln")

    def _tags(self, with_quote: bool) -> DataFrame:
        # the stored numbers and words cross the network; ids and names are written from them, and rows doubled, after the last join
        slim = self._reviews.select("_pk", "_ok", "_ln", "_flag", "rating_score", "review_date")
        words = F.split("p_name", " ")
        part = self.raw("part").select(F.col("p_partkey").alias("_pk"), words[0].alias("_w0"), words[1].alias("_w1"))
        named = slim.join(part, "_pk")
        if with_quote:
            named = self._with_text(named, "quote", F.col("text"))
        first = """named_struct('no', 1, 'category', 'Quality',
            'aspect', IF(_ln % 3 = 0, upper(_w1), _w1),
            'sentiment', CASE _flag WHEN 'N' THEN 'Positive' WHEN 'R' THEN 'Negative' ELSE 'Neutral' END)"""
        second = """named_struct('no', 2, 'category', 'Material', 'aspect', _w0,
            'sentiment', CASE WHEN rating_score >= 4 THEN 'Positive' WHEN rating_score <= 2 THEN 'Negative' ELSE 'Neutral' END)"""
        tags = named.withColumn("t", F.expr(f"explode(IF(_ln % 2 = 0, array({first}, {second}), array({first})))"))
        written = tags.withColumn("review_id", F.expr(_REVIEW_ID.replace("l_orderkey", "_ok").replace("l_linenumber", "_ln")))
        return written.selectExpr(
            "review_id || '#' || t.no AS tag_id", "review_id", f"{asin('_pk - _pk % 5')} AS parent_asin", "t.category", "t.aspect", "t.sentiment",
            "CAST(review_date AS TIMESTAMP_NTZ) AS created_at", *(["quote"] if with_quote else []),
        )

    @cached_property
    def review_tags(self) -> DataFrame:
        return self._tags(False)

    @cached_property
    def review_tags_quoted(self) -> DataFrame:
        return self._tags(True)

    @cached_property
    def aspect_mapping(self) -> DataFrame:
        word = F.split("p_name", " ")[1]
        return (
            self.raw("part").select(word.alias("raw_aspect")).filter(F.length("raw_aspect") >= 4).distinct()
            .withColumn("standard_aspect", F.concat(F.lit("Std-"), F.substring("raw_aspect", 1, 1)))
            .withColumn("category", F.lit("Quality"))
        )

    @cached_property
    def social_posts(self) -> DataFrame:
        return self.raw("events").selectExpr(
            f"{_PLATFORM} AS platform", "CAST(event_id AS STRING) AS post_id", "event_type AS keyword", "'u' || user_id AS author",
            "'new ' || event_type || ' post #' || event_type || ' #k' || get_json_object(props, '$.k') AS text",
            "'http://s.example/' || event_id AS url", "floor(value * 5) AS likes", "floor(value * 10) AS shares",
            "floor(value) AS comments_count", "floor(value * 1000) AS views", "ts AS created_at",
        )

    @cached_property
    def charges(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS log_id", "user_id", f"{_PLATFORM} AS platform", "value / 1000 AS cost_usd", "ts AS timestamp"
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("customer").selectExpr("c_custkey AS user_id", "1.0D + c_custkey % 5 AS monthly_budget")

    @cached_property
    def scrape_queue(self) -> DataFrame:
        parts = self.raw("part").agg(F.count("*").alias("_parts"))
        orders = self.raw("orders").withColumn("_parts", parts.scalar())
        return orders.selectExpr(
            "CAST(o_orderkey AS STRING) AS request_id", f"{asin('o_orderkey % _parts')} AS asin",
            "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING_APPROVAL' WHEN 'P' THEN 'IN_PROGRESS' END AS status",
            "o_custkey AS requested_by", "CASE WHEN o_orderkey % 3 = 0 THEN 'urgent' END AS note", "o_orderdate AS created_at",
        )

    @cached_property
    def pairs(self) -> DataFrame:
        """Each family head against the next one."""
        heads = self.raw("part").filter("p_partkey % 5 = 0")
        ours = heads.selectExpr("p_partkey + 5 AS _next", f"{asin('p_partkey')} AS a")
        theirs = heads.selectExpr("p_partkey AS _next", f"{asin('p_partkey')} AS b")
        return ours.join(theirs, "_next").select("a", "b")


# --- the same mapping in SQL --------------------------------------------------------------

REVIEW_TEXT = "CASE WHEN _ln = 1 AND _ok % 53 = 0 THEN NULL WHEN _ln = 2 AND _ok % 59 = 0 THEN _flag ELSE d.text END"

CTES: dict[str, tuple[list[str], str]] = {
    "products": ([], """
        SELECT 'A' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS asin,
          'A' || lpad(CAST(p_partkey - p_partkey % 5 AS VARCHAR), 9, '0') AS parent_asin,
          p_name AS title, p_brand AS brand,
          CASE WHEN p_partkey % 9 <> 0 THEN 'http://img.example/' || p_partkey || '.jpg' END AS image_url,
          split_part(p_name, ' ', 1) AS material, split_part(p_name, ' ', 2) AS main_niche,
          CASE WHEN p_partkey % 6 = 1 THEN 'Kids' WHEN p_partkey % 6 = 2 THEN 'Adults' END AS target_audience,
          CASE WHEN p_partkey % 4 <> 0 THEN 'S' || p_size END AS size_capacity,
          'L' || (p_size % 10) AS product_line,
          CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 4 AS INTEGER) END AS variation_count,
          CASE WHEN p_partkey % 11 <> 0 THEN 1.0::DOUBLE + (p_partkey * 7 % 41) / 10.0::DOUBLE END AS real_average_rating,
          CASE WHEN p_partkey % 13 <> 0 THEN p_partkey * 37 % 1000 END AS real_total_ratings,
          CASE WHEN p_partkey % 35 = 0 THEN NULL WHEN p_partkey % 55 = 0 THEN '{}' ELSE
            '{"5": ' || (40 + p_partkey % 20) || ', "4": 20, "3": 10, "2": ' || (5 + p_partkey % 7)
            || ', "1": ' || (1 + p_partkey % 9) || '}' END AS rating_breakdown,
          p_type AS category
        FROM part"""),
    "niches": (["products"], """
        SELECT parent_asin, string_agg(main_niche, ', ' ORDER BY main_niche) AS niche
        FROM (SELECT DISTINCT parent_asin, main_niche FROM products) GROUP BY 1"""),
    "product_parents": (["products", "niches"], """
        SELECT p.parent_asin, category, title, brand, image_url, niche
        FROM products p LEFT JOIN niches n ON n.parent_asin = p.parent_asin
        WHERE asin = p.parent_asin AND CAST(substr(p.parent_asin, 2) AS BIGINT) % 85 <> 0"""),
    "reviews_raw": ([], """
        SELECT 'R' || l_orderkey || '_' || l_linenumber AS review_id,
          'A' || lpad(CAST(l_partkey - l_partkey % 5 AS VARCHAR), 9, '0') AS parent_asin,
          'A' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS child_asin,
          'Size ' || (l_suppkey % 5) AS variation_text, 'U' || l_suppkey AS author_name,
          1.0::DOUBLE + l_quantity % 5 AS rating_score, CAST(l_shipdate AS DATE) AS review_date,
          l_linestatus = 'O' AS is_verified, l_linenumber AS helpful_count,
          CASE WHEN l_linenumber % 4 = 0 THEN 'PENDING' WHEN l_linenumber % 4 = 1 THEN 'QUEUED' ELSE 'COMPLETED' END AS mining_status,
          CAST(CAST(l_shipdate AS DATE) + 1 AS TIMESTAMP) AS ingested_at,
          l_returnflag AS _flag, l_partkey AS _pk, l_suppkey AS _sk, l_extendedprice AS _price,
          l_orderkey AS _ok, l_linenumber AS _ln
        FROM lineitem"""),
    "reviews": (["reviews_raw"], """
        SELECT * FROM reviews_raw QUALIFY row_number() OVER
          (PARTITION BY review_id ORDER BY review_date, _pk, _sk, _price) = 1"""),
    "reviews_text": (["reviews"], """
        SELECT r.*, """ + REVIEW_TEXT + """ AS text
        FROM reviews r LEFT JOIN documents d ON d.doc_id = r._ok % (SELECT count(*) FROM documents)"""),
    "review_tags": (["reviews"], """
        SELECT review_id || '#1' AS tag_id, review_id, parent_asin, 'Quality' AS category,
          CASE WHEN _ln % 3 = 0 THEN upper(split_part(p_name, ' ', 2)) ELSE split_part(p_name, ' ', 2) END AS aspect,
          CASE _flag WHEN 'N' THEN 'Positive' WHEN 'R' THEN 'Negative' ELSE 'Neutral' END AS sentiment,
          CAST(review_date AS TIMESTAMP) AS created_at
        FROM reviews JOIN part ON p_partkey = _pk
        UNION ALL
        SELECT review_id || '#2', review_id, parent_asin, 'Material', split_part(p_name, ' ', 1),
          CASE WHEN rating_score >= 4 THEN 'Positive' WHEN rating_score <= 2 THEN 'Negative' ELSE 'Neutral' END,
          CAST(review_date AS TIMESTAMP)
        FROM reviews JOIN part ON p_partkey = _pk WHERE _ln % 2 = 0"""),
    "review_tags_quoted": (["review_tags", "reviews_text"], """
        SELECT t.*, text AS quote
        FROM review_tags t JOIN reviews_text r USING (review_id)"""),
    "aspect_mapping": ([], """
        SELECT DISTINCT split_part(p_name, ' ', 2) AS raw_aspect,
          'Std-' || substr(split_part(p_name, ' ', 2), 1, 1) AS standard_aspect, 'Quality' AS category
        FROM part WHERE length(split_part(p_name, ' ', 2)) >= 4"""),
    "norm_mapping": (["aspect_mapping"], """
        SELECT lower(trim(raw_aspect)) AS key, arg_min(standard_aspect, raw_aspect) AS standard_aspect,
          arg_min(category, raw_aspect) AS category FROM aspect_mapping GROUP BY 1"""),
    "tags_exact": (["review_tags", "aspect_mapping"], """
        SELECT t.* EXCLUDE (aspect), t.aspect AS raw, m.standard_aspect AS std, m.category AS std_category,
          coalesce(m.standard_aspect, t.aspect) AS aspect
        FROM review_tags t LEFT JOIN aspect_mapping m ON t.aspect = m.raw_aspect"""),
    "tags_norm": (["review_tags", "norm_mapping"], """
        SELECT t.* EXCLUDE (aspect), t.aspect AS raw, m.standard_aspect AS std, m.category AS std_category,
          coalesce(m.standard_aspect, t.aspect) AS aspect
        FROM review_tags t LEFT JOIN norm_mapping m ON lower(trim(t.aspect)) = m.key"""),
    "quoted_norm": (["review_tags_quoted", "norm_mapping"], """
        SELECT t.* EXCLUDE (aspect), t.aspect AS raw, m.standard_aspect AS std, m.category AS std_category,
          coalesce(m.standard_aspect, t.aspect) AS aspect
        FROM review_tags_quoted t LEFT JOIN norm_mapping m ON lower(trim(t.aspect)) = m.key"""),
    "bd": (["products"], """
        SELECT asin, (rating_breakdown IS NULL OR rating_breakdown IN ('', '{}')) AS missing,
          CAST(rating_breakdown::JSON->>'1' AS DOUBLE) AS b1, CAST(rating_breakdown::JSON->>'2' AS DOUBLE) AS b2,
          CAST(rating_breakdown::JSON->>'3' AS DOUBLE) AS b3, CAST(rating_breakdown::JSON->>'4' AS DOUBLE) AS b4,
          CAST(rating_breakdown::JSON->>'5' AS DOUBLE) AS b5, b1 + b2 + b3 + b4 + b5 AS bsum
        FROM products"""),
    # population of every product: real and sampled reviews per star
    "rates": (["reviews", "products", "bd"], """
        SELECT s.parent_asin, star, sampled,
          CASE WHEN missing IS NULL OR missing THEN real_total / 5.0::DOUBLE
            ELSE CASE star WHEN 1 THEN b1 WHEN 2 THEN b2 WHEN 3 THEN b3 WHEN 4 THEN b4 WHEN 5 THEN b5 END / bsum * real_total END AS real_count
        FROM (SELECT parent_asin, CAST(round(rating_score) AS INTEGER) AS star, count(*) AS sampled FROM reviews GROUP BY 1, 2) s
        JOIN (SELECT l.parent_asin, CASE WHEN coalesce(p.real_total_ratings, 0) <> 0 THEN p.real_total_ratings ELSE l.n END AS real_total
              FROM (SELECT parent_asin, count(*) AS n FROM reviews GROUP BY 1) l
              LEFT JOIN products p ON p.asin = l.parent_asin) t USING (parent_asin)
        LEFT JOIN bd ON bd.asin = s.parent_asin
        WHERE star BETWEEN 1 AND 5"""),
    "impact_all": (["tags_exact", "reviews", "rates"], """
        SELECT parent_asin, aspect, CAST(trunc(round(pos, 6)) AS BIGINT) AS est_positive, CAST(trunc(round(neg, 6)) AS BIGINT) AS est_negative,
          CAST(trunc(round(pos - neg, 6)) AS BIGINT) AS net_impact, CAST(trunc(round(pos + neg, 6)) AS BIGINT) AS total_impact_vol
        FROM (
          SELECT c.parent_asin, aspect,
            sum(CASE WHEN sentiment = 'Positive' THEN cnt::DOUBLE / sampled * real_count ELSE 0 END) AS pos,
            sum(CASE WHEN sentiment = 'Positive' THEN 0 ELSE cnt::DOUBLE / sampled * real_count END) AS neg
          FROM (SELECT t.parent_asin, t.aspect, CAST(round(r.rating_score) AS INTEGER) AS star, t.sentiment, count(*) AS cnt
                FROM tags_exact t JOIN reviews r USING (review_id) GROUP BY 1, 2, 3, 4) c
          JOIN rates USING (parent_asin, star) GROUP BY 1, 2)"""),
    "impact": (["impact_all"], """
        SELECT * FROM impact_all QUALIFY row_number() OVER
          (PARTITION BY parent_asin ORDER BY total_impact_vol DESC, net_impact DESC, aspect) <= 20"""),
    "kpis": (["reviews", "products", "bd"], """
        SELECT coalesce(l.parent_asin, p.asin) AS asin,
          CAST(coalesce(p.real_total_ratings, l.n, 0) AS BIGINT) AS total_reviews,
          CAST(coalesce(p.real_average_rating, l.avg_score, 0) AS DOUBLE) AS avg_rating,
          CAST(CASE WHEN p.asin IS NULL THEN 0 WHEN coalesce(p.variation_count, 0) = 0 THEN coalesce(l.children, 0) ELSE p.variation_count END AS BIGINT) AS total_variations,
          CAST(CASE WHEN bsum > 0 THEN (b1 + b2) / bsum * 100 ELSE 0 END AS DOUBLE) AS neg_pct,
          p.asin IS NULL AS is_fallback
        FROM (SELECT parent_asin, count(*) AS n, avg(rating_score) AS avg_score, count(DISTINCT child_asin) AS children FROM reviews GROUP BY 1) l
        FULL JOIN products p ON p.asin = l.parent_asin LEFT JOIN bd ON bd.asin = p.asin
        WHERE l.parent_asin IS NOT NULL OR p.asin = p.parent_asin"""),
    "posts": ([], """
        SELECT ['tiktok', 'facebook', 'instagram'][user_id % 3 + 1] AS platform, CAST(event_id AS VARCHAR) AS post_id,
          event_type AS keyword, 'u' || user_id AS author,
          'new ' || event_type || ' post #' || event_type || ' #k' || (props::JSON->>'k') AS text,
          'http://s.example/' || event_id AS url, CAST(floor(value * 5) AS BIGINT) AS likes,
          CAST(floor(value * 10) AS BIGINT) AS shares, CAST(floor(value) AS BIGINT) AS comments_count,
          CAST(floor(value * 1000) AS BIGINT) AS views, ts AS created_at FROM events"""),
    "charges": ([], """
        SELECT event_id AS log_id, user_id, ['tiktok', 'facebook', 'instagram'][user_id % 3 + 1] AS platform,
          value / 1000 AS cost_usd, ts AS "timestamp" FROM events"""),
    "users": ([], "SELECT c_custkey AS user_id, 1.0::DOUBLE + c_custkey % 5 AS monthly_budget FROM customer"),
    "queue": ([], """
        SELECT CAST(o_orderkey AS VARCHAR) AS request_id,
          'A' || lpad(CAST(o_orderkey % (SELECT count(*) FROM part) AS VARCHAR), 9, '0') AS asin,
          CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING_APPROVAL' WHEN 'P' THEN 'IN_PROGRESS' END AS status,
          o_custkey AS requested_by, CASE WHEN o_orderkey % 3 = 0 THEN 'urgent' END AS note, o_orderdate AS created_at
        FROM orders"""),
    "pairs": ([], """
        SELECT 'A' || lpad(CAST(x.p_partkey AS VARCHAR), 9, '0') AS a, 'A' || lpad(CAST(y.p_partkey AS VARCHAR), 9, '0') AS b
        FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 5 WHERE x.p_partkey % 5 = 0"""),
}


def sql(body: str, *needs: str) -> str:
    """``body`` behind the shared definitions it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    # each definition once, whatever the number of readers
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1].strip()})" for n in order)
    return f"WITH {head}\n{body.strip()}" if head else body.strip()
