"""Spend, budgets and feeds on planted rows."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from reviewatlas.operators import social


def test_wallet(frame):
    """Budget 5: a charge of 1 passes, a request of 10 is refused with 4 left."""
    users = frame([("u", 5.0), ("v", 0.0), ("w", 10.0)], "user_id string, monthly_budget double")
    before = social.budget_position(users, frame([("u", 0.0)], "user_id string, current_spend double"))
    first = frame([("u", 1.0), ("nobody", 1.0)], "user_id string, cost_usd double")
    assert rows(social.affordable(first, before), "user_id", "accepted") == [("nobody", False), ("u", True)]
    spent = social.spend_by_user(frame([("u", 1.0), ("u", -3.0), ("v", 2.0), ("w", 9.0)], "user_id string, cost_usd double"))
    after = social.budget_position(users, spent)
    assert rows(after, "user_id", "remaining", "used_share", "level") == [
        ("u", 4.0, 0.2, "ok"), ("v", 0.0, 0.0, "ok"), ("w", 1.0, 0.9, "critical")
    ]
    assert rows(social.affordable(frame([("u", 10.0)], "user_id string, cost_usd double"), after), "accepted") == [(False,)]


def test_costs(frame):
    asked = frame([("tiktok", "feed", 1000), ("facebook", "comments", 200), ("facebook", "x", 1000), ("meta_ads", "feed", 500)], "platform string, task_type string, limit int")
    assert [r.cost_usd for r in social.estimate_cost(asked).collect()] == pytest.approx([0.3, 0.3, 2.5, 0.5])
    keyed = frame([("FB_ADS", 13), ("TIKTOK_FEED", 100), ("NONE", 5)], "platform_key string, item_count int")
    # 0.565 is below its half in binary, and rounds down
    assert [r.estimated_cost for r in social.estimate_cost_with_fee(keyed).collect()] == [0.56, 0.03, 0.0]


def test_facebook_alternatives(spark, tmp_path):
    (tmp_path / "raw.json").write_text("\n".join([
        '{"postId": "1", "postText": "", "content": "c", "author": {"name": "A"}, "like_count": 0, "reactionsCount": 7, "permalink": "u1", "date": "2024-01-02 03:04:05"}',
        '{"id": 2, "__typename": "Video", "user": {"name": "B"}, "play_count": 9, "commentsCount": 3, "url": "u2"}',
        '{"id": 3, "likes": 0}',
    ]))
    raw = spark.read.json(str(tmp_path))
    got = rows(social.normalise_facebook(raw, "kw"), "post_id", "text", "author", "likes", "comments_count", "shares", "url", "created_at")
    assert got == [
        ("1", "c", "A", 7, 0, 0, "u1", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("2", "[Video/Reel Media]", "B", 9, 3, 0, "u2", None),
        ("3", None, None, 0, 0, 0, None, None),
    ]


def test_comment_ids_repeat(frame):
    raw = frame([("u", "a", "t", 5)], "videoWebUrl string, uniqueId string, text string, createTime bigint")
    once, twice = (social.normalise_comments(raw, "tiktok").select("comment_id", "created_at").first() for _ in range(2))
    assert once == twice and len(once.comment_id) == 64
    assert once.created_at == dt.datetime(1970, 1, 1, 0, 0, 5)


def test_bursts_split_at_the_gap(frame):
    start = dt.datetime(2024, 1, 1, 20)
    hours = [0, 5, 23, 47, 48, 71, 72]
    posts = frame([("a", f"p{h}", start + dt.timedelta(hours=h), h) for h in hours], "author string, post_id string, created_at timestamp, views int")
    got = rows(social.bursts(posts, 24), "run", "posts", "total_views", "best_post")
    assert got == [(1, 3, 28, "p23"), (2, 4, 238, "p72")]


def test_rhythm_bands(frame):
    start = dt.datetime(2024, 1, 1)
    def author(name, step):
        return [(name, start + dt.timedelta(hours=i * step)) for i in range(3)]

    posts = frame(author("burst", 5) + author("machine", 48) + author("sniper", 200) + author("between", 100) + [("single", start)], "author string, created_at timestamp")
    got = dict(rows(social.posting_rhythm(posts), "author", "rhythm"))
    assert got == {"burst": "burst", "machine": "machine", "sniper": "sniper", "between": "other", "single": "other"}


def test_tracking_and_keep(frame):
    now = dt.datetime(2024, 2, 1)
    posts = frame([(str(d), now - dt.timedelta(days=d), 10, "I Returned it", d == 40) for d in (1, 5, 20, 40)], "post_id string, created_at timestamp, views int, text string, is_tagged boolean")
    at = F.lit(now)
    assert rows(social.tracking_tier(posts, at)) == [("1", "daily"), ("20", "weekly"), ("40", "archive"), ("5", "every_3_days")]
    assert rows(social.keep_posts(posts, at), "post_id", "alert") == [("1", False), ("40", True), ("5", False)]
