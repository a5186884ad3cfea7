"""Parsers of platform pages: one row per page in, a row with its error code or its entries out.

Every parser takes a DataFrame with a column of JSON text and adds ``code`` (null for a good page) and the parsed
columns. A page with one bad entry is bad as a whole, so that a changed layout never looks like a short page. All other
columns of the page rows are kept.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.sources import variant as v

# Error codes of the parsers.
PAGE_CHANGED, LOGIN, GONE, RATE = "page_changed", "login_required", "source_unavailable", "rate_limited"
NO_SUBTITLE, BAD_SUBTITLE = "subtitle_unavailable", "malformed_subtitle"
# Codes of the platforms.
BILIBILI_LOGIN, BILIBILI_GONE = (-101, -400), (-403, -404, 62002, 62004)
X_LOGIN = (32, 215, 353)
ZHIHU_LOGIN, ZHIHU_RATE = (100, 101), (4039,)


def _decoded(pages: DataFrame, body: str) -> DataFrame:
    return pages.withColumn("_v", v.decode(F.col(body)))


def _ruled(df: DataFrame, rules: list[tuple[Column, str]], **parsed: Column) -> DataFrame:
    """``code`` by the first rule that holds; parsed columns only where none does."""
    code = reduce(lambda c, r: c.when(F.coalesce(r[0], F.lit(True)), r[1]), rules[1:], F.when(F.coalesce(rules[0][0], F.lit(True)), rules[0][1]))
    df = df.withColumn("code", code)
    return df.select("*", *[F.when(F.col("code").isNull(), c).alias(k) for k, c in parsed.items()]).drop("_v", "_got", "_all", "_read")


def _read(df: DataFrame, array: Column, make, bad) -> DataFrame:
    """``_read``: what each entry holds (``x``) and whether it is no object or bad, so that rule and result read it once; a null test counts as bad."""
    both = lambda e, x: F.struct(x.alias("x"), (~v.is_object(e) | F.coalesce(bad(e, x), F.lit(True))).alias("bad"))
    return df.withColumn("_read", F.transform(array, lambda e: v.let(make(e), lambda x: both(e, x))))


def _bad_entry() -> Column:
    return F.exists("_read", lambda r: r["bad"])


def _held() -> Column:
    return F.transform("_read", lambda r: r["x"])


def exploded(parsed: DataFrame, entries: str, name: str, *kept: str) -> DataFrame:
    """A row for each of the ``entries`` of good pages. (For a plain explode Spark asks first whether the list is empty, by a filter that parses every page once more, and once for each step of it.)"""
    return parsed.select(*kept, F.explode_outer(entries).alias(name)).where(F.col(name).isNotNull())


def _any(array: Column, bad) -> Column:
    """Whether an entry is no object or bad; a null test counts as bad."""
    return F.exists(array, lambda e: ~v.is_object(e) | F.coalesce(bad(e), F.lit(True)))


def _api_rules(gone: bool) -> list[tuple[Column, str]]:
    c = v.field(F.col("_v"), "$.code")
    n = v.whole(F.col("_v"), "$.code")
    rules = [(~v.is_object(F.col("_v")), PAGE_CHANGED), (c.isNotNull() & n.isNull(), PAGE_CHANGED), (F.coalesce(n.isin(*BILIBILI_LOGIN), F.lit(False)), LOGIN)]
    if gone:
        rules.append((F.coalesce(n.isin(*BILIBILI_GONE), F.lit(False)), GONE))
    return [*rules, (F.coalesce(n != 0, F.lit(False)), PAGE_CHANGED), (~v.is_object(F.col("_v"), "$.data"), PAGE_CHANGED)]


def bilibili_folders(pages: DataFrame, body: str = "body") -> DataFrame:
    """``folders``: (scope_id, title, media_count)."""
    got = v.entries(F.col("_v"), "$.data.list")
    bad = _any(got, lambda e: v.whole(e, "$.id").isNull() | v.text(e, "$.title").isNull() | v.whole(e, "$.media_count").isNull())
    make = lambda e: F.struct(v.whole(e, "$.id").cast("string").alias("scope_id"), v.text(e, "$.title").alias("title"), v.whole(e, "$.media_count").alias("media_count"))
    return _ruled(_decoded(pages, body), [*_api_rules(False), (got.isNull(), PAGE_CHANGED), (bad, PAGE_CHANGED)], folders=F.transform(got, make))


def _bvid(e: Column) -> Column:
    first = v.field(e, "$.bvid")
    empty = ~v.present(first) | (v.any_text(e, "$.bvid") == "")
    return F.when(F.coalesce(empty, F.lit(False)), v.text(e, "$.bv_id")).otherwise(v.text(e, "$.bvid"))


def _wrong_text(e: Column, path: str) -> Column:
    """Present, but no string."""
    return v.present(v.field(e, path)) & v.any_text(e, path).isNull()


def _owner(e: Column, path: str) -> tuple[Column, Column]:
    name = F.when(v.any_text(e, path + ".name") != "", v.any_text(e, path + ".name"))
    return name.alias("author"), v.whole(e, path + ".mid").cast("string").alias("author_mid")


def _media(e: Column) -> Column:
    return F.struct(
        _bvid(e).alias("bvid"), v.text(e, "$.title").alias("title"), *_owner(e, "$.upper"), F.coalesce(v.any_text(e, "$.intro"), F.lit("")).alias("intro"),
        F.nullif(v.any_text(e, "$.cover"), F.lit("")).alias("cover_url"), v.instant(v.number(e, "$.pubtime")).alias("published_at"), v.instant(v.number(e, "$.fav_time")).alias("fav_time"),
    )


def _bad_media(e: Column, m: Column) -> Column:
    return m["bvid"].isNull() | m["title"].isNull() | m["published_at"].isNull() | _wrong_text(e, "$.cover") | _wrong_text(e, "$.upper.name")


def bilibili_resources(pages: DataFrame, body: str = "body") -> DataFrame:
    """``medias`` of a favourites page, and ``has_more``."""
    got, more = F.col("_got"), v.field(F.col("_v"), "$.data.has_more")
    rules = [*_api_rules(False), (got.isNull(), PAGE_CHANGED), (more.isNotNull() & v.flag(F.col("_v"), "$.data.has_more").isNull(), PAGE_CHANGED), (_bad_entry(), PAGE_CHANGED)]
    df = _read(_decoded(pages, body).withColumn("_got", v.entries(F.col("_v"), "$.data.medias")), got, _media, _bad_media)
    return _ruled(df, rules, medias=_held(), has_more=F.coalesce(v.flag(F.col("_v"), "$.data.has_more"), F.lit(False)))


def bilibili_media(rows: DataFrame, body: str = "body") -> DataFrame:
    """``media`` of a single favourite, by the rules of a page."""
    e = F.col("_v")
    return _ruled(_decoded(rows, body), [(~v.is_object(e), PAGE_CHANGED), (v.let(_media(e), lambda m: _bad_media(e, m)), PAGE_CHANGED)], media=_media(e))


def bilibili_detail(pages: DataFrame, body: str = "body") -> DataFrame:
    """``video`` of a detail page."""
    d = v.field(F.col("_v"), "$.data")
    number_wrong = lambda p: v.present(v.field(d, p)) & v.whole(d, p).isNull()
    bad = v.text(d, "$.bvid").isNull() | v.text(d, "$.title").isNull() | v.instant(v.number(d, "$.pubdate")).isNull() | _wrong_text(d, "$.pic") | _wrong_text(d, "$.owner.name")
    bad = reduce(lambda a, p: a | number_wrong(p), ("$.aid", "$.duration", "$.cid"), bad)
    video = F.struct(
        v.text(d, "$.bvid").alias("bvid"), v.whole(d, "$.aid").alias("aid"), v.text(d, "$.title").alias("title"), *_owner(d, "$.owner"), F.coalesce(v.any_text(d, "$.desc"), F.lit("")).alias("description"),
        F.nullif(v.any_text(d, "$.pic"), F.lit("")).alias("cover_url"), v.instant(v.number(d, "$.pubdate")).alias("published_at"), v.whole(d, "$.duration").alias("duration"), v.whole(d, "$.cid").alias("cid"),
    )
    return _ruled(_decoded(pages, body), [*_api_rules(True), (bad, PAGE_CHANGED)], video=video)


def bilibili_subtitle(pages: DataFrame, body: str = "body", language: Column | None = None) -> DataFrame:
    """``language`` and ``cues`` (start, end, content): distinct, by start, then end, then as they stood."""
    c, n = v.field(F.col("_v"), "$.code"), v.whole(F.col("_v"), "$.code")
    got = v.entries(F.col("_v"), "$.body")
    bad = _any(got, lambda e: v.number(e, "$.from").isNull() | v.number(e, "$.to").isNull() | v.any_text(e, "$.content").isNull())
    cue = lambda e: F.struct(v.number(e, "$.from").alias("start"), v.number(e, "$.to").alias("end"), v.any_text(e, "$.content").alias("content"))
    cues = F.array_distinct(F.transform(got, cue))
    order = F.array_sort(F.transform(cues, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("i"), x["content"].alias("content"))))
    cues = F.transform(order, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["content"].alias("content")))
    rules = [
        (~v.is_object(F.col("_v")), PAGE_CHANGED), (F.coalesce(n.isin(*BILIBILI_LOGIN), F.lit(False)), LOGIN), (v.present(c) & ~F.coalesce(n == 0, F.lit(False)), BAD_SUBTITLE),
        (got.isNull(), BAD_SUBTITLE), (bad, BAD_SUBTITLE), (F.size(got) == 0, NO_SUBTITLE),
    ]
    told = F.coalesce(language if language is not None else F.lit(None).cast("string"), v.text(F.col("_v"), "$.lan"), v.text(F.col("_v"), "$.lang"), F.lit("unknown"))
    return _ruled(_decoded(pages, body), rules, language=told, cues=cues)


def _author(e: Column, base: str) -> tuple[Column, Column]:
    """Name and handle of a tweet's author; the older layout has them under ``legacy``."""
    user = base + ".core.user_results.result"
    name, handle = v.text(e, user + ".core.name"), v.text(e, user + ".core.screen_name")
    return F.coalesce(name, v.text(e, user + ".legacy.name")).alias("author"), F.coalesce(handle, F.when(name.isNull(), v.text(e, user + ".legacy.screen_name"))).alias("handle")


def _tweet_text(e: Column, base: str) -> Column:
    return F.coalesce(v.text(e, base + ".note_tweet.note_tweet_results.result.text"), v.any_text(e, base + ".legacy.full_text"))


def _tombstone_text(e: Column, base: str) -> Column:
    return F.coalesce(v.text(e, base + ".tombstone.text.text"), F.lit("unavailable"))


def _unwrapped(e: Column, path: str) -> Column:
    """The tweet inside a visibility wrapper, or the result itself."""
    return F.when(v.any_text(e, path + ".__typename") == "TweetWithVisibilityResults", v.field(e, path + ".tweet")).otherwise(v.field(e, path))


def _tweet_type(e: Column, path: str) -> Column:
    name = v.any_text(e, path + ".__typename")
    return F.when(name == "TweetWithVisibilityResults", F.when(v.is_object(e, path + ".tweet"), F.lit("Tweet"))).otherwise(name)


_RESULT = "$.content.itemContent.tweet_results.result"


def _tweet(e: Column) -> Column:
    quoted = "$.quoted_status_result.result"
    return v.let(_unwrapped(e, _RESULT), lambda r: v.let(_unwrapped(r, quoted), lambda q: v.let(_gone(e), lambda gone: _tweet_of(e, r, q, gone))))


def _gone(e: Column) -> Column:
    return ~v.is_object(e, _RESULT) | (_tweet_type(e, _RESULT) == "TweetTombstone")


def _tweet_of(e: Column, r: Column, q: Column, gone: Column) -> Column:
    """The tweet of an entry with its result, the quoted result, and whether it is gone."""
    from_entry = F.regexp_extract(F.coalesce(v.any_text(e, "$.entryId"), F.lit("")), r"^(?:tweet-)?(\d+)$", 1)
    media = F.transform(v.entries(r, "$.legacy.extended_entities.media"), lambda m: F.struct(v.any_text(m, "$.type").alias("type"), v.any_text(m, "$.media_url_https").alias("url"), v.text(m, "$.ext_alt_text").alias("alt")))
    lost = _tweet_type(r, "$.quoted_status_result.result") == "TweetTombstone"
    q_author, q_handle = _author(q, "$")
    quoted = F.struct(
        F.when(lost, v.any_text(r, "$.legacy.quoted_status_id_str")).otherwise(v.any_text(q, "$.rest_id")).alias("tweet_id"), F.when(~lost, q_author).alias("author"), F.when(~lost, q_handle).alias("handle"),
        F.when(lost, _tombstone_text(q, "$")).otherwise(_tweet_text(q, "$")).alias("text"), lost.alias("unavailable"),
    )
    author, handle = _author(r, "$")
    return F.struct(
        F.when(gone, from_entry).otherwise(v.any_text(r, "$.rest_id")).alias("tweet_id"), gone.alias("tombstone"),
        F.when(gone & v.is_object(e, _RESULT), _tombstone_text(r, "$")).when(gone, F.lit("empty tweet result")).alias("reason"),
        F.when(~gone, _tweet_text(r, "$")).alias("text"), F.when(~gone, author).alias("author"), F.when(~gone, handle).alias("handle"),
        F.when(~gone, v.wire_date(v.any_text(r, "$.legacy.created_at"))).alias("created_at"), F.when(~gone, F.coalesce(media, F.array().cast("array<struct<type:string,url:string,alt:string>>"))).alias("media"),
        F.when(~gone & v.is_object(r, "$.quoted_status_result.result"), quoted).alias("quoted"),
    )


def _bad_tweet(e: Column, t: Column) -> Column:
    return v.let(_unwrapped(e, _RESULT), lambda r: _bad_result(e, t, r))


def _bad_result(e: Column, t: Column, r: Column) -> Column:
    raw = v.field(r, "$.legacy.extended_entities.media")
    media = F.coalesce(_any(v.entries(r, "$.legacy.extended_entities.media"), lambda m: ~F.coalesce((v.any_text(m, "$.type") != "") & (v.any_text(m, "$.media_url_https") != ""), F.lit(False))), v.present(raw))
    quote = v.is_object(r, "$.quoted_status_result.result") & (~F.coalesce(_tweet_type(r, "$.quoted_status_result.result").isin("Tweet", "TweetTombstone"), F.lit(False)) | t["quoted"]["text"].isNull())
    whole = ~F.coalesce(_tweet_type(e, _RESULT) == "Tweet", F.lit(False)) | ~F.coalesce(t["tweet_id"].rlike(r"^\d+$"), F.lit(False)) | ~v.is_object(r, "$.legacy") | t["text"].isNull() | t["created_at"].isNull() | media | quote
    return ~v.is_object(e, "$.content.itemContent") | F.when(t["tombstone"], t["tweet_id"] == "").otherwise(whole)


def x_bookmarks(pages: DataFrame, body: str = "body") -> DataFrame:
    """``tweets`` (whole ones and tombstones), ``bottom_cursor`` and ``has_more`` of a bookmarks page."""
    timeline = "$.data.bookmark_timeline_v2.timeline"
    errors = v.entries(F.col("_v"), "$.errors")
    words = lambda e: F.lower(F.coalesce(F.try_variant_get(e, "$.message", "string"), F.lit("")))
    out = F.exists(errors, lambda e: F.coalesce(v.whole(e, "$.code").isin(*X_LOGIN), F.lit(False)) | words(e).contains("authenticate") | words(e).contains("logged out"))
    failed = F.coalesce(F.size(errors) > 0, F.lit(False))
    steps, all_entries = F.col("_got"), F.col("_all")
    adds = F.filter(steps, lambda i: v.any_text(i, "$.type") == "TimelineAddEntries")
    found = F.flatten(F.transform(adds, lambda i: F.coalesce(v.entries(i, "$.entries"), F.array().cast("array<variant>"))))
    kind = lambda e: v.any_text(e, "$.content.entryType")
    items = F.filter(all_entries, lambda e: kind(e) == "TimelineTimelineItem")
    bottoms = F.filter(all_entries, lambda e: (kind(e) == "TimelineTimelineCursor") & (v.any_text(e, "$.content.cursorType") == "Bottom"))
    odd = _any(all_entries, lambda e: ~F.coalesce(kind(e).isin("TimelineTimelineItem", "TimelineTimelineCursor"), F.lit(False)))
    rules = [
        (~v.is_object(F.col("_v")), PAGE_CHANGED), (failed & F.coalesce(out, F.lit(False)), LOGIN), (failed, PAGE_CHANGED), (steps.isNull(), PAGE_CHANGED),
        (_any(steps, lambda i: F.lit(False)) | F.exists(adds, lambda i: v.entries(i, "$.entries").isNull()), PAGE_CHANGED), (odd, PAGE_CHANGED),
        (F.exists(bottoms, lambda e: ~F.coalesce(v.any_text(e, "$.content.value") != "", F.lit(False))), PAGE_CHANGED), (_bad_entry(), PAGE_CHANGED),
    ]
    df = _decoded(pages, body).withColumn("_got", v.entries(F.col("_v"), timeline + ".instructions")).withColumn("_all", found)
    return _ruled(_read(df, items, _tweet, _bad_tweet), rules, tweets=_held(), bottom_cursor=v.any_text(F.try_element_at(bottoms, F.lit(-1)), "$.content.value"), has_more=F.size("_read") > 0)


def _zhihu_rules() -> list[tuple[Column, str]]:
    e = v.field(F.col("_v"), "$.error")
    message, name = (F.coalesce(F.try_variant_get(e, p, "string"), F.lit("")) for p in ("$.message", "$.name"))
    code = v.whole(e, "$.code")
    login = F.coalesce(code.isin(*ZHIHU_LOGIN), F.lit(False)) | message.contains("登录") | name.contains("Authentication")
    rate = F.coalesce(code.isin(*ZHIHU_RATE), F.lit(False)) | message.contains("频繁") | message.contains("异常")
    failed = v.is_object(e)
    return [(~v.is_object(F.col("_v")), PAGE_CHANGED), (failed & login, LOGIN), (failed & rate, RATE), (failed, PAGE_CHANGED), (v.entries(F.col("_v"), "$.data").isNull(), PAGE_CHANGED)]


def zhihu_collections(pages: DataFrame, body: str = "body") -> DataFrame:
    """``collections``: (scope_id, title, item_count, is_default)."""
    got = v.entries(F.col("_v"), "$.data")
    make = lambda e: F.struct(
        v.whole(e, "$.id").cast("string").alias("scope_id"), v.text(e, "$.title").alias("title"), F.coalesce(v.whole(e, "$.item_count"), F.lit(0).cast("long")).alias("item_count"),
        F.coalesce(v.flag(e, "$.is_default"), F.lit(False)).alias("is_default"),
    )
    return _ruled(_decoded(pages, body), [*_zhihu_rules(), (_any(got, lambda e: v.whole(e, "$.id").isNull() | v.text(e, "$.title").isNull()), PAGE_CHANGED)], collections=F.transform(got, make))


def _id_text(e: Column, path: str) -> Column:
    return F.nullif(F.trim(F.coalesce(v.whole(e, path).cast("string"), v.any_text(e, path))), F.lit(""))


def _favorite(e: Column) -> Column:
    """One wide struct for answers, articles and all other types; a degraded entry without an id is named by a hash."""
    return v.let(v.field(e, "$.content"), lambda c: v.let(F.coalesce(v.any_text(c, "$.type"), F.lit("")), lambda raw: _favorite_of(e, c, raw)))


def _favorite_of(e: Column, c: Column, raw: Column) -> Column:
    answer, article = raw == "answer", raw == "article"
    url, own = v.text(c, "$.url"), v.text(c, "$.title")
    digest = F.substring(F.sha2(F.concat_ws("|", raw, F.coalesce(url, F.lit("")), F.coalesce(own, F.lit(""))), 256), 1, 16)
    number = _id_text(c, "$.question.id")
    known = answer | article
    return F.struct(
        v.iso_instant(v.any_text(e, "$.created")).alias("favorited_at"), F.when(known, raw).otherwise("other").alias("kind"), F.when(raw == "", "unknown").otherwise(raw).alias("type_raw"),
        F.coalesce(_id_text(c, "$.id"), F.when(~known, digest)).alias("item_id"), F.when(answer, v.text(c, "$.question.title")).otherwise(own).alias("title"), url.alias("url"),
        F.when(known, F.coalesce(v.any_text(c, "$.content"), F.lit(""))).alias("html"), v.text(c, "$.excerpt").alias("excerpt"), F.when(answer & number.rlike(r"^\d+$"), number).alias("question_id"),
        v.text(c, "$.author.name").alias("author"), F.when(known, v.whole(c, "$.voteup_count")).alias("voteup_count"),
        v.bounded_instant(F.when(answer, v.whole(c, "$.created_time")).when(article, v.whole(c, "$.created"))).alias("created_at"),
        v.bounded_instant(F.when(answer, v.whole(c, "$.updated_time")).when(article, v.whole(c, "$.updated"))).alias("updated_at"),
        F.when(answer & (v.any_text(c, "$.attachment.type") == "VIDEO"), v.text(c, "$.attachment.video.title")).alias("video_title"), F.when(article, v.text(c, "$.image_url")).alias("image_url"),
    )


def _bad_favorite(e: Column, f: Column) -> Column:
    known = (f["kind"] != "other") & (f["title"].isNull() | f["item_id"].isNull() | ~F.coalesce(f["url"].startswith("http"), F.lit(False)))
    return f["favorited_at"].isNull() | ~v.is_object(e, "$.content") | known


def zhihu_items(pages: DataFrame, body: str = "body") -> DataFrame:
    """``favorites`` and ``is_end`` of an items page; ``paging.is_end`` is the only sign of the end, so it must be there."""
    end = v.flag(F.col("_v"), "$.paging.is_end")
    df = _read(_decoded(pages, body), v.entries(F.col("_v"), "$.data"), _favorite, _bad_favorite)
    return _ruled(df, [*_zhihu_rules(), (end.isNull(), PAGE_CHANGED), (_bad_entry(), PAGE_CHANGED)], favorites=_held(), is_end=end)


def github_starred(pages: DataFrame, body: str = "body") -> DataFrame:
    """``stars`` of a starred page; an error envelope is told by its message."""
    message = F.lower(F.coalesce(F.try_variant_get(F.col("_v"), "$.message", "string"), F.lit("")))
    envelope = v.is_object(F.col("_v"))
    got = v.entries(F.col("_v"))
    topics = lambda e: F.filter(F.transform(v.entries(e, "$.repo.topics"), lambda t: F.when(v.kind(t) == "STRING", F.try_variant_get(t, "$", "string"))), lambda t: t.isNotNull())
    star = lambda e: F.struct(
        v.iso_instant(v.any_text(e, "$.starred_at")).alias("starred_at"), v.text(e, "$.repo.full_name").alias("full_name"), v.text(e, "$.repo.html_url").alias("html_url"),
        F.coalesce(F.nullif(v.any_text(e, "$.repo.owner.login"), F.lit("")), F.split(v.text(e, "$.repo.full_name"), "/")[0]).alias("owner"), v.text(e, "$.repo.default_branch").alias("default_branch"),
        v.iso_instant(v.any_text(e, "$.repo.created_at")).alias("created_at"), v.text(e, "$.repo.description").alias("description"), v.text(e, "$.repo.language").alias("language"),
        F.coalesce(topics(e), F.array().cast("array<string>")).alias("topics"), v.iso_instant(v.any_text(e, "$.repo.pushed_at")).alias("pushed_at"), v.whole(e, "$.repo.stargazers_count").alias("stargazers_count"),
        F.coalesce(v.flag(e, "$.repo.archived"), F.lit(False)).alias("archived"), F.coalesce(v.flag(e, "$.repo.fork"), F.lit(False)).alias("fork"),
    )
    bad = lambda e: F.exists(F.array(*[star(e)[k].isNull() for k in ("starred_at", "full_name", "html_url", "default_branch", "created_at")]), lambda x: x)
    rules = [(envelope & message.contains("rate limit"), RATE), (envelope & message.contains("not found"), GONE), (got.isNull(), PAGE_CHANGED), (_any(got, bad), PAGE_CHANGED)]
    return _ruled(_decoded(pages, body), rules, stars=F.transform(got, star))
