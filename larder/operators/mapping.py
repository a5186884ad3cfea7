"""Observations of the platforms as captured items: one wide row per item, platform details as JSON text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import fields as f
from larder.functions.hashes import iso_utc
from larder.functions.markup import render_html
from larder.functions.text import title

ASSETS = "array<struct<relative_path:string,media_type:string,text:string,sha256:string>>"
README_BYTES = 256 * 1024


def _asset(path: Column, kind: str, text: Column) -> Column:
    return F.struct(path.alias("relative_path"), F.lit(kind).alias("media_type"), text.alias("text"), F.sha2(text, 256).alias("sha256"))


def _item(df: DataFrame, platform: str, observed: Column, version: str, **columns: Column) -> DataFrame:
    base = {"author": F.lit(None).cast("string"), "collections": F.array().cast("array<string>"), "assets": F.array().cast(ASSETS), "authoritative_asset_roots": F.array().cast("array<string>")}
    columns = base | {"platform": F.lit(platform), "observed_at": observed, "extractor_version": F.lit(version)} | columns
    order = ("platform", "source_id", "canonical_url", "title", "author", "published_at", "observed_at", "body", "collections", "extractor_version", "platform_metadata", "assets", "authoritative_asset_roots")
    return df.select(*[columns[c].alias(c) for c in order])


def _json(**fields: Column) -> Column:
    """JSON text without absent fields, by name."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def _some(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def github(stars: DataFrame, observed: Column, readme: Column | None = None, version: str = "github-1") -> DataFrame:
    """Items of stars (columns of a parsed star); ``readme`` is the README's text, if fetched."""
    readme = readme if readme is not None else F.lit(None).cast("string")
    long, there = F.octet_length(readme) > README_BYTES, ~f.blank(readme)
    kept = F.when(long, f.utf8_head(readme, README_BYTES)).otherwise(readme)
    body = F.concat_ws(
        "\n\n", f.strip(F.col("description")), F.when(F.size("topics") > 0, F.concat(F.lit("主题："), F.array_join("topics", " · "))), F.when(there, F.concat(F.lit("## README\n\n"), f.strip(kept))),
    )
    meta = _json(
        source_status=F.lit("available"), favorited_at=iso_utc(F.col("starred_at")), default_branch=F.col("default_branch"), archived=F.col("archived"), fork=F.col("fork"), language=F.col("language"),
        readme_status=F.when(~there, "missing").when(long, "truncated").otherwise("available"), topics=_some(F.col("topics")), stargazers_count=F.col("stargazers_count"), pushed_at=iso_utc(F.col("pushed_at")),
    )
    return _item(
        stars, "github", observed, version, source_id=F.replace(F.col("full_name"), F.lit("/"), F.lit("__")), canonical_url=F.col("html_url"), title=F.col("full_name"), author=F.col("owner"),
        published_at=F.col("created_at"), body=body, platform_metadata=meta,
    )


def x(tweets: DataFrame, observed: Column, described: Column | None = None, failed: Column | None = None, version: str = "x-1") -> DataFrame:
    """Items of tweets and tombstones; ``described`` holds a description or null for each medium, ``failed`` the positions (from 0) that were tried in vain."""
    gone = F.col("tombstone")
    given = described is not None
    described = described if given else F.array().cast("array<string>")
    failed = failed if failed is not None else F.array().cast("array<int>")
    media = F.coalesce("media", F.array().cast("array<struct<type:string,url:string,alt:string>>"))
    text, fallback = f.strip(F.col("text")), F.concat(F.lit("https://x.com/i/web/status/"), "tweet_id")
    q = F.col("quoted")
    by = F.when(q["handle"].isNotNull(), F.concat(F.coalesce(q["author"], F.lit("")), F.lit(" @"), q["handle"])).otherwise(F.coalesce(q["author"], F.lit("未知作者")))
    quote = F.when(q["unavailable"], F.lit("## 引用推文\n\n（引用的推文已不可见）")).when(q.isNotNull(), F.concat(F.lit("## 引用推文\n\n"), by, F.lit("：\n\n"), f.strip(q["text"])))
    lines = F.transform(media, lambda m, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), m["type"], F.lit(": "), F.coalesce(m["alt"], m["url"])))
    shown = F.when(F.size(media) > 0, F.concat(F.lit("## 媒体\n\n"), F.array_join(lines, "\n")))
    told = lambda i: F.nullif(f.strip(F.get(described, i)), F.lit(""))
    status = lambda m, i: F.when(told(i).isNotNull(), "available").when(F.array_contains(failed, i), "failed").when(m["type"] == "photo", "missing").otherwise("skipped")
    details = F.transform(media, lambda m, i: F.struct(m["alt"].alias("alt"), status(m, i).alias("ocr_status"), m["type"].alias("type"), m["url"].alias("url")))
    file = lambda i: _asset(F.format_string("ocr/%04d.md", i + 1), "text/markdown", F.concat(F.lit("# 图"), (i + 1).cast("string"), F.lit(" OCR/视觉描述\n\n"), told(i), F.lit("\n")))
    assets = F.filter(F.transform(media, lambda m, i: F.when(told(i).isNotNull(), file(i))), lambda a: a.isNotNull())
    meta = _json(
        source_status=F.when(gone, "source_unavailable").otherwise("available"), favorited_at=iso_utc(observed), favorited_at_estimated=F.lit(True), published_at_estimated=F.when(gone, True),
        tombstone_reason=F.when(gone, F.col("reason")), author_handle=F.col("handle"), media=_some(details), quoted_tweet_id=F.nullif(q["tweet_id"], F.lit("")),
    )
    named = F.coalesce(F.nullif(title(F.col("text")), F.lit("")), F.concat(F.lit("推文 "), "tweet_id"))
    return _item(
        tweets, "x", observed, version, source_id=F.col("tweet_id"), canonical_url=F.when(F.col("handle").isNotNull(), F.concat(F.lit("https://x.com/"), "handle", F.lit("/status/"), "tweet_id")).otherwise(fallback),
        title=F.when(gone, F.concat(F.lit("已失效推文 "), "tweet_id")).otherwise(named), author=F.col("author"), published_at=F.when(gone, observed).otherwise(F.col("created_at")),
        body=F.when(gone, F.lit("")).otherwise(F.concat_ws("\n\n", F.nullif(text, F.lit("")), quote, shown)), platform_metadata=meta, assets=F.when(gone, F.array().cast(ASSETS)).otherwise(assets),
        authoritative_asset_roots=F.when(F.lit(given) & ~gone, F.array(F.lit("ocr"))).otherwise(F.array().cast("array<string>")),
    )


def subtitle_section(language: Column, cues: Column) -> Column:
    lines = F.transform(cues, lambda c: F.concat(F.lit("["), f.clock(c["start"]), F.lit("] "), c["content"]))
    return F.concat(F.lit("## 字幕（"), language, F.lit("）\n"), F.array_join(lines, "\n"))


def transcript(language: Column, cues: Column) -> Column:
    lines = F.transform(cues, lambda c: F.concat(F.lit("["), f.clock_ms(c["start"]), F.lit(" --> "), f.clock_ms(c["end"]), F.lit("] "), c["content"]))
    return F.concat(F.lit("# Transcript（"), language, F.lit("）\n\n"), F.array_join(lines, "\n"), F.lit("\n"))


def favourites(entries: DataFrame, key: str, folder: str, fav: str, seq: str, entry: str) -> DataFrame:
    """One observation per item: sorted folders, earliest favourite, and the entry seen first (``seq``) with its place."""
    return entries.groupBy(key).agg(
        F.array_sort(F.collect_set(folder)).alias("collections"), F.min(fav).alias("favorited_at"), F.min_by(entry, seq).alias("entry"), F.min(seq).alias("first_seen"),
    )


def bilibili(seen: DataFrame, details: DataFrame, subtitles: DataFrame, observed: Column, version: str = "bilibili-1") -> DataFrame:
    """Items of observations (bvid, collections, favorited_at, entry).

    ``details`` is (bvid, code, video), ``subtitles`` (bvid, code, language, cues, raw, source, offered, asked): an error code instead of
    a result is kept as the item's status. Each has at most one row per bvid; both join on it from the left.
    """
    d, s = details.select("bvid", F.col("code").alias("d_code"), "video"), subtitles.select("bvid", F.col("code").alias("s_code"), "language", "cues", "raw", "source", "offered", "asked")
    df = seen.join(d, "bvid", "left").join(s, "bvid", "left")
    v, e = F.col("video"), F.col("entry")
    pick = lambda a, b: F.when(v.isNotNull(), v[a]).otherwise(e[b])
    has = F.col("cues").isNotNull()
    subtitle = F.when(has, subtitle_section(F.col("language"), F.col("cues")))
    script, raw = transcript(F.col("language"), F.col("cues")), F.col("raw")
    raw_path = F.concat(F.lit("assets/subtitles/"), f.language(F.col("language")), F.lit(".json"))
    assets = F.array_compact(F.array(F.when(has, _asset(F.lit("transcript/transcript.md"), "text/markdown", script)), F.when(has & raw.isNotNull(), _asset(raw_path, "application/json", raw))))
    status = F.when(has, "available").when(F.col("s_code").isNotNull(), F.col("s_code")).when(F.col("offered").isNotNull(), "wrong_video").otherwise("unavailable")
    meta = _json(
        source_status=F.when(v.isNotNull(), "available").otherwise(F.coalesce("d_code", F.lit("source_unavailable"))), subtitle_status=status, subtitle_source=F.when(has, F.col("source")), subtitle_offered=F.col("offered"),
        subtitle_asked=F.when(F.col("offered").isNotNull(), F.col("asked")), favorited_at=iso_utc(F.col("favorited_at")), cover_url=pick("cover_url", "cover_url"), author_mid=pick("author_mid", "author_mid"), duration=v["duration"],
    )
    return _item(
        df, "bilibili", observed, version, source_id=F.col("bvid"), canonical_url=F.concat(F.lit("https://www.bilibili.com/video/"), "bvid"), title=pick("title", "title"), author=pick("author", "author"),
        published_at=pick("published_at", "published_at"), body=F.concat_ws("\n\n", F.nullif(f.strip(pick("description", "intro")), F.lit("")), subtitle), collections=F.col("collections"), platform_metadata=meta, assets=assets,
        authoritative_asset_roots=F.array(F.lit("transcript"), F.lit("assets")),
    )


def zhihu_id() -> Column:
    known = F.col("kind").isin("answer", "article")
    return F.when(known, F.concat_ws("-", "kind", "item_id")).otherwise(F.concat_ws("-", f.component(F.col("type_raw")), f.component(F.col("item_id"))))


def zhihu(favorites: DataFrame, observed: Column, version: str = "zhihu-1") -> DataFrame:
    """Items of favourites (columns of a parsed favourite, and ``collections``): answers by their question, articles by their own title, others degrade to the excerpt."""
    known, answer = F.col("kind").isin("answer", "article"), F.col("kind") == "answer"
    r = F.col("_r")
    df = favorites.withColumn("_r", render_html(F.col("html")))
    video = F.when(answer & F.col("video_title").isNotNull(), F.concat(F.lit("## 视频\n\n"), "video_title"))
    body = F.concat_ws("\n\n", F.nullif(r["text"], F.lit("")), video)
    images = F.when(F.size(r["images"]) > 0, F.concat(F.lit("\n\n## 图片\n\n- "), F.array_join(r["images"], "\n- "))).otherwise(F.lit(""))
    own = F.concat_ws("/", F.lit("https://www.zhihu.com"), "type_raw", "item_id")
    meta = _json(
        favorited_at=iso_utc(F.col("favorited_at")), content_type_raw=F.col("type_raw"), video_title=F.when(answer, F.col("video_title")), voteup_count=F.col("voteup_count"), updated_at=iso_utc(F.col("updated_at")),
        question_id=F.col("question_id"), image_url=F.col("image_url"),
    )
    return _item(
        df, "zhihu", observed, version, source_id=zhihu_id(), canonical_url=F.when(known, F.col("url")).otherwise(F.coalesce("url", own)), title=F.when(known, F.col("title")).otherwise(F.coalesce("title", F.concat_ws(" ", "type_raw", "item_id"))),
        author=F.col("author"), published_at=F.when(known, F.coalesce("created_at", observed)).otherwise(observed), body=F.when(known, F.concat(body, images)).otherwise(F.coalesce("excerpt", F.lit(""))),
        collections=F.col("collections"), platform_metadata=meta,
    )


def markdown(enriched: bool = False) -> Column:
    """The Markdown file of an item: front matter, title, body and, for enriched items (summary, tags), a summary and a tag line."""
    from larder.functions.hashes import json_list, json_text

    front = [F.concat(F.lit(f"{c}: "), json_text(F.col(c))) for c in ("platform", "source_id", "canonical_url")]
    front += [F.concat(F.lit("author: "), json_text(F.coalesce(F.nullif("author", F.lit("")), F.lit("unknown")))), F.concat(F.lit("published_at: "), json_text(iso_utc(F.col("published_at"))))]
    front.append(F.concat(F.lit("collections: "), json_list(F.array_sort(F.array_distinct("collections")))))
    end = lambda c: F.rtrim(c, F.lit(f.BLANKS))
    page = F.concat(F.lit("---\n"), F.concat_ws("\n", *front), F.lit("\n---\n\n# "), "title", F.lit("\n\n"), end(F.col("body")), F.lit("\n"))
    if not enriched:
        return page
    more = F.concat(F.lit("\n## 摘要\n\n"), end(F.col("summary")), F.lit("\n\n标签："), F.array_join("tags", " · "), F.lit("\n"))
    return F.concat(page, F.coalesce(more, F.lit("")))


def unchanged(new: str = "new", old: str = "old") -> Column:
    """Whether a stored snapshot needs no write: same hash, folders, extractor and assets."""
    a, b = F.col(new), F.col(old)
    bag = lambda x: F.array_sort(F.array_distinct(x))
    asset = lambda x: F.array_sort(F.transform(x, lambda y: F.struct(y["relative_path"], y["sha256"])))
    same = a["content_hash"].eqNullSafe(b["content_hash"]) & bag(a["collections"]).eqNullSafe(bag(b["collections"])) & a["extractor_version"].eqNullSafe(b["extractor_version"])
    return F.coalesce(same & asset(a["assets"]).eqNullSafe(asset(b["assets"])), F.lit(False))
