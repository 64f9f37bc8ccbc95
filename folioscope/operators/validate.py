"""Integrity of a vault as rows of (rule, subject): a union of predicates and anti-joins."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import tags


def violations(articles: DataFrame, items: DataFrame, translations: DataFrame) -> DataFrame:
    """Rules over articles (slug, url, title, tags), collection items (collection, slug) and translations (slug)."""
    def of(rule: str, rows: DataFrame, subject: str) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))

    checks = [
        of("title-empty", articles.where(F.coalesce(F.trim("title"), F.lit("")) == ""), "slug"),
        of("url-invalid", articles.where(~F.coalesce(F.col("url"), F.lit("")).rlike(r"^(?:https?://[^/\s]+|local:.)")), "slug"),
        of("url-twice", articles.groupBy("url").agg(F.count("*").alias("n"), F.min("slug").alias("slug")).where("n > 1"), "slug"),
        of("tags-form", articles.where(F.size(tags.form_problems(F.col("tags"))) > 0), "slug"),
        of("member-dangling", items.join(articles.select("slug"), "slug", "left_anti"), "slug"),
        of("member-twice", items.groupBy("collection", "slug").agg(F.count("*").alias("n")).where("n > 1"), "slug"),
        of("translation-orphan", translations.join(articles.select("slug"), "slug", "left_anti"), "slug"),
    ]
    return reduce(DataFrame.unionByName, checks)


def translation_problems(articles: DataFrame) -> DataFrame:
    """Articles (slug, lang, processed, failed, blocks, zh_blocks) whose translation should not be there, or should, or doesn't fit.

    blocks and zh_blocks are arrays of blocks; zh_blocks is null where there is no translation.
    """
    from folioscope.functions import markdown

    there, done, failed = F.col("zh_blocks").isNotNull(), F.coalesce("processed", F.lit(False)), F.coalesce("failed", F.lit(False))
    chinese = F.coalesce(F.col("lang") == "zh", F.lit(False))
    problem = (
        F.when(~there & done & ~chinese & ~failed, "missing")
        .when(there & chinese, "of a Chinese article")
        .when(there & failed, "marked as failed")
        .when(there & done & (F.size(markdown.alignment_errors(F.col("blocks"), F.col("zh_blocks"))) > 0), "not aligned")
    )
    return articles.select("slug", problem.alias("problem")).where("problem IS NOT NULL")


def moved_slugs(articles: DataFrame) -> DataFrame:
    """Articles whose slug is not the one that their URL gives."""
    from folioscope.functions import urls

    return articles.select("slug", urls.slug(F.col("url")).alias("expected")).where(~F.col("slug").eqNullSafe(F.col("expected")))


def collection_problems(collections: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """The first rule that a collection (id, title, cover_slug) breaks: its id, title, members or cover; docs have slug and unlisted."""
    twice = items.groupBy("collection", "slug").count().where("count > 1").select(F.col("collection").alias("id"), F.lit(True).alias("twice")).distinct()
    dangling = items.join(docs.select("slug"), "slug", "left_anti").select(F.col("collection").alias("id"), F.lit(True).alias("dangling")).distinct()
    cover = docs.select(F.col("slug").alias("cover_slug"), F.coalesce("unlisted", F.lit(False)).alias("hidden"))
    joined = collections.join(twice, "id", "left").join(dangling, "id", "left").join(cover, "cover_slug", "left")
    problem = (
        F.when(~F.col("id").rlike("^[a-z0-9][a-z0-9-]{0,68}$"), "id")
        .when(F.coalesce(F.trim("title"), F.lit("")) == "", "title")
        .when(F.col("twice"), "member twice")
        .when(F.col("dangling"), "member dangling")
        .when(F.col("cover_slug").isNotNull() & F.col("hidden").isNull(), "cover dangling")
        .when(F.col("hidden"), "cover unlisted")
    )
    return joined.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def alias_problems(aliases: DataFrame) -> DataFrame:
    """What is unsound in a table of aliases (tag, target; a null target drops the tag): key and problem, one row for each.

    twice: a key with two targets; itself: a target with the alias's own key; chain: a target that is an alias too;
    spelling: targets with one key that are written in two ways.
    """
    rows = aliases.select("tag", "target", tags.key(F.col("tag")).alias("key"), tags.key(F.col("target")).alias("goal"))
    per_key = rows.groupBy("key").agg(F.count_distinct(F.coalesce("target", F.lit(""))).alias("n")).where("n > 1")
    leads_on = rows.where("goal <> key").join(rows.select(F.col("key").alias("goal")).distinct(), "goal", "left_semi")
    spelled = rows.where("goal IS NOT NULL").groupBy("goal").agg(F.count_distinct("target").alias("n")).where("n > 1")
    of = lambda df, key, problem: df.select(F.col(key).alias("key"), F.lit(problem).alias("problem")).distinct()
    return reduce(DataFrame.unionByName, [of(per_key, "key", "twice"), of(rows.where("goal = key"), "key", "itself"), of(leads_on, "key", "chain"), of(spelled, "goal", "spelling")])


def site_problems(sites: DataFrame, files: DataFrame, most_bytes: int) -> DataFrame:
    """Rules over saved sites (slug, url, title, preview) and the files there are (slug, file, size): rule and slug."""
    of = lambda rule, rows: rows.select(F.lit(rule).alias("rule"), "slug")
    shown = sites.where("preview IS NOT NULL").select("slug", F.regexp_replace("preview", r"^\./", "").alias("file"))
    there = shown.join(files, ["slug", "file"])
    checks = [
        of("title-empty", sites.where(F.coalesce(F.trim("title"), F.lit("")) == "")),
        of("url-invalid", sites.where(~F.coalesce(F.col("url"), F.lit("")).rlike(r"^https?://[^/\s]+"))),
        of("preview-name", shown.where(~F.col("file").rlike(r"^assets/[0-9a-f]{12}\.webp$"))),
        of("preview-missing", shown.join(files, ["slug", "file"], "left_anti")),
        of("preview-size", there.where((F.col("size") == 0) | (F.col("size") > most_bytes))),
        of("translation", files.where("file = 'zh.md'").join(sites.select("slug"), "slug", "left_semi")),
    ]
    return reduce(DataFrame.unionByName, checks)


def messages(problems: DataFrame, subject: str, problem: str) -> DataFrame:
    """One row for each subject, its problems in order joined by `; `."""
    return problems.groupBy(subject).agg(F.array_join(F.array_sort(F.collect_set(problem)), "; ").alias("message"))
