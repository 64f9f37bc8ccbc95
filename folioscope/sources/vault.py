"""A vault of Markdown files with front matter as tables, and documents as such files again."""

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRONT = re.compile(r"\A---\r?\n(.*?)\r?\n---\r?\n?", re.S)
ARTICLE = "url string, title string, domain string, clipped_at string, excerpt string, author string, published_at string, unlisted boolean, lang string, title_zh string, summary string, category string, tags array<string>, processed_at string, problem string, body string"
_REQUIRED = ("url", "title", "domain", "clipped_at")


def parsed(text: str) -> dict:
    """A file's fields and body; problem says why it is none. Unknown fields are left out.

    The time of processing is in the one nested mapping that has it, whatever its name.
    """
    match = FRONT.match(text)
    if not match:
        return {"problem": "no front matter", "body": text}
    try:
        data = yaml.load(match[1], Loader=yaml.BaseLoader)
    except yaml.YAMLError as error:
        return {"problem": f"unreadable: {str(error).splitlines()[0]}", "body": text[match.end() :]}
    if not isinstance(data, dict):
        return {"problem": "no fields", "body": text[match.end() :]}
    missing = [k for k in _REQUIRED if not str(data.get(k) or "").strip()]
    extra = next((v for v in data.values() if isinstance(v, dict) and "processed_at" in v), {})
    tags = [str(t) for t in data["tags"]] if isinstance(data.get("tags"), list) else None
    text_of = lambda k: None if data.get(k) is None else str(data[k])
    return {k: text_of(k) for k in ("url", "title", "domain", "clipped_at", "excerpt", "author", "published_at", "lang", "title_zh", "summary", "category")} | {
        "unlisted": data.get("unlisted") == "true", "tags": tags, "processed_at": extra.get("processed_at"),
        "problem": f"missing {', '.join(missing)}" if missing else None, "body": text[match.end() :].lstrip("\n"),
    }


def read(spark: SparkSession, root: str, kind: str = "articles") -> DataFrame:
    """One row for each document directory that has an index.md, with its translation beside it; bad files have a problem."""
    files = spark.read.format("text").option("wholetext", True).load(f"{root}/{kind}/*/*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    named = files.select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("slug"), F.regexp_extract("path", r"/([^/]+)$", 1).alias("file"), "text")

    def parse(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in re.split(r", (?=\w+ )", ARTICLE)]
        for part in parts:
            rows = [parsed(t) for t in part["text"]]
            yield pd.DataFrame([{"slug": s} | {k: r.get(k) for k in names} for s, r in zip(part["slug"], rows)], columns=["slug", *names]).astype(object)

    main = named.where("file = 'index.md'").mapInPandas(parse, f"slug string, {ARTICLE}")
    return main.join(named.where("file = 'zh.md'").select("slug", F.col("text").alias("zh_body")), "slug", "left")


SITE = "url string, title string, domain string, clipped_at string, description string, preview string, note string, unlisted boolean, lang string, title_zh string, summary string, category string, tags array<string>, processed_at string, problem string, body string"
COLLECTION = "title string, description string, cover string, created_at string, updated_at string, items array<struct<slug:string,added_at:string,section:string>>, problem string, body string"
COLLECTION_ID = r"^[a-z0-9][a-z0-9-]{0,68}$"


def loosely(text: str | None) -> tuple[str, dict[str, str] | None]:
    """What a file's front matter is: none, unreadable, or ok with its plain fields as texts; nothing is required."""
    match = FRONT.match(text or "")
    if not match:
        return "none", None
    try:
        data = yaml.load(match[1], Loader=yaml.BaseLoader)
    except yaml.YAMLError:
        return "unreadable", None
    if not data:
        return "none", None
    return ("ok", {str(k): v for k, v in data.items() if isinstance(v, str)}) if isinstance(data, dict) else ("unreadable", None)


def _shelf(text: str) -> dict:
    """A collection's fields; items are in their order, those without a slug left out."""
    match = FRONT.match(text)
    kind, _ = loosely(text)
    if kind != "ok":
        return {"problem": "no front matter" if kind == "none" else "unreadable", "body": text}
    data = yaml.load(match[1], Loader=yaml.BaseLoader)
    listed = data.get("items") if isinstance(data.get("items"), list) else []
    items = [{k: i.get(k) for k in ("slug", "added_at", "section")} for i in (x if isinstance(x, dict) else {"slug": x} for x in listed) if isinstance(i.get("slug"), str) and i["slug"]]
    text_of = lambda k: data[k] if isinstance(data.get(k), str) and data[k] else None
    return {k: text_of(k) for k in ("title", "description", "cover", "created_at", "updated_at")} | {"items": items, "problem": None if text_of("title") else "missing title", "body": text[match.end() :].lstrip("\n")}


def _site(text: str) -> dict:
    found = parsed(text)
    match = FRONT.match(text)
    data = yaml.load(match[1], Loader=yaml.BaseLoader) if match and not (found["problem"] or "").startswith("unreadable") else {}
    more = data if isinstance(data, dict) else {}
    return found | {k: more[k] if isinstance(more.get(k), str) and more[k] else None for k in ("description", "preview", "note")}


def _table(files: DataFrame, key: str, schema: str, parse) -> DataFrame:
    names = [f.split()[0] for f in re.split(r", (?=\w+ )", schema)]

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [parse(t) for t in part["text"]]
            yield pd.DataFrame([{key: k} | {n: r.get(n) for n in names} for k, r in zip(part[key], rows)], columns=[key, *names]).astype(object)

    return files.select(key, "text").mapInPandas(run, f"{key} string, {schema}")


def _files(spark: SparkSession, pattern: str) -> DataFrame:
    files = spark.read.format("text").option("wholetext", True).load(pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def sites(spark: SparkSession, root: str) -> DataFrame:
    """One row for each saved site: sites/<slug>/index.md."""
    return _table(_files(spark, f"{root}/sites/*/index.md").withColumn("slug", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)), "slug", SITE, _site)


def collections(spark: SparkSession, root: str) -> DataFrame:
    """One row for each collection: collections/<id>.md; a file whose name is no id has that as its problem."""
    rows = _table(_files(spark, f"{root}/collections/*.md").withColumn("id", F.regexp_extract("path", r"/([^/]+)\.md$", 1)), "id", COLLECTION, _shelf)
    return rows.withColumn("problem", F.when(~F.col("id").rlike(COLLECTION_ID), "id").otherwise(F.col("problem")))


def items(shelves: DataFrame) -> DataFrame:
    """collection, pos, slug, added_at, section: a row for each member in its place."""
    return good(shelves).select(F.col("id").alias("collection"), F.posexplode("items").alias("pos", "i")).select("collection", "pos", "i.slug", "i.added_at", "i.section")


def loose(files: DataFrame) -> DataFrame:
    """path, kind and fields of files (path, text), valid or not."""

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [loosely(t) for t in part["text"]]
            yield pd.DataFrame({"path": part["path"], "kind": [k for k, _ in found], "fields": [f for _, f in found]})

    return files.select("path", "text").mapInPandas(run, "path string, kind string, fields map<string,string>")


def signatures(spark: SparkSession, root: str) -> DataFrame:
    """path, time and size of every file below root; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("modificationTime").alias("at"), F.col("length").alias("size"))


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """path and change (added, removed, changed) between two signatures: what must be read again."""
    a, b = (df.select("path", F.struct("at", "size").alias(name)) for df, name in ((before, "old"), (now, "new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")


def good(docs: DataFrame) -> DataFrame:
    return docs.where("problem IS NULL")


def rejects(docs: DataFrame) -> DataFrame:
    return docs.where("problem IS NOT NULL").select("slug", "problem")


def orphan_translations(spark: SparkSession, root: str, kind: str = "articles") -> DataFrame:
    files = spark.read.format("text").option("wholetext", True).load(f"{root}/{kind}/*/*.md").select(F.col("_metadata.file_path").alias("path"))
    named = files.select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("slug"), F.regexp_extract("path", r"/([^/]+)$", 1).alias("file"))
    return named.where("file = 'zh.md'").select("slug").join(named.where("file = 'index.md'").select("slug"), "slug", "left_anti")


def serialised(fields: dict, body: str) -> str:
    """A file with the fields that have a value, in their order, and one newline at its end."""
    lines = [f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in fields.items() if v is not None]
    return "---\n" + "\n".join(lines) + "\n---\n\n" + body.rstrip("\n") + "\n"


def rendered(docs: DataFrame, *fields: str) -> DataFrame:
    """slug and the file's text, written in the JVM: every value as JSON, which YAML reads."""
    lines = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}: "), F.to_json(F.array(f)).substr(F.lit(2), F.length(F.to_json(F.array(f))) - 2))) for f in fields]
    head = F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))
    return docs.select("slug", F.concat(head, F.lit("\n\n"), F.regexp_replace(F.coalesce("body", F.lit("")), "\n+$", ""), F.lit("\n")).alias("text"))


def write(docs: DataFrame, path: str, *fields: str) -> None:
    """Documents as text files in a folder for each slug."""
    rendered(docs, *fields).select(F.col("text").alias("value"), "slug").write.partitionBy("slug").text(path, lineSep="")
