"""Secrets in text, judged by who holds them: DataFrame functions only.

Spans come from the pieces between and the strings of each pattern's matches. Every candidate value is hashed; over the
corpus, its distinct owners and its distinct repositories (a repository belongs to one owner) are counted, distinct
triples first, so that a value copied a million times adds one row per owner and repository.

The verdict reads both counts. A value is an `example` if `wide` owners hold it, or `2 * wide` repositories, be they all
of one owner. It is `live` if it looks random and stays with its owner: one owner, in `narrow` repositories at most.
What lies between stays a plain candidate. Random-looking: letters and digits, `least_letters` different characters, and
no placeholder word or long run of one character.

Nulls and empty texts have no spans. Long texts are searched whole; a row holds its spans. Repeated rows give the same
spans; they share an owner and a repository, so they add nothing to the counts. A null owner or repository counts as one
unknown. Ties of start go by kind, as listed. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import durable, row_key

#: Kind, a cheap test, the pattern, the group that holds the value, the least length of the value.
#: For access and hex, a longer least run in the pattern itself gives the same matches as dropping short ones.
KINDS = [
    ("assign", None, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", None, r"[0-9a-f]{16,}", 0, 16),
]
ORDER = {kind: i for i, kind in enumerate([k[0] for k in KINDS] + ["live", "example"])}
FOUND = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def matches(rank: int, kind: str, group: int, least: int) -> Column:
    """Spans of one kind from the columns <kind>_all, <kind>_value and <kind>_between."""
    step = F.transform(F.col(f"{kind}_all"), lambda m, i: F.struct(F.length(F.get(f"{kind}_between", i)).alias("skip"), F.length(m).alias("size"), F.get(f"{kind}_value", i).alias("value")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["skip"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    return F.aggregate(step, empty, add, lambda s: s["out"])


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_cols: list[str], repo_cols: list[str]) -> DataFrame:
    """(row_key, doc_id, owner, repo, found) with the spans of all kinds."""
    name = lambda cols: F.concat_ws("/", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("?")) for c in cols]) if cols else F.lit("?")
    rows = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), name(owner_cols).alias("owner"), name(repo_cols).alias("repo"))
    parts = {}
    for kind, word, pattern, group, _ in KINDS:
        has = F.col("text").contains(word) if word else F.col("text").rlike(pattern)
        parts |= {f"{kind}_{what}": F.when(has, made).otherwise(F.array().cast("array<string>")) for what, made in (("all", F.regexp_extract_all("text", F.lit(pattern), F.lit(0))), ("value", F.regexp_extract_all("text", F.lit(pattern), F.lit(group))), ("between", F.split("text", pattern, -1)))}
    rows = rows.withColumns(parts)
    found = F.concat(*[matches(i, kind, group, least) for i, (kind, _, _, group, least) in enumerate(KINDS)])
    return rows.select("row_key", "doc_id", "owner", "repo", F.array_sort(found).alias("found"))


def scan(docs: DataFrame, wide: int = 5, narrow: int = 2, least_letters: int = 8, id_col: str = "doc_id", text_col: str = "text", owner_cols: list[str] | None = None, repo_cols: list[str] | None = None) -> DataFrame:
    """Per row: row_key, doc_id, found (base spans, sorted) and judged (spans of kind live or example, with the numbers of
    owners and repositories).

    owner_cols and repo_cols name the columns that tell owner and repository; by default source, and source with lang,
    as far as the table has them."""
    owner_cols = [c for c in ("source",) if c in docs.columns] if owner_cols is None else owner_cols
    repo_cols = [c for c in ("source", "lang") if c in docs.columns] if repo_cols is None else repo_cols
    base = durable(candidates(docs, id_col, text_col, owner_cols, repo_cols))
    each = base.where(F.size("found") > 0).dropDuplicates(["row_key", "owner", "repo"]).select("row_key", "owner", "repo", F.explode("found").alias("x")).withColumn("secret", F.unhex(F.md5(F.col("x.value").cast("binary"))))
    held = each.select("secret", "owner", "repo").distinct().groupBy("secret", "owner").agg(F.count("*").alias("repos")).groupBy("secret").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    value = F.col("x.value")
    random = (F.size(F.array_distinct(F.split(value, ""))) >= least_letters) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(r"(?i)example|changeme|placeholder|(.)\1{5}")
    verdict = F.when((F.col("owners") >= wide) | (F.col("repos") >= 2 * wide), "example").when((F.col("owners") == 1) & (F.col("repos") <= narrow) & random, "live")
    judged = each.join(held, "secret").withColumn("verdict", verdict).where("verdict is not null")
    rank = F.when(F.col("verdict") == "live", ORDER["live"]).otherwise(ORDER["example"])
    span = F.struct(F.col("x.start").alias("start"), rank.alias("rank"), F.col("verdict").alias("kind"), F.col("x.end").alias("end"), value.alias("value"), "owners", "repos")
    # A row's spans are few and its key is its own: the groups are bounded by a text's length.
    by_row = judged.select("row_key", span.alias("span")).distinct().groupBy("row_key").agg(F.array_sort(F.collect_list("span")).alias("judged"))
    empty = F.array().cast(FOUND.replace("value:string", "value:string,owners:bigint,repos:bigint"))
    return base.select("row_key", "doc_id", "found").join(by_row, "row_key", "left").withColumn("judged", F.coalesce("judged", empty))


def joined(spans: str | Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, mark: str = "[REDACTED]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every candidate but the widely copied examples replaced by mark; all rows and columns stay."""
    shown = F.transform(F.filter("judged", lambda x: x["kind"] == "example"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    marked = scan(docs, id_col=id_col, text_col=text_col).withColumn("open", shown)
    hide = F.filter("found", lambda x: ~F.array_contains(F.col("open"), F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    spans = marked.where(F.size("found") > 0).select("row_key", hide.alias("hide")).where(F.size("hide") > 0).dropDuplicates(["row_key"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(id_col, text_col).alias("row_key"))
    text = F.col("row").getField(text_col)

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        out = F.when(fresh, F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("hide", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    changed = F.when(F.col("hide").isNull(), text).otherwise(done)
    return rows.join(spans, "row_key", "left").select(*[(changed if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Base spans, their digest, and all spans with the verdicts."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    judged = F.transform("judged", lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "kind", "end", "value")]))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("found").cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat(F.col("found"), judged))).alias("spans"))
