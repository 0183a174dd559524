"""Scored articles: class, direction, word-list sentiment, severity; windows of them by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.news_classes import CLASSES, INTENSIFIERS, NEGATORS, QUIET, WEIGHTS
from barloom.functions.text import Lexicon, combined, first_match, lexicon_column, severity, severity_band

LEXICON = Lexicon(WEIGHTS, NEGATORS, INTENSIFIERS)


def classified(df: DataFrame, headline: str = "headline") -> DataFrame:
    """event_type, event_dir and prior severity, from a map of some tens of classes."""
    kinds = F.create_map(*[x for name, _, sign, prior in CLASSES for x in (F.lit(name), F.struct(F.lit(sign).alias("sign"), F.lit(prior).alias("prior")))])
    out = df.withColumn("event_type", first_match(headline, [(c[0], c[1]) for c in CLASSES], "OTHER"))
    found = F.element_at(kinds, F.col("event_type"))
    return out.withColumn("event_dir", F.coalesce(found["sign"], F.lit(0))).withColumn("prior", F.coalesce(found["prior"], F.lit(0.8)))


def scored(df: DataFrame, headline: str = "headline", summary: str | None = "summary", burst: str | None = None) -> DataFrame:
    """All columns of an article's score."""
    text = F.concat(F.coalesce(F.col(headline), F.lit("")), F.lit(". "), F.coalesce(F.col(summary), F.lit("")) if summary else F.lit(""))
    out = classified(df, headline).withColumn("__lex", lexicon_column(LEXICON, text))
    quiet = F.col("event_type").isin(*sorted(QUIET))
    level = severity(F.col("prior"), F.col(burst) if burst else F.lit(0.0), F.coalesce(F.col("n_symbols"), F.lit(1)) if "n_symbols" in df.columns else F.lit(1), quiet)
    out = out.withColumn("lm_score", F.col("__lex.score")).withColumn("lm_pos", F.col("__lex.n_pos")).withColumn("lm_neg", F.col("__lex.n_neg")).withColumn("severity", level)
    return out.withColumn("severity_band", severity_band(F.col("severity"))).withColumn("is_company", ~quiet).withColumn("combined", combined(F.col("event_dir"), F.col("lm_score"))).drop("__lex")


def by_symbol(df: DataFrame, symbols: str = "symbols") -> DataFrame:
    """One row an article and name; the list may be an array or comma-joined text."""
    listed = F.col(symbols) if df.schema[symbols].dataType.typeName() == "array" else F.split(symbols, ",")
    return df.withColumn("ticker", F.explode(F.filter(F.transform(listed, F.trim), lambda s: s != ""))).withColumn("n_symbols", F.size(listed))
