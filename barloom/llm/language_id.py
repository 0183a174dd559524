"""Language by hyperdimensional profiles.

Every letter has a random vector of signs. An n-gram's vector binds its letters' vectors, each permuted by its place; a
text's vector bundles (adds) those of its n-grams; a language's prototype bundles its texts' unit vectors. A text goes to
the prototype with the largest cosine.

The model is fitted on at most about `fit_rows` labelled rows of each language, chosen by a hash of doc_id (a documented
bound: it fixes the cost of fitting, not what is predicted), so that a rare language is learned from a large table too.
Every row of the table is predicted from its whole text alone, however long; its vector is bundled from distinct n-grams.

A letter is what Unicode calls one, in lower case; each has a code of its own in a to z, and one of some 2,000 otherwise,
so that letters of other scripts seldom share one. Combining marks are no letters; they end a run as spaces do. Null texts and texts without a letter are `und` at score 0. Ties go to the language that sorts first. Labels that are null
teach nothing; without any labelled text all rows are `und`. Repeated rows get equal answers. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_table

DIMENSIONS, GRAM, CODES = 1024, 3, 2048


def alphabet() -> np.ndarray:
    """Code of each character below 0x10000: 0 for what is no letter, 1 to 26 for a to z, else a class by hash."""
    codes = np.zeros(0x10000, np.uint16)
    for c in range(0x10000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()[0]
            codes[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) * 2654435761 >> 7) % (CODES - 27)
    return codes


class Profiles:
    """Encodes texts as vectors."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.codes = alphabet()
        letters = np.where(np.random.default_rng(61).random((CODES, dimensions)) < 0.5, -1, 1).astype(np.int8)
        self.placed = [np.roll(letters, GRAM - 1 - i, axis=1) for i in range(GRAM)]
        self.dimensions = dimensions

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of letters, a run of other characters counting as one border, and their counts."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.codes[np.minimum(points, 0xFFFF)].astype(np.int64)
        wide = np.flatnonzero(points > 0xFFFF)
        if len(wide):
            codes[wide] = [27 + p % (CODES - 27) if chr(p).isalpha() else 0 for p in points[wide].tolist()]
        if not codes.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = np.r_[0, codes, 0]
        codes = codes[(codes > 0) | np.r_[True, codes[:-1] > 0]]
        if len(codes) < GRAM:
            codes = np.r_[codes, np.zeros(GRAM - len(codes), np.int64)]
        gram = (codes[:-2] * CODES + codes[1:-1]) * CODES + codes[2:]
        return np.unique(gram, return_counts=True)

    def vector(self, text: str) -> np.ndarray | None:
        """The unit vector of a text; None without a letter."""
        gram, counts = self.grams(text)
        if not len(gram):
            return None
        total = np.zeros(self.dimensions, np.float32)
        for at in range(0, len(gram), 512):  # what is bound at a time stays in the processor's cache
            g = gram[at : at + 512]
            bound = self.placed[0][g // CODES**2] * self.placed[1][g // CODES % CODES] * self.placed[2][g % CODES]
            total += counts[at : at + 512].astype(np.float32) @ bound.astype(np.float32)
        size = np.linalg.norm(total)
        return total / size if size else total


_profiles: list[Profiles] = []


def profiles() -> Profiles:
    if not _profiles:
        _profiles.append(Profiles())
    return _profiles[0]


def fit(labelled: DataFrame, fit_rows: int = 5_000) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from (doc_id, text, lang). What comes to the driver is one vector a language."""
    known = labelled.where("text is not null and lang is not null")
    # Rows are drawn by id and text, so that rows without an id, or under one, are drawn apart; a language's least draw is
    # always in, so that each is learned. One row a language comes back, as the prototypes do.
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 20))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(drawn).alias("least")).collect()
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(r["least"], int(min(1.0, fit_rows / r["n"]) * (1 << 20))))]) if counts else F.create_map().cast("map<string,bigint>")
    chosen = known.where(drawn <= F.element_at(share, F.col("lang")))

    def bundle(stream):
        sums: dict[str, np.ndarray] = {}
        for batch in stream:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                v = profiles().vector(text.as_py())
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + np.round(v.astype(np.float64) * (1 << 30)).astype(np.int64)  # whole numbers: any order of adding gives one sum
        names = [k for k in sums for _ in range(DIMENSIONS)]
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(list(range(DIMENSIONS)) * len(sums), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sums.values()]))], names=["lang", "at", "value"])

    sums = chosen.select("text", "lang").mapInArrow(bundle, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value")).collect()
    out: dict[str, np.ndarray] = {}
    for lang, at, value in sums:
        out.setdefault(lang, np.zeros(DIMENSIONS))[at] = value
    return {k: (out[k] / (np.linalg.norm(out[k]) or 1)).astype(np.float32) for k in sorted(out)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, lang_pred, score (the cosine, 0 if negative), and the carried columns as `rest`."""
    names = list(prototypes)
    matrix = np.stack([prototypes[k] for k in names]) if names else np.zeros((0, DIMENSIONS), np.float32)
    rows = text_table(docs, id_col, text_col, carry)

    def run(stream):
        coder = profiles()
        for batch in stream:
            lang, score = [], []
            for text in batch.column(1):
                v = coder.vector(text.as_py()) if text.is_valid and names else None
                if v is None:
                    lang.append("und")
                    score.append(0.0)
                    continue
                near = matrix @ v
                best = int(near.argmax())
                lang.append(names[best])
                score.append(float(min(1.0, max(0.0, near[best]))))
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), *[batch.column(i) for i in ([1, 2] if carry else [])]], names=["doc_id", "lang_pred", "score", *(["text", "rest"] if carry else [])])

    kinds = "doc_id long, lang_pred string, score double"
    if carry:
        from pyspark.sql.types import StringType

        schema = docs.sparkSession.createDataFrame([], kinds).schema.add("text", StringType()).add("rest", rows.schema["rest"].dataType)
        return rows.mapInArrow(run, schema)
    return rows.mapInArrow(run, kinds)


def held_out() -> Column:
    """Rows that teach nothing: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prototypes = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
