"""Document quality by labelling lines: a linear-chain conditional random field over lines, decoded by Viterbi.

Every line with a word has a few binary features of its own text (length, case, symbols, repetition, ending, an equal line
before it). The field has a weight a feature, and weights for a label's start and for one label after another.

Only documents have labels, so the lines' labels are latent: a good document holds content in at least `most` of its
words, a poor one boilerplate. The field is fitted by turns: each chain gets the best path that meets this (a common
bonus on one label is raised until it does), then the field is fitted to these paths. The first paths come from how often
a feature stands in good and in poor documents. So a plain line of a poor document can be content, and a licence line of
a good one boilerplate. At most `fit_rows` labelled documents of each class teach (a documented bound).

The decoded path marks each line as content or boilerplate, and the share of words in content lines decides.

Null and empty texts have no words and fail the base rules. A text of one line is a chain of one; long texts are decoded
whole. At a tie a line is content, and a share equal to the threshold keeps. Without labels of both classes no line can
be told apart, and the base rules alone decide. Repeated rows get equal answers. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import U64, mix64, slices, stretches, text_table
from barloom.llm.textnum import covered, windows, words

SYMBOLS = re.compile(r"[#*$%&|<>]")
ODD = re.compile(r"[^\w\s.,;:!?'\"()\-]")
ENDING = re.compile(r"[.!?:;\"')]\s*$")
LOUD = re.compile(r"!!|\?\?|\.\.\.\.")
PAGE = re.compile(r"https?:|www\.|@\w|©|\brights reserved\b|\bcookies?\b|\bsubscribe\b|\blog ?in\b|\bclick\b|\blicen[cs]e\b", re.IGNORECASE)
BULLET = re.compile(r"\s*(?:[-*•|#>]|\d+[.)]\s)")
#: Names of the features, in the order of their numbers.
FEATURES = ["any", "words<3", "words<8", "words>=8", "words>=25", "no ending", "loud", "upper>1/2", "digits>1/5", "odd>1/50", "odd>1/10", "distinct<1/3", "distinct<2/3", "same word thrice", "seen before", "page word", "bullet", "short words", "long words", "symbol words>1/3"]
NUMBER = {name: i for i, name in enumerate(FEATURES)}


def line_features(line: str, seen: bool) -> list[int]:
    own = line.split()
    n, size = len(own), max(1, len(line.strip()))
    found = ["any", "words<3" if n < 3 else "words<8" if n < 8 else "words>=8"]
    odd = len(ODD.findall(line))
    distinct = len(set(own)) / max(1, n)
    tests = {
        "words>=25": n >= 25,
        "no ending": not ENDING.search(line),
        "loud": LOUD.search(line),
        "upper>1/2": line.upper() == line and line.lower() != line,
        "digits>1/5": sum(c.isdigit() for c in line) > size / 5,
        "odd>1/50": odd > size / 50,
        "odd>1/10": odd > size / 10,
        "distinct<1/3": n >= 6 and distinct < 1 / 3,
        "distinct<2/3": n >= 6 and distinct < 2 / 3,
        "same word thrice": any(a == b == c for a, b, c in zip(own, own[1:], own[2:])),
        "seen before": seen,
        "page word": PAGE.search(line),
        "bullet": BULLET.match(line),
        "short words": size < 3 * n,
        "long words": size > 14 * max(1, n),
        "symbol words>1/3": odd * 3 > n,
    }
    return [NUMBER[x] for x in found] + [NUMBER[k] for k, v in tests.items() if v]


def chain(text: str) -> tuple[list[list[int]], list[int], int]:
    """Features and word counts of the lines with a word, and how many of those equal an earlier line."""
    features, counts, seen, repeated = [], [], set(), 0
    for line in text.split("\n"):
        own = len(line.encode().split())
        if own:
            again = line in seen
            repeated += again
            seen.add(line)
            features.append(line_features(line, again))
            counts.append(own)
    return features, counts, repeated


class Field:
    """The fitted field: score of content over boilerplate a feature, starts and transitions (0 boilerplate, 1 content)."""

    def __init__(self, weight: np.ndarray, start: np.ndarray, step: np.ndarray):
        self.weight, self.start, self.step = weight.tolist(), start.tolist(), step.tolist()

    def path(self, features: list[list[int]], bonus: float = 0.0) -> list[int]:
        """The most probable labels; at a tie, content. bonus is added to each content line's score."""
        weight, ((s00, s01), (s10, s11)) = self.weight, self.step
        low, high, back = self.start[0], self.start[1], []
        for i, f in enumerate(features):
            if i:
                to_low = (low + s00, 0) if low + s00 > high + s10 else (high + s10, 1)
                to_high = (low + s01, 0) if low + s01 > high + s11 else (high + s11, 1)
                back.append((to_low[1], to_high[1]))
                low, high = to_low[0], to_high[0]
            high += sum([weight[k] for k in f]) + bonus
        label = int(high >= low) if features else 1
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1] if features else []


def fit_field(chains: list[list[list[int]]], paths: list[list[int]], classes: list[int], rounds: int = 60, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood of the paths by Adam on whole-batch gradients, forward and backward over all chains at once;
    classes of chains weigh alike."""
    order = np.argsort([-len(c) for c in chains], kind="stable")
    chains, paths, group = [chains[i] for i in order], [paths[i] for i in order], np.array([classes[i] for i in order])
    size = np.array([len(c) for c in chains])
    share = np.where(group == 1, 0.5 / max(1, (group == 1).sum()), 0.5 / max(1, (group == 0).sum())) / np.maximum(size, 1)
    steps = int(size.max())
    active = [int((size > t).sum()) for t in range(steps)]  # chains are sorted by length
    first = np.cumsum([0, *active[:-1]])
    matrix, y = np.zeros((int(size.sum()), len(FEATURES))), np.zeros(int(size.sum()), int)
    for t in range(steps):
        for i in range(active[t]):
            matrix[first[t] + i, chains[i][t]] = 1
            y[first[t] + i] = paths[i][t]
    seen = np.zeros((2, 2))
    for t in range(1, steps):
        n = active[t]
        np.add.at(seen, (y[first[t - 1] : first[t - 1] + n], y[first[t] : first[t] + n]), share[:n])
    begins = np.stack([y[: active[0]] == 0, y[: active[0]] == 1], axis=1)
    chain_of = np.concatenate([np.arange(n) for n in active])
    parameters = np.zeros(len(FEATURES) + 6)
    mean, square = np.zeros_like(parameters), np.zeros_like(parameters)
    for turn in range(1, rounds + 1):
        weight, start, step = parameters[:-6], parameters[-6:-4], parameters[-4:].reshape(2, 2)
        score = np.zeros((len(matrix), 2))
        score[:, 1] = matrix @ weight
        ahead = np.zeros((len(matrix), 2))
        ahead[: active[0]] = start + score[: active[0]]
        for t in range(1, steps):
            before = ahead[first[t - 1] : first[t - 1] + active[t]]
            ahead[first[t] : first[t] + active[t]] = np.logaddexp(before[:, :1] + step[0], before[:, 1:] + step[1]) + score[first[t] : first[t] + active[t]]
        behind, pairs = np.zeros((len(matrix), 2)), np.zeros((2, 2))
        last = ahead[first[size - 1] + np.arange(len(size))]
        total = np.logaddexp(last[:, 0], last[:, 1])
        for t in range(steps - 2, -1, -1):
            n = active[t + 1]
            after = (score + behind)[first[t + 1] : first[t + 1] + n]
            behind[first[t] : first[t] + n] = np.logaddexp(step[:, 0] + after[:, :1], step[:, 1] + after[:, 1:])
            joint = np.exp(ahead[first[t] : first[t] + n, :, None] + step + after[:, None, :] - total[:n, None, None]) * share[:n, None, None]
            pairs += joint.sum(axis=0)
        chance = np.exp(ahead + behind - total[chain_of, None])
        gap = (y - chance[:, 1]) * share[chain_of]
        begin = (begins - chance[: active[0]]) * share[:, None]
        gradient = np.r_[matrix.T @ gap, begin.sum(axis=0), (seen - pairs).ravel()] - decay * parameters
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        parameters = parameters + rate * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-9)
    return Field(parameters[:-6], parameters[-6:-4], parameters[-4:].reshape(2, 2))


def impute(field: Field, chains: list[list[list[int]]], counts: list[list[int]], classes: list[int], most: float) -> list[list[int]]:
    """Each chain's best path with at least `most` of its words in lines of its class, by the least bonus tried."""
    out = []
    for features, words_in, good in zip(chains, counts, classes, strict=True):
        total, bonus = sum(words_in), 0.0
        while True:
            path = field.path(features, bonus if good else -bonus)
            if bonus > 64 or sum(n for n, x in zip(words_in, path, strict=True) if x == good) >= most * total:
                break
            bonus = bonus * 1.5 or 0.25
        out.append(path)
    return out


def fit_latent(chains: list[list[list[int]]], counts: list[list[int]], classes: list[int], most: float = 2 / 3, turns: int = 3) -> Field:
    """The field of chains whose lines have no labels: paths and field by turns."""
    held = np.ones((2, len(FEATURES)))
    for features, good in zip(chains, classes, strict=True):
        for f in features:
            held[good, f] += 1
    share = held / (held[:, :1] + 1)
    weight = np.log(share[1] / share[0])
    weight[0] = 0  # the feature of every line
    field = Field(weight, np.zeros(2), np.zeros((2, 2)))
    for _ in range(turns):
        field = fit_field(chains, impute(field, chains, counts, classes, most), classes)
    return field


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 800) -> Field | None:
    """The field of labelled documents: (doc_id, text) and (doc_id, quality). At most fit_rows documents a class, by hash."""
    chosen = None
    for k in (0, 1):
        part = labels.where(F.col("quality") == k).select("doc_id", "quality").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(fit_rows)
        chosen = part if chosen is None else chosen.unionByName(part)

    def features(stream):
        for batch in stream:
            for text, quality in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, counts, _ = chain(text or "")
                if found:
                    yield pa.record_batch([pa.array([found], pa.list_(pa.list_(pa.int32()))), pa.array([counts], pa.list_(pa.int32())), pa.array([quality], pa.int32())], names=["lines", "words", "quality"])

    # The sample is bounded by fit_rows rows a class, so it can be broadcast.
    # Of the texts under one labelled id, the first in order stands for all.
    held = text_table(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = held.select("text", F.col("quality").cast("int")).mapInArrow(features, "lines array<array<int>>, words array<int>, quality int").collect()
    rows = sorted((r[2], r[0], r[1]) for r in rows)
    if {r[0] for r in rows} != {0, 1}:
        return None
    return fit_latent([r[1] for r in rows], [r[2] for r in rows], [r[0] for r in rows])


def rate(docs: DataFrame, field: Field | None, content_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share (of words
    in content lines), line_labels (of lines with a word) and kept."""
    names = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, line_labels array<int>, kept boolean"

    def run(stream):
        for batch in (part for whole in stream for part in slices(whole)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            w = words([t.encode() for t in texts])
            h, whole = windows(w, 8, 8)
            again = np.zeros(len(w.hash), bool)
            at = np.flatnonzero(whole)
            if len(at):
                key = mix64(h[at] + w.text[at].astype(U64) * U64(0x9E3779B97F4A7C15))
                order = np.argsort(key, kind="stable")
                first, end = stretches(key[order])
                again = covered(at[order[np.repeat(end - first > 1, end - first)]], 8, len(w.hash))
            repeated = np.bincount(w.text, again, minlength=len(texts)).astype(np.int64)
            letters = np.bincount(w.text, w.end - w.start, minlength=len(texts)).astype(np.int64)
            out = [[] for _ in range(9)]
            for i, t in enumerate(texts):
                n, repeat = int(w.counts[i]), int(repeated[i])
                space = len(t.encode()) - int(letters[i])
                features, counts, dup = chain(t)
                path = field.path(features) if field else [1] * len(features)
                share = sum(c for c, x in zip(counts, path, strict=True) if x) / n if n else 0.0
                failed = n < 20 or 100 * repeat > 30 * n
                row = (n, len(t) - space, len(SYMBOLS.findall(t)), dup, repeat, failed, share, path, not failed and share >= content_share)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.list_(pa.int32()), pa.bool_()]
            yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=[x.split()[0] for x in names.split(", ")])

    return text_table(docs, id_col, text_col).mapInArrow(run, names)


def op8_line_quality(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of every document, with a field fitted on the labelled ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rate(docs, field).drop("line_labels")
