"""Readers of single filings: XBRL instances, and the text of periodic transaction reports."""

from __future__ import annotations

import datetime as dt
import io
import math
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.text import amount_range

INSTANCE = "accession string, tag string, ddate date, qtrs int, uom string, value double"


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def month_end(day: dt.date) -> dt.date:
    """The nearest end of a month; the one before at a tie."""
    before = day.replace(day=1) - dt.timedelta(days=1)
    after = (day.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
    return after if (after - day) < (day - before) else before


def instance_facts(xml: bytes, wanted: set[str] | None = None) -> list[tuple]:
    """(tag, end, quarters, unit, value) of facts without dimensions. Of several reports of one fact the most exact counts,
    then the one whose end and span lie nearest to a month's end and whole quarters, then the first."""
    contexts: dict[str, tuple] = {}
    units: dict[str, str] = {}
    facts: list[tuple] = []
    for _, el in ET.iterparse(io.BytesIO(xml)):
        name = local(el.tag)
        if name == "context":
            dates = {local(x.tag): (x.text or "").strip()[:10] for x in el.iter() if local(x.tag) in ("startDate", "endDate", "instant")}
            whole = not any(len(x) for x in el.iter() if local(x.tag) in ("segment", "scenario"))
            contexts[el.get("id")] = (dates.get("startDate"), dates.get("endDate") or dates.get("instant"), whole)
        elif name == "unit":
            # Of a ratio the numerator names the unit: dollars a share are dollars.
            top = next((x for x in el.iter() if local(x.tag) == "unitNumerator"), el)
            codes = [(x.text or "").strip().split(":")[-1] for x in top.iter() if local(x.tag) == "measure"]
            units[el.get("id")] = "*".join(c for c in codes if c)
        elif el.get("contextRef") and el.get("unitRef") and (wanted is None or name in wanted):
            facts.append((name, el.get("contextRef"), el.get("unitRef"), el.get("decimals"), (el.text or "").strip()))
    best: dict[tuple, tuple] = {}
    for name, context, unit, decimals, text in facts:
        start, end, whole = contexts.get(context, (None, None, False))
        try:
            value, last = float(text), dt.date.fromisoformat(end or "")
            first = dt.date.fromisoformat(start) if start else None
        except ValueError:
            continue
        if not whole or not math.isfinite(value):
            continue
        span = (last - first).days + 1 if first else 0
        quarters = math.floor(span / 91.3125 + 0.5)
        exact = math.inf if decimals == "INF" else float(decimals) if decimals and decimals.lstrip("+-").isdigit() else -math.inf
        if unit not in units:
            continue
        fit = abs((month_end(last) - last).days) + (abs(span - 91.3125 * quarters) if first else 0.0)
        key, rank = (name, month_end(last), quarters, units[unit]), (-exact, fit, value)
        if key not in best or rank[:2] < best[key][:2]:  # a true tie keeps the first reported
            best[key] = rank
    return [(*key, rank[2] + 0.0) for key, rank in sorted(best.items())]


def instances(df: DataFrame, wanted: list[str] | None = None, xml: str = "xml") -> DataFrame:
    """Rows of INSTANCE from (accession, xml) filings; one that cannot be parsed gives none."""
    names = set(wanted) if wanted else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for accession, text in zip(part["accession"], part["xml"], strict=True):
                try:
                    rows += [(accession, *f) for f in instance_facts((text or "").encode() if isinstance(text, str) or text is None else bytes(text), names)]
                except ET.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INSTANCE.split(", ")])

    return df.select("accession", F.col(xml).alias("xml")).mapInPandas(run, INSTANCE)


ROLES = "accession string, role string"
SHOWN = "accession string, role string, concept string, parent string, depth int"


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


#: The rendering's category of face statements, and the mark of one in a role's definition.
FACE, FACE_MARK = "Statements", " - statement - "


def face_roles(summary: bytes) -> list[str]:
    """Roles of a filing's face statements, by the rendering summary's category or the role's own definition."""
    text = lambda report, tag: (report.findtext(f"{{*}}{tag}") or "").strip()
    reports = ET.fromstring(summary).iterfind(".//{*}Report")
    told = ((text(x, "Role"), text(x, "MenuCategory") == FACE or FACE_MARK in text(x, "LongName").lower()) for x in reports)
    return list(dict.fromkeys(role for role, face in told if role and face))


def presented(linkbase: bytes) -> list[tuple[str, str, str | None, int]]:
    """(role, concept, parent, depth) of each concept that a presentation linkbase places, walked from each role's roots
    along its arcs in their order. A concept that no arc reaches is a root; one under several parents has a row for each;
    a ring of arcs ends where it comes back."""
    held: dict[str, tuple[dict[str, str], list[tuple[float, str, str]]]] = {}
    for link in (x for x in ET.fromstring(linkbase).iter() if local(x.tag) == "presentationLink"):
        a = lambda x: {local(k): v for k, v in x.attrib.items()}
        names, arcs = held.setdefault(a(link).get("role", ""), ({}, []))
        for x in link:
            at = a(x)
            if local(x.tag) == "loc" and "_" in (name := at.get("href", "").rsplit("#", 1)[-1]):
                names[at.get("label", name)] = name.split("_", 1)[1]
            elif local(x.tag) == "presentationArc":
                arcs.append((float(at.get("order") or 0), at.get("from", ""), at.get("to", "")))
    out = []
    for role, (names, arcs) in held.items():
        below: dict[str, list[str]] = {}
        for _, a, b in sorted(arcs, key=lambda x: x[0]):
            if a in names and b in names:
                below.setdefault(a, []).append(b)
        reached = {b for bs in below.values() for b in bs}
        todo = [(x, None, 0, ()) for x in reversed(names) if x not in reached]
        seen = set()
        while todo:
            at, parent, depth, path = todo.pop()
            if at in path:
                continue
            seen.add(at)
            out.append((role, names[at], parent, depth))
            todo += [(b, names[at], depth + 1, (*path, at)) for b in reversed(below.get(at, []))]
        out += [(role, names[x], None, 0) for x in names if x not in seen]
    return list(dict.fromkeys(out))


def _per_filing(df: DataFrame, column: str, read, shape: str) -> DataFrame:
    """Rows that read gives for each filing's document; one that cannot be parsed gives none."""
    names = [c.split()[0] for c in shape.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for accession, text in zip(part["accession"], part["xml"], strict=True):
                try:
                    found = read((text or "").encode() if isinstance(text, str) or text is None else bytes(text))
                except ET.ParseError:
                    continue
                rows += [(accession, *(f if isinstance(f, tuple) else (f,))) for f in found]
            yield pd.DataFrame(rows, columns=names).astype({"depth": "int32"} if "depth" in names else {})

    return df.select("accession", F.col(column).alias("xml")).mapInPandas(run, shape)


def statement_roles(df: DataFrame, summary: str = "summary") -> DataFrame:
    """ROLES of the face statements of filings (accession, summary)."""
    return _per_filing(df, summary, face_roles, ROLES)


def presentation(df: DataFrame, linkbase: str = "linkbase") -> DataFrame:
    """SHOWN: where filings (accession, linkbase) place each concept."""
    return _per_filing(df, linkbase, presented, SHOWN)


def statement_concepts(shown: DataFrame, roles: DataFrame) -> DataFrame:
    """(accession, concept) of the concepts that stand on a face statement."""
    return shown.join(roles, ["accession", "role"], "left_semi").select("accession", "concept").distinct()


#: The line that holds a trade, the lines about the one before, owners' codes.
TRADE = r"(S \(partial\)|P|S|E)\s+(\d{2}/\d{2}/\d{4})\s*(\d{2}/\d{2}/\d{4})\s*(\$[\d,]+(?:\s*-\s*\$[\d,]+)?|Over \$[\d,]+)"
ABOUT = r"^(F\s+S\s+:|D\s+:|S\s+O\s+:|C\s+:|L\s+:)"
OWNER = r"^(?:\d{6,}\s*)?(SP|JT|DC)\s+"


def house_trades(df: DataFrame, text: str = "text") -> DataFrame:
    """Trades of reports (doc_id, text): lines up to a trade's own name its asset, lines after it tell about it.

    A report has some tens of lines, so its windows are small."""
    lines = df.select("doc_id", F.posexplode(F.split(F.regexp_replace(text, "\r", ""), "\n")).alias("at", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    lines = lines.withColumn("trade", F.col("line").rlike(TRADE)).withColumn("about", F.col("line").rlike(ABOUT))
    before = F.sum(F.col("trade").cast("int")).over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("n", F.coalesce(before, F.lit(0)) + F.when(F.col("about"), 0).otherwise(1))
    join = lambda test, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("at", value.alias("v"))))), lambda x: x["v"]), " ")
    head = F.when(F.col("trade"), F.trim(F.regexp_replace("line", TRADE + ".*$", ""))).otherwise(F.col("line"))
    note = lambda letter: join(F.col("line").rlike(letter), F.trim(F.regexp_replace("line", r"^[^:]*:", "")))
    rec = lines.groupBy("doc_id", "n").agg(F.bool_or("trade").alias("ok"), join(~F.col("about"), head).alias("asset"), F.max(F.when(F.col("trade"), F.col("line"))).alias("core"), note(r"^F\s+S\s+:").alias("status"), note(r"^D\s+:").alias("description")).where("ok")
    part = lambda i: F.regexp_extract("core", TRADE, i)
    day = lambda i: F.to_date(F.try_to_timestamp(part(i), F.lit("MM/dd/yyyy")))
    plausible = lambda d: F.when(d.between(F.lit("1995-01-01").cast("date"), F.make_date(F.year(F.current_date()) + 1, F.lit(12), F.lit(31))), d)
    out = rec.withColumn("owner", F.coalesce(F.nullif(F.regexp_extract("asset", OWNER, 1), F.lit("")), F.lit("self"))).withColumn("asset", F.trim(F.regexp_replace("asset", OWNER, "")))
    amount = amount_range(part(4))
    return out.select(
        "doc_id", F.col("n").cast("int").alias("n"), "owner", "asset", F.nullif(F.upper(F.regexp_extract("asset", r"\(([A-Za-z0-9.\-]{1,20})\)\s*\[[A-Z]{2}\]\s*$", 1)), F.lit("")).alias("ticker"), F.nullif(F.regexp_extract("asset", r"\[([A-Z]{2})\]\s*$", 1), F.lit("")).alias("asset_type"),
        part(1).alias("ttype"), plausible(day(2)).alias("trans_date"), plausible(day(3)).alias("notif_date"), amount["low"].alias("amount_lo"), amount["high"].alias("amount_hi"), ((amount["low"] + F.coalesce(amount["high"], amount["low"])) / 2).alias("amount_mid"), F.nullif("status", F.lit("")).alias("status"), F.nullif("description", F.lit("")).alias("description"),
    )
