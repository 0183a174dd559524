"""Readers of the feeds' formats: Spark's own readers and functions; archives are opened inside tasks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.accounting import quarters_of

US_DAY = "yyyyMMdd"


def short_volume(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated daily files: rows without a positive total, as trailers are, go."""
    raw = spark.read.option("sep", "|").option("header", True).csv(path)
    n = lambda c: F.expr(f"try_cast({c} as float)")
    out = raw.select(F.to_date(F.try_to_timestamp("Date", F.lit(US_DAY))).alias("date"), F.col("Symbol").alias("ticker"), n("ShortVolume").alias("short_vol"), n("ShortExemptVolume").alias("short_exempt"), n("TotalVolume").alias("total_vol"))
    return out.where("total_vol > 0 and date is not null")


def members(spark: SparkSession, path: str, name: str, columns: list[str], numbered: bool = False) -> DataFrame:
    """Rows of one tab-separated member of each zip archive under path, as text columns, with the archive's path and, if
    numbered, their line in the member."""
    schema = ", ".join(f"`{c}` string" for c in ["archive", *columns]) + (", line long" if numbered else "")

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for archive, content in zip(part["path"], part["content"], strict=True):
                line = 0
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(name) as f:
                    for rows in pd.read_csv(f, sep="\t", dtype=str, chunksize=50_000, usecols=lambda c: c in columns, keep_default_na=False, na_values=[""]):
                        rows = rows.reindex(columns=columns).astype(object)
                        rows = rows.where(rows.notna(), None)
                        rows.insert(0, "archive", archive)
                        if numbered:
                            rows["line"] = range(line, line + len(rows))
                            line += len(rows)
                        yield rows

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, schema)


def quarterly_facts(spark: SparkSession, path: str, wanted: list[str], forms: list[str]) -> DataFrame:
    """Facts of quarterly archives: submissions joined with numbers, whole companies only."""
    sub = members(spark, path, "sub.txt", ["adsh", "cik", "form", "filed", "fy", "fp", "sic"]).where(F.col("form").isin(forms))
    num = members(spark, path, "num.txt", ["adsh", "tag", "ddate", "qtrs", "uom", "segments", "coreg", "value"])
    num = num.where(F.col("tag").isin(wanted) & F.col("segments").isNull() & F.col("coreg").isNull())
    day = lambda c: F.to_date(F.try_to_timestamp(c, F.lit(US_DAY)))
    return num.join(sub, ["archive", "adsh"]).select(F.col("cik").cast("long"), "adsh", "tag", day("ddate").alias("ddate"), F.col("qtrs").cast("int"), F.expr("try_cast(value as double)").alias("value"), day("filed").alias("filed"), "form", F.col("fy").cast("int"), "fp", F.col("sic").cast("int"), F.coalesce("uom", F.lit("USD")).alias("uom")).where("value is not null")


#: The forms of insiders' trades, and where a relationship's words stand in its code.
TRADE_FORMS = ("4", "4/A")
RELATIONS = {"is_director": "Director", "is_officer": "Officer", "is_ten_pct": "TenPercent", "is_other": "Other"}


def insider_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Trades of quarterly insider archives: filings, owners and non-derivative transactions joined by archive and filing.

    A filing's primary owner is its first director or officer, else its first owner; owner_ciks names all in their order.
    Flags that a filing lacks are null, its relations false. A filing has a few owners, so that its list stays small."""
    key = ["archive", "ACCESSION_NUMBER"]
    sub = members(spark, path, "SUBMISSION.tsv", ["ACCESSION_NUMBER", "FILING_DATE", "PERIOD_OF_REPORT", "DOCUMENT_TYPE", "ISSUERCIK", "ISSUERNAME", "ISSUERTRADINGSYMBOL", "AFF10B5ONE"]).where(F.col("DOCUMENT_TYPE").isin(*TRADE_FORMS))
    own = members(spark, path, "REPORTINGOWNER.tsv", ["ACCESSION_NUMBER", "RPTOWNERCIK", "RPTOWNERNAME", "RPTOWNER_RELATIONSHIP", "RPTOWNER_TITLE", "RPTOWNER_TXT"], numbered=True)
    deals = members(spark, path, "NONDERIV_TRANS.tsv", ["ACCESSION_NUMBER", "SECURITY_TITLE", "TRANS_DATE", "TRANS_CODE", "TRANS_SHARES", "TRANS_PRICEPERSHARE", "TRANS_PRICEPERSHARE_FN", "TRANS_ACQUIRED_DISP_CD", "SHRS_OWND_FOLWNG_TRANS", "DIRECT_INDIRECT_OWNERSHIP"])
    relation = F.lower(F.coalesce("RPTOWNER_RELATIONSHIP", F.lit("")))
    own = own.withColumns({k: relation.contains(v.lower()) for k, v in RELATIONS.items()})
    first = F.struct((~(F.col("is_director") | F.col("is_officer"))).alias("junior"), "line", "RPTOWNERCIK", "RPTOWNERNAME", F.coalesce("RPTOWNER_TITLE", "RPTOWNER_TXT").alias("title"), *RELATIONS)
    cik = F.expr("cast(try_cast(RPTOWNERCIK as bigint) as string)")
    owners = own.groupBy(*key).agg(F.min(first).alias("p"), F.count("*").cast("int").alias("n_owners"), F.array_sort(F.collect_list(F.struct("line", cik.alias("cik")))).alias("all"))
    t = deals.join(sub, key).join(owners, key, "left")
    day = lambda c: F.coalesce(*[F.to_date(F.try_to_timestamp(F.col(c), F.lit(f))) for f in ("dd-MMM-yyyy", "yyyy-MM-dd")])
    number = lambda c: F.expr(f"try_cast(trim({c}) as double)")
    out = t.select(
        F.col("ACCESSION_NUMBER").alias("accession"), F.col("DOCUMENT_TYPE").alias("form"), day("FILING_DATE").alias("filing_date"), day("PERIOD_OF_REPORT").alias("period"), F.expr("try_cast(ISSUERCIK as bigint)").alias("issuer_cik"), F.col("ISSUERNAME").alias("issuer_name"), F.col("ISSUERTRADINGSYMBOL").alias("issuer_symbol"),
        F.expr("try_cast(p.RPTOWNERCIK as bigint)").alias("owner_cik"), F.col("p.RPTOWNERNAME").alias("owner_name"), "n_owners", F.array_join(F.transform("all", lambda x: x["cik"]), ";").alias("owner_ciks"), *[F.coalesce(f"p.{k}", F.lit(False)).alias(k) for k in RELATIONS], F.col("p.title").alias("officer_title"),
        F.when(F.col("AFF10B5ONE").isNotNull(), F.lower(F.trim("AFF10B5ONE")).isin("1", "true", "y").cast("double")).alias("aff10b5one"), F.col("SECURITY_TITLE").alias("security_title"), day("TRANS_DATE").alias("trans_date"), F.trim("TRANS_CODE").alias("trans_code"), F.trim("TRANS_ACQUIRED_DISP_CD").alias("acq_disp"),
        number("TRANS_SHARES").alias("shares"), number("TRANS_PRICEPERSHARE").alias("price"), number("SHRS_OWND_FOLWNG_TRANS").alias("shares_after"), F.trim("DIRECT_INDIRECT_OWNERSHIP").alias("direct"), F.col("TRANS_PRICEPERSHARE_FN").isNotNull().alias("price_fn"),
    )
    return out.withColumn("value", F.col("shares") * F.col("price"))


def archived_xml(spark: SparkSession, path: str) -> DataFrame:
    """(archive, xml): the first XML member of each zip archive under path; an archive without one gives no row."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for archive, content in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    name = next((n for n in z.namelist() if n.lower().endswith(".xml")), None)
                    if name:
                        rows.append((archive, z.read(name).decode("utf-8-sig", "replace")))
            yield pd.DataFrame(rows, columns=["archive", "xml"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "archive string, xml string")


def report_index(df: DataFrame, kind: str = "P", xml: str = "xml") -> DataFrame:
    """(doc_id, year, last, member, state_dst, filing_date) of a year's filing index: the reports of one kind."""
    tag = lambda name: F.trim(F.regexp_extract("m", rf"(?s)<{name}>(.*?)</{name}>", 1))
    each = df.select(F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<Member>.*?</Member>"), F.lit(0))).alias("m")).where(tag("FilingType") == kind)
    name = F.array_join(F.filter(F.array(*[tag(x) for x in ("Prefix", "First", "Last", "Suffix")]), lambda x: x != ""), " ")
    return each.select(tag("DocID").alias("doc_id"), F.expr("try_cast(regexp_extract(m, '<Year>(.*?)</Year>', 1) as int)").alias("year"), tag("Last").alias("last"), name.alias("member"), tag("StateDst").alias("state_dst"), F.to_date(F.try_to_timestamp(tag("FilingDate"), F.lit("M/d/yyyy"))).alias("filing_date"))


COMPANY = "cik long, facts map<string, map<string, struct<units: map<string, array<struct<start:string, `end`:string, val:double, accn:string, fy:int, fp:string, form:string, filed:string>>>>>>"


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file a company: taxonomy, tag, unit, fact; spans become quarters."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", COMPANY).alias("d")).select("d.cik", F.explode("d.facts").alias("taxonomy", "tags"))
    units = docs.select("cik", "taxonomy", F.explode("tags").alias("tag", "x")).select("cik", "taxonomy", "tag", F.explode("x.units").alias("uom", "rows"))
    f = units.select("cik", "taxonomy", "tag", "uom", F.explode("rows").alias("f"))
    span = F.datediff(F.to_date("f.end"), F.to_date("f.start"))
    return f.select("cik", F.col("f.accn").alias("adsh"), "tag", F.to_date("f.end").alias("ddate"), F.coalesce(quarters_of(span), F.lit(0)).cast("int").alias("qtrs"), F.col("f.val").alias("value"), F.to_date("f.filed").alias("filed"), F.col("f.form").alias("form"), F.col("f.fy").alias("fy"), F.col("f.fp").alias("fp"), "uom")


def filing_index(spark: SparkSession, path: str) -> DataFrame:
    """Daily index lines: company number, name, form, day, file, between pipes, after a header."""
    p = F.split("value", r"\|")
    rows = spark.read.text(path).where(F.size(p) == 5).select(F.expr("try_cast(trim(split(value, '[|]')[0]) as long)").alias("cik"), F.trim(p[1]).alias("name"), F.trim(p[2]).alias("form"), F.coalesce(F.to_date(F.try_to_timestamp(F.trim(p[3]), F.lit(US_DAY))), F.to_date(F.try_to_timestamp(F.trim(p[3]), F.lit("yyyy-MM-dd")))).alias("filed"), F.trim(p[4]).alias("file"))
    return rows.where("cik is not null").withColumn("accession", F.regexp_extract("file", r"(\d{10}-\d{2}-\d{6})", 1))


def submissions(spark: SparkSession, path: str, forms: list[str]) -> DataFrame:
    """One JSON file a company with parallel arrays of filings."""
    schema = "cik string, filings struct<recent: struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>, items: array<string>, acceptanceDateTime: array<string>>>"
    r = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d")).select(F.col("d.cik").cast("long").alias("cik"), "d.filings.recent.*")
    each = r.select("cik", F.explode(F.arrays_zip("accessionNumber", "form", "filingDate", "items", "acceptanceDateTime")).alias("x"))
    return each.select("cik", F.col("x.accessionNumber").alias("accession"), F.col("x.form").alias("form"), F.to_date("x.filingDate").alias("filed"), F.col("x.items").alias("items"), F.to_timestamp("x.acceptanceDateTime").alias("accepted")).where(F.col("form").isin(forms))


def form4(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Trades of ownership filings: one row a transaction line; several owners are joined."""
    v = lambda path: f"{path}: struct<value: string>"
    schema = (
        "periodOfReport string, issuer struct<issuerCik: string, issuerName: string, issuerTradingSymbol: string>, reportingOwner array<struct<reportingOwnerId: struct<rptOwnerCik: string, rptOwnerName: string>,"
        " reportingOwnerRelationship: struct<isDirector: string, isOfficer: string, isTenPercentOwner: string, officerTitle: string>>>, nonDerivativeTable struct<nonDerivativeTransaction: array<struct<"
        f"{v('securityTitle')}, {v('transactionDate')}, transactionCoding: struct<transactionCode: string>, transactionAmounts: struct<{v('transactionShares')}, {v('transactionPricePerShare')}, {v('transactionAcquiredDisposedCode')}>,"
        f" postTransactionAmounts: struct<{v('sharesOwnedFollowingTransaction')}>>>>"
    )
    d = df.withColumn("d", F.from_xml(xml, schema, {"rowTag": "ownershipDocument"}))
    yes = lambda c: F.lower(c).isin("1", "true")
    t = F.col("t")
    number = lambda c: c.try_cast("double")
    return d.select(
        *[c for c in df.columns if c != xml], F.col("d.issuer.issuerCik").cast("long").alias("issuer_cik"), F.upper("d.issuer.issuerTradingSymbol").alias("issuer_symbol"), F.col("d.reportingOwner")[0]["reportingOwnerId"]["rptOwnerCik"].cast("long").alias("owner_cik"),
        F.col("d.reportingOwner")[0]["reportingOwnerId"]["rptOwnerName"].alias("owner_name"), F.array_join(F.transform("d.reportingOwner", lambda o: o["reportingOwnerId"]["rptOwnerCik"]), ";").alias("owner_ciks"),
        yes(F.col("d.reportingOwner")[0]["reportingOwnerRelationship"]["isDirector"]).alias("is_director"), yes(F.col("d.reportingOwner")[0]["reportingOwnerRelationship"]["isOfficer"]).alias("is_officer"), F.explode_outer("d.nonDerivativeTable.nonDerivativeTransaction").alias("t"),
    ).select(
        "*", F.to_date(t["transactionDate"]["value"]).alias("trans_date"), t["transactionCoding"]["transactionCode"].alias("trans_code"), t["transactionAmounts"]["transactionAcquiredDisposedCode"]["value"].alias("acq_disp"),
        number(t["transactionAmounts"]["transactionShares"]["value"]).alias("shares"), number(t["transactionAmounts"]["transactionPricePerShare"]["value"]).alias("price"), number(t["postTransactionAmounts"]["sharesOwnedFollowingTransaction"]["value"]).alias("shares_after"),
    ).drop("t").withColumn("value", F.col("shares") * F.col("price"))


def feed_items(df: DataFrame, xml: str = "xml", item: str = "item") -> DataFrame:
    """Items of an RSS or Atom feed, with the tickers that their text names in brackets."""
    inner = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("i", rf"(?s)<{tag}[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1), r"\s+", " "))
    each = df.withColumn("i", F.explode(F.regexp_extract_all(xml, F.lit(rf"(?s)<{item}[ >].*?</{item}>"), F.lit(0))))
    out = each.select(*[c for c in df.columns if c != xml], inner("title").alias("title"), inner("link").alias("url"), F.coalesce(F.nullif(inner("pubDate"), F.lit("")), inner("updated")).alias("published"), inner("description").alias("summary"))
    return out.withColumn("tickers", F.regexp_extract_all(F.concat_ws(" ", "title", "summary"), F.lit(r"\((?:NASDAQ|NYSE|NYSE American|AMEX|OTC)\s*:\s*([A-Z.]{1,6})\)"), F.lit(1)))


def bars_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Price-feed pages {symbol: [bar]}: exchange-local time, regular hours, missing counts as zero."""
    schema = "map<string, array<struct<t: string, o: double, h: double, l: double, c: double, v: long, n: int, vw: double>>>"
    b = df.select(F.explode(F.from_json(payload, schema)).alias("ticker", "rows")).select("ticker", F.explode("rows").alias("b"))
    local = F.from_utc_timestamp(F.to_timestamp("b.t"), "America/New_York")
    out = b.select("ticker", local.alias("datetime"), F.to_date(local).alias("date"), *[F.col(f"b.{k}").alias(n) for k, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))], F.coalesce("b.v", F.lit(0)).alias("volume"), F.coalesce("b.n", F.lit(0)).alias("trades"), F.coalesce("b.vw", F.lit(0.0)).alias("vwap"))
    return out.where(F.hour("datetime").between(9, 15) | (F.hour("datetime") == 0))


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
