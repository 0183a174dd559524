"""Insider archives, yearly report indexes, and presentation linkbases of our own making."""

import datetime as dt
import zipfile

from barloom.sources import filings, formats


def archive(path, **files):
    with zipfile.ZipFile(path, "w") as z:
        for name, rows in files.items():
            z.writestr(name.replace("__", "."), rows if isinstance(rows, str) else "\n".join("\t".join(r) for r in rows) + "\n")


def test_insider_dataset(spark, tmp_path):
    sub = [("ACCESSION_NUMBER", "FILING_DATE", "PERIOD_OF_REPORT", "DOCUMENT_TYPE", "ISSUERCIK", "ISSUERNAME", "ISSUERTRADINGSYMBOL", "AFF10B5ONE"), ("A", "31-MAR-2031", "28-MAR-2031", "4", "0000012", "Birch", "BRC", "1"), ("B", "2031-04-01", "", "4/A", "13", "Elm", "ELM", ""), ("C", "2031-04-01", "", "3", "14", "Oak", "OAK", "0")]
    own = [("ACCESSION_NUMBER", "RPTOWNERCIK", "RPTOWNERNAME", "RPTOWNER_RELATIONSHIP", "RPTOWNER_TITLE", "RPTOWNER_TXT"), ("A", "0077", "Fund", "TenPercentOwner", "", ""), ("A", "88", "Ann", "Director,Officer", "", "Chair"), ("A", "99", "Bob", "Officer", "CFO", "")]
    head = ("ACCESSION_NUMBER", "SECURITY_TITLE", "TRANS_DATE", "TRANS_CODE", "TRANS_SHARES", "TRANS_PRICEPERSHARE", "TRANS_PRICEPERSHARE_FN", "TRANS_ACQUIRED_DISP_CD", "SHRS_OWND_FOLWNG_TRANS", "DIRECT_INDIRECT_OWNERSHIP")
    deals = [head, ("A", "Common", "28-MAR-2031", " P", "10", "2.5", "", "A ", "100", "D"), ("A", "Common", "28-MAR-2031", "S", "x", "3", "F1", "D", "", "I"), ("B", "Common", "", "P", "1", "", "", "A", "1", "D"), ("C", "Common", "", "P", "1", "1", "", "A", "1", "D")]
    archive(tmp_path / "q1.zip", SUBMISSION__tsv=sub, REPORTINGOWNER__tsv=own, NONDERIV_TRANS__tsv=deals)
    got = {(r.accession, r.trans_code): r for r in formats.insider_dataset(spark, str(tmp_path)).collect()}
    assert set(got) == {("A", "P"), ("A", "S"), ("B", "P")}
    a = got["A", "P"]
    assert (a.form, a.filing_date, a.period, a.issuer_cik, a.owner_cik, a.owner_name, a.n_owners, a.owner_ciks) == ("4", dt.date(2031, 3, 31), dt.date(2031, 3, 28), 12, 88, "Ann", 3, "77;88;99")
    assert (a.is_director, a.is_officer, a.is_ten_pct, a.officer_title, a.aff10b5one, a.acq_disp, a.value, a.price_fn) == (True, True, False, "Chair", 1.0, "A", 25.0, False)
    s, b = got["A", "S"], got["B", "P"]
    assert s.shares is None and s.value is None and s.price_fn and s.direct == "I"
    assert (b.form, b.owner_cik, b.n_owners, b.is_director, b.aff10b5one, b.period, b.trans_date) == ("4/A", None, None, False, None, None, None)


def test_owner_order_is_the_files(spark, tmp_path):
    """Without a director or officer the first line is primary, whatever its number is."""
    sub = [("ACCESSION_NUMBER", "DOCUMENT_TYPE"), ("A", "4")]
    own = [("ACCESSION_NUMBER", "RPTOWNERCIK", "RPTOWNERNAME", "RPTOWNER_RELATIONSHIP")] + [("A", str(900 - i), f"n{i}", "Other") for i in range(12)]
    archive(tmp_path / "q.zip", SUBMISSION__tsv=sub, REPORTINGOWNER__tsv=own, NONDERIV_TRANS__tsv=[("ACCESSION_NUMBER", "TRANS_CODE"), ("A", "P")])
    r = formats.insider_dataset(spark, str(tmp_path)).first()
    assert r.owner_name == "n0" and r.owner_ciks.split(";") == [str(900 - i) for i in range(12)] and r.is_other


def test_report_index(spark, tmp_path):
    member = lambda **k: "<Member>" + "".join(f"<{n}>{v}</{n}>" for n, v in k.items()) + "</Member>"
    xml = "﻿<?xml version='1.0'?><FinancialDisclosure>" + member(Prefix="Hon.", Last="Reed", First=" Ida ", Suffix="", FilingType="P", StateDst="OH01", Year="2031", FilingDate="2/3/2031", DocID="200") + member(Last="Moss", FilingType="C", DocID="1") + member(Last="Lark", First="Jo", FilingType="P", StateDst="", Year="", FilingDate="", DocID="201") + "</FinancialDisclosure>"
    archive(tmp_path / "2031FD.zip", a__txt="x", b__xml=xml)
    archive(tmp_path / "2030FD.zip", a__txt="x")
    got = sorted(map(tuple, formats.report_index(formats.archived_xml(spark, str(tmp_path))).collect()))
    assert got == [("200", 2031, "Reed", "Hon. Ida Reed", "OH01", dt.date(2031, 2, 3)), ("201", None, "Lark", "Jo Lark", "", None)]


LINK = 'xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink"'


def linkbase(*roles):
    body = ""
    for role, locs, arcs in roles:
        body += f'<link:presentationLink xlink:role="{role}">' + "".join(f'<link:loc xlink:label="{k}" xlink:href="x.xsd#{v}"/>' for k, v in locs.items()) + "".join(f'<link:presentationArc xlink:from="{a}" xlink:to="{b}" order="{o}"/>' for a, b, o in arcs) + "</link:presentationLink>"
    return f"<link:linkbase {LINK}>{body}</link:linkbase>"


def test_presentation(spark):
    balance = ("r/balance", {"a": "us_Sheet", "b": "us_Assets", "c": "us_Cash", "d": "own_Boats_Net", "e": "us_Alone", "f": "plain"}, [("a", "b", "2"), ("b", "c", "1"), ("a", "d", "1"), ("b", "zz", "1")])
    ring = ("r/notes", {"p": "us_P", "q": "us_Q", "s": "us_S"}, [("p", "q", "1"), ("q", "p", "1"), ("s", "q", "1")])
    summary = "<FilingSummary><MyReports><Report><Role>r/balance</Role><MenuCategory>Statements</MenuCategory></Report><Report><Role>r/notes</Role><MenuCategory>Notes</MenuCategory><LongName>9 - Disclosure - N</LongName></Report><Report><Role>r/flows</Role><LongName>3 - Statement - Flows</LongName></Report><Report><MenuCategory>Statements</MenuCategory></Report></MyReports></FilingSummary>"
    df = spark.createDataFrame([("A", summary, linkbase(balance, ring)), ("B", "<broken", "<broken"), ("C", None, None)], "accession string, summary string, linkbase string")
    roles, shown = filings.statement_roles(df), filings.presentation(df)
    assert sorted(r.role for r in roles.collect()) == ["r/balance", "r/flows"]
    rows = {(r.role, r.concept, r.parent, r.depth) for r in shown.collect()}
    assert {r[1:] for r in rows if r[0] == "r/balance"} == {("Sheet", None, 0), ("Boats_Net", "Sheet", 1), ("Assets", "Sheet", 1), ("Cash", "Assets", 2), ("Alone", None, 0)}
    assert {r[1:] for r in rows if r[0] == "r/notes"} == {("S", None, 0), ("Q", "S", 1), ("P", "Q", 2)}
    assert sorted(r.concept for r in filings.statement_concepts(shown, roles).collect()) == ["Alone", "Assets", "Boats_Net", "Cash", "Sheet"]


def test_a_ring_alone_is_still_shown():
    ring = linkbase(("r", {"p": "us_P", "q": "us_Q"}, [("p", "q", "1"), ("q", "p", "1")]))
    assert filings.presented(ring.encode()) == [("r", "P", None, 0), ("r", "Q", None, 0)]
