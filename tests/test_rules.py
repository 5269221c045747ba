"""Hand-made cases: parsing, statuses, mapping, forecasts, curves, incidents, files and the store."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.functions.kpi import channel_type
from tallyspark.operators import anomalies as A
from tallyspark.operators import cleaning as CL
from tallyspark.operators import findings as FI
from tallyspark.operators import incidents as I
from tallyspark.operators import labels as LB
from tallyspark.operators import mapping as MP
from tallyspark.operators import profile as PR
from tallyspark.operators import response as RC
from tallyspark.operators import standouts as SO
from tallyspark.operators.group import group_kpis
from tallyspark.operators.pacing import pacing_status
from tallyspark.operators.targets import target_status
from tallyspark.plans import queries_cleaning as QC
from tallyspark.plans import queries_detect as QD
from tallyspark.plans import queries_scalar as QS
from tallyspark.sources import files as FILES
from tallyspark.sources import generate as GEN
from tallyspark.sources.store import RunStore


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_numbers(spark):
    cases = {"1200": 1200.0, "-3.5": -3.5, ".5": 0.5, "₹1,23,456": 123456.0, "INR 5000": 5000.0, "Rs. 500": 500.0, "(1,200)": -1200.0, "1200,50": 1200.5, "1.234,56": 1234.56, "$1,234.5": 1234.5, "a,b": None, "1e5": None, "12d": None, "NaN": None, "Infinity": None, "n/a": None, "": None, None: None, "1,2": 1.2, " 5 ": 5.0}
    got = one_column(spark, list(cases)).select("x", X.parse_number(F.col("x"))["value"].alias("v")).collect()
    assert {r["x"]: r["v"] for r in got} == cases


def test_dates(spark):
    d = dt.date
    cases = {"2026-01-05": d(2026, 1, 5), "05/01/2026": d(2026, 1, 5), "12/25/2026": d(2026, 12, 25), "5-Jan-2026": d(2026, 1, 5), "5 January 2026": d(2026, 1, 5), "Jan 5, 2026": d(2026, 1, 5), "2026/1/5": d(2026, 1, 5), "5.1.2026": d(2026, 1, 5), "2026-01-05 10:00:00": d(2026, 1, 5), "31/02/2026": None, "soon": None, "-": None, None: None}
    got = one_column(spark, list(cases)).select("x", X.parse_date(F.col("x"))["value"].alias("v")).collect()
    assert {r["x"]: r["v"] for r in got} == cases
    us = one_column(spark, ["05/01/2026"]).select(X.parse_date(F.col("x"), False)["value"].alias("v")).first()["v"]
    assert us == d(2026, 5, 1)


def test_statuses(spark):
    got = one_column(spark, [0.95, 1.05, 1.06, 0.94, None], "double").select(pacing_status(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in got] == ["On pace", "On pace", "Overspending", "Underspending", "Not available"]
    t = spark.createDataFrame([("cpl", "down", 110.0, 100.0), ("cpl", "down", 111.0, 100.0), ("roas", "up", 90.0, 100.0), ("spend", "none", 105.0, 100.0), ("spend", "none", 89.0, 100.0), ("roas", "up", None, 1.0)], "k string, b string, a double, t double")
    assert [r[0] for r in t.select(target_status(F.col("k"), F.col("b"), F.col("a"), F.col("t"))).collect()] == ["Within 10%", "Off target", "Within 10%", "On target", "Under", "Not available"]
    names = one_column(spark, ["Email newsletter", "SEO", None, "Paid Search", " organic  SOCIAL "]).select(channel_type(F.col("x"))).collect()
    assert [r[0] for r in names] == ["owned", "owned", "paid", "paid", "owned"]


def test_ratio_of_sums_on_rows_where_both_are_known(spark):
    df = spark.createDataFrame([("a", 100.0, 10.0), ("a", 300.0, None), ("a", None, 5.0), ("b", 50.0, 0.0), (None, 10.0, 2.0)], "channel string, spend double, leads double")
    got = {r["channel"]: (r["rows"], r["cpl"]) for r in group_kpis(df, "channel").collect()}
    assert got == {"a": (3, 10.0), "b": (1, None), "(none)": (1, 5.0)}


def test_mapping():
    found = MP.map_fields(["Day", "Cost", "CTR", "AmountSpent", "Product cost", "Zork"], dict.fromkeys(["Cost", "CTR", "AmountSpent", "Product cost"], "number") | {"Day": "date", "Zork": "text"})
    assert MP.active(found) == {"date": "Day", "spend": "Cost"}
    assert MP.active(MP.map_fields(["Cost", "AmountSpent"], overrides={"AmountSpent": "spend"})) == {"spend": "AmountSpent"}
    assert LB.indel_ratio("kitten", "sitting") == pytest.approx(61.538, abs=1e-3)


def test_mapping_asks_before_it_takes_a_doubtful_column():
    for header, candidates in {"Profit": ("gross_profit",), "Sales": ("revenue", "conversions", "orders"), "Sign ups": ("leads", "conversions"), "Results": ("leads", "conversions"), "Marketing cost": ("spend",)}.items():
        found = MP.map_fields([header], {header: "number"})
        assert MP.active(found) == {} and found[header].status == "suggested" and found[header].candidates == candidates
    assert MP.map_fields(["Total cost"], {"Total cost": "number"})["Total cost"].status == "not_used"
    assert MP.to_confirm(MP.map_fields(["Sales", "Zork"], {"Sales": "number"})) == ["Sales"]
    assert MP.active(MP.map_fields(["Results"], {"Results": "number"}, results="leads")) == {"leads": "Results"}
    more = MP.Knowledge(synonyms={"spend": ["media investment"]}, recognised=["zork"])
    assert MP.active(MP.map_fields(["Media investment"], knowledge=more)) == {"spend": "Media investment"} and MP.map_fields(["Zork"], knowledge=more)["Zork"].status == "not_used"


def greedy_heads(counts, similarity=90.0):
    """Keys in the order of their counts; each goes to the first head that it is close to."""
    heads, out = [], {}
    for key in sorted(counts, key=lambda k: (-counts[k], k)):
        near = next((h for h in heads if len(key) >= 4 and [c for c in key if c.isdigit()] == [c for c in h if c.isdigit()] and LB.indel_ratio(key, h) >= similarity), None)
        if near is None:
            heads.append(key)
        else:
            out[key] = near
    return out


def test_misspelt_labels_by_brute_force(spark):
    rng = random.Random(5)
    counts = {}
    for _ in range(40):
        base = "".join(rng.choice("abcde ") for _ in range(rng.randint(3, 24))).strip() + rng.choice(["", " 1", " 2"])
        for _ in range(rng.randint(1, 6)):
            at, key = rng.randrange(len(base) + 1), base
            key = rng.choice([key, key[:at] + key[at + 1 :], key[:at] + rng.choice("abcxyz") + key[at:], key[:at] + "xy" + key[at:]])
            counts[key] = rng.randint(1, 50)
    counts.pop("", None)
    keys = spark.createDataFrame([("c", k, n) for k, n in counts.items()], "column string, key string, n long")
    got = {r["key"]: r["head"] for r in LB.merged_keys(keys).collect()}
    assert got == greedy_heads(counts) and len(got) > 10


def test_other_names_of_known_channels_become_one(spark):
    raw = spark.createDataFrame([(i, v, str(i)) for i, v in enumerate(["FB", "facebook", "Meta Ads", "meta ", "Google", "google ads", "E-mail", "Podcast", "podcast", "Podcast"])], "source_row long, Channel string, Cost string")
    table, log = CL.clean(raw, {"channel": "Channel", "spend": "Cost"})
    got = [r["channel"] for r in table.orderBy("source_row").collect()]
    assert got == ["Meta"] * 4 + ["Google Ads"] * 2 + ["Email"] + ["Podcast"] * 3
    assert log.where("action = 'label_standardized'").count() == 8


def test_quartiles_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 1001), ("d", 40)) for v in rng.integers(0, 300, n)] + [("e", None), ("c", None)]
    got = {r["key"]: (r["n"], r["q"]) for r in CL.exact_quantiles(spark.createDataFrame(rows, "key string, v double"), [0.0, 0.25, 0.75, 1.0]).collect()}
    for k in "abcd":
        own = [v for x, v in rows if x == k and v is not None]
        assert got[k][0] == len(own) and got[k][1] == pytest.approx(list(np.percentile(own, [0, 25, 75, 100])))
    assert set(got) == set("abcd")


def test_one_campaign_with_two_incidents_is_one_campaign(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [(1, "channel", "Search", day(1), day(20)), (2, "campaign", "A", day(2), day(5)), (3, "campaign", "A", day(12), day(15)), (4, "region", "North", day(1), day(20)), (5, "campaign", "B", day(3), day(6))]
    incidents = spark.createDataFrame(rows, "number long, entity_type string, entity string, start date, end date")
    of = spark.createDataFrame([("channel", "Search", ["A"]), ("region", "North", ["A", "B"]), ("campaign", "A", ["A"]), ("campaign", "B", ["B"])], "entity_type string, entity string, campaigns array<string>")
    got = {r["number"]: r["parent"] for r in I.attach(incidents, of).collect()}
    assert got == {1: 2, 2: 4, 3: 4, 4: None, 5: 4}
    alone = {r["number"]: r["parent"] for r in I.attach(incidents.where("number <= 3"), of).collect()}
    assert alone == {1: 2, 2: None, 3: None}


def test_planner_takes_the_best_steps(spark):
    rows = [("A", 1000.0, 3.0, 0.5, None, 500.0, 1300.0), ("B", 800.0, 2.0, 0.8, None, 400.0, 1040.0), ("C", 600.0, 0.05, 1.0, 36.0, 300.0, 780.0)]
    curves = spark.createDataFrame(rows, "channel string, spend8 double, a double, b double, most_conversions double, guard_low double, guard_high double")
    spend = {r["channel"]: r["new_spend"] for r in RC.suggest_allocation(curves).collect()}
    assert sum(spend.values()) == pytest.approx(2400.0) and all(max(lo, 0.7 * s) - 1e-6 <= spend[c] <= min(hi, 1.3 * s) + 1e-6 for c, s, _, _, _, lo, hi in rows)

    def bought(x):
        return sum(min(a * x[c] ** b, cap or float("inf")) for c, _, a, b, cap, _, _ in rows)

    step = 2400.0 / 400
    for up in spend:
        for down in spend:
            moved = spend | {up: spend[up] + step} if up != down else dict(spend)
            if up != down:
                moved[down] = spend[down] - step
                inside = all(max(lo, 0.7 * s) - 1e-6 <= moved[c] <= min(hi, 1.3 * s) + 1e-6 for c, s, _, _, _, lo, hi in rows)
                assert not inside or bought(moved) <= bought(spend) + 1e-9
    assert bought(spend) > bought({c: s for c, s, *_ in rows})


def test_numbers_of_answers(spark):
    text = "₹2.7-5.9 Cr, ₹3 to ₹4 lakhs, 1,950 leads in 1950, 12 weeks, -4.5%"
    got = spark.createDataFrame([(text,)], "t string").select(F.filter(X.numbers_in(F.col("t")), X.checkable).alias("n")).first()["n"]
    assert [(round(x["value"], 1), x["kind"]) for x in got] == [(27e6, "money"), (59e6, "money"), (3e5, "money"), (4e5, "money"), (1950.0, "plain"), (-4.5, "percent")]


def test_numbers_are_read_by_a_grammar(spark):
    cases = {
        "₹1,20,000 and 5-7% of 3x": [(120000.0, "money", True), (5.0, "plain", False), (7.0, "percent", False), (3.0, "ratio", False)],
        "-2.5 L, Q3 v2.0 .5 up.7": [(-250000.0, "plain", False)],
        "₹ 4 – ₹6 lakhs, 12, 13 and 1,": [(4e5, "money", False), (6e5, "money", False), (12.0, "plain", False), (13.0, "plain", False), (1.0, "plain", False)],
        "₹3 L to 40 %": [(3e5, "money", False), (40.0, "percent", False)],
        "": [],
    }
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", X.numbers_in(F.col("t")).alias("n")).collect()
    assert {r["t"]: [(round(x["value"], 6), x["kind"], x["grouped"]) for x in r["n"]] for r in got} == cases
    assert spark.range(1).select(X.numbers_in(F.lit(None).cast("string")).alias("n")).first()["n"] is None


def test_duplicates_keep_the_first_row_and_nulls_are_equal(spark):
    raw = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", ""), (4, "b", "x")], "source_row long, p string, `q.r` string")
    got = {r["source_row"]: r["first_row"] for r in CL.repeated_rows(raw, ["p", "q.r"]).collect()}
    assert got == {2: 1}


def test_totals_are_no_labels_wherever_they_stand(spark, monkeypatch):
    labels = ["Search", "Search", "search", "Searchx", "Grand Total", "Grand Total", "grand total", "Grand Total."]
    raw = spark.createDataFrame([(i, *(v if c == "Channel" else "x" for c in QC.COLUMNS)) for i, v in enumerate(labels, 1)], ["source_row", *QC.COLUMNS])
    monkeypatch.setattr(QC, "messy", lambda *_: raw)
    assert {tuple(r) for r in QC.prf_04(spark, "").collect()} == {("search", "Search"), ("Searchx", "Search")}
    assert [tuple(r) for r in QC.jn_14(spark, "").collect()] == [("search", "searchx")]


def test_every_document_is_tidied(spark, monkeypatch):
    texts = [("en", " a\t\tb "), ("en", "caf\u00e9\u00a0\u2003 d\u00e9j\u00e0"), ("de", "\u3000\u00fcber \u2028\r\n\u0085 alles\u202f"), ("fr", "\u1680\u205f"), ("es", "ni\u00f1o\x0b\x0c\u2009\U0001f600 x"), (None, None), ("en", "a\u200bb")]
    docs = spark.createDataFrame([(i, v, lang) for i, (lang, v) in enumerate(texts)], "doc_id long, text string, lang string")
    monkeypatch.setattr(QS, "table", lambda *_: docs)
    blanks = "[\\t-\\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    got = {r["doc_id"]: r["tidy"] for r in QS.QUERIES["fn_21_whole"](spark, "").collect()}
    assert got == {i: re.sub(blanks, " ", v or "").strip(" ") for i, (_, v) in enumerate(texts)}


def test_clean_of_an_empty_table_has_its_columns(spark):
    raw = spark.createDataFrame([], "source_row long, Day string, Cost string")
    table, log = CL.clean(raw, {"date": "Day", "spend": "Cost"})
    assert table.count() == 0 and log.count() == 0 and {"date", "spend", "dq_flags"} <= set(table.columns)


def test_response_curve_recovers_its_exponent(spark):
    weeks = [("Paid Search", dt.date(2025, 1, 6) + dt.timedelta(weeks=i), s := 100.0 + 37 * (i * 7 % 11), 3 * s**0.5, 9.0) for i in range(40)]
    weekly = spark.createDataFrame(weeks, "channel string, week date, spend double, conversions double, revenue double")
    fit = RC.fit_channels(weekly).first()
    assert fit["status"] == "fitted" and fit["b"] == pytest.approx(0.5) and fit["r2"] == pytest.approx(1) and fit["confidence"] == "High"
    again = RC.bootstrap(weekly).first()
    assert again["b_low"] == pytest.approx(0.5) and again["b_high"] == pytest.approx(0.5)


def test_planted_anomalies_are_found(spark):
    df = GEN.campaigns(spark).persist()
    found = A.weekly_anomalies(df, "campaign_name", "campaign", metrics=["spend", "lead_qualification_rate", "cpl"]).collect()
    hits = {(r["entity"], r["metric"]) for r in found}
    assert {("Campaign 1", "spend"), ("Campaign 4", "lead_qualification_rate"), ("Campaign 5", "cpl")} <= hits
    outage = A.tracking_outages(df, "campaign_name", "platform").collect()
    assert [(r["days"], r["campaigns"]) for r in outage] == [(2, ["Campaign 2"])]
    calm = A.weekly_anomalies(GEN.campaigns(spark, planted=False), "campaign_name", "campaign", metrics=["spend"])
    assert calm.count() == 0
    df.unpersist()


def test_every_metric_and_outages_reach_the_queries(spark, monkeypatch):
    df = GEN.campaigns(spark).persist()
    monkeypatch.setattr(QD, "rows", lambda *_: df)
    stored = QD._stored(QD._all_found(df))
    monkeypatch.setattr(QD, "_all_found", lambda _: stored)
    found = QD.ano_01(spark, "").collect()
    hits = {(r["entity_type"], r["entity"], r["metric"]) for r in found}
    assert {("campaign", "Campaign 1", "spend"), ("campaign", "Campaign 4", "lead_qualification_rate"), ("campaign", "Campaign 5", "cpl"), ("campaign", "Campaign 3", "lead_to_conversion_rate"), ("region", "South", "revenue")} <= hits
    lost = [(r["entity"], r["start"], r["end_date"]) for r in found if r["entity_type"] == "platform"]
    assert lost == [("Display network", "2026-04-19", "2026-04-20")]
    incidents = QD.inc_03(spark, "").collect()
    assert {("outage", "Display network"), ("campaign", "Campaign 4"), ("region", "South")} <= {(r["entity_type"], r["entity"]) for r in incidents}
    df.unpersist()


def test_incidents_attach_to_their_channel(spark):
    day = dt.date
    rows = [(1, "channel", "Search", day(2026, 1, 1), day(2026, 1, 10)), (2, "campaign", "A", day(2026, 1, 2), day(2026, 1, 5)), (3, "campaign", "B", day(2026, 1, 4), day(2026, 1, 8)), (4, "campaign", "C", day(2026, 3, 1), day(2026, 3, 8))]
    incidents = spark.createDataFrame(rows, "number long, entity_type string, entity string, start date, end date")
    members = spark.createDataFrame([("channel", "Search", ["A", "B", "C"]), *(("campaign", c, [c]) for c in "ABC")], "entity_type string, entity string, campaigns array<string>")
    got = {r["number"]: r["parent"] for r in I.attach(incidents, members).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: None}


def test_evidence_and_answers(spark):
    answers = spark.createDataFrame([(1, "Spend was ₹1,00,000 and ROAS 3.2x"), (2, "Spend was ₹2,00,000"), (3, "It ran for 3 weeks in 2026")], "id long, text string")
    evidence = F.array(F.struct(F.lit(100_000.0).alias("value"), F.lit("money").alias("kind"), F.lit(0.5).alias("tolerance")), F.struct(F.lit(3.21).alias("value"), F.lit("ratio").alias("kind"), F.lit(0.005).alias("tolerance")))
    assert {r["id"]: r["status"] for r in FI.check_answers(answers, evidence).collect()} == {1: "verified", 2: "unverified", 3: "weak"}


def test_capabilities():
    caps = PR.capabilities({"date", "spend", "clicks", "campaign_id"})
    assert caps["cpc"] and caps["time_series"] and caps["campaign_analysis"] and not caps["roi"] and not caps["funnel"]
    assert not PR.capabilities({"date", "spend"}, date_share=0.2)["time_series"]


def test_files(spark, tmp_path):
    def written(name, data):
        path = tmp_path / name
        path.write_bytes(data)
        return f"file://{path}"

    raw, report = FILES.load_file(spark, written("a.csv", "My report\n\nDay;Cost;Cost\n2026-01-01;1,5;x\n;;\n2026-01-02;2,5;\n".encode("latin-1")))
    assert report.delimiter == ";" and raw.columns == ["source_row", "Day", "Cost", "Cost (2)"]
    assert [(r["Day"], r["Cost"]) for r in raw.orderBy("source_row").collect()] == [("2026-01-01", "1,5"), ("2026-01-02", "2,5")]
    for name, data in (("b.csv", b""), ("c.csv", b"a\0b"), ("d.xls", b"x"), ("e.pdf", b"x")):
        with pytest.raises(FILES.LoadError):
            FILES.load_file(spark, written(name, data))
    assert FILES.encoding_of(b"\xef\xbb\xbfa") == "utf-8-sig" and FILES.encoding_of("é".encode("latin-1")) == "latin-1"


def test_files_are_judged_by_their_whole_content(spark, tmp_path):
    plain = "".join(f"{i},name {i}\n" for i in range(8_000))
    assert len(plain) > FILES.SNIFF_BYTES
    cases = {"late.csv": ("Id,Name\n" + plain + "8000,caf\xe9\n").encode("latin-1"), "wide.csv": ("Id,Name\n" + plain + '8000,café,more,"a, ""b"""\n').encode()}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    raw, report = FILES.load_file(spark, f"file://{tmp_path}/late.csv")
    assert report.encoding == "latin-1" and raw.count() == 8_001
    assert raw.where("Id = '8000'").first()["Name"] == "café"
    raw, report = FILES.load_file(spark, f"file://{tmp_path}/wide.csv")
    assert report.encoding == "utf-8" and raw.columns == ["source_row", "Id", "Name", "Unnamed column 3", "Unnamed column 4"] and len(report.warnings) == 1
    assert tuple(raw.where("Id = '8000'").first())[1:] == ("8000", "café", "more", 'a, "b"')
    assert raw.count() == 8_001 and raw.where("`Unnamed column 3` is not null").count() == 1


def test_store_replaces_a_run_and_refuses_unknown_columns(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([("a", 1.0)], "channel string, spend double")
    store.save_records("r1", df)
    store.save_records("r2", df)
    store.save_records("r1", df.withColumn("spend", F.lit(2.0)))
    assert [r["spend"] for r in store.load_records("r1").collect()] == [2.0] and store.load_records("r2").count() == 1
    with pytest.raises(ValueError):
        store.save_records("r1", df.withColumn("zork", F.lit(1)))
    with pytest.raises(ValueError):
        store.save_analysis("r1", "zork", df)
    store.drop_run("r1")
    assert store.load_records("r1").count() == 0


def test_what_stands_out(spark):
    table = spark.createDataFrame([("Search", 44.8, 55.3, 6.67, 90.0), ("Video", 40.0, 30.0, 2.0, 40.0), ("Mail", 0.0, 0.0, 2.0, None), ("Other", 15.2, 14.7, 9.0, 1.0), (None, 1.0, 99.0, 99.0, 1.0)], "channel string, spend_share double, revenue_share double, roas double, spend double")
    got = lambda df: sorted((r["kind"], r["measure"], r["entity"], r["value"], r["beside"]) for r in df.collect())
    assert got(SO.gap(table, "channel", "revenue_share")) == [("gap", "revenue_share", "Search", 55.3, 44.8)]
    assert got(SO.gap(table.where("channel = 'Video'"), "channel", "revenue_share")) == []
    found = SO.extremes(SO.facts(table, "channel", ["roas", "spend"]), {"roas": 4.18})
    assert got(found) == [("best", "roas", "Search", 6.67, 4.18), ("highest", "spend", "Search", 90.0, None), ("lowest", "spend", "Video", 40.0, None), ("worst", "roas", "Mail", 2.0, 4.18)]
    assert got(SO.extremes(SO.facts(table.where("channel = 'Video'"), "channel", ["roas"]))) == []
    funnel = spark.createDataFrame([(0, "impressions", 1000.0, None), (1, "clicks", 50.0, 5.0), (2, "leads", 10.0, 20.0), (3, "conversions", 9.0, 90.0), (6, "revenue", 1.0, None)], "place int, stage string, value double, rate double")
    assert got(SO.narrowest(funnel)) == [("step", "rate", "clicks to leads", 20.0, None)]
    days = [(dt.date(2025, 1, 1) + dt.timedelta(days=i), 100.0 if i < 28 else 87.6, 3) for i in range(56)]
    df = spark.createDataFrame(days, "date date, revenue double, clicks long")
    moved = SO.changes(df, {"date", "revenue", "clicks"})
    assert [(k, m, round(v, 6), n) for k, m, _, v, n in got(moved)] == [("change", "revenue", -12.4, 28.0)]
    assert got(SO.changes(df.where("false"), {"date", "revenue"})) == []
    plans = spark.createDataFrame([("a", 130.0, 100.0), ("b", 101.0, 100.0), ("c", 1.0, 0.0)], "channel string, projected double, budget double")
    assert got(SO.pace(plans, "channel", "projected", "budget")) == [("pace", "budget_utilisation", "a", 130.0, 100.0)]
    profit = spark.createDataFrame([("a", -5.0), ("b", 5.0)], "campaign string, contribution double")
    assert got(SO.losses(profit, "campaign")) == [("loss", "contribution", "a", -5.0, None)]
    weeks = spark.createDataFrame([("leads", 5.0), ("leads", 7.0)], "measure string, value double")
    assert got(SO.outlook(weeks, weeks.limit(1))) == [("outlook", "leads", None, 12.0, 5.0)]
    lines = {r["kind"]: r["line"] for r in SO.worded(found.unionByName(SO.narrowest(funnel)).unionByName(moved)).collect()}
    assert "Search" in lines["best"] and "6.67" in lines["best"] and "ROAS" in lines["best"] and "20.0%" in lines["step"] and "down 12.4%" in lines["change"]
    assert all(lines.values())


def test_roles_come_from_names_and_mapping(spark):
    columns = ["Cost", "Clicks", "Web sales", "Cost per click", "Store transactions", "Sales"]
    found = PR.roles(spark, columns, {"spend": "Cost", "clicks": "Clicks", "revenue": "Sales"})
    assert {(r["role"], r["column"], r["claimed"]) for r in found.collect()} == {
        ("spend", "Cost", True), ("clicks", "Clicks", True), ("revenue", "Web sales", False), ("revenue", "Sales", True), ("orders", "Store transactions", False), ("net_return", PR.NET_RETURN, True),
    }
    trials = {(r["check"], r["numerator"], r["denominator"], r["rank"]) for r in PR.trials_of(found, {"ROAS": "x", "AOV": "y", "CPC": "z"}).collect()}
    assert trials == {("ROAS", "Sales", "Cost", 0), ("ROAS", "Web sales", "Cost", 2), ("CPC", "Cost", "Clicks", 0), ("AOV", "Sales", "Store transactions", 1), ("AOV", "Web sales", "Store transactions", 2)}


def test_quoted_line_ends_over_many_tasks(spark, tmp_path):
    """Random files in small byte ranges against the csv module over the whole file, numbers and texts alike."""
    import csv
    import random

    from tallyspark.sources import records as RE

    rng = random.Random(7)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for case, signs in enumerate(["ab", 'a",\n', 'a ,"\n\n', 'é;"\nx', '"\n']):
            path = tmp_path / f"f{case}.csv"
            fields = lambda: "".join(rng.choices(signs, k=rng.randint(0, 12)))
            lines = [",".join(rng.choice([fields().replace('"', "").replace("\n", "").replace(",", ""), '"' + fields().replace('"', '""') + '"', fields().replace("\n", "")]) for _ in range(3)) for _ in range(150)]
            path.write_bytes(("\n".join(lines) + rng.choice(["", "\n"])).encode())
            packed = RE.chunks(spark, f"file://{path}")
            assert packed.select("block").distinct().count() > 3
            got = {r["record"]: r["cells"] for r in RE.read_records(packed, ",", "utf-8").collect()}
            with open(path, newline="", encoding="utf-8") as file:
                want = dict(enumerate(csv.reader(file)))
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])
