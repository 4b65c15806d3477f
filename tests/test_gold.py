"""Operators against hand-made rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions import checks as C
from evidentia.functions import text as X
from evidentia.operators import graph as G
from evidentia.operators import html as H
from evidentia.operators import ledger as L
from evidentia.operators import pii as P
from evidentia.operators import rates as R
from evidentia.operators import recon as K
from evidentia.operators import refs as A
from evidentia.operators import text as O
from evidentia.sources import files as S

D = dt.date.fromisoformat

IDS = {
    C.inn_valid: (["1655248572", "7728168971"], ["1655248573", "1657246601", "12", ""]),
    C.ogrn_valid: (["1021600000124", "1027739642281", "1021603150150"], ["1021600000125", "1161690019502"]),
    C.kpp_valid: (["165501001", "7728AB001"], ["165500001", "1655001", "16550AB010"]),
    C.snils_valid: (["123-456-789 64", "111-222-333 72", "555-666-777 50", "001-001-998 00"], ["123-456-789 63", "000-000-000 00", "111-111-111 11"]),
    C.bik_valid: (["044525593", "042202824", "040397100", "200000154", "100070023"], ["999999999", "04452559", "0445255931", "000000000", ""]),
    C.isin_valid: (["US4581401001", "US7170811035", "US7802593050", "RU0007661625"], ["US7805293050", "US481401001"]),
    C.luhn_valid: (["4111111111111111", "79927398713"], ["4111111111111112", "x"]),
}


@pytest.mark.parametrize("check", IDS, ids=lambda f: f.__name__)
def test_identifiers(spark, check):
    good, bad = IDS[check]
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, want boolean")
    assert df.filter(check("v") != F.col("want")).collect() == []


def test_accounts(spark):
    rows = [("40817810808430000005", "044525593", True), ("40702810029160002367", "042202824", True), ("40702810929070003307", "042202824", True), ("30101810200000000824", "042202824", True), ("30101810200000000593", "044525593", True), ("40817810808430075620", "044525593", False)]
    assert spark.createDataFrame(rows, "a string, b string, w boolean").filter(C.account_valid("a", "b") != F.col("w")).count() == 0


def test_mod97_and_cadastre(spark):
    ok = spark.createDataFrame([("16RS0048-01-2026-000297-14", False), ("16RS0048", False), ("", False)], "v string, w boolean")
    assert ok.filter(C.mod97_valid("v") != F.col("w")).count() == 0
    iban = spark.createDataFrame([("3214282912345698765432161182",)], "v string")  # GB82 WEST... rearranged, remainder 1
    assert iban.select(C.mod97_valid("v")).first()[0]
    rows = [(" 16:50:011234:567 ", None), ("77:01:0004042:1234", None), ("90:01:0011223:44", None), ("16-50-011234-567", "shape"), ("16:50:011234", "shape"), ("00:50:011234:5", "district"), ("92:01:0004042:1234", "district"), ("16:50:01123:567", "shape"), ("16:50:011234:0", "parcel"), ("", "empty")]
    df = spark.createDataFrame(rows, "v string, w string")
    assert df.filter(~C.cadastre_check("v").eqNullSafe(F.col("w"))).collect() == []


def test_rates(spark):
    rates = spark.createDataFrame([(D("2025-12-20"), 16.0), (D("2026-01-02"), 21.0), (D("2026-01-05"), 18.0)], "dt date, rate double")
    assert [r.rate for r in R.fill_daily(rates, "2026-01-01", "2026-01-06").orderBy("dt").collect()] == [16, 21, 21, 21, 18, 18]
    debts = spark.createDataFrame([(1, 100000.0, D("2025-01-01"), D("2025-12-31")), (2, 1e6, D("2026-01-01"), D("2026-01-03"))], "id long, amount double, since date, until date")
    rates = spark.createDataFrame([(D("2025-01-01"), 20.0), (D("2026-01-01"), 21.0), (D("2026-01-03"), 18.0)], "dt date, rate double")
    year = F.dayofyear(F.make_date("y", F.lit(12), F.lit(31)))
    got = R.accrue(debts, rates, year).orderBy("id", "from_d").collect()
    assert [(r.days, round(r.interest, 2)) for r in got if r.id == 1] == [(365, 20000.0)]
    assert len(got) == 3 and round(sum(r.interest for r in got if r.id == 2), 2) == round(1e6 * 21 / 100 * 2 / 365 + 1e6 * 18 / 100 / 365, 2)


def test_tiers(spark):
    tiers = spark.createDataFrame([(1e5, 4000.0, 0.0, 0.0, None), (3e5, 4000.0, 0.03, 1e5, None), (5e5, 10000.0, 0.025, 3e5, None), (None, 314000.0, 0.0015, 1e8, 900000.0)], "upto double, base double, pct double, over double, cap double")
    df = spark.createDataFrame([(p,) for p in (50000.0, 100000.0, 200000.0, 450000.0, 1e10, 0.0)], "p double")
    assert {r.p: r.duty for r in R.tiered_duty(df, "p", tiers).collect()} == {50000.0: 4000, 100000.0: 4000, 200000.0: 7000, 450000.0: 13750, 1e10: 900000, 0.0: None}


def test_calendar(spark):
    cal = R.calendar_fallback(spark, "2026-01-01", "2027-12-31", ["01-01", "01-02", "05-01", "05-09", "06-12", "11-04"])
    df = spark.createDataFrame([(D("2026-07-31"),), (D("2026-08-03"),)], "s date")
    assert {str(r.s): str(r.deadline) for r in R.working_deadline(df, "s", 1, cal).collect()} == {"2026-07-31": "2026-08-03", "2026-08-03": "2026-08-04"}
    assert str(R.working_deadline(df.filter("s = '2026-08-03'"), "s", 5, cal).first().deadline) == "2026-08-10"
    ends = spark.createDataFrame([(D("2026-08-03"),)], "s date").select(X.term_end("s", days=5).alias("e"))
    assert str(ends.first().e) == "2026-08-08" and str(R.moved_deadline(ends, "e", cal).first().deadline) == "2026-08-10"
    one = spark.createDataFrame([(D("2026-08-14"),)], "s date")
    assert str(one.select(X.term_end("s", months=1)).first()[0]) == "2026-09-14" and str(one.select(X.term_end("s", years=1)).first()[0]) == "2027-08-14"
    mask = spark.createDataFrame([(2026, "1" * 8 + "0" * 357), (2024, "0" * 365), (2026, "111")], "year int, mask string")
    got = R.calendar_from_mask(mask).collect()
    assert len(got) == 365 and not got[0].is_working and got[8].is_working
    text = json.dumps({"year": 2026, "months": [{"month": 1, "days": "1,2,9+,20*"}]})
    assert sorted(str(r.d) for r in R.calendar_from_json(spark.createDataFrame([(text,)], "json string")).collect()) == ["2026-01-01", "2026-01-02", "2026-01-09"]


def test_rate_feed(spark):
    xml = "<r><KR><DT>2026-01-02T00:00</DT><Rate>21,00</Rate></KR><KR><DT>2026-02-02</DT><Rate>18.5</Rate></KR></r>"
    assert [(str(r.dt), float(r.rate)) for r in R.parse_rates(spark.createDataFrame([(xml,)], "x string"), "x").collect()] == [("2026-01-02", 21.0), ("2026-02-02", 18.5)]


def numbers(spark, text, least=2):
    df = O.number_tokens(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", least)
    return {r.token: r.n for r in df.collect()}


def test_numbers(spark):
    assert numbers(spark, "№ 5 12 500,00") == {"12500.00": 1}
    assert numbers(spark, "п. № 3 1 250 000 руб.") == {"1250000": 1}
    assert numbers(spark, "по счету № 7 900 000 руб.", 4) == {"900000": 1}
    assert numbers(spark, "код 44", 4) == {}
    assert numbers(spark, "1 250 000 and 4412 and 12 500", 4) == {"1250000": 1, "4412": 1, "12500": 1}


def test_money_and_plurals(spark):
    df = spark.createDataFrame([("38 998,29", "38998.29"), ("1,250,000", "1250000.00"), ("0", None), ("abc", None)], "v string, w string")
    assert df.filter(~X.money_parse("v").cast("string").eqNullSafe(F.col("w"))).collect() == []
    n = spark.createDataFrame([(1,), (3,), (5,), (11,), (21,), (112,)], "n int").select(X.plural_form("n", F.lit("a"), F.lit("b"), F.lit("c")))
    assert [r[0] for r in n.collect()] == ["a", "b", "c", "c", "a", "c"]


def test_text_measures(spark):
    df = spark.createDataFrame([("Росскiской слово",), ("plain words here",)], "t string").select(X.mixed_script("t").alias("m"))
    assert [r.m.bad for r in df.collect()] == [1, 0]
    faux = spark.createDataFrame([("TPEXAMET XOTOBOPA APEHXA " * 12,), ("An ordinary legal sentence of the court. " * 8,), ("PDF OCR",)], "t string")
    assert [r[0] for r in faux.select(X.faux_alphabet("t", "ABCEHKMOPTXaceopxy", 0.2)).collect()] == [True, False, None]
    dates = spark.createDataFrame([("от 01.02.2024 и 5 марта 2023, 99.99.2024",)], "t string").select(X.parse_dates("t")).first()[0]
    assert [str(d) for d in dates] == ["2024-02-01", "2023-03-05"]
    assert spark.createDataFrame([("Shchukin Yuri",)], "t string").select(X.translit("t")).first()[0] == "щукин юри"


def test_masking_round_trip(spark):
    text = "Write to a.b@c.org or +7 (499) 555-6503, card 4111 1111 1111 1111; again a.b@c.org."
    df = P.mask(spark.createDataFrame([(1, text), (2, "nothing here")], "id long, t string"), "t")
    one, two = df.orderBy("id").collect()
    assert one.masked == "Write to [EMAIL_1] or [PHONE_1], card [CARD_1]; again [EMAIL_2]." and two.masked is None and two.mapping == []
    back = df.select("id", P.unmask(F.col("masked"), F.col("mapping")).alias("b"), P.residual_gate(F.col("masked")).alias("g")).orderBy("id").collect()
    assert back[0].b == text and back[0].g.released and not back[1].g.released


def test_overlap_resolution(spark):
    spans = [(0, 5, "A"), (0, 9, "B"), (4, 12, "C"), (9, 10, "D")]
    df = spark.createDataFrame([(spans,)], f"s {P.SPANS}")
    assert [tuple(x) for x in df.select(P.resolve_spans(F.col("s"))).first()[0]] == [(0, 9, "B"), (9, 10, "D")]


def test_fold_confusables(spark):
    df = spark.createDataFrame([("pаsswоrd​", "password"), ("слово", "слово"), (None, None)], "t string, w string")
    assert df.filter(~P.fold_confusables(F.col("t")).eqNullSafe(F.col("w"))).count() == 0


def test_reconcile_and_twins(spark):
    def keys(*x):
        return spark.createDataFrame([(k,) for k in x], "key string")

    got = {r.key: r.status for r in K.reconcile(keys("a", "ghost"), keys("a", "b"), keys("a", "b", "c"), "key").collect()}
    assert got == {"a": "ok", "b": "missing_in_index", "c": "missing_in_both", "ghost": "ghost"}
    q = spark.createDataFrame([(1, "petrovich"), (2, "ivan")], "qid long, name string")
    p = spark.createDataFrame([(1, "petrowiсh".replace("с", "c")), (2, "iven"), (3, "ovan x"), (4, " ")], "pid long, name string")
    assert {(r.qid, r.hits, r.unknown) for r in A.conflict_check(q, p).collect()} == {(1, 1, 1), (2, 1, 1)}


def test_citations(spark):
    sections = spark.createDataFrame([("cc", "12", False), ("cc", "13.1", True)], "code string, num string, repealed boolean")
    aliases = spark.createDataFrame([("Civil code", "cc"), ("Tax code", "tc")], "alias string, code string")
    qs = spark.createDataFrame(list(enumerate(["civil code 12", "Civil Code 13.1", "civil code 1", "tax code 5", "other 5", "civil code"])), "qid long, text string")
    got = {r.qid: r.status for r in A.resolve_citations(qs, sections, aliases).collect()}
    assert got == {0: "found", 1: "repealed", 2: "missing", 3: "not_exported", 4: "unknown_code", 5: "no_number"}


def test_ledger(spark):
    rows = [("s", 1, None), ("s", 2, 6), ("s", 3, None), ("s", 4, 2), ("t", 1, None)]
    df = spark.createDataFrame(rows, "stream string, line int, signal int")
    assert [r.step for r in L.sticky_step(df).orderBy("stream", "line").collect()] == [0, 6, 6, 2, 0]
    chain = spark.createDataFrame([("ccc", "bbb"), ("bbb", "aaa"), ("x", "y"), ("y", "x")], "c string, p string")
    got = {r.c: r.root for r in L.roots(chain, "c", "p").collect()}
    assert got["ccc"] == got["bbb"] == "aaa" and len(got) == 4


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, v string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "i int, v string")
    assert L.fingerprint(a, ["i", "v"]).collect() == L.fingerprint(b, ["i", "v"]).collect() != L.fingerprint(a.limit(1), ["i", "v"]).collect()


def test_components_and_defects(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (10, 11)], "source long, target long")
    label = G.components(e)
    assert {r.id: r.component for r in label.collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10}
    assert {r.component: round(r.cohesion, 3) for r in G.cohesion(e, label).collect()} == {1: 0.667, 10: 1.0}


def test_tables_and_front_matter(spark):
    text = "intro\n| a | b |\n|---|---|\n| 1 | 2 |\n\n| c |\n| 3 |"
    got = O.pipe_tables(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").orderBy("line_no").collect()
    assert [(r.headers, r.cells) for r in got] == [(["a", "b"], ["1", "2"]), (["c"], ["3"])]
    meta = H.front_matter(spark.createDataFrame([(1, "---\ntitle: T x\ntags: [a, b]\n---\nbody: no")], "id long, t string"), "id", "t").collect()
    assert [(r.field, r.value) for r in meta] == [("title", "T x"), ("tags", "a"), ("tags", "b")]


def test_markers_are_not_found_in_fences_or_quotes(spark):
    df = spark.createDataFrame([(1, "```\nDONE\n```"), (2, "> DONE"), (3, "DONE"), (4, "not DONE")], "id long, t string")
    assert {r.id: r.marked for r in O.has_marker(df, "id", "t", "DONE").collect()} == {1: False, 2: False, 3: True, 4: False}


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"v": 1}\n{"v": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"v": 5}\n{"v": \n')
    rows = S.read_jsonl(spark, str(tmp_path / "*.jsonl"), T.StructType([T.StructField("v", T.LongType())])).cache()
    assert rows.filter("_corrupt is null").count() == 3
    assert {r.file[-7:]: (r.status, r.total) for r in S.strict_totals(rows, "v").collect()} == {"a.jsonl": ("ok", 3), "b.jsonl": ("corrupt", None)}
    files = S.scan_files(spark, str(tmp_path)).collect()
    assert {(f.ext, f.route, f.size) for f in files} == {("jsonl", "other", 18)} or len(files) == 2


def test_statement(spark):
    text = [(1, 1, "header"), (1, 2, "01.02.2024 card 1 250,00 shop"), (1, 3, "phone +7"), (1, 4, "02.02.2024 -5,00")]
    got = S.parse_statement(spark.createDataFrame(text, "doc long, pos int, line string"), "doc", "pos", "line").orderBy("op").collect()
    assert [(str(r.day), float(r.amount), r.text) for r in got] == [("2024-02-01", 1250.0, "01.02.2024 card 1 250,00 shop phone +7"), ("2024-02-02", -5.0, "02.02.2024 -5,00")]


def test_snapshot(spark, tmp_path):
    df = spark.range(3)
    assert S.publish_snapshot(df, f"{tmp_path}/s", "one") and not S.publish_snapshot(df, f"{tmp_path}/s", "one")
    assert S.publish_snapshot(spark.range(5), f"{tmp_path}/s", "two") and S.read_snapshot(spark, f"{tmp_path}/s").count() == 5


def test_tail_of_growing_files(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    a, b = tmp_path / "logs" / "a.jsonl", tmp_path / "logs" / "b.jsonl"

    def read(state):
        lines, state = S.tail_files(spark, str(tmp_path / "logs"), state)
        rows = {(r.path.split("/")[-1], r["at"], r.line) for r in lines.collect()}
        state = spark.createDataFrame(state.collect(), "path string, offset long, size long, restarted boolean, waiting boolean")
        return rows, state, {r.path.split("/")[-1]: (r.offset, r.restarted, r.waiting) for r in state.collect()}

    a.write_text("one\nzwölf\nto")
    rows, state, seen = read(None)
    assert rows == {("a.jsonl", 0, "one"), ("a.jsonl", 4, "zwölf")} and seen == {"a.jsonl": (11, False, True)}
    a.write_text("one\nzwölf\ntorn\n")
    b.write_text("x\n")
    rows, state, seen = read(state)
    assert rows == {("a.jsonl", 11, "torn"), ("b.jsonl", 0, "x")} and seen["a.jsonl"] == (16, False, False)
    assert read(state)[0] == set()
    a.write_text("new\n")
    rows, state, seen = read(state)
    assert rows == {("a.jsonl", 0, "new")} and seen["a.jsonl"] == (4, True, False)
