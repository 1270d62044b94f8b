import random

import pytest

from gridloam.operators import compare
from gridloam.plans import dates, intent
from gridloam.plans.engine import Engine
from gridloam.plans.query import Plan, UnknownRegion, month_bounds, parse, resolve_region
from gridloam.sources import tables

CASES = [
    ("mean soil moisture in Rajasthan in June 2020", "mean", ["rajasthan"], [("2020-06-01", "2020-06-30")]),
    ("himachal pradesh winter 2020 mean", "mean", ["himachal pradesh"], [("2020-12-01", "2021-02-28")]),
    ("average Sikkim post-monsoon 2021", "mean", ["sikkim"], [("2021-10-01", "2021-11-30")]),
    ("trend in uttar pradesh from 2018 to 2022", "slope", ["uttar pradesh"], [("2018-01-01", "2022-12-31")]),
    ("compare India in 2018, 2020 and 2022", "comparison", ["india"], [dates.year_span(y) for y in (2018, 2020, 2022)]),
    ("compare rajasthan monsoon 2020 and monsoon 2021", "comparison", ["rajasthan"], [("2020-06-01", "2020-09-30"), ("2021-06-01", "2021-09-30")]),
    ("compare Rajasthan and Gujarat in 2021", "comparison", ["rajasthan", "gujarat"], [dates.year_span(2021)]),
    ("average in west bengal between 2019 and 2021", "mean", ["west bengal"], [("2019-01-01", "2021-12-31")]),
    ("mean punjab on 15-08-2021", "mean", ["punjab"], [("2021-08-15", "2021-08-15")]),
    ("data for UP in 2021", "mean", ["uttar pradesh"], [dates.year_span(2021)]),
    ("compare kerala Q1 2021 vs Q3 2022", "comparison", ["kerala"], [("2021-01-01", "2021-03-31"), ("2022-07-01", "2022-09-30")]),
    ("mean of kerala in june and july 2020", "mean", ["kerala"], [("2020-06-01", "2020-07-31")]),
    ("mean of kerala for june and july in 2020", "mean", ["kerala"], [("2020-06-01", "2020-06-30"), ("2020-07-01", "2020-07-31")]),
    ("compare punjab june vs july 2020", "comparison", ["punjab"], [("2020-06-01", "2020-06-30"), ("2020-07-01", "2020-07-31")]),
    ("minimum bihar from 2020-02-03 to 2020-01-05", "minimum", ["bihar"], [("2020-01-05", "2020-02-03")]),
    ("mean assam last 6 months", "mean", ["assam"], [("2023-07-04", "2023-12-31")]),
    ("goa may 5 to 9, 2021", "mean", ["goa"], [("2021-05-05", "2021-05-09")]),
    ("mean goa 31 February 2021", "mean", ["goa"], [("2021-02-28", "2021-02-28")]),
    ("maximum in odisha jjas 2019", "maximum", ["odisha"], [("2019-06-01", "2019-09-30")]),
    ("wettest month in tripura in 2020", "maximum", ["tripura"], [dates.year_span(2020)]),
    ("slope kerala june 2015 to may 2018", "slope", ["kerala"], [("2015-06-01", "2018-05-31")]),
    ("mean rajsthan 2021-06", "mean", ["rajasthan"], [("2021-06-01", "2021-06-30")]),
    ("maximum in goa in 2020 and rate of change according to paper.pdf", "maximum", ["goa"], [dates.year_span(2020)]),
    ("driest state in 2020", "driest_region", [], [dates.year_span(2020)]),
    ("pre-monsoon 2019 mean in bihar", "mean", ["bihar"], [("2019-03-01", "2019-05-31")]),
    ("rabi 2019 mean in bihar", "mean", ["bihar"], [("2019-10-01", "2020-03-31")]),
    ("end of 2020 mean in bihar", "mean", ["bihar"], [("2020-12-01", "2020-12-31")]),
    ("compare goa 2019 vs 2020 vs 2021", "comparison", ["goa"], [dates.year_span(y) for y in (2019, 2020, 2021)]),
    ("mean goa 13/02/2020 to 02/03/2020", "mean", ["goa"], [("2020-02-13", "2020-03-02")]),
]


@pytest.mark.parametrize("question,operation,regions,spans", CASES)
def test_parse(question, operation, regions, spans):
    plan = parse(question)
    assert (plan.operation, list(plan.regions), list(plan.spans)) == (operation, regions, spans) and plan.problem is None


def test_evaluation_calendar():
    assert parse("average Sikkim post-monsoon 2021", evaluation=True).spans == (("2021-10-01", "2021-12-31"),)


def test_problems_and_follow_up():
    plan = parse("mean in June 2020")
    assert plan.problem == "which region?"
    assert plan.patch("kerala").regions == ("kerala",) and plan.patch("kerala").problem is None and plan.patch("kerala").spans == plan.spans
    assert parse("hm").problem == "too short"
    assert parse("compare kerala 2020 with before").problem == "which periods?"
    assert parse("how many years of data are there").operation == "coverage" and parse("which year was the driest nationally").metric == "min"


def test_outputs():
    assert parse("mean kerala 2020 just the value").output == "scalar"
    assert parse("only the map of kerala 2020").output == "map"
    assert parse("what is the mean of kerala 2020").output == "scalar"
    assert parse("show the mean of kerala 2020").output == "both"


def test_binding():
    plan = Plan("mean", ("goa",), (("2001-01-01", "2002-12-31"), ("2030-01-01", "2031-01-01"))).bind("2002-07-01", "2023-12-30")
    assert plan.spans == (("2002-07-01", "2002-12-31"),) and len(plan.warnings) == 2
    assert Plan("mean", ("goa",)).bind("2002-07-01", "2023-12-30").spans == (("2002-07-01", "2023-12-30"),)
    assert plan.bind("2002-07-01", "2023-12-30") == plan
    assert month_bounds("2020-02", False) == "2020-02-29" and month_bounds("2020-02", False, True) == "2020-02-28" and month_bounds("2020-02", True) == "2020-02-01"


def test_regions():
    assert resolve_region("chhatisgarh", ["chhattisgarh", "goa"]) == "chhattisgarh" and resolve_region("goaa", ["goa", "kerala"]) == "goa"
    with pytest.raises(UnknownRegion):
        resolve_region("atlantis", ["goa", "kerala"])


@pytest.mark.parametrize("question,want", [("hello there", "chat"), ("mean of kerala in 2020", "dataset"), ("what retrieval algorithm is used", "literature"), ("mean in kerala 2020 and the algorithm in the paper", "both"), ("kerala 2020 figure 3", "both"), ("tell me more", None)])
def test_intents(question, want):
    assert intent.fast(question) == want and intent.route(question) == (want or "chat") and intent.route(question, lambda q: "dataset") == (want or "dataset")


def test_guards():
    assert intent.off_topic("bitcoin today") and not intent.off_topic("does a movie show soil moisture") and intent.about_sensor("SMAP trend")


def test_spans_are_ordered():
    rng = random.Random(0)
    words = ["2020", "2021", "june", "july", "to", "and", "q2", "2020-05", "3/4/2020", "winter", "between", "last 3 days", "vs", "kerala", "5", ",", "monsoon", "2019-01-02"]
    for _ in range(500):
        for a, b in dates.spans(" ".join(rng.choices(words, k=8))):
            assert a <= b and len(a) == len(b) == 10


def test_engine(spark):
    sf = "/root/testdata/sf0.01"
    engine = Engine(spark, tables.observations(spark, sf).cache(), tables.cell_region(spark, sf))
    plan = Plan("mean", ("nation_3",), (("1996-06-01", "1996-06-30"),))
    assert engine.execute(plan).scalars.first()["n_valid"] > 0 and engine.execute(plan).cells.count() > 0
    both = Plan("comparison", ("nation_3",), (("1996-01-01", "1996-12-31"), ("1997-01-01", "1997-12-31")), "slope", "time")
    got = engine.execute(both)
    assert got.scalars.where("winner").count() == 1 and got.cells.count() > 0 and compare.complete(got.scalars).count() == 2
    slope = engine.execute(Plan("slope", ("nation_3",), (("1996-01-01", "1996-12-31"),)))
    assert 0 <= slope.scalars.first()["p_value"] <= 1 and slope.days.count() == slope.scalars.first()["n"]
    regions = engine.execute(Plan("comparison", ("nation_3", "nation_7"), (("1996-01-01", "1996-12-31"),), "max", "region"))
    assert regions.scalars.count() == 2
    for q in ("which year was the wettest nationally", "how many years of data"):
        assert engine.ask(q).scalars.count() == 1
    assert engine.ask("driest state in 1996").scalars.count() == 3
    assert engine.execute(Plan("maximum", ("india",))).scalars.first()["value"] == 50.0
    assert engine.ask("mean in June 1996").scalars is None
    assert engine.execute(Plan("mean", ("nation_3",), (("2050-01-01", "2050-02-01"),))).scalars is None
