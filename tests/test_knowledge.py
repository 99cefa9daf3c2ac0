import json

from pyspark.sql import functions as F

from tidewrack.operators import enrich
from tidewrack.sources import knowledge


def claim(value, time=None, **more):
    c = {"mainsnak": {"datavalue": {"value": value}} if value is not None else {"snaktype": "novalue"}}
    if time:
        c["qualifiers"] = {"P585": [{"datavalue": {"value": {"time": time}}}], **more}
    return c


ENTITY = {
    "id": "Q1", "labels": {"en": {"value": "Acme"}, "de": {"value": "Akme"}}, "sitelinks": {"enwiki": {"title": "Acme (it's a ~ firm!) é"}},
    "claims": {
        "P571": [claim({"time": "+1999-00-00T00:00:00Z"})], "P31": [claim({"id": "Q4830453"}), claim({"id": "Q9"}), claim(None)],
        "P1128": [claim({"amount": "+90", "unit": "1"}), claim({"amount": "+120", "unit": "1"}, "+2020-01-01T00:00:00Z"), claim({"amount": "+7", "unit": "1"}, "+2019-01-01T00:00:00Z")],
        "P2139": [claim({"amount": "+5.5", "unit": "http://www.wikidata.org/entity/Q4917"}, "+2021-05-01T00:00:00Z")], "P856": [claim("https://www.acme.example/x"), claim("https://other.example")],
        "P159": [claim({"id": "Q64"})], "P414": [claim({"id": "Q99"})], "P154": [claim("My Logo.svg")], "P2002": [claim("acme")], "P249": [claim("ACM")],
    },
}


def landed(spark):
    rows = [json.dumps(ENTITY), json.dumps({"id": "Q2", "missing": ""}), "{broken", None, json.dumps({"id": "Q3"}), json.dumps({"claims": {}}), json.dumps({"id": "Q4", "claims": {"P31": []}})]
    return spark.createDataFrame([(r, "x") for r in rows], "json string, qid string")


def test_claims_of_nested_entities(spark):
    got = {(r.qid, r.property, r.pos): (r.value, r.unit, r.time) for r in knowledge.claims(landed(spark)).where("property IS NOT NULL AND pos IS NOT NULL").collect()}
    assert got["Q1", "P31", 0] == ("Q4830453", None, None) and got["Q1", "P31", 2] == (None, None, None) and {k[0] for k in got} == {"Q1"}
    assert got["Q1", "P1128", 1] == ("+120", "1", "+2020-01-01T00:00:00Z") and got["Q1", "P571", 0][0] == "+1999-00-00T00:00:00Z"
    assert len(got) == sum(map(len, ENTITY["claims"].values()))


def test_profiles_and_labels(spark):
    named = spark.createDataFrame([("Q64", "Berlin"), ("Q99", "Nowhere Exchange")], "id string, label string")
    r = {x.qid: x for x in knowledge.profile(landed(spark), named, this_year=2024).collect()}["Q1"]
    assert (r.founded_year, r.employee_count, r.employee_range, r.revenue_amount, r.revenue_currency) == (1999, 120, "51-200", 5.5, "USD")
    assert (r.hq_city, r.stock_exchange, r.stock_ticker, r.is_public) == ("Berlin", "Nowhere Exchange", "ACM", True)
    assert r.logo_url.endswith("/My_Logo.svg") and r.twitter_url == "https://twitter.com/acme" and r.linkedin_url is None
    assert r.wikipedia_url == "https://en.wikipedia.org/wiki/Acme_(it's_a_~_firm!)_%C3%A9"
    assert [tuple(x) for x in knowledge.labels(landed(spark)).collect()] == [("Q1", "Acme")]
    assert knowledge.labels(landed(spark), lang="de").first().label == "Akme"


def test_candidates_by_entity(spark):
    found = spark.createDataFrame([(1, 0, "Q1", "an aviation firm", "https://acme.example"), (1, 1, "Q2", "x", "https://acme.example"), (2, 0, "Q3", "x", None)], "company_id int, rank int, qid string, description string, website string")
    with_claims = knowledge.candidates(found, knowledge.claims(landed(spark)))
    assert {(r.company_id, r.qid, r.site) for r in with_claims.collect()} == {(1, "Q1", "https://www.acme.example/x"), (2, "Q3", None)}
    best = enrich.best_candidate(with_claims).collect()
    assert [(r.company_id, r.qid, r.score) for r in best] == [(1, "Q1", 119)]


def test_no_entities(spark):
    none = landed(spark).limit(0)
    assert knowledge.claims(none).count() == 0 and knowledge.profile(none, spark.createDataFrame([], "id string, label string")).count() == 0
