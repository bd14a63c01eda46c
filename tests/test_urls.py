import pytest
from pyspark.sql import functions as F

from leadloom.functions import urls as U
from leadloom.schemas import SourceConfig
from leadloom.sources.boards import frontier

BASE = "https://Host.example/a/b.html?q=1#f"


def test_resolve(values):
    cases = {
        "https://x.example": "https://x.example/",
        "HTTP://X.example/P": "http://x.example/P",
        "//y.example/z": "https://y.example/z",
        "/c/d": "https://host.example/c/d",
        "e": "https://host.example/a/e",
        "../e/./f/..": "https://host.example/e/",
        "?z=2": "https://host.example/a/b.html?z=2",
        "#top": "https://host.example/a/b.html?q=1#top",
        " /łódź x ": "https://host.example/%C5%82%C3%B3d%C5%BA%20x",
        "/100%25": "https://host.example/100%25",
        "mailto:a@b": "mailto:a@b",
    }
    assert values(lambda v: U.resolve(v, F.lit(BASE)), *cases) == list(cases.values())


def test_identity_ignores_query_and_fragment(values):
    urls = ["https://h.example/p/1?x#y", "https://h.example", "https://h.example?x=/q", "https://h.example/ł"]
    assert values(lambda v: U.external_id(F.lit("s"), v), *urls) == ["s:/p/1", "s:/", "s:/", "s:/%C5%82"]


def test_component_encoding(values):
    assert values(U.encode_component, "a b+c/~!'()*é") == ["a%20b%2Bc%2F~!'()*%C3%A9"]


def _urls(spark, source, base, filters, pages=2):
    rows = frontier(spark, SourceConfig(source, base, filters, pages)).orderBy("page_no").collect()
    return [r["url"] for r in rows]


def test_query_frontier(spark):
    full = {
        "keyword": "c# dev", "category": "js", "location": "łódź", "working_mode": "remote",
        "experience_level": "mid", "min_salary": 15000, "salary_currency": "PLN", "with_salary": True,
    }
    assert _urls(spark, "justjoinit", "https://b.example", full) == [
        "https://b.example/job-offers/all-locations?keyword=c%23+dev&category=js&location=%C5%82%C3%B3d%C5%BA"
        "&working-mode=remote&experience-level=mid&salary-from=15000&salary-currency=PLN&with-salary=true"
    ]
    assert _urls(spark, "justjoinit", "https://b.example/", {"min_salary": 0, "keyword": ""}) == [
        "https://b.example/job-offers/all-locations"
    ]


def test_path_frontier(spark):
    assert _urls(spark, "nofluffjobs", "https://b.example", {"location": " Nowy  Sącz", "keyword": "C#"}) == [
        "https://b.example/pl/nowy-s%C4%85cz/c#",
        "https://b.example/pl/nowy-s%C4%85cz/c?page=2#",
    ]
    assert _urls(spark, "nofluffjobs", "https://b.example", {})[0] == "https://b.example/pl"


def test_comma_frontier(spark):
    assert _urls(spark, "bulldogjob", "https://b.example", {"keyword": " Node JS "}) == [
        "https://b.example/companies/jobs/s/skills,Node%20JS",
        "https://b.example/companies/jobs/s/skills,Node%20JS/page,2",
    ]
    with pytest.raises(Exception, match="keyword is required"):
        _urls(spark, "bulldogjob", "https://b.example", {})
