import duckdb
import pytest

from mapforge import queries
from mapforge.operators import catalog as C
from mapforge.plans import mapping, report

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def runs(spark):
    return mapping.example(spark)


@pytest.fixture(scope="module")
def first(runs):
    return runs[0]


def test_all_tables(runs):
    """Later tables see what earlier ones added; two questions a table at most, none answered."""
    assert [(r.reused, r.new, r.excluded, r.escalated) for r in mapping.counters(runs).orderBy("seq").collect()] == [(6, 1, 0, 1), (4, 3, 0, 0), (3, 3, 3, 2)]
    assert [m.subject.name for m in runs] == ["Organization", "Product", "Person"] and all(m.errors.isEmpty() for m in runs)
    before = runs[0].catalog.attributes.select("owner", "name", "datatype")
    added = runs[2].catalog.attributes.select("owner", "name", "datatype").exceptAll(before)
    assert sorted(map(tuple, added.collect())) == [
        ("Person", "date", "date"), ("Person", "notes", "string"), ("Person", "status", "string"),
        ("Product", "country_of_origin", "string"), ("Product", "distributor", "string"), ("Product", "warranty_months", "integer"),
    ]


def test_decisions(first):
    want = {
        "vendor": ("reuse", "Organization.name", 0.8333), "homepage_url": ("reuse", "Organization.website", 1.0), "established": ("reuse", "Organization.founded_year", 0.8333),
        "sector": ("reuse", "Organization.industry", 0.8333), "hq_city": ("reuse", "Place.city", 0.8333), "hq_country": ("reuse", "Place.country", 0.8333), "employee_count": ("new_attribute", "Organization.size", 0.5833),
    }
    rows = first.decisions.collect()
    assert {r.column: (r.disposition, r.candidates[0].doc_id, round(r.candidates[0].score, 4)) for r in rows} == want
    assert {r.column: list(r.gates_fired) for r in rows if r.gates_fired} == {"employee_count": ["near_duplicate"]}
    assert first.subject.name == "Organization" and first.n_cards == 41 and first.errors.isEmpty()
    assert [(r.id, r.column, r.gate, r.default) for r in first.questions.collect()] == [("csv1.q1", "employee_count", "near_duplicate", "keep_original")]
    assert [r.target for r in first.ops.where("op = 'flag_ontology_issue'").orderBy("seq").collect()] == ["Organization / Company", "Person.data", "Organization.size"]
    assert first.catalog.attributes.where("owner = 'Organization' and name = 'employee_count' and datatype = 'integer'").count() == 1


def test_reports(runs):
    text = report.markdown(runs[2], 6).first().value
    assert text.startswith("# Mapping report — 3_crm_export.csv\n\nRow count: 6\n\n## Subject type: `Person` (reused)\n")
    assert "\n| _id | exclude | - | 1.0 | rule | surrogate_key | False |\n| contact_name | reuse | Person.full_name |" in text
    assert text.count("<details>") == text.count("</details>") == 6
    one = report.summary(runs).first()
    assert one.totals.asDict() == {"columns": 23, "reused": 13, "new": 7, "excluded": 3, "escalated": 3}
    assert [(x.csv, x.stats["columns"]) for x in one.csvs] == [("1_vendors.csv", 7), ("2_product_catalog.csv", 7), ("3_crm_export.csv", 9)]


def test_profile(first):
    p = {r.name: r for r in first.profile.collect()}
    assert (p["hq_country"].inferred_datatype, p["hq_country"].uniqueness, p["hq_country"].entity_like) == ("string", 0.625, True)
    assert p["homepage_url"].shape == "url" and p["established"].inferred_datatype == "integer"
    assert p["vendor"].samples[0] == "Acme Industrial Group" and len(p["vendor"].samples) == 5


def test_catalog_survives_nesting(first):
    again = C.flatten(C.nest(first.catalog))
    assert again.attributes.count() == first.catalog.attributes.count() and again.types.count() == 7


@pytest.mark.parametrize("name", ["profile_customer", "profile_samples", "split_names", "score_margin", "escalation_budget", "merge_aliases", "canonical_types", "gates_fired", "answers_resolved", "validate_ops", "project_rows", "mapping_counters"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("customer", "orders", "part", "lineitem", "supplier", "nation"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = ", ".join(f'"{c}"' for c in got.columns)
    plain = lambda rows: sorted(repr(tuple(float(v) if type(v).__name__ in ("Decimal", "float") else v for v in r)) for r in rows)
    assert plain(got.collect()) == plain(con.sql(f"select {cols} from ({queries.ORACLE[name]})").fetchall())
