"""Files in, files out, and the rows of the first table as linked entities."""

import glob
import json

import pytest

from mapforge.plans import report, run
from mapforge.sources.example import CATALOG, TABLES


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    (at / "ontology.json").write_text(CATALOG)
    (at / "answers.json").write_text(json.dumps({"csv1.q1": "new:employee_count"}))
    paths = []
    for name, text in TABLES.items():
        (at / name).write_text(text)
        paths.append(f"file://{at}/{name}")
    return run.run(spark, f"file://{at}/ontology.json", paths, f"file://{at}/out", f"file://{at}/answers.json"), str(at / "out")


def written(out, name):
    return "\n".join(open(p).read() for p in glob.glob(f"{out}/{name}/part-*"))


def test_rows_as_entities(done):
    rows = {r.row: r for r in report.sample_rows(done[0][0]).collect()}
    assert sorted(rows) == [1, 2, 3]
    subject, place = rows[1].entities
    assert subject.asDict() == {
        "id": "Organization:1", "type": "Organization",
        "attributes": {"name": "Acme Industrial Group", "website": "https://acmeindustrial.com", "founded_year": "1987", "industry": "Manufacturing", "employee_count": "540"},
        "relationships": {"headquartered_in": "Place:Cleveland|USA"},
    }
    assert place.asDict() == {"id": "Place:Cleveland|USA", "type": "Place", "attributes": {"city": "Cleveland", "country": "USA"}, "relationships": {}}
    assert rows[2].entities[1].id == "Place:Hamburg|Germany" and not rows[1].skipped


def test_left_out(done):
    last = {r.row: r for r in report.sample_rows(done[0][2]).collect()}
    assert {s.column: s.reason for s in last[1].skipped}.items() >= {"_id": "excluded: surrogate_key", "updated_at": "excluded: sync_metadata", "Unnamed: 8": "excluded: empty_column"}.items()


def test_files(done):
    runs, out = done
    one = json.loads(written(out, "1_vendors.report.json"))
    assert one["row_count"] == 8 and one["stats"] == {"reused": 6, "new": 1, "excluded": 0, "escalated": 1}
    assert [c["column"] for c in one["columns"]] == TABLES["1_vendors.csv"].split("\n")[0].split(",")
    assert one["escalations"][0]["source"] == "file" and one["escalations"][0]["answer"] == "new:employee_count"
    assert one["sample_rows"][0]["entities"][0]["id"] == "Organization:1"
    assert one["escalations"][0]["why"] and json.loads(one["escalations"][0]["context"])["candidates"]
    told = written(out, "1_vendors.transcript.txt").splitlines()
    assert told[0].startswith("== 1_vendors.csv: Organization") and any(x.startswith("question csv1.q1: ") for x in told) and told[-1].startswith("reused=6")
    ops = json.loads(written(out, "1_vendors.patch.json"))
    assert [o["op"] for o in ops].count("flag_ontology_issue") == 3 and {"op": "add_attribute", "on_type": "Organization", "name": "employee_count"}.items() <= ops[-1].items()
    assert written(out, "3_crm_export.report.md").startswith("# Mapping report — 3_crm_export.csv")
    types = json.loads(written(out, "final_ontology.json"))["types"]
    assert "employee_count" in [a["name"] for a in types[0]["attributes"]]
    assert json.loads(written(out, "run_summary.json"))["totals"]["columns"] == 23
