from tests.llm.test_mixing_simhash import docs_of
from tidegraph.llm import licenses


def test_long_expressions_are_read_whole(spark):
    many = " AND ".join(["(Apache-2.0 OR MIT)"] * 100)
    found = licenses.summary(licenses.Scanner().scan(f"é\nLicense: {many} AND GPL-2.0\nAND ISC"))
    assert found["labels"] == "apache,copyleft,gpl,mit"
    rows = [(1, f"License: {many}\n", "a"), (2, "License: " + "(" * 2000 + "MIT" + ")" * 2000, "a"), (3, "License: MIT" + " " * 3000 + "OR ISC", "a"), (4, f"License: {many} AND\n GPL-2.0", "a")]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs_of(spark, rows)).collect()}
    assert got == {1: "apache,mit,permissive", 2: "mit,permissive", 3: "isc,mit,permissive", 4: ""}
