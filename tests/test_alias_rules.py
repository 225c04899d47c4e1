"""Names against a table of rules."""

from oligo_engine.operators import curation


def test_rules_of_a_table_meet_names_by_their_parts(spark):
    rules = [(3, "dye", "d"), (1, "dye 12", "x"), (2, "ye 1", None), (9, "", "e"), (0, None, "n"), (4, "blue’", "b"), (1, "dye 12", "w")]
    names = ["Dye 12 cap", "Dye 1", "a dye", "nothing", None, " ", "0", "u", "BLUE", "Dye 1"]
    table = spark.createDataFrame(rules, "rule_no long, match string, symbol string")
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    mapped = curation.map_names(rows, "name", table)
    got = dict(mapped.select("id", "symbol").collect())
    assert got == {0: "w", 1: None, 2: "d", 3: "e", 4: "", 5: "", 6: "", 7: "", 8: "e", 9: None}
    assert mapped.columns == ["id", "name", "symbol"]
    # no array of all rules beside every name
    assert "sort_array" not in mapped._jdf.queryExecution().toString()
